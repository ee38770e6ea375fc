"""Spark schemas of the engine's tables, and the closed sets of their enumerated columns."""

from __future__ import annotations

#: Fixed values.
DOCUMENT_TYPES = ("lease_agreement", "court_filing", "legal_notice", "internal_memo", "contract", "title_document", "correspondence", "unknown")
EXTRACTION_METHODS = ("native_text", "ocr_scan", "ocr_image", "multimodal_llm", "hybrid")
DRAFT_TYPES = ("title_review_summary", "case_fact_summary", "notice_related_summary", "document_checklist", "internal_memo")
RULE_CATEGORIES = ("structure", "tone", "completeness", "citation_style", "formatting", "analysis", "other")
RULE_STATUSES = ("active", "disabled")
JOB_STATUSES = ("pending", "processing", "completed", "failed")
ENTITY_TYPES = ("date", "amount", "case_number", "party", "address")
WARNING_CODES = ("LOW_OVERALL_CONFIDENCE", "UNKNOWN_DOC_TYPE", "PAGE_WARNING", "NO_TEXT_EXTRACTED")

PAGES = "doc_id string, page_number int, raw_text string, cleaned_text string, confidence double, extraction_method string, word_count int, has_tables boolean, tables array<array<array<string>>>, warnings array<string>"
ENTITIES = "doc_id string, ord int, entity_type string, value string, normalized string, page int, confidence double"
CHUNK_META = "struct<word_count:int,char_count:int,chunk_method:string,chunk_kind:string,page_span:int,table_index:int,table_row_start:int,table_row_end:int,table_row_count:int,table_column_count:int,header_included:boolean>"
CHUNKS = f"chunk_id string, doc_id string, text string, page_start int, page_end int, char_start int, char_end int, chunk_index int, metadata {CHUNK_META}"
DOCUMENTS = "doc_id string, filename string, file_type string, file_size_bytes bigint, processed_at timestamp, doc_type string, doc_type_confidence double, extraction_method string, total_pages int, avg_confidence double, low_confidence_pages array<int>, full_text string, warnings array<struct<code:string,message:string,page:int>>, is_usable boolean, quality_score double"
SESSIONS = "session_id string, user_id string, created_at timestamp"
SESSION_DOCUMENTS = "session_id string, doc_id string, pos bigint"
EVIDENCE = "array<struct<doc_id:string,filename:string,chunk_id:string,page_start:int,page_end:int,snippet:string>>"
DRAFT_RUNS = f"draft_id string, user_id string, session_id string, draft_type string, instructions string, retrieval_query string, draft string, evidence {EVIDENCE}, applied_rule_ids array<string>, generated_at timestamp"
CANDIDATE = "struct<description:string,category:string,example_before:string,example_after:string,applicable_draft_types:array<string>,confidence:double>"
DIFF = "array<struct<operation:string,before:string,after:string>>"
FEEDBACK = f"feedback_id string, draft_id string, user_id string, draft_type string, original_draft string, edited_draft string, operator_notes string, retrieval_query string, status string, structured_diff {DIFF}, extracted_rule_ids array<string>, error_message string, submitted_at timestamp, processed_at timestamp"
RULES = "rule_id string, user_id string, description string, category string, example_before string, example_after string, applicable_draft_types array<string>, confidence double, support_count int, decay_count int, normalized_key string, status string, last_updated timestamp, insert_seq bigint"
JOBS = f"feedback_id string, user_id string, status string, candidates array<{CANDIDATE}>, error_message string, at timestamp, draft_type string, submitted_at timestamp, applied_rule_ids array<string>"
RULE_CONTROLS = "user_id string, rule_id string, action string, submitted_at timestamp, event_id string"
TEXT_CHUNKS = "chunk_id string, doc_id string, text string, page_start int, page_end int, char_start int, char_end int, chunk_index int"
RAW_PAGES = "doc_id string, filename string, page_number int, raw_text string, confidence double, extraction_method string, has_tables boolean, tables array<array<array<string>>>, warnings array<string>, error string"
ANSWERS = "doc_id string, page_number int, raw_text string, confidence double, warnings array<string>"
