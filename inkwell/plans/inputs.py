"""Inputs of the named queries that are derived from the driver's tables by one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.sources.readers import bound_batches, parquet, spread

LEGAL = """
SELECT o_orderkey AS doc_id,
  CASE o_orderkey % 5
    WHEN 0 THEN 'LEASE AGREEMENT between ' || c_mktsegment || ' HOLDINGS and Mary Major, landlord and tenant.\n\nThe monthly rent is $' || price || ' from ' || day || ' on. Premises: ' || (o_custkey % 900 + 10) || ' Oak Street Suite ' || (o_orderkey % 90 + 1) || ', Springfield, IL 62704. The security deposit is USD 1,200.50 in total.'
    WHEN 1 THEN 'SUPERIOR COURT OF ' || n_name || '. Case No. 24-CV-' || (o_orderkey % 9000 + 1000) || '.\nPlaintiff: ' || c_mktsegment || ' COMPANY\nDefendant: Richard Roe, an individual\nComplaint filed ' || day || '. The defendant owes ' || price || ' dollars. Docket No: DK-' || o_custkey
    WHEN 2 THEN 'NOTICE OF DEFAULT. You are hereby notified pursuant to law that by ' || (o_orderkey % 27 + 1) || ' March 2024 you must pay $' || price || ' within days. Tenant: John Doe of the notice. Reference ' || day || ' and March 3, 2024.'
    WHEN 3 THEN 'WARRANTY DEED. Grantor: ' || c_mktsegment || ' TRUST. Grantee: Jane Roe. Title to the parcel and lot number ' || (o_orderkey % 500) || ' at ' || (o_custkey % 900 + 10) || ' Elm Avenue passes on ' || day || ', free of any lien or easement.'
    ELSE 'Dear ' || c_mktsegment || ' team,\n\nPlease find enclosed order ' || o_orderkey || ' of ' || day || '. We are writing in response to your letter.\n\nSincerely yours'
  END AS text
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS STRING) AS price
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) AS o
"""

#: Every rule of the cleaner has something to do here.
NOISY = """
SELECT doc_id, '=====\n' || replace(replace(replace(replace(replace(text,
    ' und ', ' l und  ( x ) '), ' the ', ' “the” — '), '. ', ' .\n\n\n\n'), ' de ', '-\nde 0 '), ' la ', ' la- La ,')
    || '\n\x01 control line\na | tail… é – l' AS text
FROM documents
"""

#: The pages of one document are fifty documents at most, so a document is bounded at any scale.
PAGES = "SELECT CAST(floor(doc_id / 50) AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY floor(doc_id / 50) ORDER BY doc_id) AS INT) AS page_number, text AS cleaned_text, doc_id AS row_id FROM documents"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SQL text over the tables it names."""
    bound_batches(spark)
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def legal_docs(spark, sf_dir):
    return spread(sql(spark, sf_dir, LEGAL), parquet(spark, sf_dir, "orders"))


def noisy_docs(spark, sf_dir):
    return spread(sql(spark, sf_dir, NOISY), parquet(spark, sf_dir, "documents"))


def documents(spark, sf_dir):
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs, docs)


def source_pages(spark, sf_dir):
    return sql(spark, sf_dir, PAGES)
