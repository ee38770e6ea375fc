"""Sources and sinks: files to pages, tables of the store, keyed reads."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import posixpath
import re
import tempfile
import uuid
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.config import DEFAULT, Config
from inkwell.functions import text as X
from inkwell.operators.draft import OcrEngine


#: Bytes of a batch of rows that goes to a Python worker, where the session does not say.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let batches for Python workers be small, whatever the length of texts; a session's own bound stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


#: Rows of a task, about.
ROWS_OF_A_TASK = 50_000


def parts_of(table: DataFrame, least: int, rows: int = ROWS_OF_A_TASK) -> int:
    """Parts of ``least`` or, of a table of many rows, so many that a task does not grow with it."""
    return max(least, -(-table.count() // rows))


def spread(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` made from a table, dealt over all cores if the table is so small that it is read in fewer
    parts than there are cores, in more parts where it has many rows; larger inputs stay as they lie. For
    costly work on each row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parts_of(table, cores)) if table.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all
    runs in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/inkwell-shared"
    return base.rstrip("/")


def drop_folder(spark: SparkSession, folder: str, now: bool = True) -> None:
    """Delete a folder, at once or when the driver ends; nothing if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if now:
        files.delete(at, True)
    else:
        files.deleteOnExit(at)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def lean(spark: SparkSession):
    """Let the shuffle files of what is written inside go as soon as it is written."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def settled(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to the shared folder and read from there: what is used twice is done once, and a lost
    executor takes nothing away. It goes when the driver ends."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/inkwell-{label}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    drop_folder(spark, folder, now=False)
    return spark.read.schema(rows.schema).parquet(folder)


def files(spark: SparkSession, path: str, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Files of a folder by the allow-list of extensions and the largest size: those to read, and the
    rejected ones with the reason."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = lambda rows: rows.withColumns({"filename": F.element_at(F.split("path", "/"), -1), "extension": F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)), "doc_id": F.sha2(F.col("path"), 256)})
    found = named(read)
    allowed, fits = F.col("extension").isin(*config.extensions), F.col("length") <= config.max_file_mb * 1024 * 1024
    why = F.when(~allowed, F.concat(F.lit("Unsupported file type: "), "extension")).otherwise(F.format_string("File is larger than %d MB", F.lit(config.max_file_mb)))
    rejected = found.where(~(allowed & fits)).select("doc_id", "filename", "extension", why.alias("error"))
    listed = [re.sub(r"^([\w+.-]+):///", r"\1:/", unquote(name)) for name in read.inputFiles()]
    if len(listed) != read.count():  # a scan passes files of no bytes over
        empty = spark.createDataFrame([(name,) for name in listed], "path string").join(read.select("path"), "path", "left_anti")
        rejected = rejected.unionByName(named(empty).select("doc_id", "filename", "extension", F.lit(EMPTY_FILE).alias("error")))
    return found.where(allowed & fits), rejected


#: Fixed value: the error of a file without bytes.
EMPTY_FILE = "File is empty"


def cell_text(c):
    """A cell as stripped text, null as empty."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


#: Fixed value: the warning on a sheet without text.
EMPTY_SHEET = "Sheet '%s' is empty"


def sheet_pages(rows: DataFrame, doc_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages from sheet rows (doc, sheet, row_no, cells): all-empty rows go; the text is the title and
    a line for each row. A sheet without rows (null cells) is a page of its title, with a warning."""
    if "error" in rows.columns and "error" not in keep:
        rows = rows.where("error is null")
    cells = F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    rows = rows.withColumn("cells", cells).withColumn("_full", F.exists("cells", lambda c: c != ""))
    line = F.array_join(F.filter("cells", lambda c: c != ""), " | ")
    one = F.array_sort(F.collect_list(F.when(F.col("_full"), F.struct("row_no", line.alias("line"), "cells"))))
    pages = rows.groupBy(doc_col, *keep, "sheet").agg(one.alias("r"))
    title = F.concat(F.lit("Sheet: "), F.col("sheet"))
    some = F.size("r") > 0
    text = F.when(some, F.concat(title, F.lit("\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"))).otherwise(title)
    tables = F.when(some, F.array(F.transform("r", lambda x: x["cells"]))).otherwise(F.array().cast("array<array<array<string>>>"))
    notes = F.when(some, F.array().cast("array<string>")).otherwise(F.array(F.format_string(EMPTY_SHEET, "sheet")))
    return pages.select(doc_col, *keep, "sheet", text.alias("raw_text"), tables.alias("tables"), some.alias("has_tables"), F.lit(1.0).alias("confidence"), F.lit("native_text").alias("extraction_method"), notes.alias("warnings"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


_OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the standard that are dates or times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether its number format is a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'\[[^\]]*\]|"[^"]*"|\\.', "", f.get("formatCode", "")) for f in root.iterfind("m:numFmts/m:numFmt", _NS)}
    kinds = [int(x.get("numFmtId", "0")) for x in root.iterfind("m:cellXfs/m:xf", _NS)]
    return [k in _DATE_FORMATS or bool(re.search("[dmyhs]", own.get(k, ""), re.I)) for k in kinds]


def _number(text: str, date: bool, first_day: dt.datetime) -> str:
    """A number cell as text: dates from their serial, whole numbers without a fraction."""
    value = float(text)
    if date:
        if 0 <= value < 1:
            return str((first_day + dt.timedelta(seconds=round(value * 86400))).time())
        return str(first_day + dt.timedelta(days=int(value), seconds=round(value % 1 * 86400)))
    return str(int(value)) if value.is_integer() and not re.search("[.eE]", text) else str(value)


def read_workbook(content: bytes) -> list[tuple[int, str, list[list[str]]]]:
    """Sheets of an XLSX file in order: number, title, rows of cell texts; standard library only.

    The parts of sheets are those that the workbook's relationships name. Booleans read True or False,
    cells of a date format as date and time.
    """
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))
    shared = [text_of(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    options = root.find("m:workbookPr", _NS)
    mac = options is not None and options.get("date1904", "0") in ("1", "true")
    first_day = dt.datetime(1904, 1, 1) if mac else dt.datetime(1899, 12, 30)
    dates = _date_styles(book)
    parts = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            parts[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")

    def cell(c) -> str:
        kind, value = c.get("t"), c.find("m:v", _NS)
        if kind == "inlineStr":
            return text_of(c)
        text = "" if value is None else value.text or ""
        if not text:
            return ""
        if kind == "s":
            return shared[int(text)]
        if kind == "b":
            return "True" if text == "1" else "False"
        style = int(c.get("s", "0"))
        return _number(text, style < len(dates) and dates[style], first_day) if kind in (None, "n") else text

    out = []
    for k, sheet in enumerate(root.find("m:sheets", _NS), 1):
        path = parts.get(sheet.get(_OFFICE), f"xl/worksheets/sheet{k}.xml")
        rows = []
        for row in ElementTree.fromstring(book.read(path)).iter(f"{{{_NS['m']}}}row") if path in names else ():
            cells: dict[int, str] = {}
            for c in row.findall("m:c", _NS):
                at = 0
                for ch in re.match("[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(ch) - 64
                cells[at or max(cells, default=0) + 1] = cell(c).strip()
            rows.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
        out.append((k, sheet.get("name"), rows))
    return out


#: Why a file that was let in gave no pages.
UNREADABLE = "File cannot be read: %s"
NO_PAGES = "File has no pages"
NO_EXTRACTOR = "No extractor for PDF files"
NOT_RECOGNISED = "Text recognition failed: %s"


def _why(error: Exception) -> str:
    return UNREADABLE % (str(error).strip("'") or type(error).__name__)


def workbook_rows(found: DataFrame) -> DataFrame:
    """(doc_id, filename, page_number, sheet, row_no, cells, error) of XLSX files; a sheet without rows gives
    one of null cells, a file that is unreadable or has no sheets one with the error."""

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                try:
                    sheets = read_workbook(bytes(r.content))
                except Exception as why:  # whatever a broken file makes the parser raise is the file's error
                    out.append((r.doc_id, r.filename, None, None, None, None, _why(why)))
                    continue
                if not sheets:
                    out.append((r.doc_id, r.filename, None, None, None, None, NO_PAGES))
                out += [(r.doc_id, r.filename, k, title, n, cells, None) for k, title, rows in sheets for n, cells in enumerate(rows or [None], 1)]
            yield pd.DataFrame(out, columns=["doc_id", "filename", "page_number", "sheet", "row_no", "cells", "error"]).astype({"page_number": "Int32", "row_no": "Int32"})

    return found.where("extension = '.xlsx'").select("doc_id", "filename", "content").mapInPandas(run, "doc_id string, filename string, page_number int, sheet string, row_no int, cells array<string>, error string")


def image_pages(found: DataFrame, engine: OcrEngine | None = None) -> DataFrame:
    """One page for each image file, as the engine reads it (without one: empty, confidence 0); where the
    engine fails, a row with the error."""
    reader = engine or OcrEngine()

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                try:
                    out.append((r.doc_id, r.filename, 1, *reader.read(bytes(r.content)), "ocr_image", None))
                except Exception as why:  # as above, of the engine
                    out.append((r.doc_id, r.filename, None, None, None, "ocr_image", _why(why)))
            yield pd.DataFrame(out, columns=["doc_id", "filename", "page_number", "raw_text", "confidence", "extraction_method", "error"]).astype({"page_number": "Int32"})

    return found.where(~F.col("extension").isin(".xlsx", ".pdf")).select("doc_id", "filename", "content").mapInPandas(run, "doc_id string, filename string, page_number int, raw_text string, confidence double, extraction_method string, error string")


def pdf_pages(found: DataFrame, extractor=None, engine: OcrEngine | None = None) -> DataFrame:
    """Pages of PDF files; ``extractor(content)`` gives (native text, tables, image bytes or None) for
    each page. A page of too little native text is read by the text recognition from its image; if that
    fails, the page stays empty, with a warning. A file that the extractor fails on, that has no pages, or
    for which there is no extractor is a row with the error. No PDF library is bundled."""
    reader = engine or OcrEngine()
    files_ = found.where("extension = '.pdf'").select("doc_id", "filename", "content")
    if extractor is None:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("page_number", "int"), ("raw_text", "string"), ("confidence", "double"))]
        return files_.select("doc_id", "filename", *nothing, F.lit("native_text").alias("extraction_method"), F.lit(NO_EXTRACTOR).alias("error"))

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                try:
                    pages = list(extractor(bytes(r.content)))
                except Exception as why:  # as above, of the extractor
                    out.append((r.doc_id, r.filename, None, None, None, None, _why(why)))
                    continue
                out += [(r.doc_id, r.filename, n, text, tables, image, None) for n, (text, tables, image) in enumerate(pages, 1)]
                if not pages:
                    out.append((r.doc_id, r.filename, None, None, None, None, NO_PAGES))
            yield pd.DataFrame(out, columns=["doc_id", "filename", "page_number", "raw_text", "tables", "image", "error"]).astype({"page_number": "Int32"})

    def recognise(batches):
        for frame in batches:
            texts, confidences, warnings = [], [], []
            for scanned, image, text in zip(frame["scanned"], frame["image"], frame["raw_text"], strict=True):
                confidence, noted = None, []
                if scanned:
                    text, confidence = "", 0.0
                    try:
                        if image is not None:
                            text, confidence = reader.read(bytes(image))
                    except Exception as why:  # as above, of the engine
                        noted = [NOT_RECOGNISED % str(why)]
                texts.append(text)
                confidences.append(confidence)
                warnings.append(noted)
            yield frame.assign(raw_text=texts, confidence=confidences, warnings=warnings, page_number=frame["page_number"].astype("Int32")).drop(columns="image")

    kind = "doc_id string, filename string, page_number int, raw_text string, tables array<array<array<string>>>"
    pages = files_.mapInPandas(run, f"{kind}, image binary, error string")
    scanned = F.col("error").isNull() & X.is_scanned(F.col("raw_text"))
    pages = pages.withColumn("scanned", F.coalesce(scanned, F.col("error").isNull())).mapInPandas(recognise, f"{kind}, error string, scanned boolean, confidence double, warnings array<string>")
    return pages.withColumn("extraction_method", F.when(F.col("scanned"), "ocr_scan").otherwise("native_text")).drop("scanned")


def html_text(html):
    """Visible text of a web page; an addition to the file formats."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


class Store:
    """Append-only tables in a folder: the latest row of a key counts, a tombstone deletes it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, table: str, rows: DataFrame, partition: str | None = None) -> None:
        out = rows.write.mode("append")
        (out.partitionBy(partition) if partition else out).parquet(f"{self.folder}/{table}")

    def replace(self, part: str, rows: DataFrame) -> None:
        """Write a part of a table, table/column=value, in place of what it had."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part}")

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        files, at = self._at(path)
        return files.exists(at)

    def partitions(self, table: str, column: str) -> list[str]:
        """Values that a table has folders for."""
        files, at = self._at(table)
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))

    def load(self, table: str, schema: str | T.StructType) -> DataFrame:
        """All rows; none if nothing was ever written."""
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")

    def compact(self, table: str, schema: str | T.StructType, key: str, version: str, deleted: str | None = None) -> None:
        """Rewrite a table with the last version of each key only. The new rows are written whole beside the
        old ones before they take their place."""
        path = f"{self.folder}/{table}"
        latest(self.load(table, schema), key, version, deleted).write.mode("overwrite").parquet(f"{path}.new")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        files = old.getFileSystem(conf)
        files.delete(old, True)
        files.rename(new, old)

    def drop_partition(self, table: str, column: str, value: str) -> None:
        drop_folder(self.spark, f"{self.folder}/{table}/{column}={value}")


def latest(log: DataFrame, key: str, version: str, deleted: str | None = None) -> DataFrame:
    """The last version of each key, without deleted ones."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    rows = log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows if deleted is None else rows.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def in_order_of(ids: DataFrame, rows: DataFrame, ids_col: str, key: str) -> DataFrame:
    """Rows of a list of keys, in its order; keys without a row drop out."""
    listed = ids.select(*[c for c in ids.columns if c != ids_col], F.posexplode(ids_col).alias("pos", key))
    asked = listed.select(key).distinct()  # combined in each task, so that a key that many ask for does not meet in one
    return listed.join(settled(rows.join(asked, key, "left_semi"), "asked"), key)  # written, so that Spark knows whether it is small


def observed(docs: DataFrame, name: str = "doc_metrics") -> DataFrame:
    """Counts of what passes, for the query's listener; no further pass over the rows."""
    return docs.observe(name, F.count(F.lit(1)).alias("documents"), F.avg("avg_confidence").alias("avg_confidence"), F.avg("quality_score").alias("avg_quality"))


def document_measures() -> list:
    """What is measured of documents as they are written."""
    return [
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("total_pages"), F.lit(0)).cast("long").alias("pages"), F.count_if(~F.col("is_usable")).alias("unusable"),
        F.round(F.avg("avg_confidence"), 6).alias("avg_confidence"), F.round(F.avg("quality_score"), 6).alias("avg_quality"), F.sum(F.size("warnings")).cast("long").alias("warnings"),
    ]


METRICS = "documents bigint, pages bigint, unusable bigint, avg_confidence double, avg_quality double, warnings bigint"


class Metrics:
    """Measures that are taken while rows are written, without a pass over them, and kept in ``metrics``: a part
    of the table for each thing measured, which is replaced when that is written again."""

    def __init__(self, store: Store):
        self.store = store

    def written(self, rows: DataFrame, write, of: str, measures: list, schema: str) -> None:
        """Have ``write`` write rows, and then a row of what was seen of them."""
        seen = Observation()
        write(rows.observe(seen, *measures))
        row = tuple(seen.get[c.split()[0]] for c in schema.split(", "))
        self.store.replace(f"metrics/of={of}", self.store.spark.createDataFrame([row], schema).coalesce(1))

    def rows(self, schema: str = METRICS) -> DataFrame:
        return self.store.load("metrics", f"{schema}, of string")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
