"""Scans with declared schemas, file manifests, event validation, job log, chunks, sinks and the annotation hook."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ferrule.plans.registry import operator, query
from ferrule.sources.shared import shared_dir
from ferrule.sources.views import TABLES, view

MAX_BYTES = 50 * 1024 * 1024
JOB_COLUMNS = S.StructType([
    S.StructField("o_orderkey", S.LongType()), S.StructField("o_custkey", S.LongType()), S.StructField("o_orderstatus", S.StringType()),
    S.StructField("o_totalprice", S.DoubleType()), S.StructField("o_note", S.StringType()),
])


def scan(spark: SparkSession, folder: str, name: str, schema: S.StructType) -> DataFrame:
    """A table under its declared schema: only its columns are read, ones that the files lack are null."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


@query("scan_tables", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS o_note FROM orders")
def scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders", JOB_COLUMNS)


@operator("file_manifest", ["manifest"], f"""SELECT path, kind, kind IS NOT NULL AND length > 0 AND length <= {MAX_BYTES} AS is_valid, CASE WHEN kind IS NULL THEN 'unsupported' WHEN length = 0 THEN 'empty' WHEN length > {MAX_BYTES} THEN 'too_large' END AS reject_reason
    FROM (SELECT *, CASE WHEN lower(path) LIKE '%.pdf' THEN 'PDF' WHEN lower(path) LIKE '%.docx' THEN 'DOCX' WHEN lower(path) LIKE '%.pptx' THEN 'PPTX' END AS kind FROM manifest)""")
def file_manifest(files: DataFrame) -> DataFrame:
    """Kind by extension, and why a file is turned away. Over files: read with binaryFile and select path and length only."""
    p = F.lower("path")
    kind = F.when(p.endswith(".pdf"), "PDF").when(p.endswith(".docx"), "DOCX").when(p.endswith(".pptx"), "PPTX")
    reason = F.when(kind.isNull(), "unsupported").when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "too_large")
    return files.select("path", kind.alias("kind"), reason.isNull().alias("is_valid"), reason.alias("reject_reason"))


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of every file under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


@operator("job_log", ["jobs"], """SELECT id, type, status, user_id, CASE WHEN status = 'failed' THEN NULL ELSE page_count END AS page_count, CASE WHEN status = 'failed' THEN NULL ELSE input_tokens END AS input_tokens, CASE WHEN status = 'failed' THEN substring(error_message, 1, 500) END AS error_message FROM jobs WHERE status IN ('completed', 'failed')""")
def job_log(results: DataFrame) -> DataFrame:
    """Rows to append for finished jobs: failed ones carry no pages and tokens, and at most 500 characters of their error."""
    failed = F.col("status") == "failed"
    return results.where(F.col("status").isin("completed", "failed")).select("id", "type", "status", "user_id", F.when(~failed, F.col("page_count")).alias("page_count"), F.when(~failed, F.col("input_tokens")).alias("input_tokens"), F.when(failed, F.substring("error_message", 1, 500)).alias("error_message"))


USAGE = "fileName string, fileType string, status string, score long, criticalCount long, warningCount long"


@operator("usage_event_ingest", ["usage_events_raw"], r"""WITH j AS (SELECT id, value, json_valid(value) AS ok, CASE WHEN json_valid(value) THEN value ELSE '{}' END AS v FROM usage_events_raw), p AS (SELECT id, ok, json_extract_string(v, '$.fileName') AS n, json_extract_string(v, '$.fileType') AS t, json_extract_string(v, '$.status') AS s,
      CAST(json_extract_string(v, '$.score') AS BIGINT) AS sc, CAST(json_extract_string(v, '$.criticalCount') AS BIGINT) AS cc, CAST(json_extract_string(v, '$.warningCount') AS BIGINT) AS wc, len(list_filter(json_keys(v), lambda k: k NOT IN ('fileName','fileType','status','score','criticalCount','warningCount'))) AS extra FROM j),
    r AS (SELECT *, CASE WHEN NOT ok THEN 'not_json' WHEN extra > 0 THEN 'unknown_key' WHEN n IS NULL OR length(n) NOT BETWEEN 1 AND 255 THEN 'file_name' WHEN t IS NULL OR t NOT IN ('PDF','DOCX','PPTX','UNKNOWN') THEN 'file_type' WHEN s IS NULL OR s NOT IN ('completed','failed') THEN 'status' WHEN sc NOT BETWEEN 0 AND 100 THEN 'score' WHEN cc < 0 OR wc < 0 THEN 'counts' END AS reject_reason FROM p)
    SELECT id, regexp_extract(n, '([^/]*)$', 1) AS file_name, t AS file_type, s AS status, sc AS score, cc AS critical_count, wc AS warning_count, reject_reason IS NULL AS is_valid, reject_reason FROM r""")
def usage_event_ingest(raw: DataFrame) -> DataFrame:
    """Checker events against their closed schema; rejected rows stay, with the reason."""
    p = raw.select("id", F.from_json("value", USAGE).alias("p"), F.json_object_keys("value").alias("keys"), F.col("value").rlike(r"^\s*\{").alias("json"))
    e = p.select("id", "p.*", "keys", "json")
    known = F.array(*[F.lit(x.split(" ")[0]) for x in USAGE.split(", ")])
    bad = lambda c: F.coalesce(c, F.lit(True))
    off = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(~F.col("json") | F.col("keys").isNull(), "not_json").when(F.size(F.array_except("keys", known)) > 0, "unknown_key")
        .when(bad(~F.length("fileName").between(1, 255)), "file_name").when(bad(~F.col("fileType").isin("PDF", "DOCX", "PPTX", "UNKNOWN")), "file_type")
        .when(bad(~F.col("status").isin("completed", "failed")), "status").when(off(~F.col("score").between(0, 100)), "score")
        .when(off(F.col("criticalCount") < 0) | off(F.col("warningCount") < 0), "counts"))
    return e.select("id", F.regexp_extract("fileName", r"([^/]*)$", 1).alias("file_name"), F.col("fileType").alias("file_type"), "status", "score", F.col("criticalCount").alias("critical_count"), F.col("warningCount").alias("warning_count"), reason.isNull().alias("is_valid"), reason.alias("reject_reason"))


@operator("visit_event_ingest", ["visits_raw"], r"""WITH r AS (SELECT *, string_split(path, '?')[1] AS p, CASE WHEN NOT regexp_full_match(visitor_id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'visitor_id' WHEN length(path) NOT BETWEEN 1 AND 500 THEN 'path' WHEN engaged_ms NOT BETWEEN 3000 AND 86400000 THEN 'engaged_ms' WHEN NOT interaction THEN 'interaction'
      WHEN regexp_matches(user_agent, 'HeadlessChrome|Playwright|Puppeteer|bot|crawler|spider', 'i') THEN 'automated' END AS bad FROM visits_raw)
    SELECT event_id, sha256(visitor_id || ':' || 'salt') AS visitor_id_hash, CAST(CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS visit_date, p AS first_path, coalesce(bad, CASE WHEN regexp_matches(p, '^(/kb)?/admin(/|$)') THEN 'admin' END) IS NULL AS is_valid, coalesce(bad, CASE WHEN regexp_matches(p, '^(/kb)?/admin(/|$)') THEN 'admin' END) AS reject_reason FROM r""")
def visit_event_ingest(raw: DataFrame, salt: str = "salt") -> DataFrame:
    """Visits that count as likely human: identity hashed, day in Los Angeles, path without query; others with the reason."""
    p = F.substring(F.split("path", r"\?").getItem(0), 1, 500)
    reason = (
        F.when(~F.col("visitor_id").rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "visitor_id").when(~F.length("path").between(1, 500), "path")
        .when(~F.col("engaged_ms").between(3000, 86_400_000), "engaged_ms").when(~F.col("interaction"), "interaction")
        .when(F.col("user_agent").rlike("(?i)HeadlessChrome|Playwright|Puppeteer|bot|crawler|spider"), "automated").when(p.rlike("^(/kb)?/admin(/|$)"), "admin"))
    day = F.to_date(F.from_utc_timestamp("ts", "America/Los_Angeles")).cast("string")
    return raw.select("event_id", F.sha2(F.concat("visitor_id", F.lit(":"), F.lit(salt)), 256).alias("visitor_id_hash"), day.alias("visit_date"), p.alias("first_path"), reason.isNull().alias("is_valid"), reason.alias("reject_reason"))


def chunked(text: Column, max_len: int) -> Column:
    """A text cut at the last paragraph end or line break before the limit, else at the limit; the rest is the last chunk."""
    piece = rf"(?s).{{1,{max_len}}}\z|.{{1,{max_len - 4}}}(?:</p>|<br>)|.{{1,{max_len}}}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(piece), F.lit(0))


@operator("text_chunks", ["documents"])
def text_chunks(documents: DataFrame, max_len: int = 6000) -> DataFrame:
    """doc_id, chunk_no, chunk: chunks joined in order give the text."""
    return documents.select("doc_id", F.posexplode(chunked(F.col("text"), max_len)).alias("chunk_no", "chunk"))


@operator("audit_texts", ["documents"], "SELECT doc_id, CASE WHEN length(text) > 14000 THEN substring(text, 1, 14000) || chr(10) || '...[document continues]' ELSE text END AS audit_text FROM documents")
def audit_texts(documents: DataFrame, limit: int = 14_000) -> DataFrame:
    """The text that an audit reads: the feature is its cut, which says that the document goes on."""
    cut = F.concat(F.substring("text", 1, limit), F.lit("\n...[document continues]"))
    return documents.select("doc_id", F.when(F.length("text") > limit, cut).otherwise(F.col("text")).alias("audit_text"))


@query("snapshot_export")
def snapshot_export(spark: SparkSession, sf_dir: str, path: str | None = None, date: str = "2024-01-31") -> DataFrame:
    """A dated copy of the tables under a path; table and row count of each. Without a path it goes to the shared folder.

    Tables are written to a folder of this run; a manifest that names the folder and the counts comes last, so that a run that ends half-way leaves
    no snapshot and a second one of a date replaces the first as a whole. ``read_snapshot`` reads what manifests name alone.
    """
    path = path or shared_dir(spark)
    folder, counts = f"{path}/snapshot-data/{date}-{uuid.uuid4().hex}", None
    for name in TABLES:
        target = f"{folder}/{name}"
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(target)
        n = spark.read.parquet(target).agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        counts = n if counts is None else counts.unionByName(n)
    manifest = counts.withColumn("folder", F.lit(folder)).withColumn("taken", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/snapshot/{date}")
    return manifest_of(spark, path, date).select("table", "rows")


def manifest_of(spark: SparkSession, path: str, date: str) -> DataFrame:
    """table, rows, folder and taken of a date's newest whole snapshot."""
    held = spark.read.parquet(f"{path}/snapshot/{date}")
    return held.join(held.agg(F.max_by("folder", F.struct("taken", "folder")).alias("folder")), "folder", "left_semi")


def read_snapshot(spark: SparkSession, path: str, date: str, name: str) -> DataFrame:
    """A table as the date's newest whole snapshot has it."""
    return spark.read.parquet(f"{manifest_of(spark, path, date).where(F.col('table') == name).first()['folder']}/{name}")


def annotate(df: DataFrame, fn: Callable[[list[str]], list[str]], column: str, batch: int = 4, attempts: int = 3, default: str = "", pause: float = 0.0) -> DataFrame:
    """Adds result and error: fn is called with up to ``batch`` texts. ConnectionError and TimeoutError are tried again; after that, or
    after another error, the rows get the default and the error's text."""
    schema = S.StructType([*df.schema.fields, S.StructField("result", S.StringType()), S.StructField("error", S.StringType())])

    def call(texts: list[str]) -> tuple[list[str], str | None]:
        error = None
        for n in range(attempts):
            try:
                return fn(texts), None
            except (ConnectionError, TimeoutError) as e:
                error = str(e)
                time.sleep(pause * random.random() * 2**n)
            except Exception as e:
                return [default] * len(texts), str(e)
        return [default] * len(texts), error

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            results, errors = [], []
            for i in range(0, len(pdf), batch):
                got, error = call(pdf[column].iloc[i : i + batch].tolist())
                results += got
                errors += [error] * len(got)
            yield pdf.assign(result=results, error=errors)

    return df.mapInPandas(run, schema)


def length_label(texts: list[str]) -> list[str]:
    return [f"{len(t or '')} characters" for t in texts]


@query("annotate_hook", "SELECT doc_id, source, text, length(coalesce(text, '')) || ' characters' AS result, CAST(NULL AS VARCHAR) AS error FROM documents")
def annotate_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(view(spark, sf_dir, "documents").select("doc_id", "source", "text"), length_label, "text")


