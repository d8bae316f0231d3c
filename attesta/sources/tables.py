"""Sources that replay recorded tables, and sinks: JSON, CSV, nested, flat and wide forms."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def cut(rows: DataFrame) -> DataFrame:
    """rows, computed once and written to the folder that the session names for checkpoints, so that plans which use them several times don't
    compute them anew and lost executors find them. A local session without such a folder gets one; on a cluster without one rows stay a plan."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            return rows
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="attesta-"))
    return rows.checkpoint()


SEARCH_RESULT = "query string, provider string, rank int, url string, title string, snippet string"
FETCHED = "source_url string, final_url string, http_status int, content_type string, content string"


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Recorded results of search providers (JSON lines); the network is never reached from a query."""
    return spark.read.schema(SEARCH_RESULT).json(path)


def fetched_documents(spark: SparkSession, path: str) -> DataFrame:
    """Recorded fetches with their status and kind of document."""
    rows = spark.read.schema(FETCHED).parquet(path)
    return rows.withColumn("fetch_status", fetch_status()).withColumn("document_type", document_type())


def fetch_status():  # noqa: ANN201
    s = F.col("http_status")
    return F.when(s == 404, "not_found").when(s.isin(401, 402, 403, 429), "blocked").when(s >= 400, "error").when(F.coalesce("content", F.lit("")) == "", "empty").otherwise("success")


def document_type():  # noqa: ANN201
    kind, head = F.lower(F.coalesce("content_type", F.lit(""))), F.lower(F.substring(F.ltrim("content"), 1, 200))
    return F.when(kind.contains("pdf") | head.startswith("%pdf") | F.lower(F.col("final_url")).endswith(".pdf"), "pdf").when(kind.contains("html") | head.contains("<html") | head.startswith("<!doctype html"), "html").when(kind.startswith("text/"), "text").otherwise("unknown")


def unique_or_fail(rows: DataFrame, key: str) -> DataFrame:
    """rows, whose read fails if a key is missing or repeated: the check is part of the plan, on aggregated keys."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    checked = n.select(key, F.when((F.col("_n") > 1) | F.col(key).isNull(), F.raise_error(F.concat(F.lit("missing or repeated key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(0)).alias("_ok"))
    return rows.join(checked, key).filter("_ok is null or _ok = 0").drop("_ok")


def evidence_rows(profile: DataFrame) -> DataFrame:
    """One row for each evidence of (entity, attribute, status, supporting, conflicting: arrays of url); one without url if there is none."""
    tag = lambda c, role: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda u: F.struct(F.lit(role).alias("role"), u.alias("url")))
    return profile.select("entity", "attribute", "status", F.explode_outer(F.concat(tag("supporting", "supporting"), tag("conflicting", "conflicting"))).alias("e")).select("entity", "attribute", "status", "e.role", "e.url")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def upsert(table: DataFrame, new: DataFrame, key: str, time: str) -> DataFrame:
    """Last writer wins: of each key the row with the latest time, new before old on ties."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, "_new")).alias("_r")).select(key, "_r.*").select(*table.columns)
