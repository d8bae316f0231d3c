"""The workflow as one plan: results of a search become candidates, fetched pages, facts, normalized and mapped attributes, and a resolved profile.

Services are functions between tables, so any step can be replaced; a repository is a table of results under keys."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions.concepts import Concept
from ..operators import concepts as O
from ..operators import discovery as D
from ..operators import normalization as Z
from ..operators import relate as R
from ..operators import resolve as V
from ..sources import html as H
from ..sources import replay as P
from ..sources import tables as T
from ..streaming import state as S


class Budget:
    """Seconds that a run may take on the driver's clock; a batch asks before each product."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.clock, self.end = clock, clock() + seconds

    def remaining(self) -> float:
        return max(0.0, self.end - self.clock())

    def expired(self) -> bool:
        return self.remaining() == 0.0

    def share(self, most: float) -> float:
        """What a step may take: no more than is left."""
        return min(most, self.remaining())


@dataclass(frozen=True)
class Config:
    """How discovery runs: providers in order, results that are enough, candidates to fetch, circuit breaker."""

    providers: tuple[str, ...] = ("bing", "duckduckgo_html", "duckduckgo_lite", "naver", "seznam", "google")
    enough: int = 5
    fetch_limit: int = 5
    open_after: int = S.OPEN_AFTER
    cooldown: float = S.COOLDOWN
    most_cooldown: float = S.MOST_COOLDOWN

    def __post_init__(self) -> None:
        if self.fetch_limit < 1 or self.enough < 1 or self.open_after < 1 or not 0 < self.cooldown <= self.most_cooldown:
            raise ValueError("limits are positive, and a cooldown is not above the most")


SCOPES, LEVELS, PRIORITIES = ("universal", "category_specific", "discovered"), ("model_level", "variant_level", "market_level", "unknown"), ("critical", "high", "medium", "low")


@dataclass(frozen=True)
class Definition:
    """An attribute of a schema, checked when made; `schema_rows` turns definitions into the table that joins read."""

    canonical: str
    aliases: tuple[str, ...] = ()
    scope: str = "category_specific"
    level: str = "unknown"
    priority: str = "medium"
    expected: bool = True
    family: str = ""

    def __post_init__(self) -> None:
        if not self.canonical.strip() or self.scope not in SCOPES or self.level not in LEVELS or self.priority not in PRIORITIES:
            raise ValueError(f"no valid definition: {self.canonical!r}")


def schema_rows(spark: SparkSession, definitions: list[Definition]) -> DataFrame:
    """place, canonical, alias (a row for each different alias, the name among them), scope, level, priority, expected, family."""
    rows = [(k, d.canonical, a, d.scope, d.level, d.priority, d.expected, d.family) for k, d in enumerate(definitions) for a in dict.fromkeys((d.canonical.replace("_", " "), *d.aliases))]
    return spark.createDataFrame(rows, "place int, canonical string, alias string, scope string, level string, priority string, expected boolean, family string")


@dataclass(frozen=True)
class Services:
    """discover: requests -> results (entity, seq, url, title, source_type, authority, score); fetch: candidates -> documents (…, content, status);
    extract: pages (page_id, html, model) -> facts. Each may be any function of tables."""

    discover: Callable[[DataFrame], DataFrame]
    fetch: Callable[[DataFrame], DataFrame]
    extract: Callable[[DataFrame], DataFrame] = field(default=lambda pages: H.page_facts(pages, "model"))


def recorded(results: DataFrame, documents: DataFrame) -> Services:
    """Services that replay tables: results (query, url, title, ...) by the requests' queries, documents by URL."""
    return Services(lambda requests: requests.join(results, "query").drop("query"), lambda candidates: P.fetch_recorded(candidates, documents))


def select_candidates(requests: DataFrame, services: Services, limit: int) -> DataFrame:
    """entity, url, tier, place, model, source_type, authority, identity of the candidates to fetch for requests (entity, query, brand, model)."""
    found = services.discover(requests.select("entity", "query")).join(requests.select("entity", "model", F.lit(None).cast("string").alias("article"), F.col("query").alias("query")), "entity")
    judged = D.relevance(found)
    identity = F.when(F.col("relation") == "exact", "exact_variant").when(F.col("relation") == "likely_variant", "same_base_model").otherwise("unknown")
    judged = T.cut(judged.withColumn("identity", identity).withColumn("score", F.col("score").cast("int")))
    chosen = D.select_sources(judged.select("entity", "seq", "url", "score", "relation", "model_match", "identity", "authority", "source_type", "reason"), limit)
    return chosen.join(judged.select("entity", "url", "model", "source_type", "authority", "identity").dropDuplicates(["entity", "url"]), ["entity", "url"])


def product_profiles(requests: DataFrame, services: Services, concepts: list[Concept], expected: DataFrame | None = None, limit: int = 5, category: str = "") -> DataFrame:
    """The resolved profile of each request: entity, attribute, status, value, source, confidence, reason, n_support, n_conflict.

    requests: entity, query, brand, model. A request without results has rows only for what is expected of it."""
    pages = services.fetch(select_candidates(requests, services, limit)).filter("status = 'success'")
    pages = T.cut(pages.withColumn("page_id", F.xxhash64("entity", "url")).withColumnRenamed("content", "html"))  # what was fetched is not fetched again
    facts = services.extract(pages.select("page_id", "html", "model"))
    raw = facts.join(pages.select("page_id", "entity", F.col("url").alias("source_url"), "source_type", "authority", "identity", "model"), "page_id")
    raw = raw.withColumn("seq", F.xxhash64("page_id", "seq"))
    records = Z.without_template_blocks(Z.normalized_records(raw.select("entity", "seq", "label", "value", "method", "section", "source_url", "source_type", "model")))
    specs = records.filter("cls = 'SPEC'").select(
        "entity", F.col("seq").alias("id"), F.lit(category).alias("category"), "label", F.array().cast("array<string>").alias("aliases"), F.filter(F.split("section", r"\s*>\s*"), lambda p: p != "").alias("group_path"),
        "value", "kind", "unit", "boolean", "display", F.array().cast("array<string>").alias("alternates"), "method",
    )
    mapped = O.map_concepts(specs, concepts).filter("status = 'mapped'").withColumnRenamed("id", "seq")
    sources = raw.select("entity", "seq", "source_url", "source_type", "authority", "identity")
    family = {c.key: c.family for c in concepts}
    claims = mapped.join(sources, ["entity", "seq"]).select(
        "entity", F.col("key").alias("attribute"), "seq", "value", "unit", F.col("value").alias("raw_value"), F.concat_ws(" = ", "key", "value").alias("evidence"), "source_url", "source_type", "authority", F.lit("high").alias("confidence"), "identity",
        F.lit("success").alias("status"), R.case(F.col("key"), family, "").alias("family"),
    )
    return V.resolve(claims, expected)


class Repository:
    """Results under keys in Parquet, the latest of each key; a folder that a cluster shares. get, save, delete and clear work on whole tables of keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def available(self) -> bool:
        return self.spark.sparkContext._jvm is not None

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def get(self, keys: DataFrame, now: float, ttl: float) -> DataFrame:
        """The entry of each key (key) that is not older than ttl and not deleted."""
        last = R.last_of_each(self.rows().join(keys.select("key").distinct(), "key", "left_semi"), ["key"], ["at"])
        return last.filter((F.lit(now) - F.col("at") <= ttl) & F.col("value").isNotNull())

    def save(self, rows: DataFrame) -> None:
        """Append entries (key, value, at); the latest of a key counts, so a writer that runs again changes nothing."""
        rows.select("key", "value", "at").write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame, now: float) -> None:
        self.save(keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(now).alias("at")))

    def compact(self, path: str) -> None:
        """Write the latest entry of each key to a new folder, from which deleted keys are gone."""
        R.last_of_each(self.rows(), ["key"], ["at"]).filter("value is not null").select("key", "value", "at").write.parquet(path)


class Verifier:
    """verify: profiles of requests as JSON, from the repository where it has fresh ones, else by the workflow, whose results are saved."""

    def __init__(self, services: Services, repository: Repository, concepts: list[Concept], ttl: float = 86400.0, limit: int = 5):
        self.services, self.repository, self.concepts, self.ttl, self.limit = services, repository, concepts, ttl, limit

    def verify(self, requests: DataFrame, now: float, force: bool = False) -> DataFrame:
        """entity, profile (JSON), cached of requests (entity, query, brand, model)."""
        keyed = requests.withColumn("key", I.cache_key(brand=F.col("brand"), model=F.col("model")))
        held = self.repository.get(keyed, now, self.ttl if not force else -1.0).select("key", F.col("value").alias("held"))
        known = keyed.join(held, "key", "left")
        fresh = known.filter("held is null")
        profiles = product_profiles(fresh.select("entity", "query", "brand", "model"), self.services, self.concepts, limit=self.limit)
        rows = profiles.groupBy("entity").agg(F.to_json(F.array_sort(F.collect_list(F.struct("attribute", "status", "value", "confidence")))).alias("profile"))
        made = fresh.select("entity", "key").join(rows, "entity", "left").select("entity", "key", F.coalesce("profile", F.lit("[]")).alias("profile"))
        self.repository.save(made.select("key", F.col("profile").alias("value"), F.lit(float(now)).alias("at")))
        saved = self.repository.get(fresh, now, self.ttl).select("key", F.col("value").alias("made"))
        return known.join(saved, "key", "left").select("entity", F.coalesce("held", "made").alias("profile"), F.col("held").isNotNull().alias("cached"))


def verify_products(requests: DataFrame, services: Services, repository: Repository, concepts: list[Concept], now: float) -> DataFrame:
    return Verifier(services, repository, concepts).verify(requests, now)


def run_batch(requests: DataFrame, records: DataFrame, verifier: Verifier, now: float, retry: bool = False) -> DataFrame:
    """records (product, success) with those of the requests that were still to do: a run that was interrupted goes on where it stopped."""
    from ..operators.report import resumable

    todo = resumable(requests.withColumnRenamed("entity", "product"), records, retry).withColumnRenamed("product", "entity")
    done = verifier.verify(todo, now).select(F.col("entity").alias("product"), (F.col("profile") != "[]").alias("success"))
    return records.select("product", "success").unionByName(done)


def stored(spark: SparkSession, path: str) -> Repository:
    return Repository(spark, path, "key string, value string, at double")


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """Recorded result pages in a folder, by the data source."""
    spark.dataSource.register(P.RecordedSearch)
    return spark.read.format("recorded_search").load(path)
