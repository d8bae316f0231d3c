"""Relational operators: ordered dedup, top-k by tiers, alias mapping, collisions, set algebra, audits, state over time.

Each takes and returns DataFrames; ties are broken by an explicit total order, since rows have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How far each way of extraction is trusted, and weights of candidates.
METHOD_PRIORITY = {"json_ld": 10, "embedded_json": 9, "structured_data": 8, "html_table": 7, "definition_list": 6, "label_value": 5, "pdf_spec": 4, "spec_block": 3, "pdf_text": 2, "plain_text": 1}
MATCH_SCORE = {"exact": 60, "likely_variant": 45, "likely": 30, "unknown": -35, "mismatch": -120, "different_variant": -120}
SOURCE_SCORE = {"manufacturer": 25, "official_document": 20, "retailer": 5, "marketplace": -25}
PAGE_SCORE = {"product": 15, "support": 10, "homepage": -25, "catalog": -20, "weak": -20}


def case(c: Column, table: dict, otherwise: object = 0) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


# ---------------------------------------------------------------- dedup, rank, top-k
def best_of_each(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, first in the order given. Aggregated on the map side, so a hot key is folded before the shuffle.

    Order columns must be numbers or strings sorted upwards; negate a number to sort it downwards."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def deduplicate_methods(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Of facts with equal keys the one by the most trusted method, at the first one's place (first_seq)."""
    first = facts.groupBy(*keys).agg(F.min("seq").alias("first_seq"), F.min(F.struct((-case(F.col("method"), METHOD_PRIORITY)).alias("p"), "seq", "method")).alias("b"))
    return first.select(*keys, "first_seq", F.col("b.seq").alias("seq"), F.col("b.method").alias("method"))


def candidate_score(match: Column, source_type: Column, authority: Column, page_kind: Column, in_title: Column, in_url: Column) -> Column:
    one = lambda c, w: F.when(c, w).otherwise(0)
    return case(match, MATCH_SCORE, -35) + case(source_type, SOURCE_SCORE) + one(authority == "verified", 20) + case(page_kind, PAGE_SCORE) + one(in_title, 10) + one(in_url, 10)


def top_k_by_family(rows: DataFrame, family: list[str], k: int, *order: Column) -> DataFrame:
    """First pass: the best of each family by rank; then the others fill up to k. Adds `place`.

    Families are cut to k rows each before the global order, which is taken by a limit, not by one task's sort."""
    within = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*family).orderBy(*order))).filter(F.col("_n") <= k)
    best = within.orderBy(F.when(F.col("_n") == 1, 0).otherwise(1), *order).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("_n") == 1, 0).otherwise(1), *order))).drop("_n")


def keep_last(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


# ---------------------------------------------------------------- mapping
def alias_mapping(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """labels (id, variants: array of keys) x aliases (alias, canonical): mapped, ambiguous or unmapped, by the number of canonical names.

    An equi-join on exploded variants; the rule table is small and Spark sees its size."""
    hit = labels.select("id", F.explode("variants").alias("alias")).join(aliases, "alias").groupBy("id").agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("canonical"))
    j = labels.select("id").join(hit, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("id", F.when(n == 1, "mapped").when(n > 1, "ambiguous").otherwise("unmapped").alias("status"), F.when(n == 1, F.col("canonical")).alias("canonical"), n.alias("n_candidates"))


def winner_with_margin(scores: DataFrame, key: str, least: int, margin: int, sure: int = 7, sure_margin: int = 3) -> DataFrame:
    """key, label, confidence of scores (key, label, score): unknown unless the top reaches `least` and leads by `margin`."""
    top = scores.groupBy(key).agg(F.max(F.struct("score", (-F.xxhash64("label")).alias("t"), "label")).alias("a"), F.sort_array(F.collect_list("score"), False).alias("s"))
    lead = F.col("a.score") - F.coalesce(F.get("s", 1), F.lit(0))
    ok = (F.col("a.score") >= least) & (lead >= margin)
    return top.select(key, F.when(ok, F.col("a.label")).otherwise("unknown").alias("label"), F.when(ok & (F.col("a.score") >= sure) & (lead >= sure_margin), "high").when(ok, "medium").otherwise("low").alias("confidence"))


def collisions(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Kind of collision of each key with two attributes or more (id, value, unit): same, equivalent or different values."""
    g = fields.groupBy(*keys).agg(F.countDistinct("id").alias("members"), F.countDistinct(F.struct("value", "unit")).alias("n_values"), F.countDistinct("value").alias("n_texts")).filter("members > 1")
    return g.select(*keys, "members", F.when(F.col("n_values") == 1, "same").when(F.col("n_texts") == 1, "equivalent").otherwise("different").alias("kind"))


def component_occurrence(fields: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The second and later occurrence of a key in a section gets the prefix secondary_component_."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return fields.withColumn("occurrence", n).withColumn("field", F.when(F.col("occurrence") > 1, F.concat(F.lit("secondary_component_"), F.col("field"))).otherwise(F.col("field")))


def compose_dimensions(parts: DataFrame, keys: list[str]) -> DataFrame:
    """struct-like columns height, width, depth, unit of groups that hold each axis (h, w, d) exactly once in one unit."""
    one = lambda a: F.sum(F.when(F.col("axis") == a, 1).otherwise(0)) == 1
    val = lambda a: F.max(F.when(F.col("axis") == a, F.col("value")))
    g = parts.groupBy(*keys).agg(one("h").alias("_h"), one("w").alias("_w"), one("d").alias("_d"), F.countDistinct("unit").alias("_u"), val("h").alias("height"), val("w").alias("width"), val("d").alias("depth"), F.min("unit").alias("unit"))
    return g.filter("_h and _w and _d and _u = 1").drop("_h", "_w", "_d", "_u")


def overriding_union(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, the row of `over`."""
    return over.unionByName(base.join(over.select(key), key, "left_anti"))


def long_form(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return wide.unpivot(keys, columns, "attribute", "value")


def wide_form(long: DataFrame, keys: list[str], attributes: list[str], missing: str | None = None) -> DataFrame:
    """One row for each key, a column for each of a fixed list of attributes; blanks filled by `missing`."""
    w = long.groupBy(*keys).pivot("attribute", attributes).agg(F.min("value"))
    return w if missing is None else w.select(*keys, *[F.coalesce(a, F.lit(missing)).alias(a) for a in attributes])


# ---------------------------------------------------------------- audits
def metrics(records: DataFrame, value: str, flag: Column, keys: list[str]) -> DataFrame:
    """Counts, conditional counts, mean and median for each key and over all (grouping sets; key null, level 1)."""
    cube = records.withColumn("_flag", flag.cast("int")).groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys])
    return cube.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("_flag").alias("n_flag"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def funnel(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """step, n, conversion from the step before: rows that pass it and all before. One aggregation, then a row for each step."""
    done, sums = F.lit(True), []
    for name, c in steps.items():
        done = done & F.coalesce(c, F.lit(False))
        sums.append(F.sum(F.when(done, 1).otherwise(0)).alias(name))
    total = rows.agg(F.count("*").alias("_all"), *sums)
    names = ["_all", *steps]
    pairs = [F.struct(F.lit(n).alias("step"), F.coalesce(F.col(n), F.lit(0)).alias("n"), F.try_divide(F.col(n).cast("double"), F.col(b).cast("double")).alias("conversion")) for b, n in zip(names, names[1:], strict=False)]
    return total.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def first_failure(steps: dict[str, Column]) -> Column:
    """Name of the first step whose condition holds, else none."""
    out = F.lit("none")
    for name, c in reversed(steps.items()):
        out = F.when(F.coalesce(c, F.lit(False)), name).otherwise(out)
    return out


def compare_to_baseline(baseline: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, delta, verdict for each baseline row: improved, regressed, same or missing."""
    j = baseline.select(key, F.col(value).alias("before")).join(now.select(key, F.col(value).alias("after")), key, "left")
    d = F.col("after") - F.col("before")
    return j.select(key, "before", "after", d.alias("delta"), F.when(F.col("after").isNull(), "missing").when(d > 0, "improved").when(d < 0, "regressed").otherwise("same").alias("verdict"))


# ---------------------------------------------------------------- time and state
def latest_within(queries: DataFrame, entries: DataFrame, key: str, asked: str, stored: str, ttl_seconds: int) -> DataFrame:
    """For each query the latest entry of its key at or before `asked`, if not older than the ttl; else nulls.

    Both sides are merged in one sort by key and time and the last entry is carried forward: no range join."""
    q = queries.select(key, F.col(asked).alias("_t"), F.lit(1).alias("_q"), F.struct(*queries.columns).alias("_query"), F.lit(None).cast(entries.select(F.struct(*entries.columns).alias("s")).schema["s"].dataType).alias("_entry"))
    e = entries.select(key, F.col(stored).alias("_t"), F.lit(0).alias("_q"), F.lit(None).cast(queries.select(F.struct(*queries.columns).alias("s")).schema["s"].dataType).alias("_query"), F.struct(*entries.columns).alias("_entry"))
    w = Window.partitionBy(key).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    found = q.unionByName(e).withColumn("_entry", F.last("_entry", True).over(w)).filter("_q = 1")
    fresh = F.col("_t").cast("double") - F.col("_entry")[stored].cast("double") <= ttl_seconds
    return found.select("_query.*", *[F.when(fresh, F.col("_entry")[c]).alias(f"entry_{c}") for c in entries.columns])


def streaks(events: DataFrame, key: str, failed: Column, *order: Column) -> DataFrame:
    """key, streak number and length of each run of failures (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_f", failed.cast("int")).withColumn("_g", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("_f = 1").groupBy(key, F.col("_g").alias("island")).agg(F.count("*").alias("length"))


def bottleneck(losses: DataFrame, key: str, priority: dict[str, int]) -> DataFrame:
    """key, bottleneck, n: the most frequent loss of each key (rows key, loss); of equals the one of least priority."""
    n = losses.groupBy(key, "loss").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by(F.struct("loss", "n"), F.struct("n", -case(F.col("loss"), priority))).alias("m")).select(key, F.col("m.loss").alias("bottleneck"), F.col("m.n").alias("n"))


def last_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by the columns of order; aggregated before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def token_matches(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """item, doc, matched, required: documents (doc, tokens) that hold the required number of a query's tokens (item, tokens): half of them, two at least, one of one.

    A document with `required` of n tokens has one of any n - required + 1 of them, so only the rarest that many of each query look for documents;
    a common word brings no pairs. What is found is counted exactly. Tokens are different ones; empty lists match nothing."""
    need = F.when(F.col("n") == 1, 1).otherwise(F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2))).cast("int")
    q = queries.filter(F.size("tokens") > 0).withColumn("n", F.size("tokens")).withColumn("required", need)
    wanted = q.select("item", "n", "required", F.explode("tokens").alias("token"))
    # Of documents only tokens that some query has go on, so what is counted at the end is short.
    held = docs.select("doc", F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    seen = held.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "token"))
    rare = wanted.join(seen, "token", "left").withColumn("place", place).filter("place <= n - required + 1")
    pairs = rare.select("item", "token").join(held, "token").select("item", "doc").distinct()
    both = pairs.join(q.select("item", "required", F.col("tokens").alias("own")), "item").join(held.groupBy("doc").agg(F.collect_set("token").alias("tokens")), "doc")
    return both.select("item", "doc", F.size(F.array_intersect("own", "tokens")).cast("long").alias("matched"), "required").filter("matched >= required")
