"""Reports over runs and profiles: audits, comparisons between runs, what is shown and exported, jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identity as I
from ..functions.text import FOREIGN_SCRIPT, plural_slavic, utf16_units

# Fields that are no attributes, a unit of radio fields, markers of outside trouble, fields of families of measures, first-party types.
IDENTITY_FIELDS = ("brand", "model", "manufacturer_article")
RADIO_UNIT = r"\d\s*(?:dBm|W/kg)\b"
TROUBLE = ("blocked", "error")
RELATED = {"weight": ("net_weight", "gross_weight", "weight"), "dimension": ("product_dimensions", "product_height", "product_width", "product_depth", "package_dimensions")}
FAILED = ("blocked", "timeout", "parse_error", "error", "low_value")
CLASSES = ("SPEC", "IDENTITY", "CONTENT", "UNKNOWN")


def _count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


# ---------------------------------------------------------------- audits of a result
def multi_valued_labels(facts: DataFrame) -> DataFrame:
    """entity, n: labels that have two values or more (value and unit) within one source; facts: entity, url, label, value, unit."""
    per = facts.groupBy("entity", "url", F.lower("label").alias("label")).agg(F.countDistinct("value", F.coalesce("unit", F.lit(""))).alias("n")).filter("n > 1")
    return per.groupBy("entity").agg(F.countDistinct("label").alias("n"))


def normalization_summary(raw: DataFrame, clusters: DataFrame) -> DataFrame:
    """entity, raw counts by class, specs (clusters), dedup (share of raw specs that merged), issues; raw: entity, cls; clusters: entity, cls, reason."""
    r = raw.groupBy("entity").agg(F.count("*").alias("raw"), *[_count(F.col("cls") == c).alias(f"raw_{c.lower()}") for c in CLASSES])
    is_ = lambda *reasons: _count(F.col("reason").isin(*reasons))
    c = clusters.groupBy("entity").agg(F.count("*").alias("total"), _count(F.col("cls") == "SPEC").alias("specs"), is_("unresolved_i18n_key").alias("_keys"), is_("placeholder_value", "template_text", "template_block").alias("_blank"))
    j = r.join(c, "entity", "left").fillna(0, ["total", "specs", "_keys", "_blank"])
    issue = lambda n, text: F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.lit(text)))
    issues = F.concat_ws("; ", issue(F.col("_keys"), "unresolved i18n"), issue(F.col("_blank"), "placeholder/template"), F.when(F.col("specs") == 0, "no product specs"))
    dedup = F.when(F.col("raw_spec") > 0, F.round(1 - F.col("specs") / F.col("raw_spec"), 3)).otherwise(0.0)
    return j.select("entity", "raw", *[f"raw_{c.lower()}" for c in CLASSES], "specs", "total", dedup.alias("dedup"), issues.alias("issues"))


def change_examples(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (entity, seq, kind, changed) in turns over entities: the first of each kind that changed, round by round, limit in all (the report's own)."""
    first = rows.filter("changed").groupBy("entity", "kind").agg(F.min("seq").alias("seq"))
    turn = first.withColumn("turn", F.row_number().over(Window.partitionBy("entity").orderBy("seq")))
    return turn.orderBy("turn", "entity").limit(limit)


def value_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def gate_summary(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """run, products, completed, successes, confirmed_any, mean_coverage, median_coverage, seconds, collapses, provider_failures of records (run, product,
    timed_out, success, confirmed, found, coverage, seconds) and attempts (run, provider, status)."""
    r = records.groupBy("run").agg(
        F.count("*").alias("products"), _count(~F.col("timed_out")).alias("completed"), _count(F.col("success")).alias("successes"), _count(F.col("confirmed") > 0).alias("confirmed_any"),
        F.round(F.avg("coverage"), 4).alias("mean_coverage"), F.round(F.median("coverage"), 4).alias("median_coverage"), F.round(F.sum("seconds"), 4).alias("seconds"), _count((F.col("found") == 0) & (F.col("coverage") == 0)).alias("collapses"),
    )
    a = attempts.groupBy("run").agg(_count(F.col("status").isin(*FAILED)).alias("provider_failures"))
    return r.join(a, "run", "left").fillna(0, ["provider_failures"])


def provider_performance(attempts: DataFrame) -> DataFrame:
    """run, provider, n, failures, results, seconds, mean_seconds of attempts (run, provider, status, results, seconds)."""
    g = attempts.groupBy("run", "provider").agg(F.count("*").alias("n"), _count(F.col("status").isin(*FAILED)).alias("failures"), F.sum("results").alias("results"), F.round(F.sum("seconds"), 4).alias("seconds"))
    return g.withColumn("mean_seconds", F.round(F.col("seconds") / F.col("n"), 4))


def stability(runs: DataFrame, n_runs: int) -> DataFrame:
    """product, n_runs, spread of confirmed, jump (from none, or by more than half), statuses that occur, stable; runs: run, product, confirmed, status.
    A read fails if a product is not in every run exactly once."""
    g = runs.groupBy("product").agg(F.count("*").alias("_n"), F.countDistinct("run").alias("n_runs"), F.min("confirmed").alias("low"), F.max("confirmed").alias("high"), F.sort_array(F.collect_set("status")).alias("statuses"))
    told = F.when((F.col("_n") != n_runs) | (F.col("n_runs") != n_runs), F.raise_error(F.concat(F.lit("product not in every run once: "), F.col("product").cast("string")))).otherwise(F.lit(True))
    jump = (F.col("high") > 0) & ((F.col("high") - F.col("low")) / F.greatest(F.lit(1), F.col("low")) > 0.5)
    return g.withColumn("_ok", told).filter("_ok is null or _ok").select("product", "n_runs", (F.col("high") - F.col("low")).alias("spread"), jump.alias("jump"), "statuses", (~jump & (F.size("statuses") == 1)).alias("stable"))


def completeness_diff(facts: DataFrame, profile: DataFrame) -> DataFrame:
    """facts (entity, canonical, value) with outcome and reason: accepted if the profile (entity, attribute, status, reason, official: an official source supports
    it) confirms it with official support; components of dimensions count as the whole."""
    target = F.when(F.col("canonical").isin("product_height", "product_width", "product_depth"), "product_dimensions").otherwise(F.col("canonical"))
    p = profile.select("entity", "attribute", "status", F.col("reason").alias("_why"), "official")
    j = facts.withColumn("attribute", target).join(p, ["entity", "attribute"], "left")
    why = (
        F.when(F.col("status").isNull(), "not present in the final profile").when(F.col("status") != "Confirmed", F.concat_ws(": ", "status", "_why"))
        .when(~F.col("official"), "outranked: confirmed value comes from a non-official source").otherwise("")
    )
    return j.select("entity", "canonical", "attribute", "value", F.when(why == "", "accepted").otherwise("rejected").alias("outcome"), why.alias("reason"))


def shared_facts(facts: DataFrame, columns: DataFrame) -> DataFrame:
    """Facts (entity, column, canonical, value, unit) that every column of an entity's table states; columns: entity, n. For tables that name no model."""
    unit = F.coalesce("unit", F.lit(""))
    g = facts.groupBy("entity", "canonical", "value", unit.alias("unit")).agg(F.countDistinct("column").alias("k"))
    return g.join(columns, "entity").filter("k = n").select("entity", "canonical", "value", "unit")


def related_facts(gaps: DataFrame, facts: DataFrame) -> DataFrame:
    """entity, attribute, related: how many facts (entity, canonical, label) of the same family of measures, or with its word in the label, an entity has
    beside a gap (entity, attribute). Facts are cut to the few words of families before they meet gaps."""
    word = lambda c: F.when(c.contains("weight"), "weight").when(c.contains("dimension") | c.isin(*RELATED["dimension"]), "dimension")
    f = facts.withColumn("family", F.coalesce(word(F.coalesce("canonical", F.lit(""))), word(F.lower("label")))).filter("family is not null").groupBy("entity", "family").agg(F.count("*").alias("related"))
    return gaps.withColumn("family", word(F.col("attribute"))).join(f, ["entity", "family"], "left").select("entity", "attribute", F.coalesce("related", F.lit(0)).alias("related"))


def searchable(gaps: DataFrame) -> DataFrame:
    """gaps (entity, attribute, scope, model, sku, color, display_context) with searchable and reason."""
    why = (
        F.when(F.col("attribute").isin("brand", "model", "manufacturer_article", "product_code", "sku", "gtin"), "identity field").when(F.coalesce("model", F.lit("")) == "", "no model").when((F.col("attribute") == "color") & F.coalesce("display_context", F.lit(False)), "display colour")
        .when((F.col("scope") == "variant_level") & (F.when(F.col("attribute") == "color", F.coalesce("color", F.lit(""))).otherwise(F.coalesce("sku", F.lit(""))) == ""), "no variant signal")
    )
    return gaps.withColumn("reason", why).withColumn("searchable", why.isNull())


def targeted_counts(queries: DataFrame) -> DataFrame:
    """entity, queries, candidates, rejected, fetches of queries (entity, candidates, rejected, fetched: arrays)."""
    size = lambda c: F.sum(F.greatest(F.size(c), F.lit(0)))
    return queries.groupBy("entity").agg(F.count("*").alias("queries"), size("candidates").alias("candidates"), size("rejected").alias("rejected"), size("fetched").alias("fetches"))


def official_resolution(profiles: DataFrame) -> DataFrame:
    """entity, decision, reason of counts (entity, official_candidates, exact_official, selected_official, fetched_official, raw_official, confirmed_official):
    the first step at which nothing official is left."""
    steps = (("official_candidates", "no_official_source", "no official candidate"), ("exact_official", "no_exact_page", "no exact official page"), ("selected_official", "not_selected", "no official page selected"), ("fetched_official", "fetch_failed", "no official page fetched"), ("raw_official", "no_facts", "official pages state no facts"), ("confirmed_official", "not_confirmed", "no official fact confirmed"))
    decision, reason = F.lit("resolved"), F.lit("official facts confirmed")
    for column, name, text in reversed(steps):
        decision, reason = F.when(F.coalesce(column, F.lit(0)) == 0, name).otherwise(decision), F.when(F.coalesce(column, F.lit(0)) == 0, text).otherwise(reason)
    return profiles.select("entity", decision.alias("decision"), reason.alias("reason"))


def loss_class(rows: DataFrame) -> DataFrame:
    """rows with loss: the furthest stage that an attribute reached (booleans discovered, fetched, extracted, normalized, mapped, resolved, confirmed)."""
    stages = (("discovered", "discovery_loss"), ("fetched", "fetch_loss"), ("extracted", "extraction_loss"), ("normalized", "normalization_loss"), ("mapped", "mapping_loss"), ("resolved", "resolution_loss"), ("confirmed", "validation_loss"))
    out = F.lit("confirmed")
    for column, name in reversed(stages):
        out = F.when(~F.coalesce(column, F.lit(False)), name).otherwise(out)
    return rows.withColumn("loss", out)


# ---------------------------------------------------------------- batches
def selected_products(products: DataFrame, tag: str | None, limit: int | None) -> DataFrame:
    """products (seq, tags) with a tag, the first `limit` by seq."""
    rows = products if tag is None else products.filter(F.array_contains("tags", tag))
    return rows if limit is None else rows.orderBy("seq").limit(limit)


def resumable(products: DataFrame, records: DataFrame, retry: bool) -> DataFrame:
    """products (product) that no record (product, success) is of; with retry also those whose records all failed."""
    seen = records.groupBy("product").agg(F.max(F.coalesce("success", F.lit(False))).alias("ok"))
    return products.join(seen.filter("ok") if retry else seen, "product", "left_anti")


def external_trouble(marker: Column, timed_out: Column, status: Column, sources: Column) -> Column:
    """Whether a record failed for reasons outside: a block, a time-out, or nothing found by a partial search."""
    return F.coalesce(marker != "", F.lit(False)) | F.coalesce(timed_out, F.lit(False)) | F.coalesce(status.isin(*TROUBLE), F.lit(False)) | F.coalesce((status == "partial") & (sources == 0), F.lit(False))


def job_requests(requests: DataFrame) -> DataFrame:
    """key, seq, accepted of requests (key: chat and request, seq, at, seconds): one is a duplicate while the accepted one before it is active.

    Folded over rows sorted by (key, at, seq) in partitions, so a hot key needs no more memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, until = object(), 0.0
        for pdf in batches:
            out = []
            for k, at, seconds in zip(pdf["key"], pdf["at"], pdf["seconds"], strict=True):
                new = k != key or at >= until
                if new:
                    key, until = k, at + seconds
                out.append(new)
            yield pdf[["key", "seq"]].assign(accepted=out)

    rows = requests.select("key", "seq", F.col("at").cast("double").alias("at"), F.col("seconds").cast("double").alias("seconds")).repartition("key").sortWithinPartitions("key", "at", "seq")
    return rows.mapInPandas(run, "key long, seq long, accepted boolean")


def job_states(events: DataFrame) -> DataFrame:
    """job, state, seconds of events (job, at, kind: queued, started, cancelled, succeeded, failed): a terminal event ends a job, the first of them counts; a
    cancelled job stays so, whatever its worker tells later."""
    terminal = F.col("kind").isin("cancelled", "succeeded", "failed")
    g = events.groupBy("job").agg(F.min_by("kind", F.when(terminal, F.struct("at", "kind"))).alias("end"), F.max((F.col("kind") == "started").cast("int")).alias("ran"), F.min("at").alias("first"), F.min(F.when(terminal, F.col("at"))).alias("last"))
    state = F.when(F.col("end") == "succeeded", "completed").when(F.col("end").isNotNull(), F.col("end")).when(F.col("ran") == 1, "running").otherwise("queued")
    return g.select("job", state.alias("state"), (F.col("last") - F.col("first")).alias("seconds"))


# ---------------------------------------------------------------- what is shown
def user_facing(attribute: Column, discovered: Column) -> Column:
    return ~attribute.isin(*IDENTITY_FIELDS) & ~F.coalesce(discovered, F.lit(False))


def usable(value: Column) -> Column:
    """No foreign script and no radio unit; a null is usable."""
    return value.isNull() | ~(value.rlike(FOREIGN_SCRIPT) | value.rlike(RADIO_UNIT))


def shown_status(status: Column, value: Column) -> Column:
    return F.when((status == "Confirmed") & ~usable(value), "Unresolved").otherwise(status)


def found_counts(profile: DataFrame) -> DataFrame:
    """entity, found, total: attributes that a user sees (entity, attribute, discovered, status, value), and those of them confirmed with a usable value."""
    rows = profile.filter(user_facing(F.col("attribute"), F.col("discovered")))
    return rows.groupBy("entity").agg(_count(shown_status(F.col("status"), F.col("value")) == "Confirmed").alias("found"), F.count("*").alias("total"))


def source_count(profile: DataFrame) -> DataFrame:
    """entity, n: different URLs that support or contradict any attribute (arrays supporting, conflicting)."""
    empty = F.array().cast("array<string>")
    each = profile.select("entity", F.explode_outer(F.concat(F.coalesce("supporting", empty), F.coalesce("conflicting", empty))).alias("url"))
    return each.groupBy("entity").agg(F.countDistinct("url").alias("n"))


def attribute_lines(profile: DataFrame, limit: int) -> DataFrame:
    """entity, lines: confirmed attributes (label: value) in the order of place, `limit` of them, then how many more there are."""
    rows = profile.filter(user_facing(F.col("attribute"), F.col("discovered")) & (shown_status(F.col("status"), F.col("value")) == "Confirmed"))
    n = F.row_number().over(Window.partitionBy("entity").orderBy("place", "attribute"))
    rows = rows.withColumn("n", n).withColumn("line", F.concat_ws(": ", "label", "value"))
    g = rows.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= limit, F.struct("n", "line")))), lambda x: x["line"]).alias("lines"), F.count("*").alias("all"))
    more = F.when(F.col("all") > limit, F.array(F.concat(F.lit("and "), F.col("all") - limit, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return g.select("entity", F.concat("lines", more).alias("lines"))


def truncate_units(c: Column, most: Column) -> Column:
    """At most so many UTF-16 units, an ellipsis for what is cut; no character is split."""
    chars = F.split(c, "")
    width = lambda x: F.when(F.octet_length(x) > 3, 2).otherwise(1)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))
    taken = F.aggregate(chars, start, lambda a, x: F.struct(F.when(a["full"] | (a["used"] + width(x) > most - 1), a["used"]).otherwise(a["used"] + width(x)).alias("used"), F.when(a["full"] | (a["used"] + width(x) > most - 1), a["kept"]).otherwise(a["kept"] + 1).alias("kept"), (a["full"] | (a["used"] + width(x) > most - 1)).alias("full")))
    return F.when(utf16_units(c) <= most, c).otherwise(F.concat(F.substring(c, F.lit(1), taken["kept"]), F.lit("…")))


def chunk_lines(lines: Column, most: int) -> Column:
    """Lines joined into chunks of at most so many UTF-16 units, line ends included; a longer line is truncated, none is split."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def step(a: Column, line: Column) -> Column:
        n = utf16_units(line)
        fits = a["open"].isNotNull() & (a["size"] + n + 1 <= most)
        done = F.when(a["open"].isNull() | fits, a["done"]).otherwise(F.array_append(a["done"], a["open"]))
        return F.struct(done.alias("done"), F.when(fits, F.concat(a["open"], F.lit("\n"), line)).otherwise(line).alias("open"), F.when(fits, a["size"] + n + 1).otherwise(n).alias("size"))

    cut = F.transform(lines, lambda x: truncate_units(x, F.lit(most)))
    return F.aggregate(cut, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def scoped_id(value: Column, key: str, length: int = 10) -> Column:
    """A short keyed digest of an identifier: HMAC-SHA256 of its text, by the definition of HMAC."""
    block = key.encode().ljust(64, b"\0") if len(key.encode()) <= 64 else None
    if block is None:
        raise ValueError("key of 64 bytes at most")
    inner = F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(value.cast("string"), "UTF-8"))
    return F.substring(F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(F.sha2(inner, 256))), 256), 1, length)


def localize_value(attribute: Column, text: Column, words: dict[str, str], units: dict[str, str], plurals: dict[str, tuple[str, str, str]]) -> Column:
    """A value for readers of a language with decimal commas: words of lists by a dictionary, units after numbers, some of which take the form that
    their number asks for, x between sizes as ×. Unknown items stay, formats too."""
    item = lambda x: F.coalesce(F.create_map(*[F.lit(y) for kv in words.items() for y in kv])[F.lower(F.trim(x))], F.trim(x))
    lists = attribute.isin("color", "sensors", "package_contents", "authentication", "buttons") | attribute.rlike("_color$|_sensors$|material")
    listed = F.array_join(F.transform(F.split(text, ";"), item), "; ")
    number = r"(\d+(?:\.\d+)?)\s*"
    out = F.regexp_replace(F.regexp_replace(text, r"(?<=\d)\s*[x×]\s*(?=\d)", " × "), r"(\d)\.(\d)", "$1,$2")
    for unit, forms in plurals.items():
        n = F.regexp_extract(text, number + unit + r"\b", 1)
        whole = n.try_cast("int")
        form = F.when(n.contains("."), forms[1]).otherwise(plural_slavic(whole, *forms))
        out = F.when(n != "", F.regexp_replace(out, r"(\d+(?:,\d+)?)\s*" + unit + r"\b", F.concat(F.lit("$1 "), form))).otherwise(out)
    for unit, name in units.items():
        out = F.regexp_replace(out, r"(\d)\s*" + unit + r"\b", f"$1 {name}")
    known = F.create_map(*[F.lit(y) for kv in words.items() for y in kv])[F.lower(F.trim(text))]
    return F.when(attribute == "video_formats", text).when(lists, listed).when(known.isNotNull(), known).otherwise(out)


def display_composite(raw: DataFrame) -> DataFrame:
    """Raw pairs (entity, seq, label, value) of a display that state size and type in one: a row for display_size and one for display_type."""
    pattern = r"""(?i)^\s*(\d{1,2}(?:[.,]\d{1,2})?)\s*(?:inch(?:es)?|in|"|″|”)[\s,;:–—-]+(.*\p{L}.*?)\s*$"""
    rows = raw.filter(F.lower("label").isin("display", "screen", "display type", "screen type")).filter(F.col("value").rlike(pattern))
    size, kind = F.regexp_replace(F.regexp_extract("value", pattern, 1), ",", "."), F.regexp_extract("value", pattern, 2)
    both = F.array(F.struct(F.lit("display_size").alias("canonical"), size.alias("value"), F.lit("in").alias("unit")), F.struct(F.lit("display_type").alias("canonical"), kind.alias("value"), F.lit(None).cast("string").alias("unit")))
    return rows.select("entity", "seq", F.explode(both).alias("f")).select("entity", "seq", "f.*")


def source_summary(sources: DataFrame) -> DataFrame:
    """entity, summary: how many sources (entity, url, source_type, authority, status) are official, others, failed, as one text for an export."""
    official = I.is_official(F.col("source_type"), F.col("authority"))
    g = sources.groupBy("entity").agg(_count(official & (F.col("status") == "success")).alias("a"), _count(~official & (F.col("status") == "success")).alias("b"), _count(F.col("status") != "success").alias("c"))
    return g.select("entity", F.concat_ws("; ", F.concat(F.lit("official "), "a"), F.concat(F.lit("other "), "b"), F.concat(F.lit("failed "), "c")).alias("summary"))


def profile_json(profile: DataFrame) -> DataFrame:
    """entity, json: one document for each entity, its attributes (attribute, status, value, place) in order; nulls are written."""
    fields = F.struct("place", "attribute", "status", "value")
    g = profile.groupBy("entity").agg(F.array_sort(F.collect_list(fields)).alias("a"))
    return g.select("entity", F.to_json(F.struct("entity", F.transform("a", lambda x: F.struct(x["attribute"].alias("name"), x["status"].alias("status"), x["value"].alias("value"))).alias("attributes")), {"ignoreNullFields": "false"}).alias("json"))
