"""Queries of reports over orders, parts and events, and over rows composed of supplier columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as P
from .normal import composed, stated
from .queries import query, table


def _line(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "lineitem")


@query("""SELECT l_partkey AS entity, count(DISTINCT l_returnflag) AS n FROM (SELECT l_partkey, l_suppkey, l_returnflag FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_linestatus, l_linenumber)) > 1) GROUP BY l_partkey""")
def multi_valued_labels(spark, d):  # noqa: ANN001, ANN201
    return P.multi_valued_labels(_line(spark, d).select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("url"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("value"), F.col("l_linenumber").cast("string").alias("unit")))


@query("""WITH r AS (SELECT l_partkey AS entity, (ARRAY['SPEC', 'IDENTITY', 'CONTENT', 'UNKNOWN'])[(l_linenumber % 4) + 1] AS cls, (ARRAY['x', 'unresolved_i18n_key', 'template_text', 'y'])[(l_linenumber % 4) + 1] AS reason, l_linenumber FROM lineitem),
a AS (SELECT entity, count(*) AS raw, count(*) FILTER (cls = 'SPEC') AS raw_spec, count(*) FILTER (cls = 'IDENTITY') AS raw_identity, count(*) FILTER (cls = 'CONTENT') AS raw_content, count(*) FILTER (cls = 'UNKNOWN') AS raw_unknown FROM r GROUP BY entity),
c AS (SELECT entity, count(*) AS total, count(*) FILTER (cls = 'SPEC') AS specs, count(*) FILTER (reason = 'unresolved_i18n_key') AS k, count(*) FILTER (reason = 'template_text') AS b FROM (SELECT DISTINCT * FROM r) GROUP BY entity)
SELECT entity, raw, raw_spec, raw_identity, raw_content, raw_unknown, specs, total, CASE WHEN raw_spec > 0 THEN round(1 - specs / raw_spec, 3) ELSE 0 END::DOUBLE AS dedup,
concat_ws('; ', CASE WHEN k > 0 THEN k || ' unresolved i18n' END, CASE WHEN b > 0 THEN b || ' placeholder/template' END, CASE WHEN specs = 0 THEN 'no product specs' END) AS issues FROM a JOIN c USING (entity)""")
def normalization_summary(spark, d):  # noqa: ANN001, ANN201
    k = (F.col("l_linenumber") % 4).cast("int")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), k)
    r = _line(spark, d).select(F.col("l_partkey").alias("entity"), pick(*("SPEC", "IDENTITY", "CONTENT", "UNKNOWN")).alias("cls"), pick("x", "unresolved_i18n_key", "template_text", "y").alias("reason"), "l_linenumber")
    return P.normalization_summary(r, r.distinct())


@query("""WITH f AS (SELECT l_partkey AS entity, l_returnflag AS kind, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS turn FROM f)
SELECT entity, kind, seq, turn::INTEGER AS turn FROM t ORDER BY turn, entity LIMIT 30""")
def change_examples(spark, d):  # noqa: ANN001, ANN201
    return P.change_examples(_line(spark, d).select(F.col("l_partkey").alias("entity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("kind"), (F.col("l_discount") > 0.02).alias("changed")), 30)


@query("""WITH r AS (SELECT c_nationkey AS run, count(*) AS products, count(*) FILTER (o_orderstatus <> 'O') AS completed, count(*) FILTER (o_orderstatus = 'F') AS successes, count(*) FILTER (o_orderkey % 3 > 0) AS confirmed_any, round(avg(o_orderkey % 11), 4)::DOUBLE AS mean_coverage,
round(median(o_orderkey % 11), 4)::DOUBLE AS median_coverage, round(sum(o_totalprice), 4)::DOUBLE AS seconds, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 11 = 0) AS collapses FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
a AS (SELECT user_id % 25 AS run, count(*) FILTER (event_type = 'error') AS provider_failures FROM events GROUP BY 1) SELECT r.*, coalesce(provider_failures, 0) AS provider_failures FROM r LEFT JOIN a USING (run)""")
def gate_summary(spark, d):  # noqa: ANN001, ANN201
    o, k = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")), F.col("o_orderkey")
    r = o.select(F.col("c_nationkey").alias("run"), (F.col("o_orderstatus") == "O").alias("timed_out"), (F.col("o_orderstatus") == "F").alias("success"), (k % 3).alias("confirmed"), (k % 2).alias("found"), (k % 11).cast("double").alias("coverage"), F.col("o_totalprice").cast("double").alias("seconds"))
    return P.gate_summary(r, table(spark, d, "events").select((F.col("user_id") % 25).alias("run"), F.col("event_type").alias("status")))


@query("""SELECT user_id % 5 AS run, event_type AS provider, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, sum(event_id % 7)::BIGINT AS results, round(sum(value), 4) AS seconds, round(round(sum(value), 4) / count(*), 4) AS mean_seconds FROM events GROUP BY ALL""")
def provider_performance(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("provider"), F.col("event_type").alias("status"), (F.col("event_id") % 7).alias("results"), F.col("value").alias("seconds"))
    return P.provider_performance(e)


@query("""WITH r AS (SELECT p_partkey AS product, k AS run, (p_size * (k + 1)) % 13 AS confirmed, CASE WHEN (p_partkey + CASE WHEN p_partkey % 3 = 0 THEN k ELSE 0 END) % 2 = 0 THEN 'verified' ELSE 'partial' END AS status FROM part, range(0, 3) AS x(k)),
g AS (SELECT product, max(confirmed) - min(confirmed) AS spread, max(confirmed) > 0 AND (max(confirmed) - min(confirmed)) / greatest(1, min(confirmed)) > 0.5 AS jump, array_to_string(list_sort(list_distinct(list(status))), '|') AS statuses FROM r GROUP BY product)
SELECT product, 3::BIGINT AS n_runs, spread, jump, statuses, NOT jump AND NOT contains(statuses, '|') AS stable FROM g""")
def run_stability(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, range(3)))).alias("run"))
    status = F.when((F.col("p_partkey") + F.when(F.col("p_partkey") % 3 == 0, F.col("run")).otherwise(0)) % 2 == 0, "verified").otherwise("partial")
    runs = p.select("run", F.col("p_partkey").alias("product"), (F.col("p_size") * (F.col("run") + 1) % 13).alias("confirmed"), status.alias("status"))
    return P.stability(runs, 3).withColumn("statuses", F.array_join("statuses", "|"))


# Name of a fact, status, reason, official support; then attribute, outcome, reason.
_FACTS = (
    ("net_weight", "Confirmed", "ok", True, "net_weight", "accepted", ""), ("product_height", "Confirmed", "ok", True, "product_dimensions", "accepted", ""), ("ram", "Conflict", "two values", True, "ram", "rejected", "Conflict: two values"), ("storage", "Confirmed", "ok", False, "storage", "rejected", "outranked: confirmed value comes from a non-official source"),
    ("color", None, None, None, "color", "rejected", "not present in the final profile"),
)


@query(f"SELECT s_suppkey AS entity, canonical, attribute, outcome, told AS reason FROM {stated(_FACTS, ('canonical', 'status', 'reason', 'official', 'attribute', 'outcome', 'told'), ())}")
def completeness_diff(spark, d):  # noqa: ANN001, ANN201
    f = composed(spark, d, _FACTS, ("canonical", "status", "reason", "official", "attribute", "outcome", "told")).withColumnRenamed("s_suppkey", "entity")
    profile = f.filter("status is not null").select("entity", "attribute", "status", "reason", "official")
    return P.completeness_diff(f.select("entity", "canonical", F.lit("v").alias("value")), profile).drop("value")


@query("""WITH c AS (SELECT l_partkey AS entity, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1), f AS (SELECT l_partkey AS entity, l_linenumber AS canonical, l_linestatus AS value, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY ALL)
SELECT entity, canonical, value, '' AS unit FROM f JOIN c USING (entity) WHERE k = n""")
def shared_facts(spark, d):  # noqa: ANN001, ANN201
    f = _line(spark, d).select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("column"), F.col("l_linenumber").alias("canonical"), F.col("l_linestatus").alias("value"), F.lit(None).cast("string").alias("unit"))
    return P.shared_facts(f, f.groupBy("entity").agg(F.countDistinct("column").alias("n")))


# Gap, scope, model, sku, colour, display context; searchable, reason; related facts.
_GAPS = (("brand", "model_level", "M", "S", "red", False, False, "identity field", 0), ("gross_weight", "model_level", "", "S", "red", False, False, "no model", 2), ("color", "variant_level", "M", "S", "red", True, False, "display colour", 0), ("color", "variant_level", "M", "S", "", False, False, "no variant signal", 0), ("ram", "variant_level", "M", "", "", False, False, "no variant signal", 0), ("package_dimensions", "model_level", "M", "", "", False, True, None, 1))


@query(f"SELECT s_suppkey AS entity, attribute, searchable, reason, related::BIGINT AS related FROM {stated(_GAPS, ('attribute', 'scope', 'model', 'sku', 'color', 'display_context', 'searchable', 'reason', 'related'), ())}")
def searchable_gaps(spark, d):  # noqa: ANN001, ANN201
    g = composed(spark, d, [r[:6] for r in _GAPS], ("attribute", "scope", "model", "sku", "color", "display_context")).withColumnRenamed("s_suppkey", "entity").withColumn("_k", F.col("i"))
    facts = composed(spark, d, (("net_weight", "x"), (None, "Weight of box"), ("product_height", "y"), ("ram", "z")), ("canonical", "label")).withColumnRenamed("s_suppkey", "entity")
    told = P.searchable(g)
    related = P.related_facts(g.select("entity", "attribute").distinct(), facts)
    return told.join(related, ["entity", "attribute"]).select("entity", "attribute", "searchable", "reason", "related")


@query("""SELECT l_orderkey AS entity, count(*) AS queries, sum(l_linenumber % 3)::BIGINT AS candidates, sum(l_linenumber % 2)::BIGINT AS rejected, 0::BIGINT AS fetches FROM lineitem GROUP BY 1""")
def targeted_counts(spark, d):  # noqa: ANN001, ANN201
    urls = lambda n: F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), n)
    q = _line(spark, d).select(F.col("l_orderkey").alias("entity"), urls(F.col("l_linenumber") % 3).alias("candidates"), urls(F.col("l_linenumber") % 2).alias("rejected"), F.lit(None).cast("array<string>").alias("fetched"))
    return P.targeted_counts(q)


@query("""SELECT p_partkey AS entity, (ARRAY['no_official_source', 'no_exact_page', 'not_selected', 'fetch_failed', 'no_facts', 'not_confirmed', 'resolved'])[(p_partkey % 7) + 1] AS decision, (ARRAY['discovery_loss', 'fetch_loss', 'extraction_loss', 'normalization_loss', 'mapping_loss', 'resolution_loss', 'validation_loss'])[(p_partkey % 7) + 1] AS loss FROM part""")
def resolution_steps(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey") % 7
    names = ("official_candidates", "exact_official", "selected_official", "fetched_official", "raw_official", "confirmed_official")
    stages = ("discovered", "fetched", "extracted", "normalized", "mapped", "resolved", "confirmed")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), *[F.when(k > n, k).otherwise(0).alias(c) for n, c in enumerate(names)], *[(k > n).alias(c) for n, c in enumerate(stages)])
    return P.official_resolution(p).join(P.loss_class(p).select("entity", "loss"), "entity").select("entity", "decision", "loss")


@query("""WITH r AS (SELECT o_custkey AS product, bool_or(o_orderstatus = 'F') AS ok FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) SELECT c_custkey AS product, CASE WHEN ok IS NULL THEN 2 ELSE 1 END::BIGINT AS rounds FROM customer LEFT JOIN r ON c_custkey = product WHERE ok IS NULL OR NOT ok""")
def resumable_products(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("product"))
    r = table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("product"), (F.col("o_orderstatus") == "F").alias("success"))
    return P.resumable(c, r, False).unionAll(P.resumable(c, r, True)).groupBy("product").agg(F.count("*").alias("rounds"))


@query("""SELECT o_orderkey, o_orderkey % 5 IN (0, 1) OR o_orderkey % 7 < 2 OR (o_orderkey % 7 = 2 AND o_orderkey % 3 = 0) AS outside FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_orderkey LIMIT 200""")
def external_trouble(spark, d):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", k.alias("seq"), F.array("o_orderpriority").alias("tags"))
    first = P.selected_products(o.withColumn("tags", F.transform("tags", lambda t: F.substring(t, 1, 1))), "1", 200)
    status = F.when(k % 7 == 0, "blocked").when(k % 7 == 1, "error").when(k % 7 == 2, "partial").otherwise("complete")
    return first.select("o_orderkey", P.external_trouble(F.when(k % 5 == 0, "captcha").otherwise(""), F.when(k % 5 == 1, True), status, k % 3).alias("outside"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch(ts)::DOUBLE AS t, 3600.0 * (event_id % 5) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT key, seq, k, true AS accepted, t + s AS until FROM e WHERE k = 1 UNION ALL SELECT e.key, e.seq, e.k, e.t >= until, CASE WHEN e.t >= until THEN e.t + e.s ELSE until END FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1) SELECT key, seq, accepted FROM f""")
def job_requests(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("event_id") % 5 * 3600).alias("seconds"))
    return P.job_requests(e)


@query("""SELECT o_orderkey AS job, CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS state, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 5 THEN 1 ELSE 2 END::BIGINT AS seconds FROM orders""")
def job_states(spark, d):  # noqa: ANN001, ANN201
    ev = lambda *xs: F.array(*[F.struct(F.lit(t).cast("long").alias("at"), F.lit(x).alias("kind")) for t, x in xs])
    k = F.col("o_orderkey") % 6
    go = ((0, "queued"), (1, "started"))
    events = F.when(k == 0, ev((0, "queued"))).when(k == 1, ev(*go)).when(k == 2, ev(*go, (2, "succeeded"))).when(k == 3, ev(*go, (2, "failed"))).when(k == 4, ev(*go, (2, "cancelled"), (3, "succeeded"))).otherwise(ev((0, "queued"), (1, "cancelled"), (2, "failed")))
    return P.job_states(table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.explode(events).alias("e")).select("job", "e.*"))


# Attribute, label, discovered, status, value, place, supporting, conflicting.
_PROFILE = (
    ("brand", "Brand", False, "Confirmed", "Acme", 0, "u1", ""), ("mass", "Mass", False, "Confirmed", "{s} kg", 2, "u1|u2", "u3"), ("width", "Width", False, "Confirmed", "5{s} mm", 1, "u2", ""), ("note", "Note", False, "Confirmed", "電池 {s}", 3, "u4", ""), ("extra", "Extra", True, "Confirmed", "x", 4, "", ""),
    ("depth", "Depth", False, "Conflict", None, 5, "", "u5|u1"), ("power", "Power", False, "Confirmed", "{s} W", 6, "u1", ""), ("field", "Field", False, "Confirmed", "20 dBm", 7, "", ""),
)


def _profile(spark, d):  # noqa: ANN001, ANN202
    p = composed(spark, d, _PROFILE, ("attribute", "label", "discovered", "status", "value", "place", "supporting", "conflicting")).withColumnRenamed("s_suppkey", "entity")
    some = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    return p.withColumn("supporting", some("supporting")).withColumn("conflicting", some("conflicting"))


@query("""SELECT s_suppkey AS entity, 3::BIGINT AS found, 6::BIGINT AS total, 5::BIGINT AS sources, 'Width: 5' || (s_nationkey + 10) || ' mm|Mass: ' || (s_nationkey + 10) || ' kg|and 1 more' AS lines, 'official 1; other 1; failed 1' AS summary FROM supplier""")
def profile_view(spark, d):  # noqa: ANN001, ANN201
    p = _profile(spark, d)
    s = composed(spark, d, (("manufacturer", "verified", "success"), ("retailer", "verified", "success"), ("manufacturer", "verified", "blocked")), ("source_type", "authority", "status")).withColumnRenamed("s_suppkey", "entity")
    lines = P.attribute_lines(p, 2).withColumn("lines", F.array_join("lines", "|"))
    return P.found_counts(p).join(P.source_count(p).withColumnRenamed("n", "sources"), "entity").join(lines, "entity").join(P.source_summary(s), "entity")


@query("""SELECT s_suppkey AS entity, '{"entity":' || s_suppkey || ',"attributes":[{"name":"brand","status":"Confirmed","value":"Acme"},{"name":"width","status":"Confirmed","value":"5' || (s_nationkey + 10) || ' mm"},{"name":"depth","status":"Conflict","value":null}]}' AS json FROM supplier""")
def profile_json(spark, d):  # noqa: ANN001, ANN201
    return P.profile_json(_profile(spark, d).filter("attribute in ('brand', 'width', 'depth')"))


@query(r"""SELECT s_suppkey, i::BIGINT AS i, replace(chunks, '{k}', s_suppkey::VARCHAR) AS chunks FROM supplier, (VALUES (1, 'ab/cd|ef' || chr(128512)), (2, '123456…|x'), (3, chr(128512) || chr(128512) || chr(128512) || '…|a'), (4, ''), (5, '1234567')) AS v(i, chunks)""")
def chunked_lines(spark, d):  # noqa: ANN001, ANN201
    smile = "\U0001f600"
    rows = ((f"ab|cd|ef{smile}",), ("123456789|x",), (smile * 4 + "|a",), ("",), ("1234567",))
    r = composed(spark, d, rows, ("said",))
    lines = F.filter(F.split("said", r"\|"), lambda x: x != "")
    return r.select("s_suppkey", "i", F.replace(F.array_join(P.chunk_lines(lines, 7), "|"), F.lit("\n"), F.lit("/")).alias("chunks"))


# Attribute, value, localized value.
_LOCAL = (
    ("color", "Black; Ice Mint{s}", "чёрный; Ice Mint{s}"), ("battery_life", "2{s}.5 h", "2{s},5 ч"), ("software_update_support", "21 years", "21 год"), ("software_update_support", "3 years", "3 года"), ("software_update_support", "11 years", "11 лет"), ("software_update_support", "2.5 years", "2,5 года"), ("product_dimensions", "1.5 x 2{s} x 3 mm", "1,5 × 2{s} × 3 мм"),
    ("nfc", "Yes", "да"), ("video_formats", "H.264 at 5.1 h", "H.264 at 5.1 h"), ("net_weight", "1{s} g", "1{s} г"),
)


@query(f"SELECT s_suppkey, i, shown FROM {stated(_LOCAL, ('attribute', 'said', 'shown'), ('shown',))}")
def localized_values(spark, d):  # noqa: ANN001, ANN201
    r = composed(spark, d, [x[:2] for x in _LOCAL], ("attribute", "said"))
    return r.select("s_suppkey", "i", P.localize_value(F.col("attribute"), F.col("said"), {"black": "чёрный", "yes": "да"}, {"h": "ч", "mm": "мм", "g": "г"}, {"years": ("год", "года", "лет")}).alias("shown"))


@query("""SELECT s_suppkey AS entity, i::BIGINT AS seq, canonical, replace(value, '{s}', (s_nationkey + 10)::VARCHAR) AS value, unit FROM supplier, (VALUES (1, 'display_size', '6.{s}', 'in'), (1, 'display_type', 'OLED panel', NULL), (2, 'display_size', '15', 'in'), (2, 'display_type', 'IPS', NULL)) AS v(i, canonical, value, unit)""")
def display_composite(spark, d):  # noqa: ANN001, ANN201
    rows = (("Display", "6,{s} inches, OLED panel"), ("Screen type", '15" - IPS'), ("Display", "OLED"), ("Weight", "5 in X"), ("Display", "6 in"))
    return P.display_composite(composed(spark, d, rows, ("label", "value")).withColumnsRenamed({"s_suppkey": "entity", "i": "seq"}))
