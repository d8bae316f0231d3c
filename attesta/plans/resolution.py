"""Queries of resolution: claims composed of supplier columns that meet each rule, whose outcome SQL can state; folds in the order of claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as V
from .normal import composed, stated
from .queries import SQL, query, table

BEST, GOOD, SHOP = ("manufacturer", "verified", "high"), ("specialized_reference", "unverified", "high"), ("retailer", "unverified", "high")
# Attribute, value, unit, evidence, source, (type, authority, confidence), identity, status, family, variant sensitive, model wide.
_CLAIMS = (
    ("mass", "1000", "g", "e", "https://a.example/1", BEST, "exact_variant", "success", "mass", False, False), ("mass", "1 kg", "", "e", "https://b.example/2", BEST, "exact_variant", "success", "mass", False, False),
    ("mass", "1000.8", "g", "e", "https://c.example/3", GOOD, "exact_variant", "success", "mass", False, False), ("mass", "1001.6", "g", "e", "https://d.example/4", BEST, "exact_variant", "success", "mass", False, False),
    ("colour", "Red", None, "e", "https://b.example/p?utm_source=x", BEST, "exact_variant", "success", None, False, False), ("colour", "red", None, "e", "https://a.example/p", BEST, "exact_variant", "success", None, False, False),
    ("width", "6{s},0", "mm", "e", "https://r.example/1", GOOD, "exact_variant", "success", "length", False, False), ("width", "5{s}", "mm", "e", "https://z.example/1", BEST, "same_base_model", "success", "length", False, False), ("width", "5{s}.1 mm", "", "e", "https://y.example/1", SHOP, "exact_variant", "success", "length", False, False),
    ("power", "5 W", "", "e", "https://r.example/1", GOOD, "exact_variant", "success", None, False, False), ("volume", "{s} L", "", "e", "https://s.example/1", SHOP, "exact_variant", "success", None, False, False), ("depth", "{s} mm", "", "e", "https://a.example/1", BEST, "different_model", "success", "length", False, False),
    ("height", "{s} mm", "", "e", "https://a.example/1", BEST, None, "success", "length", False, False), ("noise", "{s} dB", "", " ", "https://a.example/1", BEST, "exact_variant", "success", None, False, False), ("speed", "n/a", "", "e", "https://a.example/1", BEST, "exact_variant", "success", None, False, False),
    ("port", "USB", "", "e", "https://a.example/1", BEST, "exact_variant", "blocked", None, False, False), ("storage", "{s} GB", "", "e", "https://a.example/1", BEST, "same_base_model", "success", None, True, False), ("ram", "{s} GB", "", "e", "https://a.example/1", BEST, "same_base_model", "success", None, True, True),
    ("timer", "Yes", None, "e", "https://a.example/1", BEST, "exact_variant", "success", "boolean", False, False), ("timer", "on", None, "e", "https://b.example/1", BEST, "exact_variant", "success", "boolean", False, False), ("timer", "yes", None, "e", "https://a.example/1#top", BEST, "exact_variant", "success", "boolean", False, False),
    ("size", "20 x {s} x 40", "mm", "e", "https://a.example/1", BEST, "exact_variant", "success", "length", False, False), ("size", "2 x 0{s}0.0 x 4,0", "mm", "f", "https://a.example/1", SHOP, "exact_variant", "success", "length", False, False),
    ("input", "1 kW", "", "e", "https://a.example/1", BEST, "exact_variant", "success", None, False, False), ("input", "1000 W", "", "e", "https://b.example/1", BEST, "exact_variant", "success", None, False, False), ("torque", "{s} Nm", "", "e", "https://a.example/1", SHOP, "exact_variant", "success", None, False, False),
)
CLAIMS = tuple((*c[:5], *c[5], *c[6:]) for c in _CLAIMS)
_NAMES = ("attribute", "value", "unit", "evidence", "source_url", "source_type", "authority", "confidence", "identity", "status", "family", "variant_sensitive", "model_wide")
# Attribute, status, value, source, confidence, reason, supporting, conflicting.
OUTCOMES = (
    ("mass", "Conflict", None, None, "low", "conflicting_equal_authority", 3, 1), ("colour", "Confirmed", "red", "https://a.example/p", "high", "equivalent_multi_source_evidence", 2, 0), ("width", "Confirmed", "5{s}", "https://z.example/1", "high", "higher_authority_source", 2, 1),
    ("power", "Confirmed", "5 W", "https://r.example/1", "medium", "specialized_exact_model_explicit", 1, 0), ("volume", "Unresolved", "{s} L", "https://s.example/1", "low", "insufficient_source_quality", 1, 0), ("depth", "Unresolved", None, None, "low", "no_valid_evidence", 0, 0),
    ("height", "Unresolved", None, None, "low", "insufficient_identity", 0, 0), ("noise", "Unresolved", None, None, "low", "missing_provenance", 0, 0), ("speed", "Unresolved", None, None, "low", "missing_provenance", 0, 0), ("port", "Unresolved", None, None, "low", "no_valid_evidence", 0, 0),
    ("storage", "Unresolved", None, None, "low", "insufficient_identity", 0, 0), ("ram", "Confirmed", "{s} GB", "https://a.example/1", "high", "official_exact_model_explicit", 1, 0), ("timer", "Confirmed", "Yes", "https://a.example/1", "high", "equivalent_multi_source_evidence", 2, 0),
    ("size", "Confirmed", "20 x {s} x 40", "https://a.example/1", "high", "higher_authority_source", 1, 1), ("input", "Conflict", None, None, "low", "conflicting_equal_authority", 1, 1), ("torque", "Unresolved", "{s} Nm", "https://a.example/1", "low", "ambiguous_scope", 1, 0), ("charger", "Unresolved", None, None, "low", "no_valid_evidence", 0, 0),
)
_OUTCOME = ("attribute", "status", "value", "source", "confidence", "reason", "n_support", "n_conflict")


def _composed_claims(spark, d):  # noqa: ANN001, ANN202
    return composed(spark, d, CLAIMS, _NAMES).withColumnsRenamed({"s_suppkey": "entity", "i": "seq"})


def _resolved(spark, d):  # noqa: ANN001, ANN202
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    expected = s.select("entity", F.explode(F.array(*[F.lit(o[0]) for o in OUTCOMES])).alias("attribute"))
    hints = s.select("entity", F.lit("torque").alias("attribute"), F.lit("ambiguous_scope").alias("reason")).unionByName(s.select("entity", F.lit("power").alias("attribute"), F.lit("ambiguous_scope").alias("reason")))
    return V.resolve(_composed_claims(spark, d), expected, hints)


@query(f"SELECT s_suppkey AS entity, attribute, status, value, source, confidence, reason, n_support::BIGINT AS n_support, n_conflict::BIGINT AS n_conflict FROM {stated(OUTCOMES, _OUTCOME, ('value',))}")
def resolve_rules(spark, d):  # noqa: ANN001, ANN201
    return _resolved(spark, d)


@query("""SELECT s_suppkey AS entity, attribute, code, n::BIGINT AS n FROM supplier, (VALUES ('depth', 'rejected_wrong_model', 1), ('port', 'rejected_source_state', 1), ('noise', 'rejected_missing_provenance', 1), ('speed', 'rejected_missing_provenance', 1),
('height', 'rejected_insufficient_identity', 1), ('storage', 'rejected_insufficient_identity', 1)) AS v(attribute, code, n)""")
def claim_diagnostics(spark, d):  # noqa: ANN001, ANN201
    return V.claim_diagnostics(_composed_claims(spark, d))


_SCHEMA = (("width", 1, True), ("mass", 2, True), ("port", 3, False), ("charger", 4, True))


@query(f"""SELECT entity, attribute, coalesce(e, false) AS expected, row_number() OVER (PARTITION BY entity ORDER BY coalesce(e, false) DESC, coalesce(place, 1073741824), attribute) AS row
FROM (SELECT s_suppkey AS entity, attribute FROM supplier, (VALUES {', '.join(f"('{o[0]}')" for o in OUTCOMES)}) AS o(attribute)) LEFT JOIN (VALUES ('width', 1, true), ('mass', 2, true), ('port', 3, false), ('charger', 4, true)) AS s(attribute, place, e) USING (attribute)""")
def final_profile(spark, d):  # noqa: ANN001, ANN201
    schema = spark.createDataFrame([(a, p, e, a.title()) for a, p, e in _SCHEMA], "attribute string, place int, expected boolean, label string")
    return V.final_profile(_resolved(spark, d), schema).select("entity", "attribute", "expected", "row")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 7 AS k FROM part) SELECT p_partkey AS entity, 'a' AS attribute, unnest(CASE k WHEN 0 THEN ['unknown status', 'confidence of what is not confirmed'] WHEN 1 THEN ['confirmed without value', 'confirmed without support'] WHEN 2 THEN ['conflict with a value'] WHEN 3 THEN ['repeated attribute'] WHEN 4 THEN ['confidence of what is not confirmed'] ELSE [] END) AS violation FROM p""")
def profile_violations(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey") % 7
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("entity"), F.lit("a").alias("attribute"), F.when(k == 0, "Odd").when(k == 1, "Confirmed").when(k == 2, "Conflict").when(k == 4, "Unresolved").otherwise("Confirmed").alias("status"),
        F.when(k == 1, " ").when(k == 4, None).otherwise("v").alias("value"), F.when(k == 2, "low").otherwise("high").alias("confidence"), F.when(k == 1, 0).otherwise(2).alias("n_support"), k.alias("k"),
    )
    return V.profile_violations(p.unionByName(p.filter("k = 3")).drop("k"))


# Source rows: seq, URL, final URL, status, type, authority, identity.
_SOURCES = ((1, "https://a.example/x", "https://a.example/y/", "success", "manufacturer", "verified", "exact_variant"), (2, "https://a.example/y", "https://b.example/", "blocked", "retailer", "unverified", "unknown"), (3, "https://www.c.example/q?utm_id=1", "", "success", "other", "unverified", "same_base_model"))
_CANDIDATES = ((1, "https://d.example/only", "", "success", "marketplace", "unverified", "unknown"), (2, "https://a.example/x", "", "error", "other", "unverified", "unknown"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'blocked' ELSE 'success' END AS status, CASE p_partkey % 5 WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'retailer' WHEN 2 THEN 'other' WHEN 3 THEN 'marketplace' ELSE 'unknown' END AS source_type,
CASE p_partkey % 5 WHEN 0 THEN 'verified' WHEN 4 THEN 'unknown' ELSE 'unverified' END AS authority, CASE p_partkey % 5 WHEN 0 THEN 'exact_variant' WHEN 2 THEN 'same_base_model' ELSE 'unknown' END AS identity FROM part""")
def source_metadata(spark, d):  # noqa: ANN001, ANN201
    schema = "seq int, source_url string, final_url string, status string, source_type string, authority string, identity string"
    url = F.get(F.array(*map(F.lit, ("https://a.example/y/", "https://a.example/y", "https://c.example/q#a", "https://D.example/only/", "https://nowhere.example/"))), (F.col("p_partkey") % 5).cast("int"))
    claims = table(spark, d, "part").select("p_partkey", url.alias("source_url"))
    return V.with_source_metadata(claims, spark.createDataFrame(_SOURCES, schema), spark.createDataFrame(_CANDIDATES, schema)).drop("source_url")


# ---------------------------------------------------------------- folds in order, as recursive SQL
SQL["tolerance_group_fold"] = """WITH RECURSIVE l AS (SELECT l_partkey AS entity, l_orderkey * 10 + l_linenumber AS seq, round(l_extendedprice / l_quantity, 1)::DOUBLE AS x, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem),
f AS (SELECT entity, seq, k, [x] AS heads, x FROM l WHERE k = 1
UNION ALL SELECT l.entity, l.seq, l.k, CASE WHEN len(list_filter(heads, lambda h: abs(h - l.x) <= 1.0000001)) > 0 THEN heads ELSE list_append(heads, l.x) END, l.x FROM f JOIN l ON l.entity = f.entity AND l.k = f.k + 1)
SELECT entity, seq, (list_position(list_transform(heads, lambda h: abs(h - x) <= 1.0000001), true) - 1)::INTEGER AS "group" FROM f"""

SQL["breaker_state"] = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch(ts)::DOUBLE AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT DISTINCT key, NULL::BIGINT AS seq, 0::BIGINT AS k, 0 AS failures, NULL::DOUBLE AS opened, 45::DOUBLE AS cooldown, 'closed' AS state FROM e
UNION ALL SELECT key, seq, k, CASE WHEN b = 'open' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN b = 'open' THEN opened WHEN ok THEN NULL WHEN b = 'half_open' OR failures + 1 >= 2 THEN t ELSE opened END,
    CASE WHEN b = 'open' THEN cooldown WHEN ok THEN 45 WHEN b = 'half_open' THEN least(2 * cooldown, 180) ELSE cooldown END, CASE WHEN b = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN b = 'half_open' OR failures + 1 >= 2 THEN 'open' ELSE 'closed' END
    FROM (SELECT e.key, e.seq, e.k, e.t, e.ok, failures, opened, cooldown, CASE WHEN opened IS NULL THEN 'closed' WHEN e.t - opened >= cooldown THEN 'half_open' ELSE 'open' END AS b FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1))
SELECT key, seq, state FROM f WHERE k > 0"""
