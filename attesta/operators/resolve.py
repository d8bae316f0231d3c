"""Resolution of claims: which value of an attribute is confirmed, which conflicts, and why one is not resolved.

A claim is a row: entity, attribute, seq (its place in the input), value, unit, source_url, source_type, authority
(verified or not), confidence (high, medium, low), identity (relation of the source's subject), status, model_wide.
All grouping is by (entity, attribute), so one shuffle serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measure import comparison_text, comparison_value, equivalent
from ..functions.text import blank, concrete
from ..functions.url import canonical_url

# Ranks of identities.
IDENTITY_RANK = {"exact_variant": 4, "same_base_model": 3, "probable_same_base_model": 2, "unknown": 1, "different_model": 0}


def authority_rank(source_type: Column, authority: Column) -> Column:
    kind = F.lower(source_type)
    return (
        F.when((authority == "verified") & kind.isin("manufacturer", "official_document"), 4)
        .when(kind.isin("specialized_reference", "specialized", "reference"), 3)
        .when(kind.isin("retailer", "marketplace", "distributor"), 2)
        .otherwise(1)
    )


def identity_rank(identity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in IDENTITY_RANK.items():
        out = F.when(identity == name, rank).otherwise(out)
    return out


def strong(rank: Column, confidence: Column) -> Column:
    """Weak sources never confirm, however many agree."""
    return ((rank == 4) & confidence.isin("high", "medium")) | ((rank == 3) & (confidence == "high"))


def compatible(identity: Column, variant_sensitive: Column, model_wide: Column) -> Column:
    exact = identity == "exact_variant"
    base = identity == "same_base_model"
    return F.when(variant_sensitive, exact | ((identity == "same_base_model") & model_wide)).otherwise(exact | base)


def _heads(values: Column) -> Column:
    """The first value of each group of values (an array of structs with cmp, in order): a value joins the first group whose first value it equals."""
    first = lambda x: F.struct(x["cmp"].alias("cmp"))
    empty = F.transform(F.slice(values, 1, 0), first)
    return F.aggregate(values, empty, lambda acc, x: F.when(F.exists(acc, lambda h: equivalent(h["cmp"], x["cmp"])), acc).otherwise(F.concat(acc, F.array(first(x)))))


def _group_of(heads: Column, cmp: Column) -> Column:
    """Place (from 1) of the first group that takes a value."""
    return F.array_position(F.transform(heads, lambda h: equivalent(h["cmp"], cmp)), True)


def greedy_groups(claims: DataFrame, keys: list[str], family: str | None = None) -> DataFrame:
    """Order-dependent groups within tolerance: a claim (seq, value, unit) joins the first group whose first value it equals, else opens one.

    Not a transitive closure. A row keys, seq, group (from 0) for each claim. Equal values always join the group of their first, so a
    key's claims are cut to its different values, each with its first seq, before these are folded in one row; claims then look theirs up."""
    keyed = claims.withColumn("_cmp", comparison_value(F.col("value"), F.coalesce("unit", F.lit("")), F.lit(family or "")))
    distinct = keyed.groupBy(*keys, "_cmp").agg(F.min("seq").alias("first"))
    lists = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("first"), F.col("_cmp").alias("cmp")))).alias("all"))
    lists = lists.withColumn("heads", _heads(F.col("all")))
    placed = lists.select(*keys, "heads", F.explode("all").alias("v")).select(*keys, F.col("v.cmp").alias("_cmp"), (_group_of(F.col("heads"), F.col("v.cmp")) - 1).cast("int").alias("group"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"g.{k}")) for k in (*keys, "_cmp")]
    return keyed.select(*keys, "seq", "_cmp").alias("c").join(placed.alias("g"), on).select(*[F.col(f"c.{k}") for k in keys], "c.seq", "g.group")


def with_source_metadata(claims: DataFrame, sources: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """claims (source_url) with status, source_type, authority, identity of their source.

    sources and candidates: seq, source_url, final_url, status, source_type, authority, identity. A claim takes the first source whose URL is its own, else
    the first whose canonical URL is, by either of its URLs, else the first candidate; without any, its status is success and the rest unknown."""
    facts = ["status", "source_type", "authority", "identity"]

    def first(rows: DataFrame, key: Column, name: str) -> DataFrame:
        g = rows.select("seq", key.alias("key"), F.struct(*facts).alias("m")).filter("key <> ''").groupBy("key").agg(F.min_by("m", "seq").alias(name))
        return g.withColumnRenamed("key", f"key_{name}")

    url = lambda c: canonical_url(F.coalesce(F.col(c), F.lit("")))
    out, found = claims.withColumn("_canonical", url("source_url")), [("direct", first(sources, F.col("source_url"), "direct"), "source_url")]
    both = sources.select("seq", *facts, F.explode(F.array(url("source_url"), url("final_url"))).alias("key"))
    found.append(("like", first(both, F.col("key"), "like"), "_canonical"))
    if candidates is not None:
        found.append(("candidate", first(candidates, url("source_url"), "candidate"), "_canonical"))
    for name, table, key in found:
        out = out.join(table, out[key] == table[f"key_{name}"], "left").drop(f"key_{name}")
    m = F.coalesce(*[F.col(name) for name, _, _ in found])
    default = {"status": "success", "source_type": "unknown", "authority": "unknown", "identity": "unknown"}
    return out.select(*claims.columns, *[F.coalesce(m[f], F.lit(default[f])).alias(f) for f in facts])


def first_claims(claims: DataFrame) -> DataFrame:
    """Of claims that say the same (entity, attribute, canonical source, words of value, unit and raw value, evidence) the first by seq."""
    key = [
        F.col("entity"), F.col("attribute"), F.coalesce(F.nullif(canonical_url(F.coalesce("source_url", F.lit(""))), F.lit("")), F.col("source_url")).alias("_url"),
        F.concat_ws("|", comparison_text(F.col("value")), comparison_text(F.col("unit")), comparison_text(F.col("raw_value"))).alias("_said"), F.col("evidence"),
    ]
    rest = [c for c in claims.columns if c not in ("entity", "attribute", "evidence")]
    return claims.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("_r")).select("entity", "attribute", "evidence", "_r.*").select(*claims.columns)


_OPTIONAL = {"unit": "string", "raw_value": "string", "evidence": "string", "family": "string", "variant_sensitive": "boolean", "model_wide": "boolean"}


def judged_claims(claims: DataFrame) -> DataFrame:
    """claims, the first of equal ones, with rank, usable, valid, fits, eligible, strong, cmp and order (of facts, the best first)."""
    for name, kind in _OPTIONAL.items():
        if name not in claims.columns:
            claims = claims.withColumn(name, F.col("source_url") if name == "evidence" else F.lit(None).cast(kind))
    rows = first_claims(claims).withColumn("rank", authority_rank(F.col("source_type"), F.coalesce("authority", F.lit(""))))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.withColumn("usable", (F.coalesce("identity", F.lit("unknown")) != "different_model") & (F.coalesce("status", F.lit("")) == "success"))
    rows = rows.withColumn("valid", F.col("usable") & F.coalesce(concrete(F.col("value")), F.lit(False)) & ~blank(F.col("source_url")) & ~blank(F.col("evidence")))
    rows = rows.withColumn("fits", F.coalesce(compatible(F.col("identity"), yes("variant_sensitive"), yes("model_wide")), F.lit(False)))
    rows = rows.withColumn("eligible", F.col("valid") & F.col("fits")).withColumn("strong", F.col("eligible") & F.coalesce(strong(F.col("rank"), F.col("confidence")), F.lit(False)))
    source = F.coalesce(F.nullif(canonical_url(F.coalesce("source_url", F.lit(""))), F.lit("")), F.col("source_url"))
    order = F.struct((-F.col("rank")).alias("rank"), (-F.coalesce(identity_rank(F.col("identity")), F.lit(0))).alias("identity"), source.alias("source"), comparison_text(F.col("value")).alias("text"), F.col("seq").alias("seq"))
    return rows.withColumn("cmp", comparison_value(F.col("value"), F.coalesce("unit", F.lit("")), F.coalesce("family", F.lit("")))).withColumn("order", order)


def resolve(claims: DataFrame, expected: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """entity, attribute, status, value, source, confidence, reason, n_support, n_conflict.

    Claims (entity, attribute, seq, value, source_url, source_type, authority, confidence, identity, status; unit, raw_value, evidence, family,
    variant_sensitive and model_wide if there are such) that say the same count once. Those of other models, of failed sources, without a
    concrete value, source or evidence, or of an identity that does not fit are not eligible; a null identity is an unknown one. Strong ones are
    grouped in the order of seq, within tolerance of each group's first value; the groups of the highest rank decide: one confirms, several
    conflict, none leaves the attribute unresolved. Support and conflict are counted among eligible claims; the value is that of the first
    supporting claim by rank, identity, source and text. Every expected (entity, attribute) has a row, also without claims. hints (entity,
    attribute, reason) tell reasons to prefer for what is unresolved. Only the different values of an attribute are brought together in a row.
    """
    key, rows = ["entity", "attribute"], judged_claims(claims)
    fact = F.struct("order", "value", "source_url")
    values = rows.groupBy(*key, "cmp").agg(
        F.min(F.when(F.col("strong"), F.col("seq"))).alias("strong_first"), F.max(F.when(F.col("strong"), F.col("rank"))).alias("top"), F.min(F.when(F.col("strong"), F.col("order"))).alias("strong_order"),
        F.min(F.when(F.col("eligible"), F.col("seq"))).alias("first"), F.count_if(F.col("eligible")).alias("n"), F.min(F.when(F.col("eligible"), fact)).alias("best"),
        F.min(F.when(F.col("eligible"), F.col("order.source"))).alias("low"), F.max(F.when(F.col("eligible"), F.col("order.source"))).alias("high"),
        F.max("valid").alias("valid"), F.max("usable").alias("usable"),
    )
    value = F.struct("first", "cmp", "n", "best", "low", "high")
    firm = F.struct(F.col("strong_first").alias("first"), F.col("cmp"), F.col("top"), F.col("strong_order").alias("order"))
    per = values.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("strong_first").isNotNull(), firm))).alias("strong"), F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), value))).alias("all"),
        F.max("valid").alias("valid"), F.max("usable").alias("usable"),
    )
    per = per.withColumn("heads", _heads(F.col("strong"))).withColumn("all_heads", _heads(F.col("all")))
    members = lambda h: F.filter("strong", lambda v: F.get(F.col("heads"), (_group_of(F.col("heads"), v["cmp"]) - 1).cast("int"))["cmp"] == h["cmp"])
    groups = F.transform("heads", lambda h: F.struct(F.array_max(F.transform(members(h), lambda v: v["top"])).alias("top"), F.array_min(F.transform(members(h), lambda v: v["order"])).alias("order"), h["cmp"].alias("cmp")))
    per = per.withColumn("groups", groups).withColumn("best_rank", F.array_max(F.transform("groups", lambda g: g["top"])))
    per = per.withColumn("tops", F.array_sort(F.transform(F.filter("groups", lambda g: g["top"] == F.col("best_rank")), lambda g: F.struct(g["order"], g["cmp"]))))
    per = per.withColumn("winner", F.get("tops", 0)["cmp"])
    backs = lambda v: equivalent(F.get(F.col("all_heads"), (_group_of(F.col("all_heads"), v["cmp"]) - 1).cast("int"))["cmp"], F.col("winner"))
    per = per.withColumn("support", F.when(F.size("tops") > 0, F.filter("all", backs)).otherwise(F.col("all")))
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v["n"])
    n_support, n_all = count("support"), count("all")
    one, none = F.size("tops") == 1, F.size("tops") == 0
    first = F.array_min(F.transform("support", lambda v: v["best"]))
    several = F.array_min(F.transform("support", lambda v: v["low"])) != F.array_max(F.transform("support", lambda v: v["high"]))
    status = F.when(none, "Unresolved").when(one, "Confirmed").otherwise("Conflict")
    lacking = F.when(F.size("all") > 0, "insufficient_source_quality").when(F.col("valid"), "insufficient_identity").when(F.col("usable"), "missing_provenance").otherwise("no_valid_evidence")
    reason = (
        F.when(none, lacking).when(~one, "conflicting_equal_authority").when(n_all > n_support, "higher_authority_source").when(several, "equivalent_multi_source_evidence")
        .when(F.col("best_rank") == 4, "official_exact_model_explicit").otherwise("specialized_exact_model_explicit")
    )
    out = per.select(
        *key, status.alias("status"), F.when(one | none, first["value"]).alias("value"), F.when(one | none, first["source_url"]).alias("source"),
        F.when(one & (F.col("best_rank") == 4), "high").when(one, "medium").otherwise("low").alias("confidence"), reason.alias("reason"), n_support.alias("n_support"), (n_all - n_support).alias("n_conflict"),
    )
    if expected is not None:
        out = expected.select(*key).distinct().join(out, key, "full")
    if hints is not None:
        out = out.join(hints.groupBy(*key).agg(F.min("reason").alias("hint")), key, "left")
    told = F.when(F.coalesce("status", F.lit("Unresolved")) == "Unresolved", F.col("hint")) if hints is not None else F.lit(None).cast("string")
    return out.select(
        *key, F.coalesce("status", F.lit("Unresolved")).alias("status"), "value", "source", F.coalesce("confidence", F.lit("low")).alias("confidence"),
        F.coalesce(told, F.col("reason"), F.lit("no_valid_evidence")).alias("reason"), F.coalesce("n_support", F.lit(0)).alias("n_support"), F.coalesce("n_conflict", F.lit(0)).alias("n_conflict"),
    )


def claim_diagnostics(claims: DataFrame) -> DataFrame:
    """entity, attribute, code, n: why claims of an attribute were not eligible."""
    rows = judged_claims(claims)
    code = (
        F.when(F.coalesce("identity", F.lit("")) == "different_model", "rejected_wrong_model").when(F.coalesce("status", F.lit("")) != "success", "rejected_source_state")
        .when(~F.col("valid"), "rejected_missing_provenance").when(~F.col("fits"), "rejected_insufficient_identity")
    )
    return rows.withColumn("code", code).filter("code is not null").groupBy("entity", "attribute", "code").agg(F.count("*").alias("n"))


def final_profile(resolved: DataFrame, schema: DataFrame) -> DataFrame:
    """resolved with the schema's (attribute, place, expected, label) and its place in the profile: expected attributes in the order of the schema, others by name."""
    d = schema.groupBy("attribute").agg(F.min("place").alias("place"), F.max("expected").alias("expected"), F.min_by("label", "place").alias("label"))
    j = resolved.join(F.broadcast(d), "attribute", "left").withColumn("expected", F.coalesce("expected", F.lit(False)))
    order = Window.partitionBy("entity").orderBy(F.desc("expected"), F.coalesce("place", F.lit(1 << 30)), "attribute")
    return j.withColumn("row", F.row_number().over(order))


def profile_violations(profile: DataFrame) -> DataFrame:
    """entity, attribute, violation of a profile (entity, attribute, status, value, confidence, expected, n_support): no rows if it is sound."""
    profile = profile.withColumn("_n", F.count("*").over(Window.partitionBy("entity", "attribute")))
    checks = {
        "repeated attribute": F.col("_n") > 1,
        "unknown status": ~F.coalesce(F.col("status").isin("Confirmed", "Conflict", "Unresolved"), F.lit(False)),
        "confirmed without value": (F.col("status") == "Confirmed") & blank(F.col("value")),
        "confirmed without support": (F.col("status") == "Confirmed") & (F.coalesce("n_support", F.lit(0)) == 0),
        "conflict with a value": (F.col("status") == "Conflict") & F.col("value").isNotNull(),
        "confidence of what is not confirmed": (F.col("status") != "Confirmed") & (F.col("confidence") != "low"),
    }
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    return profile.select("entity", "attribute", F.explode(found).alias("violation")).distinct()


def missing_expected(profile: DataFrame, expected: DataFrame) -> DataFrame:
    """The expected (entity, attribute) that a profile has no row for."""
    return expected.select("entity", "attribute").distinct().join(profile, ["entity", "attribute"], "left_anti")


def quality_status(profile: DataFrame) -> DataFrame:
    """entity, coverage, found_ratio, confirmed_ratio, high_ratio, quality of rows (entity, status, confidence, expected, critical,
    and for the entity: category, category_confidence, identity_confidence). Only expected attributes count."""
    own = profile.filter("expected")
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    crit, conf = F.col("critical"), F.col("status") == "Confirmed"
    n = own.groupBy("entity", "category", "category_confidence", "identity_confidence").agg(
        F.count("*").alias("n"), flag(conf).alias("confirmed"), flag(crit).alias("critical"), flag(crit & (F.col("status") != "Unresolved")).alias("found"),
        flag(crit & conf).alias("critical_confirmed"), flag(crit & conf & (F.col("confidence") == "high")).alias("high"), flag(crit & (F.col("status") == "Conflict")).alias("conflicts"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    r = n.select("*", part("confirmed", "n").alias("coverage"), part("found", "critical").alias("found_ratio"), part("critical_confirmed", "critical").alias("confirmed_ratio"), part("high", "critical_confirmed").alias("high_ratio"))
    quality = (
        F.when(F.col("conflicts") > 0, "conflicted")
        .when(F.col("category").isNull() | (F.col("category") == "unknown") | (F.col("identity_confidence") == "low"), "insufficient")
        .when((F.col("coverage") < 0.25) | (F.col("found_ratio") < 0.34), "insufficient")
        .when((F.col("coverage") >= 0.40) & (F.col("confirmed_ratio") >= 0.75) & (F.col("found_ratio") >= 1.0) & (F.col("high_ratio") >= 0.5) & (F.col("category_confidence") != "low"), "verified")
        .otherwise("partial")
    )
    return r.select("entity", "coverage", "found_ratio", "confirmed_ratio", "high_ratio", quality.alias("quality"))


def gap_states(schema: DataFrame, coverage: DataFrame) -> DataFrame:
    """entity, attribute, gap of expected attributes: satisfied, ambiguous, missing_low or missing_searchable, in this order.

    schema (entity, attribute, expected, priority), coverage (entity, attribute, n_mapped, n_ambiguous)."""
    j = schema.join(coverage, ["entity", "attribute"], "left")
    state = F.when(F.coalesce("n_mapped", F.lit(0)) > 0, "satisfied").when(~F.col("expected"), "not_expected").when(F.coalesce("n_ambiguous", F.lit(0)) > 0, "ambiguous").when(F.col("priority") == "low", "missing_low").otherwise("missing_searchable")
    return j.select("entity", "attribute", state.alias("gap"))
