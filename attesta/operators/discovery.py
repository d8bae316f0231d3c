"""Search results, fetched pages and documents as tables: gates, authority, selection, traces, merges. All keys are URLs or registrable domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identity as I
from ..functions import url as U

# Words that make a company, that claim a relation, sites that are no product sites, order of locales.
COMPANY = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "gmbh", "ag", "sa", "spa", "srl", "kk", "group", "holding", "holdings", "plc", "ооо", "оао", "зао", "пао", "ип")
DISTRIBUTOR = (
    "official distributor", "authorized distributor", "exclusive distributor", "official importer", "authorized importer", "official supplier", "official supply", "official deliveries", "официальный дистрибьютор", "эксклюзивный дистрибьютор",
    "официальный импортер", "официальный импортёр", "официальные поставки", "официальный поставщик",
)
DEALER = (
    "authorized dealer", "official dealer", "authorized reseller", "official reseller", "certified dealer", "official partner", "authorized partner", "official retailer", "official seller", "официальный дилер", "авторизованный дилер",
    "официальный партнер", "официальный партнёр", "официальный продавец", "официальный представитель", "авторизованный реселлер", "официальный реселлер",
)
NO_PRODUCTS = ("press", "media", "news", "job", "career", "karriere", "blog", "invest", "foundation", "stiftung", "corporate", "group", "csr", "sustainab", "legal", "privacy", "academy", "stories", "shop", "store", "outlet", "reseller", "dealer", "market", "mall")
STATIC = ("assets", "static", "media", "images", "image", "files", "cdn", "upload", "uploads", "fonts")
LOCALES = ("ENG", "AEN", "EN", "EN_GB", "EN-GB", "EN_US", "RUS", "RU")
CHECK = "content verification"


def _t(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def root_label(domain: Column) -> Column:
    """The registrable domain without its public suffix."""
    return F.substring_index(U.registrable_domain(domain), ".", 1)


# ---------------------------------------------------------------- relevance
def relevance(candidates: DataFrame) -> DataFrame:
    """candidates (url, title, model, article, authority, source_type, query) with relation (exact, likely_variant, weak or reject) and reason, by the
    first rule that a result meets. Authority never makes a result relevant; it only lets a silent page be fetched once for a check."""
    m, t, u = F.col("model"), F.concat_ws(" ", "title", "url"), F.col("url")
    rows = candidates.withColumn("_match", I.candidate_match(m, F.col("title"), u)).withColumn("_kind", U.page_kind(u)).withColumn("_sku", I.sku_kind(m, F.concat_ws(" ", "title", U.path(_t("url")))))
    path = I.compact(U.path(_t("url")))
    other_item = (F.col("_kind") == "product") & (F.size(F.filter(I.parts(m), lambda p: F.length(p) >= 3)) > 0) & ~F.exists(F.filter(I.parts(m), lambda p: F.length(p) >= 3), lambda p: path.contains(p))
    accessory = F.lower(t).rlike(r"\b(?:case|cover|charger|adapter|replacement|spare part|accessor(?:y|ies)|compatible with|for use with)\b")
    person = F.lower(t).rlike(r"\b(?:wikipedia|biography|footballer|actor|player profile|linkedin|forum)\b") | U.not_a_product(u)
    generic = F.col("_kind").isin("catalog", "homepage", "weak")
    exact = (F.col("_match") == "exact") | I.base_model_in_text(m, t)
    whole = F.forall(I.parts(m), lambda p: path.contains(p))
    asked = F.coalesce(I.base_model_in_text(m, F.col("query")), F.lit(False))
    row = lambda r, why: F.struct(F.lit(r).alias("relation"), F.lit(why).alias("reason"))
    out = (
        F.when(F.col("_match") == "different_variant", row("reject", "another variant")).when(U.search_landing(u), row("reject", "search landing")).when(F.col("_match") == "mismatch", row("reject", "conflicting identifier"))
        .when(person, row("reject", "no product context")).when(accessory, row("reject", "accessory")).when(other_item, row("reject", "another item"))
        .when((F.col("_match") == "likely_variant") & (F.col("_sku") == "regional_suffix"), row("exact", "regional suffix")).when(F.col("_match") == "likely_variant", row("likely_variant", "variant suffix"))
        .when(exact & generic, row("weak", "generic page")).when(exact & ~whole, row("weak", "incomplete url")).when(exact, row("exact", "model named"))
        .when(I.article_matches(F.col("article"), t), row("exact", "article named")).when(F.col("_match") == "likely", row("weak", "probable base model"))
        .when(asked & I.is_official(F.col("source_type"), F.col("authority")) & ~generic, row("weak", CHECK)).otherwise(row("reject", "model absent"))
    )
    return rows.withColumn("_r", out).select(*candidates.columns, F.col("_match").alias("model_match"), "_r.relation", "_r.reason")


def discovery_trace(raw: DataFrame, judged: DataFrame) -> DataFrame:
    """raw (seq, url) with outcome: invalid (no URL), rejected, accepted (the first of a canonical URL) or merged_duplicate; judged (url, relation)."""
    keyed = raw.withColumn("canonical", U.canonical_url(_t("url")))
    verdict = judged.select(U.canonical_url(_t("url")).alias("canonical"), (F.col("relation") == "reject").alias("no")).filter("canonical <> ''").groupBy("canonical").agg(F.min("no").alias("no"))
    first = keyed.filter("canonical <> ''").groupBy("canonical").agg(F.min("seq").alias("first"))
    j = keyed.join(verdict, "canonical", "left").join(first, "canonical", "left")
    outcome = F.when(F.col("canonical") == "", "invalid").when(F.coalesce("no", F.lit(True)), "rejected").when(F.col("seq") == F.col("first"), "accepted").otherwise("merged_duplicate")
    return j.select("seq", "url", outcome.alias("outcome"))


def provider_counts(attempts: DataFrame, judged: DataFrame) -> DataFrame:
    """attempts (provider) with accepted, rejected: different URLs, and official: the first accepted official URL. judged: url, relation, providers (array), source_type, authority."""
    each = judged.select("url", "relation", I.is_official(F.col("source_type"), F.col("authority")).alias("official"), F.explode(F.array_distinct("providers")).alias("provider"))
    g = each.groupBy("provider").agg(
        F.countDistinct(F.when(F.col("relation") != "reject", F.col("url"))).alias("accepted"), F.countDistinct(F.when(F.col("relation") == "reject", F.col("url"))).alias("rejected"), F.min(F.when((F.col("relation") != "reject") & F.col("official"), F.col("url"))).alias("official")
    )
    return attempts.join(g, "provider", "left").select(*attempts.columns, F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("rejected", F.lit(0)).alias("rejected"), "official")


# ---------------------------------------------------------------- authority
def entity_key(c: Column) -> Column:
    """Words of a name together, company forms at its end left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    company = F.array(*map(F.lit, COMPANY))
    kept = F.aggregate(F.reverse(words), F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & F.array_contains(company, w), acc).otherwise(F.concat(F.array(w), acc)))
    return F.array_join(kept, "")


def self_declared(domain: Column, brand: Column, text: Column, names: Column) -> Column:
    """The role that a page claims: official_distributor, authorized_dealer or manufacturer if its domain agrees with the brand, else unknown.

    names: what the page calls its owner (organizations and brands in linked data, site names); a copyright line counts too."""
    key, label = I.compact(F.coalesce(brand, F.lit(""))), I.compact(F.substring_index(domain, ".", 1))
    consistent = (F.length(key) >= 3) & (label != "") & (label.startswith(key) | key.startswith(label))
    low = F.lower(F.coalesce(text, F.lit("")))
    says = lambda marks: low.rlike("|".join(marks))
    notices = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(?:©|\(c\)|copyright)\s*\d{4}(?:\s*[-–—]\s*\d{4})?\s+([^.,;\n]{1,60})"), 1)
    own = F.exists(F.concat(F.coalesce(names, F.array().cast("array<string>")), notices), lambda n: entity_key(n) == entity_key(brand))
    return F.when(~consistent, "unknown").when(says(DISTRIBUTOR), "official_distributor").when(says(DEALER), "authorized_dealer").when(own, "manufacturer").otherwise("unknown")


def corroboration(domains: DataFrame, links: DataFrame) -> DataFrame:
    """domains (domain) with evidence: a trusted domain whose page links to the domain, above or below it; links (trusted, host).

    An equi-join on registrable domains, then the exact relation, as hosts of one relation share that domain."""
    bare = lambda c: F.regexp_replace(F.lower(_t(c)), r"^www\.", "")
    d = domains.select("domain").distinct().withColumn("_d", bare("domain")).filter("_d <> ''").withColumn("_root", U.registrable_domain(F.col("_d")))
    h = links.select("trusted", bare("host").alias("_h")).filter("_h <> ''").distinct().withColumn("_root", U.registrable_domain(F.col("_h")))
    related = (F.col("_d") == F.col("_h")) | F.col("_d").endswith(F.concat(F.lit("."), F.col("_h"))) | F.col("_h").endswith(F.concat(F.lit("."), F.col("_d")))
    found = d.join(h, "_root").filter(related).groupBy("domain").agg(F.min("trusted").alias("evidence"))
    return domains.join(found, "domain", "left")


def resolve_authority(pages: DataFrame) -> DataFrame:
    """pages (url, domain, brand, text, names, links, source_type, authority) with role, and with source_type and authority of pages whose claim a verified
    manufacturer's page confirms by a link. Without that a claim makes a retailer; a marketplace is never more."""
    official = (F.col("source_type") == "manufacturer") & (F.col("authority") == "verified")
    links = pages.filter(official).select(F.col("domain").alias("trusted"), F.explode("links").alias("link")).select("trusted", U.host(F.col("link")).alias("host"))
    rows = corroboration(pages, links)
    claim = self_declared(F.col("domain"), F.col("brand"), F.col("text"), F.col("names"))
    market = F.substring_index(U.registrable_domain(F.col("domain")), ".", 1).isin(*U.MARKETPLACES)
    rows = rows.withColumn("_claim", claim).withColumn("role", F.when(market, "marketplace").when(F.col("_claim") == "unknown", "unknown").when(F.col("evidence").isNotNull(), F.col("_claim")).otherwise("retailer"))
    rows = rows.withColumn("role", F.when(F.coalesce("authority", F.lit("unknown")) == "unknown", F.col("role")))
    raised = F.col("role").isin("manufacturer", "official_distributor", "authorized_dealer")
    kind = F.when(raised, F.when(F.col("role") == "manufacturer", "manufacturer").otherwise("retailer")).otherwise(F.col("source_type"))
    return rows.withColumn("source_type", kind).withColumn("authority", F.when(raised, "verified").otherwise(F.col("authority"))).drop("_claim")


def official_domains(brand_results: DataFrame, product_results: DataFrame) -> DataFrame:
    """brand, domain, evidence (URL), score of domains proven to be a brand's, the best result of each.

    brand_results (brand, position, url, title): a title that says official and names the brand, on a domain like it; or a domain that is exactly the
    brand's name, with another result on it that names the model. product_results (brand, model, position, url, title): an exact page on such a domain."""
    host, title = U.host(F.col("url")), F.col("title")
    key, label = _slug(F.col("brand")), _slug(F.substring_index(host, ".", 1))
    b = brand_results.withColumn("root", U.registrable_domain(host)).withColumn("domain", host).withColumn("evidence", U.canonical_url(F.col("url")))
    like = (key != "") & (label.contains(key) | ((label != "") & key.contains(label)) | (root_label(host) == key))
    named = I.compact(title).contains(I.compact(F.col("brand")))
    b = b.withColumn("claims", F.lower(title).rlike("official|официаль")).withColumn("exact_root", (root_label(host) == key) & (F.length(key) >= 3)).filter(like & named)
    p = product_results.filter(~U.search_landing(F.col("url"))).withColumn("root", U.registrable_domain(host)).withColumn("evidence", U.canonical_url(F.col("url")))
    exact = p.filter(I.match_model(F.col("model"), F.concat_ws(" ", "title", "url")) == "exact").select("brand", "root", F.col("evidence").alias("other")).distinct()
    claimed = b.filter("claims").select("brand", "domain", "evidence", (F.lit(120) - F.col("position")).alias("score"))
    proven = b.filter("not claims and exact_root").join(exact, ["brand", "root"]).filter("other <> evidence").select("brand", F.col("root").alias("domain"), "evidence", (F.lit(100) - F.col("position")).alias("score"))
    own = p.filter((root_label(host) == _slug(F.col("brand"))) & (F.length(key) >= 2) & I.compact(F.concat_ws(" ", "title", "url")).contains(I.compact(F.col("brand"))) & I.candidate_match(F.col("model"), F.col("title"), F.col("url")).isin("exact", "likely_variant"))
    direct = own.select("brand", F.col("root").alias("domain"), "evidence", (F.lit(90) - F.col("position")).alias("score"))
    every = claimed.unionByName(proven).unionByName(direct)
    return every.groupBy("brand", "domain").agg(F.max(F.struct("score", "evidence")).alias("r")).select("brand", "domain", "r.evidence", "r.score")


def family_domains(pages: DataFrame, limit: int) -> DataFrame:
    """brand, label, domain, n_roots, n_links, place: sibling sites (brand and a word) that official pages (brand, url, html) link to.

    Labels on many public suffixes come first, then those with many links; of a label the .com domain, then the one with most links. limit a brand."""
    found = pages.select("brand", U.registrable_domain(U.host(F.col("url"))).alias("own"), F.explode(F.array_distinct(F.regexp_extract_all(_t("html"), F.lit(r"""(https?://[^\s"'<>)\\]+)"""), 1))).alias("link"))
    found = found.withColumn("root", U.registrable_domain(U.host(F.col("link")))).withColumn("label", F.substring_index("root", ".", 1)).withColumn("slug", _slug(F.col("brand")))
    word = F.substring(F.col("label"), F.length("slug") + 1, F.length("label"))
    sibling = (F.length("slug") >= 4) & F.col("label").startswith(F.col("slug")) & (F.length(word) >= 3) & ~word.rlike("|".join(NO_PRODUCTS)) & (F.col("root") != F.col("own"))
    roots = found.filter(sibling).groupBy("brand", "label", "root").agg(F.count("*").alias("links"))
    best = F.min_by("root", F.struct((~F.col("root").endswith(".com")).alias("a"), (-F.col("links")).alias("b"), F.col("root").alias("c")))
    labels = roots.groupBy("brand", "label").agg(best.alias("domain"), F.count("*").alias("n_roots"), F.sum("links").alias("n_links"), F.min("root").alias("_first"))
    place = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("n_roots"), F.desc("n_links"), "_first"))
    return labels.withColumn("place", place).filter(F.col("place") <= limit).drop("_first")


def sku_prefixes(texts: DataFrame, limit: int = 2) -> DataFrame:
    """domain, prefix, n: path prefixes before stock numbers in texts (domain, text) that two numbers or more share; the `limit` with most of each domain."""
    pattern = r"(/(?:[A-Za-z][A-Za-z_-]{0,14}/){1,3}[A-Za-z]{1,6}[0-9]{3,}[A-Za-z0-9]{0,4}(?:[_-][0-9A-Za-z]{1,3})?)/[A-Za-z0-9._%-]{3,}"
    hit = texts.select("domain", F.explode(F.regexp_extract_all(_t("text"), F.lit(pattern), 1)).alias("hit"))
    split = r"^(.*/)([^/]+)$"
    rows = hit.select("domain", F.regexp_extract("hit", split, 1).alias("prefix"), F.upper(F.regexp_extract("hit", split, 2)).alias("token"))
    rows = rows.filter(~F.arrays_overlap(F.split(F.lower("prefix"), "/"), U.strings(STATIC)))
    g = rows.groupBy("domain", "prefix").agg(F.countDistinct("token").alias("n")).filter("n >= 2")
    return g.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "prefix"))).filter(F.col("_n") <= limit).drop("_n")


def official_hosts(candidates: DataFrame) -> DataFrame:
    """entity, hosts: the registrable domains of verified official candidates (entity, seq, domain, source_type, authority), in the order of seq."""
    own = candidates.filter(I.is_official(F.col("source_type"), F.col("authority"))).select("entity", "seq", U.registrable_domain(_t("domain")).alias("host")).filter("host <> ''")
    first = own.groupBy("entity", "host").agg(F.min("seq").alias("seq"))
    return first.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "host"))), lambda x: x["host"]).alias("hosts"))


# ---------------------------------------------------------------- selection
def select_sources(candidates: DataFrame, limit: int) -> DataFrame:
    """entity, url, tier, place of the candidates to fetch: entity, seq, url, score, relation, model_match, identity, authority, source_type, reason.

    Rejected ones and those of other models go; of a canonical URL the best score stays, the first of equals. Seven tiers, which depend on whether any
    exact official page is there; one of each host and source type and one ordinary weak page come first, the rest by rank fills up to limit."""
    rows = candidates.withColumn("_url", U.canonical_url(_t("url"))).filter(F.col("_url") != "")
    rows = rows.filter((_t("relation") != "reject") & (_t("identity") != "different_model") & (_t("model_match") != "mismatch"))
    best = rows.groupBy("entity", "_url").agg(F.max_by(F.struct(*candidates.columns), F.struct("score", (-F.col("seq")).alias("s"))).alias("r")).select("r.*")
    official, verified = I.is_official(F.col("source_type"), F.col("authority")), _t("authority") == "verified"
    exact = (_t("model_match") == "exact") & _t("identity").isin("same_base_model", "exact_variant")
    best = best.withColumn("_any", F.max(official & exact).over(Window.partitionBy("entity")))
    weak, asks = _t("relation") == "weak", F.lower(_t("reason")).contains(CHECK)
    check = official & weak & (F.coalesce("identity", F.lit("unknown")) == "unknown") & asks
    tier = (
        F.when(weak & ~check, 6).when(verified & exact & (F.col("source_type") == "official_document"), 0).when(verified & exact & (F.col("source_type") == "manufacturer"), 1)
        .when((F.col("source_type") == "specialized_reference") & exact, F.when(F.col("_any"), 2).otherwise(3)).when(check, F.when(F.col("_any"), 3).otherwise(2)).when(~weak, 4).otherwise(5)
    )
    rank = [F.col("tier"), F.desc("score"), F.col("url")]
    by_entity = Window.partitionBy("entity")
    best = best.withColumn("tier", tier).withColumn("ordinary", weak & ~asks).withColumn("host", U.host(_t("url")))
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("entity", "host", F.coalesce("source_type", F.lit("other"))).orderBy(*rank)))
    # One ordinary weak page at most: the first that leads its host and type, else the first of all.
    lone = Window.partitionBy("entity", F.col("ordinary")).orderBy(F.col("nth") > 1, *rank)
    best = best.withColumn("weak_place", F.row_number().over(lone)).filter(~F.col("ordinary") | (F.col("weak_place") == 1))
    place = F.row_number().over(by_entity.orderBy((F.col("nth") > 1), *rank))
    return best.withColumn("place", place).filter(F.col("place") <= limit).select("entity", "url", "tier", "place")


def all_fetched(first: DataFrame, targeted: DataFrame) -> DataFrame:
    """Rows (entity, seq, source_url, ...) of both, one for each entity and URL: the first search's, then the least seq."""
    rows = first.withColumn("_late", F.lit(0)).unionByName(targeted.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    keep = [c for c in rows.columns if c not in ("entity", "source_url", "_late")]
    return rows.groupBy("entity", "source_url").agg(F.min_by(F.struct(*keep), F.struct("_late", "seq")).alias("r")).select("entity", "source_url", "r.*")


def url_set(*columns: Column) -> Column:
    """The different canonical URLs among columns, those that are none left out."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*[U.canonical_url(F.coalesce(c, F.lit(""))) for c in columns]), lambda u: u != "")))


# ---------------------------------------------------------------- documents
def merge_documents(documents: DataFrame) -> DataFrame:
    """entity, key, url, kind, match, found_on, place: one row for each canonical document URL of documents (entity, seq, url, kind, match, found_on).

    An exact match stands over others, the first of equals; found_on is the union in the order of seq. Exact ones come first, then by kind and URL."""
    rank = F.when(F.col("match") == "exact", 0).otherwise(1)
    keyed = documents.withColumn("key", F.coalesce(F.nullif(I.document_url(_t("url")), F.lit("")), F.col("url")))
    g = keyed.groupBy("entity", "key").agg(F.min_by(F.struct("url", "kind", "match"), F.struct(rank.alias("r"), F.col("seq"))).alias("d"), F.array_sort(F.collect_list(F.struct("seq", "found_on"))).alias("f"))
    g = g.select("entity", "key", "d.*", F.array_distinct(F.flatten(F.transform("f", lambda x: x["found_on"]))).alias("found_on"))
    order = F.when(F.col("match") == "exact", 0).when(F.col("match") == "probable", 1).otherwise(2)
    return g.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(order, "kind", "url")))


def collapse_locales(documents: DataFrame) -> DataFrame:
    """documents (entity, url, kind, title, page, locale) with one row for each kind, title and page that locales share: the English one, else the
    first by URL; locales lists all in that order. Rows without a locale stay."""
    rank = F.coalesce(F.nullif(F.array_position(U.strings(LOCALES), F.upper("locale")), F.lit(0)), F.lit(len(LOCALES) + 1))
    said = F.trim(F.regexp_replace(F.lower(_t("title")), r"[^\p{L}\p{N}_]+", " "))
    some = documents.filter("locale is not null and locale <> ''").groupBy("entity", "kind", said.alias("said"), "page").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("url"), F.col("title"), F.col("locale")))).alias("m"))
    one = some.select("entity", F.col("m")[0]["url"].alias("url"), "kind", F.col("m")[0]["title"].alias("title"), "page", F.array_distinct(F.transform("m", lambda x: x["locale"])).alias("locales"))
    rest = documents.filter("locale is null or locale = ''").select("entity", "url", "kind", "title", "page", F.array().cast("array<string>").alias("locales"))
    return one.unionByName(rest)


def with_verdicts(documents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """documents (url, match, ...) with the match and evidence of verdicts (url, match, evidence) where a file's text was read."""
    v = verdicts.groupBy("url").agg(F.min(F.struct("match", "evidence")).alias("v"))
    return documents.join(v, "url", "left").withColumn("match", F.coalesce("v.match", "match")).withColumn("evidence", F.coalesce("v.evidence", F.lit(""))).drop("v")


def first_images(images: DataFrame, limit: int) -> DataFrame:
    """entity, url, place of images (entity, seq, official, url): official pages first, then seq; equal URLs once; limit an entity."""
    key = F.regexp_replace("url", r"\?.*$", "")
    g = images.groupBy("entity", key.alias("key")).agg(F.min(F.struct((~F.col("official")).alias("late"), F.col("seq"), F.col("url"))).alias("r"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("r"))).filter(F.col("place") <= limit).select("entity", "r.url", "place")


def official_first(sources: DataFrame) -> DataFrame:
    """sources (entity, seq, source_type, authority) with place: official ones first, in the order of seq."""
    return sources.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(~I.is_official(F.col("source_type"), F.col("authority")), "seq")))


def rejected_examples(rejected: DataFrame, limit: int) -> DataFrame:
    """entity, reason, url: the first (by seq) of each reason, limit an entity, in the order of seq."""
    first = rejected.groupBy("entity", "reason").agg(F.min(F.struct("seq", "url")).alias("r")).select("entity", "reason", "r.*")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy("seq"))).filter(F.col("_n") <= limit).select("entity", "reason", "url")


def inspection_summary(inspections: DataFrame) -> DataFrame:
    """entity, pages, primary, expandable, any_script of inspections (entity, seq, url, match, expandable, needs_script): the exact page first; any_script is
    true if any page is, unknown before false."""
    order = F.struct((F.col("match") != "exact").alias("a"), F.col("seq").alias("b"))
    rank = F.when(F.col("needs_script") == "true", 0).when(F.col("needs_script") == "unknown", 1).otherwise(2)
    return inspections.groupBy("entity").agg(F.count("*").alias("pages"), F.min_by("url", order).alias("primary"), F.min_by("expandable", order).alias("expandable"), F.min_by("needs_script", rank).alias("any_script"))


# ---------------------------------------------------------------- targeted search
def search_plan(gaps: DataFrame, per_field: int = 3) -> DataFrame:
    """entity, attribute, place, query for gaps (entity, attribute, gap, brand, model, aliases): only what is missing and searchable, with the brand,
    model and the attribute's first names, quoted model first; per_field queries a field."""
    own = gaps.filter("gap = 'missing_searchable' and coalesce(model, '') <> ''")
    names = F.concat(F.array(F.regexp_replace("attribute", "_", " ")), F.coalesce("aliases", F.array().cast("array<string>")))
    each = F.transform(F.array_distinct(names), lambda n: F.concat(F.concat_ws(" ", "brand", F.concat(F.lit('"'), F.col("model"), F.lit('"'))), F.lit(" "), n))
    return own.select("entity", "attribute", F.posexplode(each).alias("place", "query")).filter(F.col("place") < per_field)


def targeted_rejection(candidates: DataFrame) -> DataFrame:
    """candidates (url, title, model, source_type) with rejection: why a result of a targeted search is not fetched; null if it is."""
    match = I.candidate_match(F.col("model"), F.col("title"), F.col("url"))
    why = (
        F.when(U.canonical_url(_t("url")) == "", "no url").when(match.isin("mismatch", "different_variant"), "another model").when(U.search_landing(F.col("url")) | U.page_kind(_t("url")).isin("homepage", "catalog"), "no product page")
        .when(~match.isin("exact", "likely_variant", "likely"), "model not named").when(_t("source_type") == "marketplace", "marketplace")
    )
    return candidates.withColumn("rejection", why)


def until_no_gain(attempts: DataFrame, most: int = 5) -> DataFrame:
    """attempts (entity, seq, gained) up to the one that makes `most` in a row without gain; those after it were never made."""
    order = Window.partitionBy("entity").orderBy("seq")
    rows = attempts.withColumn("_run", F.sum(F.col("gained").cast("int")).over(order))
    rows = rows.withColumn("_idle", F.sum((~F.col("gained")).cast("int")).over(Window.partitionBy("entity", "_run").orderBy("seq")))
    ended = F.max((F.col("_idle") >= most).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_ended", F.coalesce(ended, F.lit(0))).filter("_ended = 0").drop("_run", "_idle", "_ended")
