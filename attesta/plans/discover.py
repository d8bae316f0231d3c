"""Queries of discovery: results, pages and documents composed of supplier columns, with the outcome of each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery as D
from .normal import composed, stated
from .queries import query, table

# Title, URL, model, article, authority, type, query; then match, relation, reason. Model: Pixel 9 unless another is named.
RESULTS = (
    ("Pixel 9 Pro", "https://a.example/x/pixel-9-pro", "Pixel 9", None, None, "other", "", "reject", "another variant"), ("Pixel 9", "https://a.example/search?q=pixel+9", "Pixel 9", None, None, "other", "", "reject", "search landing"), ("EC685M", "https://a.example/x/ec685x", "EC685M", None, None, "other", "", "reject", "conflicting identifier"),
    ("Pixel 9", "https://facebook.com/pixel-9", "Pixel 9", None, None, "other", "", "reject", "no product context"), ("Pixel 9 case", "https://a.example/x/pixel-9", "Pixel 9", None, None, "other", "", "reject", "accessory"), ("Great thing", "https://a.example/p/zz{s}", "Pixel 9", None, None, "other", "", "reject", "another item"),
    ("Brush HX9992/12", "https://a.example/x/y", "HX9992", None, None, "other", "", "exact", "regional suffix"), ("Brush HX9992/LONG", "https://a.example/x/y", "HX9992", None, None, "other", "", "likely_variant", "variant suffix"), ("Pixel 9", "https://a.example/x/catalog", "Pixel 9", None, None, "other", "", "weak", "generic page"),
    ("Pixel 9 test", "https://a.example/x/y/z", "Pixel 9", None, None, "other", "", "weak", "incomplete url"), ("Pixel 9", "https://a.example/x/pixel-9", "Pixel 9", None, None, "other", "", "exact", "model named"), ("Thing A-{s}77", "https://a.example/x/y/z", "Zeta 5{s}", "A{s}77", None, "other", "", "exact", "article named"),
    ("Galaxy S2{s} here", "https://a.example/x/y/z", "Galaxy S2{s} Neo", None, None, "other", "", "weak", "probable base model"), ("Support", "https://a.example/x/y/z", "Pixel 9", None, "verified", "manufacturer", "acme pixel 9", "weak", "content verification"), ("Support", "https://a.example/x/y/z", "Pixel 9", None, None, "retailer", "acme pixel 9", "reject", "model absent"),
)
_NAMES = ("title", "url", "model", "article", "authority", "source_type", "query")


def _results(spark, d):  # noqa: ANN001, ANN202
    return composed(spark, d, [r[:7] for r in RESULTS], _NAMES).withColumnsRenamed({"s_suppkey": "entity", "i": "seq"})


@query(f"SELECT s_suppkey AS entity, i AS seq, relation, reason FROM {stated(RESULTS, (*_NAMES, 'relation', 'reason'), ())}")
def relevance_rules(spark, d):  # noqa: ANN001, ANN201
    return D.relevance(_results(spark, d)).select("entity", "seq", "relation", "reason")


_TRACED = ("accepted", "merged_duplicate", "rejected", "invalid", "rejected")


@query(f"SELECT p_partkey AS seq, CASE WHEN p_partkey % 5 = 1 AND p_partkey < 5 THEN 'accepted' ELSE (ARRAY['accepted', 'merged_duplicate', 'rejected', 'invalid', 'rejected'])[(p_partkey % 5) + 1] END AS outcome FROM part")
def discovery_trace(spark, d):  # noqa: ANN001, ANN201
    k, p = (F.col("p_partkey") % 5).cast("int"), F.col("p_partkey")
    url = F.get(F.array(F.concat(F.lit("https://a.example/p/"), p), F.lit("https://www.a.example/same/?utm_x=1"), F.concat(F.lit("https://a.example/no/"), p), F.lit("nothing"), F.concat(F.lit("https://a.example/unjudged/"), p)), k)
    raw = table(spark, d, "part").select(p.alias("seq"), url.alias("url"))
    judged = raw.filter(~F.col("url").contains("unjudged")).select(F.regexp_replace("url", r"www\.", "").alias("url"), F.when(F.col("url").contains("/no/"), "reject").otherwise("exact").alias("relation"))
    return D.discovery_trace(raw, judged).select("seq", "outcome")


@query("""SELECT s_suppkey AS entity, provider, accepted::BIGINT AS accepted, rejected::BIGINT AS rejected, official FROM supplier, (VALUES ('bing', 1, 0, 'https://a.example/1'), ('naver', 2, 1, 'https://a.example/1'), ('none', 0, 0, NULL)) AS v(provider, accepted, rejected, official) WHERE s_suppkey < 40""")
def provider_counts(spark, d):  # noqa: ANN001, ANN201
    rows = [("https://a.example/1", "exact", ["bing", "naver", "bing"], "manufacturer", "verified"), ("https://a.example/1", "exact", ["naver"], "manufacturer", "verified"), ("https://b.example/2", "weak", ["naver"], "retailer", "verified"), ("https://c.example/3", "reject", ["naver"], "manufacturer", "verified")]
    judged = spark.createDataFrame(rows, "url string, relation string, providers array<string>, source_type string, authority string")
    attempts = table(spark, d, "supplier").filter("s_suppkey < 40").select(F.col("s_suppkey").alias("entity"), F.explode(F.array(*map(F.lit, ("bing", "naver", "none")))).alias("provider"))
    return D.provider_counts(attempts, judged)


# Page: URL, domain, text, what it calls its owner, links, type, authority; then role, type and authority after.
PAGES = (
    ("u0", "acme.example", "Home", "", "https://www.shop.acme{s}.example/x|https://acme-dist.example/", "manufacturer", "verified", None, "manufacturer", "verified"), ("u1", "shop.acme{s}.example", "Acme{s} shop", "", "", "other", "unknown", "unknown", "other", "unknown"),
    ("u2", "acme-dist.example", "We are the official distributor of it", "", "", "other", "unknown", "official_distributor", "retailer", "verified"), ("u3", "acme-deal.example", "An Authorized Dealer since 1990", "", "", "other", None, "retailer", "other", None),
    ("u4", "acmeworld.example", "© 2020-2024 Acme Inc. All", "", "", "other", "unknown", "retailer", "other", "unknown"), ("u5", "amazon.de", "official dealer", "", "", "other", "unknown", "marketplace", "other", "unknown"), ("u6", "zeta.example", "official dealer", "Acme", "", "other", "unknown", "unknown", "other", "unknown"),
    ("u7", "acme.other.example", "plain", "ACME GmbH", "", "other", "unknown", "retailer", "other", "unknown"), ("u8", "acme.example", "shown already", "Acme", "", "retailer", "unverified", None, "retailer", "unverified"), ("u9", "acmeshop.acme-dist.example", "Copyright 2024 Acme", "", "", "other", "unknown", "manufacturer", "manufacturer", "verified"),
)
_PAGE = ("url", "domain", "said", "names", "links", "source_type", "authority", "role", "type_after", "authority_after")


@query(f"SELECT s_suppkey, url, role, type_after AS source_type, authority_after AS authority FROM {stated(PAGES, _PAGE, ())} WHERE s_suppkey = 1")
def resolve_authority(spark, d):  # noqa: ANN001, ANN201
    p = composed(spark, d, [x[:7] for x in PAGES], _PAGE[:7]).filter("s_suppkey = 1")
    some = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    p = p.withColumn("brand", F.lit("Acme")).withColumn("text", F.col("said")).withColumn("names", some("names")).withColumn("links", some("links"))
    return D.resolve_authority(p).select("s_suppkey", "url", "role", "source_type", "authority")


@query("""WITH p AS (SELECT p_partkey, 'b' || (p_partkey % 7) AS b FROM part) SELECT b AS brand, b || '.com' AS domain, 'https://' || b || '.com/start' AS evidence, 120 - 3 AS score FROM p WHERE p_partkey % 7 IN (0, 1) GROUP BY b UNION ALL
SELECT b, b || 'brand.de', 'https://' || b || 'brand.de/', 100 - 4 FROM p WHERE p_partkey % 7 IN (2) GROUP BY b UNION ALL SELECT b, b || 'brand.co.uk', 'https://' || b || 'brand.co.uk/p/mx500', 90 - 5 FROM p WHERE p_partkey % 7 = 3 GROUP BY b""")
def official_domains(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "part").select((F.col("p_partkey") % 7).alias("k"), F.concat(F.lit("b"), F.col("p_partkey") % 7).alias("brand")).distinct()
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    b = F.col("brand")
    results = p.filter("k < 2").select("brand", F.lit(3).alias("position"), cat("https://www.", b, ".com/start?utm_a=1").alias("url"), cat(b, " official site").alias("title"))
    results = results.unionByName(p.filter("k in (2, 5)").select("brand", F.lit(4).alias("position"), cat("https://", b, "brand.de/").alias("url"), cat(b, "brand home").alias("title"))).withColumn("brand", F.when(F.col("url").contains("brand"), F.concat("brand", F.lit("brand"))).otherwise(F.col("brand")))
    products = p.filter("k = 2").select("brand", cat("https://", b, "brand.de/x/mx500").alias("url"), cat("The MX500").alias("title")).unionByName(p.filter("k = 3").select("brand", cat("https://", b, "brand.co.uk/p/mx500").alias("url"), cat(b, "brand MX500").alias("title")))
    products = products.select(F.concat("brand", F.lit("brand")).alias("brand"), F.lit("MX500").alias("model"), F.lit(5).alias("position"), "url", "title")
    out = D.official_domains(results, products).filter("not (score = 85 and brand = 'b2brand')")
    return out.withColumn("brand", F.regexp_replace("brand", "brand$", ""))


@query("""SELECT 'Acme' || s_suppkey AS brand, v.label || s_suppkey || w AS label, 'acme' || s_suppkey || w || tld AS domain, r::BIGINT AS n_roots, l::BIGINT AS n_links, place::INTEGER AS place FROM supplier, (VALUES ('acme', 'tools', '.com', 2, 3, 1), ('acme', 'garden', '.de', 1, 1, 2)) AS v(label, w, tld, r, l, place)""")
def family_domains(spark, d):  # noqa: ANN001, ANN201
    s, cat = F.col("s_suppkey").cast("string"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    html = cat("<a href='https://acme", s, "tools.at/1'> <a href='https://acme", s, "tools.com/1'> https://acme", s, "tools.at/2 <i>https://acme", s, "garden.de/</i> https://acme", s, "press.com https://other.com https://acme", s, ".com/self https://acme", s, "x.com ")
    pages = table(spark, d, "supplier").select(cat("Acme", s).alias("brand"), cat("https://acme", s, ".com/").alias("url"), html.alias("html"))
    return D.family_domains(pages, 2)


@query("""SELECT s_suppkey AS domain, prefix, n::BIGINT AS n FROM supplier, (VALUES ('/p/', 3), ('/en/item/', 2)) AS v(prefix, n)""")
def sku_prefixes(spark, d):  # noqa: ANN001, ANN201
    text = "/p/AB100/x-one /p/AB101/y-two /p/ab101/again /p/AB1022_1/z-z /en/item/QX500/aaa /en/item/QX501/bbb /static/AB100/x.js /static/AB101/y.js /solo/AB100/one"
    return D.sku_prefixes(table(spark, d, "supplier").select(F.col("s_suppkey").alias("domain"), F.lit(text).alias("text")))


# URL, score, relation, match, identity, authority, type, reason; tier, place (null: not chosen).
CHOICES = (
    ("https://a.example/man", 10, "exact", "exact", "exact_variant", "verified", "manufacturer", "", 1, 2), ("https://a.example/doc.pdf", 5, "exact", "exact", "same_base_model", "verified", "official_document", "", 0, 1), ("https://ref.example/x", 7, "exact", "exact", "exact_variant", "unverified", "specialized_reference", "", 2, 3),
    ("https://a.example/silent", 1, "weak", "unknown", "unknown", "verified", "manufacturer", "requires content verification", 3, None), ("https://s.example/1", 9, "exact", "exact", "unknown", "unverified", "retailer", "", 4, 4), ("https://s.example/2", 8, "exact", "exact", "unknown", "unverified", "retailer", "", 4, None),
    ("https://w.example/1", 20, "weak", "likely", "unknown", "unverified", "other", "", 6, 5), ("https://v.example/1", 19, "weak", "likely", "unknown", "unverified", "other", "", 6, None), ("https://s.example/1?utm_q=1", 3, "exact", "exact", "unknown", "unverified", "retailer", "", 4, None),
    ("https://bad.example/1", 99, "reject", "exact", "unknown", "verified", "manufacturer", "", 4, None), ("https://bad.example/2", 99, "exact", "mismatch", "unknown", "verified", "manufacturer", "", 4, None), ("https://bad.example/3", 99, "exact", "exact", "different_model", "verified", "manufacturer", "", 4, None), ("no url", 99, "exact", "exact", "unknown", "verified", "manufacturer", "", 4, None),
    ("https://o.example/p", 2, "weak", "exact", "unknown", "unverified", "other", "needs content verification", 6, 6),
)
_CHOICE = ("url", "score", "relation", "model_match", "identity", "authority", "source_type", "reason")


@query(f"""SELECT s_suppkey AS entity, url, tier::INTEGER AS tier, place::INTEGER AS place FROM {stated(CHOICES, (*_CHOICE, 'tier', 'place'), ())} WHERE place IS NOT NULL""")
def select_sources(spark, d):  # noqa: ANN001, ANN201
    c = composed(spark, d, [x[:8] for x in CHOICES], _CHOICE).withColumnsRenamed({"s_suppkey": "entity", "i": "seq"}).drop("s_nationkey")
    return D.select_sources(c, 6)


@query("""SELECT p_partkey AS entity, 'u' || k AS source_url, CASE WHEN k < 2 THEN 'first' ELSE 'late' END AS origin, CASE WHEN k = 0 THEN 1 ELSE 5 END AS seq FROM part, range(0, 3) AS r(k)""")
def all_fetched(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "part").select(F.col("p_partkey").alias("entity"))
    rows = lambda items, origin: p.select("entity", F.explode(F.array(*[F.struct(F.lit(u).alias("source_url"), F.lit(s).alias("seq")) for u, s in items])).alias("x")).select("entity", "x.*", F.lit(origin).alias("origin"))
    return D.all_fetched(rows([("u0", 1), ("u0", 2), ("u1", 5)], "first"), rows([("u1", 0), ("u2", 5), ("u2", 7)], "late"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://a.example/x|https://b.example/' WHEN 1 THEN 'https://a.example/x' ELSE '' END AS urls FROM part""")
def url_sets(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey") % 3
    a, b, c = F.when(k < 2, "https://www.a.example/x/"), F.when(k == 0, "https://b.example").otherwise("nothing"), F.when(k < 2, "https://a.example/x#z")
    return table(spark, d, "part").select("p_partkey", F.array_join(D.url_set(a, b, c), "|").alias("urls"))


# Document rows: URL, kind, match, found on, title, page, locale.
FILES = (
    ("https://a.example/m.pdf?v=1", "manual", "probable", "p1", "Manual", "p1", "DE"), ("https://www.a.example/m.pdf", "manual", "exact", "p2|p1", "manual!", "p1", "EN"), ("https://a.example/d.pdf", "datasheet", "probable", "p1", "Sheet", "p1", ""), ("https://a.example/z.pdf", "certificate", "exact", "p3", "Cert", "p1", "FR"), ("not-a-url", "manual", "unverified", "p9", "x", "p2", ""),
)


@query("""SELECT s_suppkey AS entity, url, kind, match, found, place::INTEGER AS place FROM supplier, (VALUES ('https://a.example/z.pdf', 'certificate', 'exact', 'p3', 1), ('https://www.a.example/m.pdf', 'manual', 'exact', 'p1|p2', 2), ('https://a.example/d.pdf', 'datasheet', 'probable', 'p1', 3), ('not-a-url', 'manual', 'unverified', 'p9', 4)) AS v(url, kind, match, found, place)
UNION ALL SELECT s_suppkey, url, kind, 'locale', locales, 0 FROM supplier, (VALUES ('https://www.a.example/m.pdf', 'manual', 'EN|DE'), ('https://a.example/z.pdf', 'certificate', 'FR'), ('https://a.example/d.pdf', 'datasheet', ''), ('not-a-url', 'manual', '')) AS v(url, kind, locales)
UNION ALL SELECT s_suppkey, 'https://a.example/m.pdf?v=1', 'manual', 'unverified', 'not_in_text', 1 FROM supplier""")
def merged_documents(spark, d):  # noqa: ANN001, ANN201
    f = composed(spark, d, FILES, ("url", "kind", "match", "found_on", "title", "page", "locale")).withColumnsRenamed({"s_suppkey": "entity", "i": "seq"}).withColumn("found_on", F.split("found_on", r"\|"))
    merged = D.merge_documents(f).select("entity", "url", "kind", "match", F.array_join("found_on", "|").alias("found"), "place")
    locales = D.collapse_locales(f).select("entity", "url", "kind", F.lit("locale").alias("match"), F.array_join("locales", "|").alias("found"), F.lit(0).alias("place"))
    verdicts = spark.createDataFrame([("https://a.example/m.pdf?v=1", "unverified", "not_in_text")], "url string, match string, evidence string")
    checked = D.with_verdicts(f, verdicts).filter("evidence <> ''").select("entity", "url", "kind", "match", F.col("evidence").alias("found"), F.col("seq").cast("int").alias("place"))
    return merged.unionByName(locales).unionByName(checked)


@query("""SELECT s_suppkey AS entity, what, value, place::INTEGER AS place FROM supplier, (VALUES ('image', 'b.jpg', 1), ('image', 'a.jpg?w=2', 2), ('host', 'b.co.uk', 1), ('host', 'a.com', 2), ('reason', 'too weak', 1), ('reason', 'no url', 2), ('first', '2', 1), ('first', '1', 2), ('first', '3', 3), ('pages', 'u2', 3), ('script', 'unknown', 1)) AS v(what, value, place)""")
def ordered_picks(spark, d):  # noqa: ANN001, ANN201
    """Bounded ordered lists: images, official hosts, one rejected of each reason, official sources first, pages inspected."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    rows = lambda data, schema: s.join(F.broadcast(spark.createDataFrame(data, schema)), F.lit(True))
    out = lambda df, what, value, place: df.select("entity", F.lit(what).alias("what"), value.cast("string").alias("value"), place.cast("int").alias("place"))
    images = D.first_images(rows([(1, False, "a.jpg?w=2"), (2, True, "b.jpg"), (3, False, "a.jpg?w=1"), (4, False, "c.jpg")], "seq int, official boolean, url string"), 2)
    c = rows([(1, "x.a.com", "retailer", "verified"), (2, "www.b.co.uk", "manufacturer", "verified"), (3, "a.com", "official_document", "verified"), (4, "q.a.com", "manufacturer", "verified"), (5, "z.com", "manufacturer", "unknown")], "seq int, domain string, source_type string, authority string")
    hosts = D.official_hosts(c).select("entity", F.posexplode("hosts").alias("place", "host"))
    why = D.rejected_examples(rows([(1, "too weak", "u1"), (2, "too weak", "u2"), (3, "no url", "u3"), (4, "other", "u4")], "seq int, reason string, url string"), 2)
    first = D.official_first(c.filter("seq < 4").withColumn("source_type", F.when(F.col("seq") == 3, "other").otherwise(F.col("source_type"))))
    pages = D.inspection_summary(rows([(1, "u1", "weak", True, "false"), (2, "u2", "exact", False, "false"), (3, "u3", "exact", True, "unknown")], "seq int, url string, match string, expandable boolean, needs_script string"))
    place = F.when(F.col("reason") == "too weak", 1).otherwise(2)
    return (
        out(images, "image", F.col("url"), F.col("place")).unionByName(out(hosts, "host", F.col("host"), F.col("place") + 1)).unionByName(out(why, "reason", F.col("reason"), place)).unionByName(out(first, "first", F.col("seq"), F.col("place")))
        .unionByName(out(pages, "pages", F.col("primary"), F.col("pages"))).unionByName(out(pages, "script", F.col("any_script"), F.lit(1)))
    )


@query("""SELECT p_partkey AS entity, 'no_load_speed' AS attribute, place::INTEGER AS place, 'Acme "M' || p_partkey || '" ' || n AS query FROM part, (VALUES (0, 'no load speed'), (1, 'idle speed')) AS v(place, n) WHERE p_partkey % 2 = 0""")
def search_plan(spark, d):  # noqa: ANN001, ANN201
    p = F.col("p_partkey")
    gaps = table(spark, d, "part").select(p.alias("entity"), F.lit("no_load_speed").alias("attribute"), F.when(p % 2 == 0, "missing_searchable").otherwise("ambiguous").alias("gap"), F.lit("Acme").alias("brand"), F.concat(F.lit("M"), p).alias("model"), F.array(F.lit("no load speed"), F.lit("idle speed"), F.lit("rpm")).alias("aliases"))
    return D.search_plan(gaps, 2)


@query("""SELECT s_suppkey, i::BIGINT AS i, rejection FROM supplier, (VALUES (1, 'no url'), (2, 'another model'), (3, 'no product page'), (4, 'model not named'), (5, 'marketplace'), (6, NULL)) AS v(i, rejection)""")
def targeted_rejections(spark, d):  # noqa: ANN001, ANN201
    rows = (("Pixel 9", "x", "other"), ("Pixel 9 Pro", "https://a.example/p/pixel-9-pro", "other"), ("Pixel 9", "https://a.example/catalog", "other"), ("Thing", "https://a.example/p/thing", "other"), ("Pixel 9", "https://amazon.de/p/pixel-9", "marketplace"), ("Pixel 9", "https://a.example/p/pixel-9", "other"))
    return D.targeted_rejection(composed(spark, d, rows, ("title", "url", "source_type")).withColumn("model", F.lit("Pixel 9"))).select("s_suppkey", "i", "rejection")


@query("""WITH e AS (SELECT user_id, event_id, event_type <> 'view' AS gained, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT *, sum(CASE WHEN gained THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n ROWS 2 PRECEDING) AS idle FROM e),
s AS (SELECT user_id, min(n) AS stop FROM r WHERE idle = 3 GROUP BY user_id) SELECT user_id AS entity, event_id AS seq, gained FROM e LEFT JOIN s USING (user_id) WHERE n <= coalesce(stop, n)""")
def until_no_gain(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), (F.col("event_type") != "view").alias("gained"))
    return D.until_no_gain(e, 3).select("entity", "seq", "gained")
