"""Queries of connectors and of the workflow, over recordings composed of supplier columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.concepts import Concept
from ..sources import replay as P
from . import workflow as W
from .normal import composed, stated
from .queries import query, table

# Provider, page; then rank, URL, title, snippet, status of its rows.
SERPS = (
    ("bing", '<ol><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=https%3A%2F%2Fa.example%2F{k}">Thing <b>{s}</b></a></h2><div class="b_caption">All of it</div></li><li class="b_algo"><a href="https://b.example/">B</a></li><li class="b_ad"><a href="https://ad.example/">Ad</a></li></ol>'),
    ("duckduckgo_html", '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx">X</a><a class="result__snippet" href="#">snip {s}</a>'), ("duckduckgo_lite", "<html>anomaly-modal<a href='/'>x</a></html>"), ("naver", '<a class="link_tit" href="https://n.example/{k}">N</a><a class="link_tit" href="https://search.naver.com/x">own</a>'),
    ("google", '<div class="yuRUbf"><a href="/url?q=https://g.example/p&sa=1"><h3>G {s}</h3></a></div><div class="VwiC3b">found</div>'), ("seznam", "<p><a href='/x'>nothing</a></p>"), ("bing", ""),
)
ROWS = (
    ("bing", 1, 1, "https://a.example/{k}", "Thing {s}", "All of it", "success"), ("bing", 1, 2, "https://b.example/", "B", "", "success"), ("duckduckgo_html", 2, 1, "https://a.example/x", "X", "snip {s}", "success"), ("duckduckgo_lite", 3, 0, None, None, None, "blocked"), ("naver", 4, 1, "https://n.example/{k}", "N", "", "success"),
    ("google", 5, 1, "https://g.example/p", "G {s}", "found", "success"), ("seznam", 6, 0, None, None, None, "parse_error"), ("bing", 7, 0, None, None, None, "empty"),
)


@query(f"SELECT provider, s_suppkey || '-' || page AS query, rank::INTEGER AS rank, url, title, snippet, status FROM {stated(ROWS, ('provider', 'page', 'rank', 'url', 'title', 'snippet', 'status'), ('url', 'title', 'snippet'))}")
def search_results(spark, d):  # noqa: ANN001, ANN201
    return P.search_pages(composed(spark, d, SERPS, ("provider", "html")).withColumn("query", F.concat_ws("-", F.col("s_suppkey").cast("string"), F.col("i").cast("string"))))


@query("""SELECT s_suppkey::VARCHAR AS query, provider, count(*) AS n FROM supplier, (VALUES ('bing', 1), ('naver', 1), ('naver', 2), ('google', 1), ('google', 2)) AS v(provider, rank) WHERE provider <> 'google' OR s_suppkey % 2 = 1 GROUP BY ALL""")
def provider_chain(spark, d):  # noqa: ANN001, ANN201
    rows = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(k).alias("rank")) for p, k in (("google", 1), ("google", 2), ("bing", 1), ("naver", 1), ("naver", 2))])
    r = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("query"), F.explode(rows).alias("r")).select("query", "r.*")
    r = r.withColumn("status", F.when((F.col("query").cast("int") % 2 == 1) & (F.col("provider") == "naver"), "blocked").otherwise("success"))
    return P.provider_chain(r, ["bing", "naver", "google"], 2).groupBy("query", "provider").agg(F.count("*").alias("n"))


# URL, recorded URL, HTTP status, content; status.
FETCHES = (
    ("https://a.example/1", "https://a.example/1", 200, "x", "success"), ("https://a.example/2", "https://a.example/2/", 200, "x", "success"), ("https://a.example/3/", "https://a.example/3", 404, "", "not_found"), ("https://a.example/4", "https://a.example/4", 403, "x", "blocked"), ("https://a.example/5", "https://a.example/5", 429, "x", "rate_limited"),
    ("https://a.example/6", "https://a.example/6", 503, "x", "unavailable"), ("https://a.example/7", "https://a.example/7", 410, "x", "error"), ("https://a.example/8", "https://a.example/8", 200, "", "empty"), ("https://a.example/9", "https://a.example/none", 200, "x", "not_recorded"), ("mail:me", "mail:me", 200, "x", "unsupported"),
)


@query(f"SELECT s_suppkey, i, status FROM {stated(FETCHES, ('url', 'source_url', 'http_status', 'content', 'status'), ())}")
def fetch_recorded(spark, d):  # noqa: ANN001, ANN201
    r = composed(spark, d, [f[:4] for f in FETCHES], ("url", "source_url", "http_status", "content"))
    fetched = r.filter("s_suppkey = 1").select("source_url", F.col("source_url").alias("final_url"), F.col("http_status").cast("int").alias("http_status"), F.lit("text/html").alias("content_type"), "content")
    return P.fetch_recorded(r.select("s_suppkey", "i", "url"), fetched).select("s_suppkey", "i", "status")


@query("""SELECT 'd' || s_suppkey || '.example' AS domain, 'https://d' || s_suppkey || '.example' || path AS url, level::INTEGER AS level FROM supplier, (VALUES ('/p/one', 0), ('/p/two', 1), ('/p/three?a=1&b=2', 2)) AS v(path, level)""")
def sitemap_urls(spark, d):  # noqa: ANN001, ANN201
    host = F.concat(F.lit("https://d"), F.col("s_suppkey"), F.lit(".example"))
    maps = {
        "/sitemap.xml": "<loc>{h}/p/one</loc><loc> {h}/deep.xml </loc><loc>https://other.example/p/x</loc>", "/deep.xml": "<loc>{h}/p/two</loc><loc>{h}/p/one/</loc><loc>{h}/deeper.xml.gz</loc><loc>{h}/sitemap.xml</loc>", "/deeper.xml.gz": "<loc>{h}/p/three?a=1&amp;b=2</loc><loc>{h}/deep.xml</loc>",
    }
    s = table(spark, d, "supplier").select(host.alias("h"), F.explode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(t).alias("t")) for u, t in maps.items()])).alias("m"))
    recorded = s.select(F.concat("h", "m.u").alias("url"), F.replace("m.t", F.lit("{h}"), F.col("h")).alias("text"))
    roots = table(spark, d, "supplier").select(F.concat(F.lit("d"), F.col("s_suppkey"), F.lit(".example")).alias("domain"), F.concat(host, F.lit("/sitemap.xml")).alias("url"))
    return P.sitemap_urls(recorded, roots)


@query("""SELECT domain, url, stage, match FROM (SELECT 'd' || s_suppkey || '.example' AS domain, s_suppkey % 2 = 0 AS early, v.* FROM supplier, (VALUES ('/x/other', 'links', 'unknown', false), ('/x/mx500', 'site_search', 'exact', false), ('/x/later-mx500', 'crawl', 'exact', true)) AS v(path, stage, match, late)) t,
LATERAL (SELECT 'https://' || domain || path AS url) u WHERE (early AND NOT late) OR (NOT early AND stage <> 'site_search')""")
def probe_records(spark, d):  # noqa: ANN001, ANN201
    rows = (("links", "/x/other", "Thing"), ("site_search", "/x/mx500", "MX500"), ("site_search", "/catalog", "MX500"), ("crawl", "/x/later-mx500", "MX500"), ("crawl", "/x/other", "Thing"), ("nowhere", "/x/mx500", "MX500"))
    r = composed(spark, d, rows, ("stage", "path", "title")).withColumn("domain", F.concat(F.lit("d"), F.col("s_suppkey"), F.lit(".example")))
    r = r.filter("s_suppkey % 2 = 0 or stage <> 'site_search'").withColumn("url", F.concat(F.lit("https://"), "domain", "path"))
    return P.probe_records(r, F.lit("MX500"))


@query("""SELECT s_suppkey AS entity, what, replace(value, '{k}', s_suppkey::VARCHAR) AS value FROM supplier, (VALUES ('template', 'https://d{k}.example/p/ab100'), ('file', 'https://a.example/{k}.pdf'), ('file', 'https://b.example/m.docx?x=1'), ('link', 'https://d{k}.example/x/tech-specs'), ('link', 'https://www.d{k}.example/data'),
('attribute', '0 Power = {k} W'), ('attribute', '1 Mass = 2 kg')) AS v(what, value)""")
def harvested_links(spark, d):  # noqa: ANN001, ANN201
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.concat(F.lit("d"), F.col("s_suppkey"), F.lit(".example")).alias("domain"), F.col("s_suppkey").cast("string").alias("k"))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    out = lambda df, what, value: df.select("entity", F.lit(what).alias("what"), value.alias("value"))
    t = P.template_urls(s.select("domain", F.lit("/p/").alias("prefix")), s.select("domain", F.lit("AB100").alias("sku"))).join(s, "domain")
    html = cat('<a data-x="https:\\/\\/a.example\\/', F.col("k"), '.pdf"></a><script>"//b.example/m.docx?x=1" "https://b.example/page.html"</script><i>https://a.example/', F.col("k"), ".pdf</i>")
    files = P.document_urls(s.select(F.col("entity").alias("page_id"), html.alias("html"))).withColumnRenamed("page_id", "entity")
    links = (("tech-specs", "Page"), ("#top", "Specifications"), ("https://other.example/specs", "Specs"), ("mailto:specs@x", "Specifications"), ("//www.{d}/data", "Technical data"), ("", "Specs"), ("/about", "About"))
    rows = s.select("entity", "domain", F.posexplode(F.array(*[F.struct(F.lit(a).alias("href"), F.lit(b).alias("anchor")) for a, b in links])).alias("seq", "l"))
    rows = rows.select("entity", "seq", cat("https://", F.col("domain"), "/x/y").alias("page_url"), F.replace("l.href", F.lit("{d}"), F.col("domain")).alias("href"), "l.anchor")
    picked = P.official_spec_links(P.resolved_links(rows).filter("url is not null"), 2).withColumn("url", F.when(F.col("place") == 2, F.regexp_replace("url", "//", "//www.")).otherwise(F.col("url")))
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("Power").alias("raw_label"), F.concat("k", F.lit(" W")).alias("raw_value")), F.struct(F.lit("Mass").alias("raw_label"), F.lit("2 kg").alias("raw_value"))).alias("attributes")))
    traces = s.select("entity", payload.alias("payload")).unionByName(s.select("entity", F.lit("no json").alias("payload")))
    a = P.trace_attributes(traces)
    return out(t, "template", F.col("url")).unionByName(out(files, "file", F.col("url"))).unionByName(out(picked, "link", F.col("url"))).unionByName(out(a, "attribute", F.concat_ws(" ", "seq", F.concat_ws(" = ", "raw_label", "raw_value"))))


# ---------------------------------------------------------------- workflow
CONCEPTS = [Concept("power_w", "measure", "W", "power", labels=("^(?:rated )?power$",), plausible=(1, 20000)), Concept("weight_kg", "measure", "kg", "mass", labels=("^weight$",), plausible=(0.1, 90)), Concept("height_mm", "measure", "mm", "length", labels=("^height$",), plausible=(10, 3000)), Concept("has_timer", "boolean", labels=("^timer$",))]
_TABLE = "<h2>Technical data</h2><table>{0}</table>"
_ROW = "<tr><td>{0}</td><td>{1}</td></tr>"
# Title, URL, type, authority, score, page.
RESULTS = (
    ("Acme MX{s}00", "https://acme.example/p/mx{s}00", "manufacturer", "verified", 90, _TABLE.format(_ROW.format("Power", "1.5 kW") + _ROW.format("Weight", "{s} kg") + _ROW.format("Height", "2{s} mm") + _ROW.format("Timer", "Yes"))),
    ("Acme MX{s}00 data", "https://ref.example/x/mx{s}00", "specialized_reference", "unverified", 50, _TABLE.format(_ROW.format("Rated power", "1500 W") + _ROW.format("Weight", "9{s}0 g") + _ROW.format("Height", "2{s} mm"))),
    ("Acme MX{s}00 offer", "https://shop.example/x/mx{s}00", "retailer", "unverified", 70, _TABLE.format(_ROW.format("Timer", "No"))), ("Acme MX{s}00 Pro", "https://acme.example/p/mx{s}00-pro", "manufacturer", "verified", 99, _TABLE.format(_ROW.format("Power", "9 W"))),
)
PROFILE = (
    ("power_w", "Confirmed", "1500", "high", "equivalent_multi_source_evidence", 2, 0), ("weight_kg", "Confirmed", "{s}", "high", "higher_authority_source", 1, 1), ("height_mm", "Confirmed", "2{s}", "high", "equivalent_multi_source_evidence", 2, 0), ("has_timer", "Confirmed", "true", "high", "higher_authority_source", 1, 1), ("has_display", "Unresolved", None, "low", "no_valid_evidence", 0, 0),
)


def _services(spark, d):  # noqa: ANN001, ANN202
    r = composed(spark, d, RESULTS, ("title", "url", "source_type", "authority", "score", "content")).withColumn("url", F.concat("url", F.lit("/s"), F.col("s_suppkey")))
    q = F.concat(F.lit("acme mx"), F.col("s_nationkey") + 10, F.lit("00 "), F.col("s_suppkey"))
    results = r.select(q.alias("query"), F.col("i").alias("seq"), "url", "title", "source_type", "authority", "score")
    documents = r.select(F.col("url").alias("source_url"), F.col("url").alias("final_url"), F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), "content")
    requests = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), q.alias("query"), F.lit("Acme").alias("brand"), F.concat(F.lit("MX"), F.col("s_nationkey") + 10, F.lit("00")).alias("model"))
    return requests, W.recorded(results, documents)


@query(f"SELECT s_suppkey AS entity, attribute, status, value, confidence, reason, n_support::BIGINT AS n_support, n_conflict::BIGINT AS n_conflict FROM {stated(PROFILE, ('attribute', 'status', 'value', 'confidence', 'reason', 'n_support', 'n_conflict'), ('value',))}")
def product_workflow(spark, d):  # noqa: ANN001, ANN201
    requests, services = _services(spark, d)
    expected = requests.select("entity", F.explode(F.array(F.lit("power_w"), F.lit("has_display"))).alias("attribute"))
    return W.product_profiles(requests, services, CONCEPTS, expected).drop("source")
