"""Operators on small fixtures: resolution, grouping, measures, HTML, state, sinks."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attesta.functions import measure as M
from attesta.functions import text as T
from attesta.functions import url as U
from attesta.operators import relate as R
from attesta.operators import resolve as V
from attesta.plans.queries import QUERIES
from attesta.sources import html as H
from attesta.sources import tables as S
from attesta.streaming import state as K


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("1,234.56", "1234.56"), ("1.234,5", "1234.5"), ("12,5", "12.5"), ("1,234", "1234"), ("1.234.567", "1234567"), ("-3", "-3"), ("abc", None), ("1 234,5", "1234.5"), ("1'234", "1234"), ("12 345 678", "12345678"), ("1 2", None)])
def test_numbers(spark, text, want):
    assert one(spark, M.number(F.col("t")), t=text) == (None if want is None else Decimal(want))


def test_measures(spark):
    assert one(spark, M.parse_measure(F.col("t")), t="50 - 60 Hz").asDict() == {"kind": "range", "minimum": Decimal(50), "maximum": Decimal(60), "unit": "Hz"}
    assert one(spark, M.parse_measure(F.col("t")), t="no measure") is None
    assert one(spark, M.to_base("length", F.lit("in"), F.lit(2))) == Decimal("50.8")
    assert one(spark, M.to_base("length", F.lit("kg"), F.lit(2))) is None
    assert one(spark, M.undoubled_unit(F.col("t"), ("Hz", "W")), t="HzHz") == "Hz"
    assert M.families_of("month") == ["duration_months", "duration_years"]


def test_greedy_groups_are_not_transitive(spark):
    rows = [("e", 1, "1000", "g"), ("e", 2, "1000.8", "g"), ("e", 3, "1001.6", "g"), ("e", 4, "1", "kg"), ("f", 1, "x", None)]
    got = V.greedy_groups(spark.createDataFrame(rows, "entity string, seq long, value string, unit string"), ["entity"], "mass")
    assert {(r.entity, r.seq): r.group for r in got.collect()} == {("e", 1): 0, ("e", 2): 0, ("e", 3): 1, ("e", 4): 0, ("f", 1): 0}


def test_resolve_empty(spark):
    none = spark.createDataFrame([], CLAIM)
    assert V.resolve(none).count() == 0 and V.claim_diagnostics(none).count() == 0
    assert V.resolve(none, spark.createDataFrame([("e", "a")], "entity string, attribute string")).first().reason == "no_valid_evidence"


CLAIM = "entity string, attribute string, seq int, value string, source_url string, source_type string, authority string, confidence string, identity string, status string, variant_sensitive boolean, model_wide boolean"


def claim(attribute, value, kind="manufacturer", authority="verified", confidence="high", identity="exact_variant", status="success", url="u"):
    return ("e", attribute, 0, value, url, kind, authority, confidence, identity, status, False, False)


def test_resolve(spark):
    rows = [
        claim("a", "1"), claim("a", "2", "specialized", "unverified"), claim("b", "1"), claim("b", "2"), claim("c", "1", "retailer"), claim("c", "1", "retailer"), claim("d", "n/a"),
        claim("e", "1", identity="different_model"), claim("f", "1", "specialized", "unverified", url="x"), claim("f", "1", "specialized", "unverified", url="y"), claim("g", "1", status="error"),
    ]
    expected = spark.createDataFrame([("e", "a"), ("e", "z")], "entity string, attribute string")
    got = {r.attribute: (r.status, r.value, r.confidence, r.reason) for r in V.resolve(spark.createDataFrame(rows, CLAIM), expected).collect()}
    assert got == {
        "a": ("Confirmed", "1", "high", "higher_authority_source"), "b": ("Conflict", None, "low", "conflicting_equal_authority"), "c": ("Unresolved", "1", "low", "insufficient_source_quality"),
        "d": ("Unresolved", None, "low", "missing_provenance"), "e": ("Unresolved", None, "low", "no_valid_evidence"), "f": ("Confirmed", "1", "medium", "equivalent_multi_source_evidence"),
        "g": ("Unresolved", None, "low", "no_valid_evidence"), "z": ("Unresolved", None, "low", "no_valid_evidence"),
    }


def test_text(spark):
    assert one(spark, T.fold(F.col("t")), t="HÖHE Straße") == "hohe strasse"
    assert one(spark, T.label_key(F.col("t")), t="Высота, упаковки (мм)") == "высота упаковки"
    assert one(spark, T.clean_text(F.col("t")), t="cafÃ© &amp;amp; Ａ x") == "café & A x"
    assert one(spark, T.tidy_punctuation(F.col("t")), t="a , b;c,, d") == "a, b; c, d"
    assert one(spark, T.redact(F.col("t")), t='api_key = "abc" Bearer x.y token:z') == f"api_key = {T.MASK} Bearer {T.MASK} token:{T.MASK}"
    assert one(spark, T.concrete(F.col("t")), t=" N/A ") is False
    assert one(spark, T.plural_slavic(F.lit(22), "a", "b", "c")) == "b"
    assert one(spark, T.utf16_units(F.col("t")), t="a😀") == 3


def test_text_hygiene_reads_whole_texts(spark, tmp_path):
    texts = {1: "Wide label (mm), " * 9 + "one", 2: "Wide label (mm), " * 9 + "two", 3: "x", 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.key for r in QUERIES["text_hygiene"](spark, str(tmp_path)).collect()}
    assert got == {i: T._label_key(t) for i, t in texts.items()} and got[1] != got[2]


def test_urls(spark):
    assert one(spark, U.canonical_url(F.col("u")), u="HTTPS://www.Ex.com:443//a//b/?utm_x=1&q=2&fbclid=3#f") == "https://ex.com/a/b?q=2"
    assert one(spark, U.canonical_url(F.col("u")), u="ftp://x") == ""
    assert one(spark, U.registrable_domain(F.col("u")), u="a.b.co.uk") == "b.co.uk"
    assert one(spark, U.page_kind(F.col("u")), u="http://x.com/a/product/9") == "product"
    assert one(spark, U.belongs(F.col("u"), F.lit("x.com")), u="http://shop.x.com/") is True
    assert one(spark, U.model_match(F.lit("GX 12"), F.col("t")), t="the gx-12 drill") == "exact"


def test_html():
    page = """<html><head><title>T</title><script type="application/ld+json">{"@type": "Product", "name": "Drill", "weight": {"value": 2, "unitText": "kg"}}</script></head>
    <body><nav><a href="/x">x</a></nav><h2>Specs</h2><table><tr><th>Power</th><td>500 W</td></tr></table><dl><dt>Color<dd>red</dl><p><b>Voltage:</b> 18 V</p><div class="specs"><div><span>Speed</span><span>3000</span></div></div></body>"""
    got = {(r["label"], r["value"]): (r["method"], r["section"]) for r in H.facts(page).rows}
    assert got["Power", "500 W"] == ("table_row", "Specs") and got["Color", "red"][0] == "definition_list" and got["weight", "2 kg"][0] == "json_ld_field"
    assert got["Voltage", "18 V"][0] == "label_colon" and got["Speed", "3000"][0] == "element_pair"
    assert H.facts(None).rows == [] and H.facts("<p><b>unclosed <i>x").rows == []


def test_page_without_bounds():
    """Neither depth nor number of nodes ends a read: the last of 8000 facts, 300 levels down, is found."""
    deep = '{"specs": ' * 300 + '{"name": "Deepest", "value": "1 mm"}' + "}" * 300
    rows = "".join(f"<tr><td>Row {i}</td><td>{i} mm</td></tr>" for i in range(8000))
    got = {r["label"] for r in H.facts(f"<script type='application/json'>{deep}</script><table>{rows}</table>").rows}
    assert {"Deepest", "Row 7999"} <= got


def test_js_literals():
    assert H.loads("{a: 'it\\'s', b: !0, c: void 0, d: [1, 2,], e: x.y, \"f\": null}") == {"a": "it's", "b": True, "c": None, "d": [1, 2], "e": None, "f": None}
    assert H.loads("{a: ") is None and H.balanced("x{'}': [1]} y", 1) == 11


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1><a href='/u'>x</a>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in H.page_links(pages).collect()] == [(1, 0, "/u", "x")]
    assert [tuple(r) for r in H.page_headings(pages).collect()] == [(1, 0, "h1", "A")]
    assert {r.page_id: r.text for r in H.page_text(pages).collect()} == {1: "A x", 2: ""}


def test_breaker():
    b = K.Breaker()
    assert [b.record(t, ok) for t, ok in ((0, False), (1, False), (10, True), (46, False), (100, True), (136, True), (137, False))] == ["closed", "open", "open", "open", "open", "closed", "closed"]


def test_breaker_table_and_stream(spark, tmp_path):
    rows = [("a", 1, 0.0, False), ("a", 2, 1.0, False), ("b", 1, 0.0, True), ("a", 3, 50.0, True)]
    df = spark.createDataFrame(rows, "key string, seq long, at double, ok boolean")
    want = {("a", 1): "closed", ("a", 2): "open", ("a", 3): "closed", ("b", 1): "closed"}
    schema = df.withColumn("key", F.when(F.col("key") == "a", 1).otherwise(2).cast("long"))
    assert {("ab"[r.key - 1], r.seq): r.state for r in K.breaker_states(schema).collect()} == want
    schema.write.parquet(str(tmp_path / "in"))
    q = K.breaker_stream(spark.readStream.schema(schema.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("breaker").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {("ab"[r.key - 1], r.seq): r.state for r in spark.table("breaker").collect()} == want


def test_stream_metrics_equal_the_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    e = spark.read.parquet(src)
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = K.tumbling_metrics(s, 3600, 60).writeStream.format("memory").queryName("metrics").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: {(r.start, r.name): (r.n, round(r.total, 6)) for r in df.collect()}
    assert key(spark.table("metrics")) == key(K.tumbling_metrics(e, 3600, 60))


def test_relational(spark):
    long = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "b", "y")], "id int, attribute string, value string")
    assert {tuple(r) for r in R.wide_form(long, ["id"], ["a", "b"], "?").collect()} == {(1, "x", "?"), (2, "?", "y")}
    s = spark.createDataFrame([(1, "p", 8), (1, "q", 3), (2, "p", 5), (2, "q", 4)], "id int, label string, score int")
    assert {tuple(r) for r in R.winner_with_margin(s, "id", 4, 2).collect()} == {(1, "p", "high"), (2, "unknown", "low")}
    f = R.funnel(spark.range(10), {"a": F.col("id") > 1, "b": F.col("id") > 5})
    assert [tuple(r) for r in f.collect()] == [("a", 8, 0.8), ("b", 4, 0.5)]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, 5, "old"), (2, 5, "keep")], "k int, at int, v string")
    n = spark.createDataFrame([(1, 6, "new"), (2, 4, "late")], "k int, at int, v string")
    assert {r.k: r.v for r in S.upsert(t, n, "k", "at").collect()} == {1: "new", 2: "keep"}
    p = spark.createDataFrame([("e", "a", "Confirmed", ["u"], None), ("e", "b", "Unresolved", None, None)], "entity string, attribute string, status string, supporting array<string>, conflicting array<string>")
    rows = S.evidence_rows(p)
    assert {(r.attribute, r.role, r.url) for r in rows.collect()} == {("a", "supporting", "u"), ("b", None, None)}
    S.write_csv(rows, str(tmp_path / "csv"), ["entity", "attribute", "url"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    S.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert S.unique_or_fail(t, "k").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        S.unique_or_fail(t.union(t), "k").collect()


def test_small_functions(spark):
    import hashlib
    import hmac

    from attesta.functions import identity as I
    from attesta.functions import normalize as N
    from attesta.operators import report as P

    want = hmac.new(b"key", b"12345", hashlib.sha256).hexdigest()[:10]
    assert one(spark, P.scoped_id(F.lit(12345), "key")) == want
    with pytest.raises(ValueError, match="64 bytes"):
        P.scoped_id(F.lit(1), "k" * 65)
    assert one(spark, N.text_units(F.col("t")), t="1.5Ah and 50 HzHz, 3m") == "1.5 Ah and 50 Hz, 3m" and one(spark, N.text_units(F.lit(None).cast("string"))) is None
    away = lambda a, b: one(spark, I.redirected_away(F.lit("MX500"), F.lit(a), F.lit(b)))
    assert away("https://a.example/p/mx500", "https://a.example/all") and not away("https://a.example/p/mx500", "https://a.example/de/mx500") and not away("https://a.example/x", "https://a.example/all")
    assert one(spark, U.search_queries(F.lit("Acme"), F.lit("MX500"), F.lit(None).cast("string"))) == ["Acme MX500", '"Acme MX500"']
    assert round(one(spark, M.celsius(F.lit("°F"), F.lit(482.0))), 6) == 250.0 and one(spark, M.celsius(F.lit("K"), F.lit(1.0))) is None
    counts = P.value_counts(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "k")
    assert {r.k: r.n for r in counts.collect()} == {"a": 2, None: 1}


def test_fetched_documents(spark, tmp_path):
    rows = [("u", "u", 200, "text/html", "<html>"), ("u", "u.pdf", 200, "", "x"), ("u", "u", 404, "", ""), ("u", "u", 403, "", "x"), ("u", "u", 500, "", "x"), ("u", "u", 200, "text/plain", ""), (None, None, None, None, None)]
    spark.createDataFrame(rows, S.FETCHED).write.parquet(f"{tmp_path}/f")
    got = {(r.fetch_status, r.document_type) for r in S.fetched_documents(spark, f"{tmp_path}/f").collect()}
    assert got == {("success", "html"), ("success", "pdf"), ("not_found", "unknown"), ("blocked", "unknown"), ("error", "unknown"), ("empty", "text"), ("empty", "unknown")}


def test_prose_of_siblings(spark):
    """A value is the model's where the match that states it follows the model, not where its digits begin another number."""
    from attesta.operators import sections as X

    pages = [
        (1, "Acme MX2000", "Up to 120 Hz refresh, or 90 Hz display on others. The MX2000 reaches 12000 nits, the Pro 22000 nits."),
        (2, "Acme 9", "The Acme 9 has a 120 Hz display, the Acme 109 has a 90 Hz display."), (3, "Acme 9", "With 120 Hz refresh or 90 Hz refresh. The Acme 9 charges at 120 W."), (4, None, "5,000 mAh or 4,000 mAh"),
    ]
    got = X.prose_facts(spark.createDataFrame(pages, "entity long, model string, text string")).collect()
    assert {(r.entity, r.attribute, r.value) for r in got} == {(1, "peak_brightness", "12000"), (2, "refresh_rate", "120")}
