"""Queries of extraction: pages and documents composed of supplier columns, whose facts SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import documents as D
from ..sources import html as H
from .normal import composed, stated
from .queries import SQL, query, table
from .specs import _filled, sql_text

#: A page about model AB{s}0C ({s}: a number of two digits of the supplier).
PAGE = """<html><head><title>Drill {s}</title><style>p {margin: 0}</style>
<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Drill {s}", "sku": "AB{s}0C", "weight": {"value": {s}, "unitText": "kg"}, "brand": {"name": "Acme"},
"additionalProperty": [{"name": "Chuck", "value": "13", "unitText": "mm"}, {"name": "Speeds", "value": 2}]}, {"@type": "Product", "name": "Other", "sku": "AB{s}9X", "color": "green"}], "url": "https://a.example/ld", "name": "Graph"}</script>
<script type="application/json">{"page": {"specs": [{"name": "Stroke", "value": "{s} mm"}, {"label": "Modes", "values": ["a", "b"]}], "technicalData": {"noLoad": "1{s} rpm", "tabTitle": "x", "link": "https://x"}, "blurb": "<table><tr><td>Grip</td><td>soft {s}</td></tr></table>"}}</script>
<script>window.state = {spec: 1}; var t = {productSpecs: [{name: 'Impact', value: '{s} J', on: !0,}], n: void 0}; var m = {"tech_spec_torque": {"defaultMessage": "Torque"}};
var rec = {"groupedTechSpecs": {"Power": ["torque"]}, "c_torque": "4{s} Nm"};</script></head>
<body><nav><ul><li><a href="/a">One</a></li></ul><p><b>Menu</b>: none</p></nav>
<h2>Technical data</h2><table><tr><th>Voltage</th><td>{s} V</td></tr><tr><td>Drilling</td><td></td></tr><tr><td>- Steel</td><td>1{s} mm</td></tr><tr><td>Noise</td><td>7{s} dB</td></tr></table>
<table class="related-products"><tr><td>Other</td><td>thing</td></tr></table>
<table><thead><tr><th>Model</th><th>AB{s}0C</th><th>AB{s}5D</th></tr></thead><tr><td>Length</td><td>2{s} mm</td><td>9 mm</td></tr></table>
<table><tr><th>Size</th><th>S</th><th>L</th></tr><tr><td>Reach</td><td>1 m</td><td>2 m</td></tr></table>
<dl><dt>Case</dt><dd>yes {s}</dd></dl><div hidden><p><strong>Fuse:</strong> {s} A</p></div><p>Just prose: with a colon</p>
<div class="attr"><span class="attr-name">Cable</span><span class="attr-value">{s} m</span></div>
<ul class="features"><li><i>Light</i><i>LED {s}</i></li><li><i>Belt</i><i>clip</i></li></ul>
<div class="box"><div><b>Lead</b> time {s}</div><div><b>Seal</b> - rubber</div><div><b>Features:</b> drying at 60 °C, then {s} °C. End</div></div>
<section class="spec-list"><h3>Class</h3><em data-value="II {s}">2</em></section><h2>Delivery</h2><dl><dt>Ships</dt><dd>today</dd></dl>
<script type="text/template"><dl><dt>Bag</dt><dd>nylon {s}</dd></dl></script><h2>Cards</h2><dl><dt>Screen</dt><dd>{s}0 Hz smooth refresh rate</dd></dl><template><p><b>Oil:</b> none {s}</p></template>
<img src="/p/{s}.jpg" alt="Front"><img src="/logo.png"><img src="/p/{s}.jpg"><button class="spec-toggle">All specs</button><footer>end</footer></body></html>"""
_LD, _STATE, _DATA = ("json_ld",), ("json_state",), "Technical data"
# Label, value, method, section, location.
PAGE_FACTS = (
    ("name", "Drill {s}", "json_ld_field", "", "json_ld"), ("sku", "AB{s}0C", "json_ld_field", "", "json_ld"), ("brand", "Acme", "json_ld_field", "", "json_ld"), ("weight", "{s} kg", "json_ld_field", "", "json_ld"), ("Chuck", "13 mm", "json_ld_property", "", "json_ld"), ("Speeds", "2", "json_ld_property", "", "json_ld"),
    ("Stroke", "{s} mm", "json_state_pair", "page > specs", "json_state"), ("Modes", "a, b", "json_state_pair", "page > specs", "json_state"), ("noLoad", "1{s} rpm", "json_state_map", "technicalData", "json_state"), ("Impact", "{s} J", "json_state_pair", "productSpecs", "json_state"), ("Torque", "4{s} Nm", "json_state_keyed_spec", "Power", "json_state"),
    ("Voltage", "{s} V", "table_row", _DATA, "visible_dom"), ("- Steel", "1{s} mm", "table_row", _DATA + " > Drilling", "visible_dom"), ("Noise", "7{s} dB", "table_row", _DATA, "visible_dom"), ("Length", "2{s} mm", "table_row_model_column", _DATA, "visible_dom"), ("Reach", "1 m | 2 m", "table_row_multi", _DATA, "visible_dom"),
    ("Case", "yes {s}", "definition_list", _DATA, "visible_dom"), ("Screen", "{s}0 Hz smooth refresh rate", "definition_list", "Cards", "visible_dom"), ("Cable", "{s} m", "element_pair", _DATA, "visible_dom"), ("Light", "LED {s}", "element_pair", _DATA, "visible_dom"), ("Belt", "clip", "element_pair", _DATA, "visible_dom"),
    ("Class", "2", "element_pair", _DATA, "visible_dom"), ("Fuse", "{s} A", "label_colon", _DATA, "dom_hidden"), ("Features", "drying at 60 °C, then {s} °C. End", "label_colon", _DATA, "visible_dom"), ("Oil", "none {s}", "label_colon", "Cards", "template"), ("Class", "II {s}", "structured_data", _DATA, "visible_dom"),
    ("Lead", "time {s}", "inline_label", _DATA, "visible_dom"), ("Seal", "rubber", "inline_label", _DATA, "visible_dom"), ("drying", "{s} °C", "feature_temperature", _DATA, "visible_dom"), ("Grip", "soft {s}", "table_row+json_html", "", "json_html"), ("Bag", "nylon {s}", "definition_list+script_template", "", "template"), ("Refresh Rate", "{s}0 Hz", "feature_measure", "Cards", "visible_dom"),
)


def _pages(spark, d):  # noqa: ANN001, ANN202
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("page_id"), _filled(F.lit(PAGE)).alias("html"), F.concat(F.lit("AB"), F.col("s_nationkey") + 10, F.lit("0C")).alias("model"))


@query(f"SELECT s_suppkey AS page_id, label, value, method, section, location FROM {stated(PAGE_FACTS, ('label', 'value', 'method', 'section', 'location'), ('value',))}")
def html_facts(spark, d):  # noqa: ANN001, ANN201
    return H.page_facts(_pages(spark, d), "model").select("page_id", "label", "value", "method", "section", "location")


_OUT = (("neighbour_json_ld_product", 1), ("neighbour_context_table", 1), ("neighbour_context_line", 1), ("non_spec_section", 1))


@query(f"SELECT s_suppkey AS page_id, reason, n::INTEGER AS n FROM supplier, (VALUES {', '.join(f'({sql_text(a)}, {b})' for a, b in _OUT)}) AS v(reason, n)")
def html_exclusions(spark, d):  # noqa: ANN001, ANN201
    return H.page_exclusions(_pages(spark, d), "model").select("page_id", "reason", "n")


@query("""SELECT s_suppkey AS page_id, kind, replace(url, '{s}', (s_nationkey + 10)::VARCHAR) AS url, said FROM supplier, (VALUES ('image', '/p/{s}.jpg', 'Front'), ('link', '/a', 'One'), ('data', 'https://a.example/ld', 'Graph'), ('control', 'true', 'All specs')) AS v(kind, url, said)""")
def html_links_and_images(spark, d):  # noqa: ANN001, ANN201
    p = _pages(spark, d)
    row = lambda df, kind, url, said: df.select("page_id", F.lit(kind).alias("kind"), url.alias("url"), said.alias("said"))
    out = row(H.page_images(p), "image", F.col("url"), F.col("alt")).unionByName(row(H.page_links(p), "link", F.col("href"), F.col("anchor"))).unionByName(row(H.page_data_links(p), "data", F.col("href"), F.col("anchor")))
    i = H.page_inspection(p)
    return out.unionByName(row(i, "control", (F.col("expandable") & F.col("n_controls").isin(1)).cast("string"), F.array_join("spec_controls", "|")))


SQL["html_text"] = r"""SELECT page_id, 0 AS seq, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g'), ' +', ' ', 'g')) AS text FROM (SELECT page_id,
regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<header.*?</header>|<aside.*?</aside>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)"""

# ---------------------------------------------------------------- documents
# Page, text of a manual for AB{s}0C.
MANUAL = (
    (1, "Manual for AB{s}0C\nWeight: {s} kg in prose part\nNote: read this"),
    (2, "Technical data\n• Voltage: {s} V\nNo load speed   1{s}00 rpm\nHold for 5 s\nPlease note: never open\nweight: {s} kg\n\n-  Depth: 3{s} mm"),
    (3, "Belt 7\nCase: steel {s}\nWeight: {s} KG"), (4, "For AB{s}5D only\nWidth: 9 mm"), (5, "AB{s}0C and AB{s}5D\nHeight: 9 mm"),
)
LEAFLET = ((1, "Leaflet AB{s}0C\nColour: red {s}"), (2, "Size: {s} cm\nhttp: no"))
OTHER = ((1, "For nothing\nColour: blue"),)


def _documents(spark, d):  # noqa: ANN001, ANN202
    rows = [(k, kind, page, text) for k, (kind, pages) in enumerate((("manual", MANUAL), ("datasheet", LEAFLET), ("datasheet", OTHER))) for page, text in pages]
    r = composed(spark, d, rows, ["k", "document_type", "page", "text"])
    return r.select((F.col("s_suppkey") * 10 + F.col("k")).alias("doc_id"), F.col("page").cast("int").alias("page"), "text", F.concat(F.lit("AB"), F.col("s_nationkey") + 10, F.lit("0C")).alias("model"), "document_type")


# Document, page, label, value, method, scope.
DOCUMENT_FACTS = ((1, 1, "Colour", "red {s}", "pdf_label_colon", "document_model_page"), (1, 2, "Size", "{s} cm", "pdf_label_colon", "document_scope"), (1, 2, "http", "no", "", ""))


@query(f"SELECT s_suppkey * 10 + k AS doc_id, page::INTEGER AS page, scope, label, value, method FROM {stated(DOCUMENT_FACTS[:2], ('k', 'page', 'label', 'value', 'method', 'scope'), ('value',))}")
def document_facts(spark, d):  # noqa: ANN001, ANN201
    return D.document_facts(_documents(spark, d))


@query("SELECT s_suppkey * 10 AS doc_id, reason, n::BIGINT AS n FROM supplier, (VALUES ('neighbour_sku_shared_page', 1), ('neighbour_sku_ambiguous_page', 3)) AS v(reason, n)")
def document_exclusions(spark, d):  # noqa: ANN001, ANN201
    return D.excluded_pages(_documents(spark, d))


_LINES = (
    (1, "Manual for AB{s}0C", False), (1, "Weight: {s} kg in prose part", False), (1, "Note: read this", False), (2, "Voltage: {s} V", True), (2, "No load speed 1{s}00 rpm", True), (2, "Hold for 5 s", True), (2, "Please note: never open", True), (2, "weight: {s} kg", True), (2, "Depth: 3{s} mm", True), (3, "Belt 7", True),
    (3, "Case: steel {s}", True), (3, "Weight: {s} KG", True), (4, "For AB{s}5D only", True), (4, "Width: 9 mm", True), (5, "AB{s}0C and AB{s}5D", True), (5, "Height: 9 mm", True),
)


@query(f"SELECT s_suppkey * 10 AS doc_id, page::INTEGER AS page, said AS text, tech FROM {stated(_LINES, ('page', 'said', 'tech'), ('said',))}")
def document_sections(spark, d):  # noqa: ANN001, ANN201
    return D.document_lines(_documents(spark, d)).filter("document_type = 'manual'").select("doc_id", "page", "text", "tech")


SHEET = (
    "12\nEN\nSpecifications\nPower: {s} W\nVoltage (mains\n220-240 V)\nNet weight\n{s} kg\nNoise 7{s} dB", "Some prose without pairs\nand more of it", "Width: {s} mm\nDepth: 2{s} mm\nsee page 7", "Only: one pair\nline two\nline three", "Hotline: 123\nE-mail: x\nFax: 5", "Contents ........ 5\nLength: 1 m\nTitle.: no", "Parameters\nMode: fast and",
)
# Block, page number, heading, label, value.
SHEET_FACTS = (
    (0, "12", "Specifications", "Power", "{s} W"), (0, "12", "Specifications", "Net weight", "{s} kg"), (0, "12", "Specifications", "Noise", "7{s} dB"), (2, None, None, "Width", "{s} mm"), (2, None, None, "Depth", "2{s} mm"),
)


@query(f"SELECT s_suppkey AS doc_id, block::INTEGER AS block, number AS page_number, heading, label, value FROM {stated(SHEET_FACTS, ('block', 'number', 'heading', 'label', 'value'), ('value',))}")
def document_blocks(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_suppkey", "s_nationkey", _filled(F.lit("\n\n".join(SHEET))).alias("text"))
    return D.spec_blocks(docs)


TEXT = "Power: {s} W\nLength ..... 3{s} cm\nWeight 2{s} kg\nSpeed\n{s} rpm\nAnna Smith\n5\n01.02.2024\nNo fact here\nModel 7 speed 5 rpm"
TEXT_FACTS = (("Power", "{s} W", "product"), ("Length", "3{s} cm", "product"), ("Weight", "2{s} kg", "product"), ("Speed", "{s} rpm", "product"))


@query(f"SELECT s_suppkey AS doc_id, label, value, kind FROM {stated(TEXT_FACTS, ('label', 'value', 'kind'), ('value',))} UNION ALL SELECT s_suppkey, label, value, kind FROM supplier, (VALUES ('SKU', 'x', 'identity'), ('Price', '5', 'commerce'), ('EUR', '5', 'commerce'), ('Mood', 'good', 'unknown'), ('Reach', '5 m', 'product')) AS v(label, value, kind)")
def line_pairs(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_suppkey", "s_nationkey", _filled(F.lit(TEXT)).alias("text"))
    more = spark.createDataFrame([("SKU", "x"), ("Price", "5"), ("EUR", "5"), ("Mood", "good"), ("Reach", "5 m")], "label string, value string")
    both = D.line_pairs(docs).select("doc_id", "label", "value").unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id")).join(F.broadcast(more), F.lit(True)).select("doc_id", "label", "value"))
    return both.select("doc_id", "label", "value", D.attribute_kind(F.col("label"), F.col("value"), F.lit("spec_block")).alias("kind"))
