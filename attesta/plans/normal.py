"""Queries of normalization: labels and values composed of supplier columns, whose records SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import normalization as Z
from .queries import query, table
from .specs import FILLED, _filled, sql_rows

_AT = "(s_suppkey % {n}) = i"


def composed(spark, d, rows, names):  # noqa: ANN001, ANN201
    """A row of constants for each supplier and row, numbers filled in."""
    types = [type(next((r[k] for r in rows if r[k] is not None), "")) for k in range(len(names))]
    lit = lambda v, t: F.lit(v).cast("string" if t is str else "boolean" if t is bool else "long")
    items = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), *[lit(v, t).alias(n) for v, t, n in zip(r, types, names, strict=True)]) for i, r in enumerate(rows, 1)])
    page = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.explode(items).alias("r")).select("s_suppkey", "s_nationkey", "r.*")
    return page.select("s_suppkey", "s_nationkey", "i", *[(_filled(F.col(n)) if t is str else F.col(n)).alias(n) for n, t in zip(names, types, strict=True)])


def stated(rows, names, texts):  # noqa: ANN001, ANN201
    """The same in SQL: FROM clause with i and the columns, texts of them filled in."""
    values = ", ".join(f"{FILLED.format(n)} AS {n}" if n in texts else n for n in names)
    return f"(SELECT s_suppkey, s_nationkey, i::BIGINT AS i, {values} FROM supplier, (VALUES {sql_rows([(i, *r) for i, r in enumerate(rows, 1)])}) AS v(i, {', '.join(names)}))"


# Written value, kind, what is shown, unit, least, greatest, truth, alternates.
VALUES = (
    ("{s},5 kg", "number", "{s}.5", "kg", "{s}.5", "{s}.5", None, ""), ("{s}-9{s} mm", "range", "{s}–9{s}", "mm", "{s}", "9{s}", None, ""), ("20 x {s} x 50,5 cm", "dimensions", "20 × {s} × 50.5", "cm", None, "50.5", None, ""),
    ("{s} HzHz", "number", "{s}", "Hz", "{s}", "{s}", None, ""), ("{s} in (8{s} mm)", "number", "{s}", "in", "{s}", "{s}", None, "8{s} mm"), ("Yes.", "boolean", "true", None, None, None, True, ""),
    ("specs.general.hasFan.no", "boolean", "no", None, None, None, False, ""), ("n/a", "placeholder", "n/a", None, None, None, None, ""), ("Lorem ipsum {k}", "template_text", "Lorem ipsum {k}", None, None, None, None, ""),
    ("Details:", "heading", "Details", None, None, None, None, ""), ("labels.productName.title", "i18n_key", "labels.productName.title", None, None, None, None, ""), ("910-007{s}", "text", "910-007{s}", None, None, None, None, ""),
    ("1.234.567 rpm", "number", "1234567", "rpm", "1234567", "1234567", None, ""), ("Text number {s} ,, here.", "text", "Text number {s}, here", None, None, None, None, ""), ("-{s} °C", "number", "-{s}", "°C", "-{s}", "-{s}", None, ""),
    ("9{s}-1{s} mm", "text", "9{s}-1{s} mm", None, None, None, None, ""), ("{s} V V", "number", "{s}", "V", "{s}", "{s}", None, ""), ("caf&amp;eacute; {s}", "text", "café {s}", None, None, None, None, ""),
    ("de-DE: Stahl, fr: Acier", "text", "Stahl, Acier", None, None, None, None, ""), ("1,234.5 Wh", "number", "1234.5", "Wh", "1234.5", "1234.5", None, ""), ("{s} furlong", "text", "{s} furlong", None, None, None, None, ""), ("да", "boolean", "true", None, None, None, True, ""), ("Ja!", "boolean", "true", None, None, None, True, ""),
    ("Ｆｕｌｌ {s}*", "text", "Full {s}", None, None, None, None, ""), ("Ã©tÃ© {s}", "text", "été {s}", None, None, None, None, ""),
)
_VALUE_NAMES = ("raw", "kind", "shown", "unit", "low", "high", "truth", "alternates")


@query(f"""SELECT s_suppkey, i, raw, kind, shown, unit, CASE WHEN kind = 'dimensions' THEN least(20, s_nationkey + 10) ELSE low::DECIMAL(18, 6) END::DOUBLE AS low, CASE WHEN kind = 'dimensions' THEN greatest(50.5, s_nationkey + 10) ELSE high::DECIMAL(18, 6) END::DOUBLE AS high, truth, alternates
FROM {stated(VALUES, _VALUE_NAMES, ("raw", "shown", "low", "high", "alternates"))}""")
def normalize_value(spark, d):  # noqa: ANN001, ANN201
    rows = composed(spark, d, [v[:1] for v in VALUES], ["raw"]).withColumn("v", N.normalize_value(F.col("raw")))
    return rows.select("s_suppkey", "i", "raw", "v.kind", F.coalesce("v.value", "v.text").alias("shown"), "v.unit", F.col("v.minimum").cast("double").alias("low"), F.col("v.maximum").cast("double").alias("high"), F.col("v.boolean").alias("truth"), F.array_join("v.alternates", "; ").alias("alternates"))


# Label, section, label as shown, key, nested, unit, groups, qualified label.
LABELS = (
    ("Power (W):", "Specs > Electrical", "Power", "power", False, "W", "Specs|Electrical", "Power"), ("- Steel {s}", "Drilling capacity", "Steel {s}", "steel {s}", True, "", "Drilling capacity", "Drilling capacity > Steel {s}"),
    ("batteryCapacity", "", "battery Capacity", "battery capacity", False, "", "", "battery Capacity"), ("MAX_TORQUE*", "", "Max torque", "max torque", False, "", "", "Max torque"), ("Hi", "Technical data", "Hi", "hi", False, "", "Technical data", "Hi"),
    ("Lo", "Speed {s}", "Lo", "lo", False, "", "Speed {s}", "Speed {s} > Lo"), ("Weight, kg", "a > b", "Weight", "weight", False, "kg", "a|b", "Weight"), ("specs.motor.noLoadSpeed", "", "no Load Speed", "no load speed", False, "", "", "no Load Speed"),
    ("Länge der Straße", "", "Länge der Straße", "lange der strasse", False, "", "", "Länge der Straße"), ("• It's {k} (x)", "Specs", "It's {k} (x)", "its {k} x", True, "", "Specs", "It's {k} (x)"), ("", "x", "", "", False, "", "x", "x > "),
)
_LABEL_NAMES = ("raw", "section", "label", "key", "nested", "hint", "path", "qualified")


@query(f"SELECT s_suppkey, i, label, key, nested, hint, path, qualified FROM {stated(LABELS, _LABEL_NAMES, ('label', 'key', 'path', 'qualified'))}")
def normalize_label(spark, d):  # noqa: ANN001, ANN201
    rows = composed(spark, d, [r[:2] for r in LABELS], ["raw", "section"]).withColumn("l", N.normalize_label(F.col("raw"), F.col("section")))
    return rows.select("s_suppkey", "i", "l.label", "l.key", "l.nested", F.col("l.unit_hint").alias("hint"), F.array_join("l.group_path", "|").alias("path"), "l.qualified")


# Label, value, method, section, class, reason: each reason once.
PAIRS = (
    ("", "1", "table_row", "", "UNKNOWN", "empty_label"), ("@type", "Product", "json_state_map", "", "UNKNOWN", "schema_artifact"), ("Depth", "n/a", "table_row", "", "UNKNOWN", "placeholder_value"), ("Note", "dolor sit amet", "table_row", "", "UNKNOWN", "template_text"),
    ("Title", "labels.productName.title", "table_row", "", "UNKNOWN", "unresolved_i18n_key"), ("Top", "General:", "table_row", "", "UNKNOWN", "value_is_heading"), ("weight", "{s} kg", "json_ld_field", "", "SPEC", "json_ld_measure"), ("description", "Good", "json_ld_field", "", "CONTENT", "json_ld_content"),
    ("name", "Thing {s}", "json_ld_field", "", "IDENTITY", "json_ld_scalar"), ("Model number", "X{s}", "table_row", "", "IDENTITY", "identifier_label"), ("Manual", "PDF {s} MB", "table_row", "", "CONTENT", "download_entry"), ("Variant", "GX-{k}00A z", "table_row", "", "IDENTITY", "value_is_model_identifier"),
    ("EN 60335-1", "conform", "table_row", "", "UNKNOWN", "standard_reference"), ("{s} mm", "big", "table_row", "", "UNKNOWN", "label_is_value"), ("Subscribe now", "here", "table_row", "", "CONTENT", "content_label"), ("Returned", "30 days", "table_row", "Shipping info", "CONTENT", "content_section"),
    ("Story", "One two three four five six seven eight nine ten eleven twelve", "text_block", "", "CONTENT", "prose_value"), ("Speed", "{s} rpm", "text_block", "", "SPEC", "measurable_value"), ("Material", "steel", "table_row", "", "SPEC", "structured_pair"),
    ("Finish", "matt", "text_block", "Technical data", "SPEC", "spec_section"), ("Finish", "matt", "text_block", "Other", "UNKNOWN", "unstructured_pair"),
)


def raw_pairs(rows):  # noqa: ANN001, ANN201
    """Columns of raw pairs for composed rows that lack some of them."""
    have = rows.columns
    fill = {"source_url": F.lit("https://a.example/en/p"), "source_type": F.lit("manufacturer"), "model": F.concat(F.lit("GX"), "s_suppkey", F.lit("00A"))}
    return rows.select(F.col("s_suppkey").alias("entity"), F.col("i").alias("seq"), *[F.col(c) if c in have else fill[c].alias(c) for c in ("label", "value", "method", "section", "source_url", "source_type", "model")])


@query(f"SELECT s_suppkey AS entity, i AS seq, cls, reason FROM {stated(PAIRS, ('label', 'value', 'method', 'section', 'cls', 'reason'), ())}")
def classify_pairs(spark, d):  # noqa: ANN001, ANN201
    rows = composed(spark, d, [r[:4] for r in PAIRS], ["label", "value", "method", "section"])
    return Z.normalized_records(raw_pairs(rows)).select("entity", "seq", "cls", "reason")


EN, DE, OTHER = "https://a.example/en/p{k}", "https://a.example/de/p{k}", "https://b.example/x"
# Label, value, method, section, page, the first of its cluster, display of the cluster's head, its class.
CLUSTERS = (
    ("Power", "{s} W", "table_row", "", OTHER, 1, "{s} W", "SPEC"), ("power:", "{s}W", "text_block", "", EN, 1, "{s} W", "SPEC"), ("Power (W)", "{s}", "table_row", "", EN, 1, "{s} W", "SPEC"), ("Power", "{s} kW", "table_row", "", OTHER, 4, "{s} kW", "SPEC"),
    ("Width", "3{s}", "table_row", "", OTHER, 5, "3{s} mm", "SPEC"), ("Width", "3{s} mm", "table_row", "", OTHER, 5, "3{s} mm", "SPEC"), ("Note", "lorem ipsum", "text_block", "Form", OTHER, 7, "lorem ipsum", "UNKNOWN"), ("Name", "you", "table_row", "Form", OTHER, 8, "you", "UNKNOWN"),
    ("Height", "1{s} mm", "definition_list", "", EN, 9, "1{s} mm", "SPEC"), ("Depth", "2{s} mm", "definition_list", "", EN, 10, "2{s} mm", "SPEC"), ("Volume", "{s} L", "definition_list", "", EN, 11, "{s} L", "SPEC"), ("Mass", "7 kg", "definition_list", "", EN, 12, "7 kg", "SPEC"),
    ("Höhe", "1{s} mm", "definition_list", "", DE, 9, "1{s} mm", "SPEC"), ("Tiefe", "2{s} mm", "definition_list", "", DE, 10, "2{s} mm", "SPEC"), ("Inhalt", "{s} L", "definition_list", "", DE, 11, "{s} L", "SPEC"), ("Masse", "7 kg", "definition_list", "", DE, 12, "7 kg", "SPEC"),
    ("Socket", "1.5Ah 2Ah pack", "table_row", "", OTHER, 17, "1.5 Ah 2 Ah pack", "SPEC"), ("Height", "1{s} mm", "table_row", "", OTHER, 9, "1{s} mm", "SPEC"),
)
_CLUSTER_NAMES = ("label", "value", "method", "section", "source_url", "head", "display", "cls")


@query(f"SELECT s_suppkey AS entity, head::BIGINT AS cluster, min(display) AS display, min(cls) AS cls, count(*) AS n, min(i) AS first FROM {stated(CLUSTERS, _CLUSTER_NAMES, ('display',))} GROUP BY s_suppkey, head")
def normalize_clusters(spark, d):  # noqa: ANN001, ANN201
    rows = composed(spark, d, [r[:5] for r in CLUSTERS], ["label", "value", "method", "section", "source_url"])
    out = Z.normalize_attributes(raw_pairs(rows))
    return out.select("entity", "cluster", "display", "cls", "n", F.col("evidence")[0]["seq"].alias("first"))


# Key, value, page, node, role, variant.
SCALARS = (
    ("name", "Red one", EN, 0, "variant", "red"), ("sku", "A{k}", EN, 0, "variant", "red"), ("color", "red", EN, 0, "variant", "red"), ("name", "Blue one", EN, 1, "variant", "Blue one"), ("sku", "B{k}", EN, 1, "variant", "Blue one"),
    ("name", "All of them", EN, 2, "parent", ""), ("name", "Alone", OTHER, 0, "product", ""), ("gtin", "{s}", OTHER, 0, "product", ""), ("sku", "C{k}", DE, 0, "variant", "L"), ("size", "L", DE, 0, "variant", "L"),
)


@query(f"SELECT s_suppkey AS entity, source_url, node, role, variant, count(*) AS n FROM {stated(SCALARS, ('label', 'value', 'source_url', 'node', 'role', 'variant'), ('source_url',))} GROUP BY ALL")
def identity_nodes(spark, d):  # noqa: ANN001, ANN201
    rows = composed(spark, d, [r[:3] for r in SCALARS], ["label", "value", "source_url"]).withColumn("method", F.lit("json_ld_field")).withColumn("section", F.lit(""))
    return Z.identity_nodes(Z.normalized_records(raw_pairs(rows))).select("entity", "source_url", "node", "role", "variant", F.size("seqs").cast("long").alias("n"))
