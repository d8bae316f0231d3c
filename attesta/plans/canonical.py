"""Queries of concept mapping over attributes composed of supplier columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import concepts as K
from ..functions import measure as M
from ..operators import concepts as O
from .normal import composed, stated
from .queries import query, table

TABLE = [
    K.Concept("power_w", "measure", "W", "power", labels=(r"^(?:rated )?power$", r"^leistung$"), weak=(r"^connection$",), plausible=(1, 20000), component=True),
    K.Concept("weight_kg", "measure", "kg", "mass", labels=(r"^(?:net )?weight$", r"^gewicht$"), plausible=(0.2, 90)),
    K.Concept("height_mm", "measure", "mm", "length", labels=("^height$", "^hohe$"), groups=("dimension",), plausible=(150, 2500)),
    K.Concept("dimensions", "dimensions", "mm", "length", labels=("^dimensions",), plausible=(100, 3000), axis_split=True),
    K.Concept("has_timer", "boolean", labels=("^timer$",)),
    K.Concept("programmes", "count", labels=("^programmes$",), prefix=True, categories=("oven",)),
    K.Concept("capacity_l", "measure", "L", "volume", categories=("oven",), generic=("^capacity$",), labels=("^volume$",)),
    K.Concept("capacity_kg", "measure", "kg", "mass", categories=("oven",), generic=("^capacity$",)),
    K.Concept("material", "text", labels=("^material$",), list_field=True),
    K.Concept("steel_type", "text", labels=("^material$",), value_gate="steel"),
    K.Concept("warranty_years", "measure", "year", "duration_years", labels=("^warranty$",)),
    K.Concept("drill_steel", "measure", "mm", "length", groups=("drilling",), need_group=True, labels=("^steel$",)),
    K.Concept("heating", "text", groups=("^heating modes$",), group_only=True),
    K.Concept("movements", "measure", labels=("^movements$",), value_pattern=r"(\d[\d.,]*) strokes"),
    K.Concept("temperature_c", "measure", "°C", "temperature", labels=("^max temperature$",), test=(0, 300, "hotter than any oven")),
]
# Category, label, aliases, groups, value, kind, unit, truth, alternates | status, key, confidence, value, unit, unit status, way.
ATTRIBUTES = (
    ("oven", "Rated power", "", "", "1.5", "number", "kW", None, "", "mapped", "power_w", 0.93, "1500", "W", "converted", "label"), ("oven", "Connection", "", "", "2{s}", "number", "W", None, "", "ambiguous", None, None, None, None, None, None),
    ("oven", "Weight", "Gewicht", "", "{s}", "number", "", None, "", "mapped", "weight_kg", 0.75, "{s}", "kg", "implied", "label"), ("oven", "Weight", "Höhe", "", "{s}", "number", "kg", None, "", "mapped", "weight_kg", 0.83, "{s}", "kg", "explicit", "label"),
    ("oven", "Height", "", "Dimensions", "9{s}", "number", "mm", None, "", "mapped", "height_mm", 0.98, "9{s}", "mm", "explicit", "label"), ("oven", "Height", "", "", "3.32", "number", "in", None, "84.3 mm", "mapped", "height_mm", 0.93, "84.3", "mm", "converted", "label"),
    ("oven", "Dimensions (HxWxD)", "", "", "5{s} × 600 × 550", "dimensions", "mm", None, "", "mapped", "dimensions", 0.93, "5{s} × 600 × 550", "mm", "explicit", "label"), ("oven", "Timer", "", "", "Yes, {s} hours", "text", "", None, "", "mapped", "has_timer", 0.85, "true", "", "", "label"),
    ("oven", "Programmes", "", "", "{s} automatic programmes", "text", "", None, "", "mapped", "programmes", 0.88, "{s}", "", "", "label"), ("tool", "Programmes", "", "", "{s} automatic programmes", "text", "", None, "", "unmapped", None, None, None, None, None, None),
    ("oven", "Capacity", "", "", "{s}", "number", "L", None, "", "mapped", "capacity_l", 0.78, "{s}", "L", "explicit", "generic"), ("oven", "Capacity", "", "", "{s}", "number", "", None, "", "ambiguous", None, None, None, None, None, None),
    ("oven", "Material", "", "", "Steel grade {s}", "text", "", None, "", "ambiguous", None, None, None, None, None, None), ("oven", "Material", "", "", "Glass {s}", "text", "", None, "", "mapped", "material", 0.9, "Glass {s}", "", "", "label"),
    ("oven", "Warranty", "", "", "24 Monate", "text", "", None, "", "mapped", "warranty_years", 0.93, "2", "year", "converted", "label"), ("oven", "Steel", "", "Drilling capacity", "1{s}", "number", "mm", None, "", "mapped", "drill_steel", 0.98, "1{s}", "mm", "explicit", "label"),
    ("oven", "Steel", "", "", "1{s}", "number", "mm", None, "", "unmapped", None, None, None, None, None, None), ("oven", "Grill", "", "Heating modes", "wide", "text", "", None, "", "mapped", "heating", 0.78, "wide", "", "", "group_only"),
    ("oven", "Movements", "", "", "about 62,000 strokes a minute", "text", "", None, "", "mapped", "movements", 0.85, "62000", "", "none", "value_pattern"), ("oven", "Max temperature", "", "", "482", "number", "°F", None, "", "mapped", "temperature_c", 0.93, "250", "°C", "converted", "label"),
    ("oven", "Max temperature", "", "", "9{s}", "number", "°C", None, "", "ambiguous", None, None, None, None, None, None), ("oven", "Leistungs Name", "Leistung", "", "{s}", "number", "W", None, "", "mapped", "power_w", 0.9, "{s}", "W", "explicit", "alias"),
    ("oven", "Colour", "", "", "red", "text", "", None, "", "not_a_spec", None, None, None, None, None, None), ("oven", "Motto", "", "", "It helps you cook", "text", "", None, "", "not_a_spec", None, None, None, None, None, None), ("oven", "Type", "", "", "X{s}", "text", "", None, "", "unmapped", None, None, None, None, None, None),
    ("oven", "Rated power", "", "", "up to 9{s} W (peak)", "text", "", None, "", "mapped", "power_w", 0.77, "9{s}", "W", "explicit", "embedded_measure"), ("oven", "Timer", "", "", "{s}", "number", "kg", None, "", "ambiguous", None, None, None, None, None, None),
    ("oven", "Material", "", "", "Glass", "text", "", None, "", "mapped", "material", 0.9, "Glass", "", "", "label"), ("oven", "Power", "", "", "1500", "number", "W", None, "", "mapped", "power_w", 0.93, "1500", "W", "explicit", "label"),
    ("oven", "Volume", "", "", "{s} Liter", "text", "", None, "", "mapped", "capacity_l", 0.96, "{s}", "L", "explicit", "label"), ("oven", "Volume", "", "", "7.5", "number", "dl", None, "", "mapped", "capacity_l", 0.96, "0.75", "L", "converted", "label"), ("oven", "Warranty", "", "", "2", "number", "year", None, "", "mapped", "warranty_years", 0.93, "2", "year", "explicit", "label"),
)
_IN = ("category", "label", "alias", "grp", "value", "kind", "unit", "truth", "alternate")
_OUT = ("status", "key", "confidence", "found", "found_unit", "unit_status", "way")
_ROWS = tuple((*r[:11], None if r[11] is None else str(r[11]), *r[12:]) for r in ATTRIBUTES)
_SQL = stated(_ROWS, (*_IN, *_OUT), ("value", "found"))


def _attributes(spark, d):  # noqa: ANN001, ANN202
    rows = composed(spark, d, [r[:9] for r in ATTRIBUTES], _IN)
    one = lambda c: F.filter(F.array(c), lambda x: x != "")
    return rows.select(F.col("s_suppkey").alias("entity"), F.col("i").alias("id"), "category", "label", one("alias").alias("aliases"), one("grp").alias("group_path"), "value", "kind", "unit", F.col("truth").cast("boolean").alias("boolean"), F.lit("").alias("display"), one("alternate").alias("alternates"), F.lit("table_row").alias("method"))


@query(f"""SELECT s_suppkey AS entity, i AS id, status, key, confidence::DOUBLE AS confidence, found AS value, found_unit AS unit, unit_status, way AS method FROM {_SQL}
UNION ALL SELECT s_suppkey, 7, 'mapped', k, 0.91, v, 'mm', 'explicit', 'dimension_split' FROM (SELECT s_suppkey, unnest(['height_mm', 'width_mm', 'depth_mm']) AS k, unnest(['5' || (s_nationkey + 10), '600', '550']) AS v FROM supplier)""")
def map_concepts(spark, d):  # noqa: ANN001, ANN201
    return O.map_concepts(_attributes(spark, d), TABLE).select("entity", "id", "status", "key", "confidence", "value", "unit", "unit_status", "method")


@query(f"""SELECT s_suppkey AS entity, count(*) AS specs, count(*) FILTER (status = 'mapped') AS mapped, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmapped') AS unmapped, count(*) FILTER (status = 'not_a_spec') AS not_a_spec,
count(*) FILTER (status <> 'not_a_spec') AS eligible, count(DISTINCT key) + 2 AS keys, round(count(*) FILTER (status = 'mapped') / count(*) FILTER (status <> 'not_a_spec'), 3) AS coverage FROM {_SQL} GROUP BY s_suppkey""")
def mapping_summary(spark, d):  # noqa: ANN001, ANN201
    return O.mapping_summary(O.map_concepts(_attributes(spark, d), TABLE))


@query(f"""WITH m AS (SELECT s_suppkey, i, key, found, found_unit, value, unit_status FROM {_SQL} WHERE status = 'mapped' UNION ALL SELECT s_suppkey, 7, 'height_mm', '5' || (s_nationkey + 10), 'mm', '', 'explicit' FROM supplier)
SELECT s_suppkey AS entity, key, count(DISTINCT i) AS members, CASE WHEN key = 'material' THEN 'list_field' WHEN count(DISTINCT (found, found_unit)) > 1 THEN 'different_values' WHEN count(DISTINCT value) > 1 AND bool_or(unit_status = 'converted') THEN 'equivalent_after_conversion' ELSE 'same_value' END AS kind FROM m GROUP BY s_suppkey, key HAVING count(DISTINCT i) > 1""")
def mapping_collisions(spark, d):  # noqa: ANN001, ANN201
    a = _attributes(spark, d)
    m = O.map_concepts(a, TABLE).join(a.select("entity", "id", F.col("value").alias("display")), ["entity", "id"])
    return O.field_collisions(m, TABLE)


@query(f"""WITH m AS (SELECT s_suppkey, i, key, row_number() OVER (PARTITION BY s_suppkey, key, i % 2 ORDER BY i) AS n, confidence::DOUBLE AS confidence FROM {_SQL} WHERE key = 'power_w')
SELECT s_suppkey AS entity, i AS id, CASE WHEN n > 1 THEN 'secondary_component_power_w' ELSE key END AS key, round(CASE WHEN n > 1 THEN confidence - 0.1 ELSE confidence END, 3) AS confidence FROM m""")
def mapping_components(spark, d):  # noqa: ANN001, ANN201
    m = O.map_concepts(_attributes(spark, d), TABLE).withColumn("block", F.col("id") % 2)
    return O.repeated_components(m, TABLE).filter("key like '%power_w'").select("entity", "id", "key", "confidence")


_FAMILY_UNITS = [(f, u) for f, (_, units) in M.FAMILIES.items() for u in units]
_FACTOR_SQL = " ".join(f"WHEN family = '{f}' AND unit = '{u}' THEN " + ("(x - 32) * 5 / 9.0" if u == "°F" else f"x * {x.partition('/')[0]}" + (f" / {x.partition('/')[2]}" if "/" in x else "")) for f, (_, us) in M.FAMILIES.items() for u, x in us.items())


@query(f"""SELECT s_suppkey, family, unit, round((CASE {_FACTOR_SQL} END)::DOUBLE, 4) AS base FROM (SELECT s_suppkey, s_nationkey::DOUBLE + 1.5 AS x, unnest({[f for f, _ in _FAMILY_UNITS]}) AS family, unnest({[u for _, u in _FAMILY_UNITS]}) AS unit FROM supplier)""")
def convert_families(spark, d):  # noqa: ANN001, ANN201
    pairs = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(u).alias("unit")) for f, u in _FAMILY_UNITS])
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1.5).alias("x"), F.explode(pairs).alias("p")).select("s_suppkey", "x", "p.*")
    base = F.coalesce(*[F.when(F.col("family") == f, M.to_base(f, F.col("unit"), F.col("x")).cast("double")) for f in M.FAMILIES])
    return s.select("s_suppkey", "family", "unit", F.round(base, 4).alias("base"))
