"""Numbers, units, measures and the figures of audits, as native expressions."""

from __future__ import annotations

from decimal import Decimal
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact factors to base units, tolerances in them, words for yes and no.
TO_GRAM = {"mg": "0.001", "g": "1", "kg": "1000", "lb": "453.59237", "oz": "28.349523125"}
TO_MM = {"mm": "1", "cm": "10", "m": "1000", "in": "25.4"}
TOLERANCE = {"mass_g": "1", "length_mm": "0.1"}
TRUE_WORDS = ("1", "yes", "true", "on", "enabled", "да")
FALSE_WORDS = ("0", "no", "false", "off", "disabled", "нет")
# Families of the canonical mapper: base unit, exact factors.
FAMILIES = {
    "length": ("mm", {"mm": "1", "cm": "10", "m": "1000", "in": "25.4", "ft": "304.8", "µm": "0.001"}),
    "mass": ("kg", {"kg": "1", "g": "0.001", "mg": "0.000001", "lb": "0.45359237", "oz": "0.028349523125"}),
    "volume": ("L", {"L": "1", "ml": "0.001", "cl": "0.01", "dl": "0.1"}),
    "power": ("W", {"W": "1", "kW": "1000"}),
    "voltage": ("V", {"V": "1", "mV": "0.001", "kV": "1000"}),
    "current": ("A", {"A": "1", "mA": "0.001"}),
    "charge": ("Ah", {"Ah": "1", "mAh": "0.001"}),
    "energy": ("Wh", {"Wh": "1", "kWh": "1000"}),
    "frequency": ("Hz", {"Hz": "1", "kHz": "1000", "MHz": "1000000"}),
    "rotation": ("rpm", {"rpm": "1"}),
    "impact_rate": ("ipm", {"ipm": "1", "bpm": "1"}),
    "pressure": ("bar", {"bar": "1", "kPa": "0.01", "Pa": "0.00001", "MPa": "10"}),
    "torque": ("Nm", {"Nm": "1"}),
    "sound": ("dB(A)", {"dB(A)": "1"}),
    "temperature": ("°C", {"°C": "1", "°F": "5/9"}),  # °F has another zero too
    "resolution": ("DPI", {"DPI": "1"}),
    "duration_months": ("month", {"month": "1", "year": "12"}),
    "duration_years": ("year", {"year": "1", "month": "1/12"}),
    "duration_h": ("h", {"h": "1", "min": "1/60", "d": "24"}),
    "distance": ("m", {"m": "1", "cm": "0.01", "mm": "0.001", "ft": "0.3048", "in": "0.0254"}),
}
FACTOR = "decimal(22,12)"


def number_text(c: Column) -> Column:
    """A written number with a point: of comma and point the later is decimal; groups of three after single marks, spaces or apostrophes are thousands."""
    body = F.regexp_replace(F.regexp_replace(F.trim(c), "^[+]", ""), "(?<=\\d)[ \u00a0\u202f'’](?=\\d{3}(?!\\d))", "")
    comma, point = F.instr(F.reverse(body), ","), F.instr(F.reverse(body), ".")
    both = F.when(comma < point, F.regexp_replace(F.regexp_replace(body, "\\.", ""), ",", ".")).otherwise(F.regexp_replace(body, ",", ""))
    grouped = F.when(body.rlike("^-?\\d{1,3}(,\\d{3})+$"), F.regexp_replace(body, ",", "")).otherwise(F.regexp_replace(body, ",", "."))
    dotted = F.when(body.rlike("^-?\\d{1,3}(\\.\\d{3}){2,}$"), F.regexp_replace(body, "\\.", "")).otherwise(body)
    return F.when((comma > 0) & (point > 0), both).when(comma > 0, grouped).otherwise(dotted)


def number(c: Column, kind: str = "decimal(18,6)") -> Column:
    """Null where the text is no number."""
    return number_text(c).try_cast(kind)


def undoubled_unit(c: Column, known: tuple[str, ...]) -> Column:
    """A known unit, or one that is written twice over; else null."""
    half = F.substring(c, F.lit(1), (F.length(c) / 2).cast("int"))
    return F.when(c.isin(*known), c).when((F.length(c) % 2 == 0) & (F.concat(half, half) == c) & half.isin(*known), half)


def _lookup(table: dict[str, str], unit: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(Decimal(v)).cast(FACTOR)) for k, v in table.items()))[unit]


def to_base(family: str, unit: Column, value: Column) -> Column:
    """Decimal in the family's base unit, exact unless a factor is no decimal fraction; null for a unit of another family."""
    parts = {u: f.partition("/") for u, f in FAMILIES[family][1].items()}
    above, below = _lookup({u: a for u, (a, _, _) in parts.items()}, unit), {u: b for u, (_, _, b) in parts.items() if b}
    if family == "temperature":
        value = F.when(unit == "°F", value.cast("decimal(15,6)") - 32).otherwise(value.cast("decimal(15,6)"))
    scaled = value.cast("decimal(15,6)") * above
    return F.when(unit.isin(*below), scaled / F.coalesce(_lookup(below, unit), F.lit(1))).otherwise(scaled) if below else scaled


def celsius(unit: Column, value: Column) -> Column:
    return F.when(unit == "°C", value).when(unit == "°F", (value - 32) * 5 / 9)


def families_of(unit: str) -> list[str]:
    return [f for f, (_, units) in FAMILIES.items() if unit in units]


MEASURE = "^\\s*([-+]?[\\d.,]*\\d)(?:\\s*(?:-|–|\\.\\.\\.?|to)\\s*([\\d.,]*\\d))?\\s*([^\\d\\s].{0,12})?\\s*$"


def parse_measure(c: Column) -> Column:
    """struct(kind, minimum, maximum, unit) of a whole value that is a number or a range with an optional unit; else null."""
    low, high, unit = (F.regexp_extract(c, MEASURE, i) for i in (1, 2, 3))
    top = F.when(high != "", number(high)).otherwise(number(low))
    found = F.struct(F.when(high != "", "range").otherwise("number").alias("kind"), number(low).alias("minimum"), top.alias("maximum"), F.trim(unit).alias("unit"))
    return F.when(c.rlike(MEASURE) & number(low).isNotNull() & top.isNotNull(), found)


def boolean_of(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


AMOUNT = "decimal(38,12)"


def comparison_text(c: Column) -> Column:
    """Word tokens in lower case."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([\\p{L}\\p{N}_]+)"), 1), " ")


def comparison_value(value: Column, unit: Column, family: Column) -> Column:
    """struct(kind, amounts, text) that values are compared by; the stored value stays as it is.

    family says what the attribute holds: boolean, mass, length or anything else. A unit may be in the value (1 kg) or beside it; several
    numbers (10 x 20 x 30) are several amounts."""
    text, own = F.trim(F.coalesce(value, F.lit(""))), F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    embedded = F.lower(F.regexp_extract(text, "(?i)^(.+?)\\s*(mg|kg|g|lb|oz|mm|cm|m|in)$", 2))
    named = F.when(own != "", own).otherwise(embedded)
    tokens = F.regexp_extract_all(text, F.lit("([-+]?\\d+(?:[.,]\\d+)?)"), 1)
    amounts = F.transform(tokens, lambda t: F.regexp_replace(t, ",", ".").try_cast("decimal(18,6)"))
    word = comparison_text(value)
    grams, mm = _lookup(TO_GRAM, named), _lookup(TO_MM, named)

    def row(kind: Column | str, x: Column | None, t: Column | None) -> Column:
        none = F.lit(None)
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if x is None else x).cast(f"array<{AMOUNT}>").alias("amounts"), (none if t is None else t).cast("string").alias("text"))

    scaled = lambda f: F.transform(amounts, lambda a: a * f)
    return (
        F.when((family == "boolean") & word.isin(*TRUE_WORDS), row("boolean", None, F.lit("true")))
        .when((family == "boolean") & word.isin(*FALSE_WORDS), row("boolean", None, F.lit("false")))
        .when(family == "boolean", row("text", None, word))
        .when((family == "mass") & grams.isNotNull() & (F.size(amounts) == 1), row("mass_g", scaled(grams), None))
        .when((family == "length") & mm.isNotNull() & (F.size(amounts) > 0), row("length_mm", scaled(mm), None))
        .when((F.size(amounts) > 0) & (named != ""), row(F.concat(F.lit("numeric:"), named), amounts, None))
        .otherwise(row("text", None, word))
    )


def equivalent(a: Column, b: Column) -> Column:
    """Equal kinds, and equal texts or as many amounts, each within the tolerance of the kind."""
    allowed = F.coalesce(F.create_map(*chain.from_iterable((F.lit(k), F.lit(Decimal(v)).cast(AMOUNT)) for k, v in TOLERANCE.items()))[a["kind"]], F.lit(Decimal(0)).cast(AMOUNT))
    near = (F.size(a["amounts"]) == F.size(b["amounts"])) & F.forall(F.arrays_zip(a["amounts"].alias("l"), b["amounts"].alias("r")), lambda p: F.abs(p["l"] - p["r"]) <= allowed)
    return (a["kind"] == b["kind"]) & F.when(a["text"].isNotNull(), F.coalesce(a["text"] == b["text"], F.lit(False))).otherwise(near)


# ---------------------------------------------------------------- figures of audits
def rate(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def variance(c: Column) -> Column:
    """Aggregate: population variance, 0 of a single value."""
    return F.coalesce(F.var_pop(c), F.lit(0.0))


def jump_over_half(low: Column, high: Column) -> Column:
    return F.coalesce((high > 0) & ((high - low) / F.greatest(F.lit(1), low) > 0.5), F.lit(False))


def repeatability(confirmed_spread: Column, coverage_spread: Column, change_rate: Column, jump_rate: Column) -> Column:
    """0 to 100; 100 if nothing varies."""
    terms = [1.0 - F.least(F.lit(1.0), x) for x in (confirmed_spread, coverage_spread / 100.0, change_rate, jump_rate)]
    return sum(terms[1:], terms[0]) / 4.0 * 100.0
