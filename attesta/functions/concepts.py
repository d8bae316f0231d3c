"""Concepts of a canonical schema: which of them an attribute is, how sure that is, and its value in the concept's unit.

A concept is a row of rules (patterns of labels and groups, a family of units, a plausible range); the table of concepts is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from fractions import Fraction

from .measure import FAMILIES
from .normalize import measure_of, number_of, prose, unit_of
from .text import _fold

# Thresholds and weights of the score, units in words and in Cyrillic, units tried where none is written.
MAP_MIN, CANDIDATE_MIN, MARGIN = 0.70, 0.40, 0.10
BASE = {"label": 0.90, "generic": 0.72, "weak": 0.60, "group_only": 0.78}
SHAPE_CAP, IMPLIED_CAP, TOP = 0.50, 0.75, 0.99
CYRILLIC = {"мм": "mm", "см": "cm", "м": "m", "кг": "kg", "г": "g", "л": "L", "мл": "ml", "Вт": "W", "кВт": "kW", "В": "V", "А": "A", "Гц": "Hz", "бар": "bar", "об/мин": "rpm", "мин": "min", "ч": "h"}
WORDS = {
    "L": "litre litres liter liters литр литра литров litri litry litru",
    "month": "month months monat monate monaten mois mesi mese mesic mesice mesicu месяц месяца месяцев",
    "year": "year years jahr jahre jahren an ans annee annees anno anni rok roky let год года лет",
    "d": "day days tag tage tagen jour jours giorno giorni den dni дней день дня",
    "h": "hour hours stunde stunden heure heures ora ore hodina hodiny hodin час часа часов",
}
TRIED = {
    "length": ("mm", "cm", "m"), "mass": ("kg", "g"), "volume": ("L", "ml"), "power": ("W", "kW"), "voltage": ("V",), "current": ("A", "mA"), "charge": ("Ah", "mAh"), "energy": ("Wh", "kWh"), "frequency": ("Hz",), "rotation": ("rpm",),
    "impact_rate": ("ipm",), "pressure": ("bar",), "torque": ("Nm",), "sound": ("dB(A)",), "temperature": ("°C", "°F"), "resolution": ("DPI",), "duration_months": ("month", "year"), "duration_years": ("year",), "duration_h": ("h", "d"), "distance": ("m", "cm", "mm"),
}
METRIC = ("mm", "cm", "m", "µm", "kg", "g", "mg", "L", "ml", "cl", "dl", "W", "kW", "V", "A", "mA", "Ah", "mAh", "Wh", "kWh")
TRUE = ("yes", "true", "ja", "oui", "si", "да", "ano", "tak")
FALSE = ("no", "false", "nein", "non", "нет", "ne", "nie")
UNAVAILABLE = r"(?:not available|non disponibile|non disponible|nicht verfugbar|nedostupn\w*|недоступн\w*|нет)\b"
AXES = {"h": "height_mm", "в": "height_mm", "b": "width_mm", "w": "width_mm", "ш": "width_mm", "t": "depth_mm", "d": "depth_mm", "г": "depth_mm", "l": "length_mm"}
AXIS_ORDER = r"\(\s*([a-zа-я])\s*[x×х*]\s*([a-zа-я])\s*[x×х*]\s*([a-zа-я])\s*\)"
GENERIC_LABEL = r"^(?:type|typ|tip|тип|name|value|wert|valeur|info|information|details?|other|sonstige\w*)$"
NOT_A_SPEC = (
    ("identity_metadata", r"barcode|bar code|штрихкод|\bgtin\b|\bean\b|\bupc\b|\bsku\b|artikelnummer|^product type$|тип товара|^category$|country of origin|страна производ|herkunftsland|pays d origine|paese di origine|zeme puvodu|made in"),
    ("variant_metadata", r"colou?r|farbe|couleur|colore|barva|цвет|^col (?:main|door|panel)"),
    ("commercial_metadata", r"\beligible\b|\boffers?\b|\bprice\b|availability|\bfsa\b"),
    ("documentation_metadata", r"user manual|gebrauchsanweisung|mode d emploi|manuale|manual lang|navod|руководство|инструкция"),
    ("legal_or_certification", r"\bsrn\b|^remarks?$|declaration|directive|richtlinie|regulation|conformity|compliance|harmoni|европеискии|^(?:en|iec|iso|cispr|din) ?\d|certificat|zertifik"),
    ("company_or_address", r"\b(?:ltd|llc|gmbh|inc|corp|ооо|тоо|зао|оао|лтд|бин|инн|vat|eori)\b|^(?:дом|ул\w*|улица|street|str|strasse|офис|office|floor|этаж|город|city|zip|postal)$"),
)
LEGAL_VALUE = r"\bкаб\.|\bстр\.|\bул\.|\bgmbh\b|\bltd\b|\bбин\b|schedule \d"
PROMO_GROUP = r"\bchapter\b|benefit|feature highlights|why choose|marketing|promo"
PROMO_VALUE = r"\*{2,}|up to \d+ ?x|\d+ ?x (?:more|better|healthier|effective|gesunder\w*|effektiver)|% more|bis zu \d+|gently|exceptional|invigorating|ausserordentlich|receive|erhalten sie|track your|verfolgen sie|get (?:three|\d)|helps? you|lets you|automatically"

_WORD_UNIT = {_fold(w): unit for unit, ws in WORDS.items() for w in ws.split()}
_FACTORS = {f: {u: Fraction(x) for u, x in units.items()} for f, (_, units) in FAMILIES.items()}
_FAMILIES_OF: dict[str, list[str]] = {}
for _f, _units in _FACTORS.items():
    for _u in _units:
        _FAMILIES_OF.setdefault(_u, []).append(_f)
_LETTERS = ("in", "h", "m", "s", "N", "g", "L", "d")
_UNIT_WORD = "|".join(sorted((re.escape(u) for u in {*_FAMILIES_OF, *CYRILLIC} - set(_LETTERS)), key=lambda u: (-len(u), u))) + "|(?i:" + "|".join(sorted(map(re.escape, _WORD_UNIT), key=lambda u: (-len(u), u))) + ")|[LhmgN]"
_INSIDE = re.compile(rf"(?<![\w.,<>≤≥~])(\d[\d.,]*)(?:\s*(-|–|—|bis|to|und|až|az|/|до)\s*(\d[\d.,]*))?\s*({_UNIT_WORD})(?!\w)")
_LEADING = re.compile(rf"(\d[\d.,]*)\s*((?i:{'|'.join(sorted(map(re.escape, _WORD_UNIT), key=lambda u: (-len(u), u)))}))\b")


@dataclass(frozen=True)
class Concept:
    """vtype: measure, dimensions, count, boolean or text. Patterns meet folded text. test: (least, greatest, reason) of plausible amounts
    for this label; plausible decides which unit is meant where none is written."""

    key: str
    vtype: str
    unit: str = ""
    family: str = ""
    categories: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    need_group: bool = False
    group_only: bool = False
    exclude: str = ""
    plausible: tuple[float, float] | None = None
    test: tuple[float, float, str] | None = None
    value_gate: str = ""
    value_pattern: str = ""
    prefix: bool = False
    component: bool = False
    axis_split: bool = False
    list_field: bool = False


@dataclass
class Amount:
    low: Fraction
    high: Fraction
    unit: str
    way: str = "written"
    at_start: bool = True
    alternates: tuple[str, ...] = ()


@dataclass
class Reading:
    """What a concept makes of a value: reject says that it can't be this concept at all, ok that the value has its shape."""

    ok: bool = True
    reject: str = ""
    cap: float = TOP
    penalty: float = 0.0
    value: str = ""
    unit: str = ""
    low: Fraction | None = None
    high: Fraction | None = None
    unit_status: str = ""
    method: str = ""
    parts: tuple[Fraction, ...] = ()
    converted: str = ""

    def unfit(self) -> Reading:
        self.ok, self.cap = False, SHAPE_CAP
        return self


def fold_label(text: str) -> str:
    return " ".join(re.sub(r"[^\w%]+|_", " ", _fold(text)).split())


def unit_token(token: str) -> str:
    """The Latin unit of a written unit or word; empty if it is none."""
    token = token.strip()
    unit = CYRILLIC.get(token) or unit_of(token)[0]
    return CYRILLIC.get(unit, unit) or _WORD_UNIT.get(_fold(token), "")


def families_of(unit: str) -> list[str]:
    return _FAMILIES_OF.get(unit, [])


def family_for(unit: str, wanted: str = "") -> str:
    """The wanted family if the unit is of it, else the first that it is of."""
    found = families_of(unit)
    return wanted if wanted in found else found[0] if found else ""


def to_canonical(family: str, unit: str, value: Fraction) -> Fraction | None:
    factor = _FACTORS[family].get(unit)
    return None if factor is None else (value - 32) * factor if unit == "°F" else value * factor


def format_number(value: Fraction) -> str:
    """Up to six decimals, half to even beyond, no zeros at the end."""
    text = f"{round(value * 10**6):d}"
    sign, digits = ("-" if text[0] == "-" else ""), text.lstrip("-").rjust(7, "0")
    text = f"{digits[:-6]}.{digits[-6:]}".rstrip("0").rstrip(".")
    return sign + text if text != "0" else "0"


def span_text(low: Fraction, high: Fraction) -> str:
    return format_number(low) if low == high else f"{format_number(low)}–{format_number(high)}"


def fraction(token: str) -> Fraction | None:
    try:
        return Fraction(number_of(token.rstrip(".,")))
    except (ValueError, ZeroDivisionError):
        return None


def inside(text: str) -> list[Amount]:
    """Amounts with a unit within running text, descending ranges left out."""
    out = []
    for m in _INSIDE.finditer(text):
        low, unit = fraction(m[1]), unit_token(m[4])
        high = fraction(m[3]) if m[3] else low
        if unit and low is not None and high is not None and low <= high:
            out.append(Amount(low, high, unit, "embedded", m.start() == 0))
    return out


def analysed(value: str, kind: str, unit: str, boolean: bool | None, display: str = "", alternates: Iterable[str] = ()) -> dict:
    """kind, text, amount, parts, unit, boolean, lead (truth of the first word), count (leading whole number) of a normalized value."""
    info: dict = {"kind": kind, "text": display or value, "amount": None, "parts": (), "unit": unit_token(unit) if unit else "", "boolean": boolean, "lead": None, "count": None}
    if kind == "boolean":
        return info
    if kind in ("number", "range") and (not unit or info["unit"]):
        ends = [fraction(x) for x in value.split("–")]
        return info | {"kind": "measure", "amount": Amount(ends[0], ends[-1], info["unit"], alternates=tuple(alternates))}
    if kind == "dimensions":
        return info | {"parts": tuple(fraction(p) for p in re.split(r"\s*×\s*", value))}
    folded = _fold(value).strip()
    first = re.split(r"\W+", folded, maxsplit=1)[0]
    info |= {"kind": "text", "lead": True if first in TRUE else False if first in FALSE or re.match(UNAVAILABLE, folded) else None}
    if m := re.match(r"\s*(\d+)(?![\d.,]|\s*[-–]\s*\d)", value):
        info["count"] = int(m[1])
    if m := _LEADING.match(value.strip()):
        info["amount"] = Amount(fraction(m[1]), fraction(m[1]), unit_token(m[2]), "prefix")
    return info


def infer_unit(c: Concept, values: tuple[Fraction, ...]) -> str:
    """The only unit in which all values are plausible; empty if there is none or several."""
    tried = TRIED[c.family]
    if c.plausible is None:
        return tried[0] if len(tried) == 1 else ""
    fit = [u for u in tried if all(c.plausible[0] <= to_canonical(c.family, u, v) <= c.plausible[1] for v in values)]
    return fit[0] if len(fit) == 1 else ""


def tolerance(value: Fraction) -> float:
    """Relative agreement asked of another way to write a value: 1 %, or the rounding of the value where that is coarser."""
    if value == 0:
        return 0.01
    decimals = len(format_number(value).partition(".")[2])
    return max(0.01, 0.5 * 10**-decimals / float(abs(value)))


def read_amount(c: Concept, info: dict, out: Reading) -> Amount | None:
    amount = info["amount"]
    if info["kind"] == "measure":
        return amount
    if info["kind"] != "text":
        return None
    text = info["text"]
    if amount and (c.prefix or c.family in ("volume", "duration_months", "duration_h") or re.fullmatch(r"\s*\d[\d.,]*\s*\S+\s*", text)):
        return amount
    found = [m for m in inside(text) if family_for(m.unit, c.family) == c.family]
    if found:
        first = found[0]
        if len(found) > 1:
            a, b = (to_canonical(c.family, m.unit, m.low) for m in found[:2])
            same = b and all(m.low == m.high for m in found[:2]) and abs(float(a / b) - 1) <= 0.02 and "(" in text
            if same:
                first.alternates = (f"{format_number(found[1].low)} {found[1].unit}",)
            elif not first.at_start:
                return None
        out.penalty += 0.08 + (0 if first.at_start else 0.08)
        out.method = "embedded_measure"
        return first
    if c.value_pattern and (m := re.search(c.value_pattern, _fold(text))):
        out.penalty += 0.05
        out.method = "value_pattern"
        n = fraction(m[1])
        return Amount(n, n, "", "pattern") if n is not None else None
    return None


def read_measure(c: Concept, info: dict, out: Reading) -> Reading:
    amount = read_amount(c, info, out)
    if amount is None or (not c.family and amount.unit and amount.way == "written"):
        return out.unfit()
    low, high, unit, out.unit_status = amount.low, amount.high, amount.unit, "explicit"
    if not c.family:
        out.value, out.unit, out.unit_status, out.low, out.high = span_text(low, high), c.unit, "explicit" if c.unit else "none", low, high
        return out
    if unit and c.family not in families_of(unit):
        out.reject = f"unit {unit} is not a {c.family} unit"
        return out
    if not unit:
        unit = infer_unit(c, (low, high))
        if not unit:
            return out.unfit()
        out.cap, out.unit_status = IMPLIED_CAP, "implied"
    base = FAMILIES[c.family][0]
    a, b = to_canonical(c.family, unit, low), to_canonical(c.family, unit, high)
    if unit != base:
        out.converted = "unit_conversion"
        # What the source itself states in a metric unit is better than arithmetic on another one.
        for other in amount.alternates if unit not in METRIC and low == high and b else ():
            m = measure_of(other.split(";")[0].strip())
            own = unit_token(m["unit"]) if m and m["kind"] == "number" else ""
            if own in METRIC and c.family in families_of(own) and abs(float(to_canonical(c.family, own, Fraction(m["value"])) / b) - 1) <= tolerance(low):
                a = b = to_canonical(c.family, own, Fraction(m["value"]))
                out.converted = "source_alternate"
                break
        out.unit_status = "converted" if out.unit_status != "implied" else "implied"
    out.value, out.unit, out.low, out.high = span_text(a, b), base, a, b
    return out


def read_dimensions(c: Concept, info: dict, out: Reading) -> Reading:
    if info["kind"] != "dimensions":
        return out.unfit()
    unit, out.unit_status = info["unit"], "explicit"
    if unit and c.family not in families_of(unit):
        out.reject = f"unit {unit} is not a {c.family} unit"
        return out
    if not unit:
        unit = infer_unit(c, info["parts"])
        if not unit:
            return out.unfit()
        out.cap, out.unit_status = IMPLIED_CAP, "implied"
    out.parts = tuple(to_canonical(c.family, unit, p) for p in info["parts"])
    out.value, out.unit, out.low, out.high = " × ".join(map(format_number, out.parts)), FAMILIES[c.family][0], min(out.parts), max(out.parts)
    if unit != out.unit:
        out.converted, out.unit_status = "unit_conversion", "converted" if out.unit_status != "implied" else "implied"
    return out


def evaluate(c: Concept, info: dict) -> Reading:
    """The value of an attribute as the value of a concept."""
    out, text, kind = Reading(), info["text"], info["kind"]
    if c.value_gate and not re.search(c.value_gate, _fold(text)):
        out.reject = "value does not look like the expected item"
    elif c.vtype == "boolean":
        truth = info["boolean"] if kind == "boolean" else info["lead"]
        if truth is None:
            return out.unfit()
        out.value, out.penalty = str(truth).lower(), 0.0 if kind == "boolean" else 0.05
    elif c.vtype == "text":
        if kind == "boolean" or (len(text) > 160 and prose(text)):
            return out.unfit()
        out.value = text
    elif c.vtype == "count":
        m = info["amount"]
        if kind == "measure" and not m.unit and m.low == m.high and m.low.denominator == 1:
            out.value, out.low, out.high = format_number(m.low), m.low, m.low
        elif kind == "text" and info["count"] is not None and (c.prefix or text.strip().isdigit()):
            out.value, out.low, out.high, out.penalty = str(info["count"]), Fraction(info["count"]), Fraction(info["count"]), 0.05
        else:
            return out.unfit()
    else:
        return read_dimensions(c, info, out) if c.vtype == "dimensions" else read_measure(c, info, out)
    return out


def label_hit(c: Concept, label: str, group: str) -> tuple[float, str, bool] | None:
    """(base score, way, whether the group fits) of a folded label under a folded group."""
    if c.exclude and re.search(c.exclude, label):
        return None
    fits = any(re.search(g, group) for g in c.groups)
    if c.need_group and not fits:
        return None
    if c.group_only:
        return (BASE["group_only"], "group_only", True) if fits else None
    for way, patterns in (("label", c.labels), ("generic", c.generic if c.categories else ()), ("weak", c.weak)):
        if any(re.search(p, label) for p in patterns):
            return BASE[way], way, fits
    return None


def applies(c: Concept, category: str) -> bool:
    return (not c.categories or category in c.categories) and category not in c.excluded


def ranked(attribute: dict, category: str, concepts: list[Concept]) -> tuple[list[tuple[float, Concept, Reading, str]], dict]:
    """Concepts of an attribute (label, aliases, group_path, value, kind, unit, boolean, display, alternates) by falling score, the best rule of each key."""
    group = fold_label(" > ".join(p for p in attribute["group_path"] if len(p.split()) <= 6))
    primary, able = fold_label(attribute["label"]), [c for c in concepts if applies(c, category)]
    aliases = [a for a in map(fold_label, attribute["aliases"]) if a != primary]
    info = analysed(attribute["value"], attribute["kind"], attribute["unit"], attribute["boolean"], attribute["display"], attribute["alternates"])
    hits = [(c, hit) for c in able if (hit := label_hit(c, primary, group))]
    by_alias = not hits
    if by_alias:
        hits = [(c, max(found)) for c in able if (found := [h for a in aliases if (h := label_hit(c, a, group))])]
    said = [{c.key for c in able if not c.group_only and label_hit(c, a, group)} for a in aliases]
    best: dict[str, tuple[float, Concept, Reading, str]] = {}
    for c, (score, way, fits) in hits:
        r = evaluate(c, info)
        if r.reject:
            continue
        if c.test and r.ok and r.low is not None and not c.test[0] <= r.low <= r.high <= c.test[1]:
            r.unfit()
        score += -0.05 if by_alias else 0.05 * (fits and not c.group_only)
        score += 0.03 * (category in c.categories) + 0.03 * bool(r.unit_status in ("explicit", "converted") and c.family)
        score += min(0.04, 0.02 * sum(c.key in keys for keys in said)) - 0.10 * any(keys and c.key not in keys for keys in said) - r.penalty
        score = round(min(score, r.cap, TOP), 3)
        way = r.method or ("alias" if by_alias else way)
        if c.key not in best or score > best[c.key][0]:
            best[c.key] = (score, c, r, way)
    return sorted(best.values(), key=lambda b: -b[0]), info


def axis_order(texts: Iterable[str]) -> tuple[str, ...] | None:
    """The axes that a label names in order, as in (H x W x D)."""
    for text in texts:
        m = re.search(AXIS_ORDER, _fold(text))
        order = tuple(AXES.get(g, "") for g in m.groups()) if m else ()
        if order and all(order) and len(set(order)) == 3:
            return order
    return None


def not_a_spec(attribute: dict) -> str:
    """Why an attribute that no concept takes is no specification at all; empty if it may be one."""
    labels, value = [fold_label(x) for x in (attribute["label"], *attribute["aliases"])], _fold(attribute["value"])
    words, group = len(value.split()), fold_label(" > ".join(attribute["group_path"]))
    told = next((why for why, pattern in NOT_A_SPEC if any(re.search(pattern, x) for x in labels)), "")
    if told or re.search(LEGAL_VALUE, value):
        return told or "company_or_address"
    if attribute["method"].startswith("pdf") and (len(labels[0].split()) >= 5 or attribute["label"][:1].islower()):
        return "document_fragment"
    in_promo = re.search(PROMO_GROUP, group) and words >= 4 and not inside(attribute["value"]) and not re.search(r"[<>≤≥]\s*\d", attribute["value"])
    return "promotional_content" if in_promo or (words >= 3 and re.search(PROMO_VALUE, value)) else ""


def map_attribute(attribute: dict, category: str, concepts: list[Concept]) -> list[dict]:
    """Rows of an attribute: mapped (and its axes, where its label names them), or one row ambiguous, unmapped or not_a_spec, with candidates."""
    order, info = ranked(attribute, category, concepts)

    def row(status: str, **more) -> dict:  # noqa: ANN003
        empty = {"key": None, "confidence": None, "value": None, "unit": None, "value_type": None, "unit_status": None, "method": None, "converted": None, "derived_from": None, "candidates": [], "reason": ""}
        return empty | {"status": status} | more

    candidates = [f"{c.key}:{s}" for s, c, _, _ in order if s >= CANDIDATE_MIN]
    if not candidates:
        why = not_a_spec(attribute)
        generic = re.search(GENERIC_LABEL, fold_label(attribute["label"]))
        return [row("not_a_spec", reason=why)] if why else [row("unmapped", reason="label too generic to identify a field" if generic else "no concept of this category")]
    score, c, r, way = order[0]
    close = len(order) > 1 and score - order[1][0] < MARGIN
    if score < MAP_MIN or not r.ok or close:
        return [row("ambiguous", candidates=candidates, reason="several keys with close confidence" if close and score >= MAP_MIN else "low confidence")]
    kind = c.vtype if c.vtype != "measure" else "range" if r.low != r.high else "number"
    main = row("mapped", key=c.key, confidence=score, value=r.value, unit=r.unit, value_type=kind, unit_status=r.unit_status, method=way, converted=r.converted)
    axes = axis_order([attribute["label"], *attribute["aliases"], *attribute.get("raw_labels", ())]) if c.axis_split and len(r.parts) == 3 else None
    split = [main | {"key": k, "value": format_number(p), "value_type": "number", "method": "dimension_split", "derived_from": c.key, "confidence": round(score - 0.02, 3)} for k, p in zip(axes or (), r.parts, strict=False)]
    return [main, *split]
