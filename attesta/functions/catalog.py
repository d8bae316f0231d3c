"""Language-neutral names of attributes, the aliases that lead to them, and identifiers for labels that none of them knows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold_key

# Canonical name, label, aliases.
CATALOG = (
    ("display_ppi", "Pixel density", ("ppi", "pixel density", "pixels per inch")),
    ("display_aspect_ratio", "Display aspect ratio", ("aspect ratio", "screen ratio")),
    ("cover_glass", "Cover glass", ("display glass", "screen glass", "protective glass")),
    ("hdr_support", "HDR support", ("hdr",)),
    ("hdr_brightness", "HDR brightness", ("hdr peak brightness",)),
    ("peak_brightness", "Peak brightness", ("maximum brightness", "max brightness", "brightness peak", "peak display brightness")),
    ("contrast_ratio", "Contrast ratio", ("contrast",)),
    ("color_depth", "Color depth", ("colour depth", "bit depth")),
    ("number_of_colors", "Number of colors", ("colors count", "display colors", "colours")),
    ("battery_capacity_min", "Minimum battery capacity", ("minimum battery",)),
    ("fast_charging", "Fast charging", ("quick charge", "quick charging")),
    ("wireless_charging", "Wireless charging", ("qi charging",)),
    ("wireless_charging_standard", "Wireless charging standard", ()),
    ("battery_life", "Battery life", ("battery endurance",)),
    ("battery_life_power_saving", "Battery life (power saving)", ()),
    ("battery_features", "Battery features", ()),
    ("security_coprocessor", "Security coprocessor", ("security chip",)),
    ("security_features", "Security features", ()),
    ("software_update_support", "Software update support", ("update support", "os updates")),
    ("max_zoom", "Max zoom", ("maximum zoom", "zoom range", "super res zoom")),
    ("rear_camera_features", "Rear camera features", ()),
    ("front_camera_features", "Front camera features", ()),
    ("camera_features", "Camera features", ()),
    ("editing_features", "Photo editing features", ()),
    ("video_formats", "Video formats", ()),
    ("video_features", "Video features", ()),
    ("rear_video_features", "Rear video features", ()),
    ("front_video_features", "Front video features", ()),
    ("video_audio_features", "Video audio features", ()),
    ("materials_and_durability", "Materials and durability", ()),
    ("authentication", "Authentication", ("biometrics", "unlock methods")),
    ("safety_features", "Safety features", ()),
    ("sensors", "Sensors", ()),
    ("speakers", "Speakers", ("loudspeaker",)),
    ("microphone_count", "Microphones", ("number of microphones",)),
    ("media_features", "Audio features", ()),
    ("wireless_features", "Wireless features", ()),
    ("uwb", "Ultra-wideband (UWB)", ("ultra wideband",)),
    ("gnss", "GNSS / positioning", ("gps", "positioning", "navigation satellites")),
    ("model_number", "Model number", ("regulatory model number",)),
    ("accessibility_features", "Accessibility features", ()),
)
LENS_ROLES = ("wide", "ultrawide", "telephoto", "periscope", "macro", "main", "depth")


def _key(text: str) -> str:
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split())


def _aliases() -> dict[str, str]:
    out: dict[str, str] = {}
    for canonical, label, aliases in CATALOG:
        for alias in (canonical.replace("_", " "), label, *aliases):
            out.setdefault(_key(alias), canonical)
    return out


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))


def attribute_slug(label: Column) -> Column:
    """snake_case identifier of a label."""
    s = F.regexp_replace(F.regexp_replace(fold_key(label), r"\s+", "_"), "^_+|_+$", "")
    return F.when(s == "", "unnamed_attribute").otherwise(s)


def label_variants(label: Column) -> Column:
    """Ordered distinct look-up keys: the label, its parts at ' / ' or ' | ', each without a bracketed end or a leading count, then without a final number."""
    numbered = r"\s+(?:(?:no|n)\s*)?\d+\s*$"
    parts = F.when(label.rlike(r"\s[/|]\s"), F.concat(F.array(label), F.split(label, r"\s[/|]\s"))).otherwise(F.array(label))
    each = F.flatten(F.transform(parts, lambda c: F.array(c, F.regexp_replace(c, r"\s*[(\[][^)\]]{1,40}[)\]]\s*$", ""), F.regexp_replace(c, r"^\s*\d+\s+(?=[A-Za-z])", ""))))
    keys = F.flatten(F.transform(each, lambda c: F.array(fold_key(c), F.regexp_replace(fold_key(c), numbered, ""))))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def lookup_canonical(label: Column) -> Column:
    """The catalogued name of the first variant of a label that is an alias; null if none is."""
    table = _lookup(_aliases())
    return F.get(F.filter(F.transform(label_variants(label), lambda k: table[k]), lambda c: c.isNotNull()), 0)


def resolve_canonical(label: Column) -> Column:
    return F.coalesce(lookup_canonical(label), attribute_slug(label))


def label_for(canonical: Column) -> Column:
    words = F.trim(F.regexp_replace(canonical, "_", " "))
    return F.coalesce(_lookup({c: label for c, label, _ in CATALOG})[canonical], F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, F.lit(2), F.length(words)))))


def lens_parts(canonical: Column) -> Column:
    """struct(role, part) of an attribute of one camera lens; null for others."""
    role, part = (F.regexp_extract(canonical, "^([a-z]+)_camera_([a-z_]+)$", i) for i in (1, 2))
    return F.when(role.isin(*LENS_ROLES), F.struct(role.alias("role"), part.alias("part")))


def extension_definitions(hints: DataFrame, known: DataFrame) -> DataFrame:
    """canonical, label, boolean of the hints (seq, canonical, label, boolean) whose name is not in known (canonical): the first hint of
    each name, a missing label made from the name. Null names are left out; no rows give no rows."""
    first = hints.filter("canonical is not null").groupBy("canonical").agg(F.min_by(F.struct("label", "boolean"), "seq").alias("h"))
    new = first.join(known.select("canonical").distinct(), "canonical", "left_anti")
    return new.select("canonical", F.coalesce("h.label", label_for(F.col("canonical"))).alias("label"), F.coalesce("h.boolean", F.lit(False)).alias("boolean"))


def discovered_definitions(labels: DataFrame, schema: DataFrame) -> DataFrame:
    """schema (canonical, alias) with a name for each label (seq, label) that no alias knows: canonical, label, scope; the first label of a name stays."""
    keys = schema.select(fold_key(F.col("alias")).alias("key")).distinct()
    own = schema.select("canonical").distinct().select("canonical", F.lit(None).cast("string").alias("label"), F.lit("schema").alias("scope"))
    rows = labels.select("seq", "label", fold_key(F.col("label")).alias("key")).filter("key <> ''").join(keys, "key", "left_anti")
    new = rows.groupBy(F.regexp_replace("key", " ", "_").alias("canonical")).agg(F.min_by("label", "seq").alias("label"))
    return own.unionByName(new.join(own, "canonical", "left_anti").select("canonical", "label", F.lit("discovered").alias("scope")))
