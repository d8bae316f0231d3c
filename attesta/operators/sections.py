"""Specification sections: lines of a section become atomic facts, by a table of rules over the shape of a line.

A section's heading gives its roles; each role has rules. All rules are expressions, so a table of lines is read in one pass: lines are dealt by
(entity, section) once, and what follows (rejoining of wrapped lines, sub-headings, the choice among lines that
match a rule) are windows over that partitioning. Sections are what a page shows under one heading, so a window is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.catalog import label_for, lookup_canonical, resolve_canonical

# What a heading means, where the leftover lines of a section go, limits of lists.
ROLES = {
    "front_camera": r"\b(?:front|selfie)\b.*\bcamera|\bcamera\b.*\b(?:front|selfie)\b",
    "rear_camera": r"\b(?:rear|back|main)\b.*\bcamera|\bcamera\b.*\b(?:rear|back)\b",
    "display": r"\b(?:display|screen)\b",
    "body": r"\b(?:dimensions?|weight|size)\b",
    "battery": r"\b(?:battery|charging)\b",
    "memory": r"\b(?:memory|storage|ram)\b",
    "processor": r"\b(?:processors?|chip(?:set)?|cpu|soc)\b",
    "durability": r"\b(?:materials?|durability|build|protection|body|design)\b",
    "os": r"^(?:operating system|os|software)$",
    "updates": r"\bupdates?\b",
    "video": r"\bvideo\b",
    "media": r"\b(?:media|audio|sound)\b",
    "ports": r"\b(?:ports?|connectors?|interfaces?|buttons?)\b",
    "wireless": r"\b(?:wireless|connectivity|location|wi-?fi|bluetooth)\b",
    "network": r"\b(?:network|cellular|5g|4g|lte|sims?)\b",
    "accessibility": r"\baccessibility\b",
    "colors": r"^(?:colou?rs?|finish(?:es)?)$",
    "box": r"\b(?:in the box|box contents|package contents|what'?s included)\b",
}
LIST_TARGETS = (
    (r"^rear camera$", None, "rear_camera_features"),
    (r"^front camera$", None, "front_camera_features"),
    (r"^camera features$", r"^editing", "editing_features"),
    (r"^camera features$", None, "camera_features"),
    (r"^video$", r"rear", "rear_video_features"),
    (r"^video$", r"front", "front_video_features"),
    (r"^video$", r"audio", "video_audio_features"),
    (r"^video$", None, "video_features"),
    (r"\b(?:materials?|durability)\b", None, "materials_and_durability"),
    (r"^security$", None, "security_features"),
    (r"^authentication$", None, "authentication"),
    (r"^safety$", None, "safety_features"),
    (r"^sensors?$", None, "sensors"),
    (r"^media$|\baudio\b", None, "media_features"),
    (r"^accessibility$", None, "accessibility_features"),
    (r"\bwireless\b|\bconnectivity\b", None, "wireless_features"),
    (r"\bbattery\b", None, "battery_features"),
    (r"\b(?:in the box|box contents|package contents)\b", None, "package_contents"),
    (r"^colou?rs?$", None, "color"),
)
LIST_CHARS, ITEM_CHARS, VALUE_CHARS = 600, 140, 300
LINK, POINTER = r"(?i)^(?:https?://|www\.|[a-z0-9-]+\.[a-z]{2,}/)\S*$", r"(?i)^(?:learn more(?: at)?|see|and|or|more|details|read more|click here|[.,;:()])$"

SIZE = r"""(?i)(\d{1,2}(?:[.,]\d{1,2})?)[\s-]*(?:inch(?:es)?\b|in\b|"|″|”)"""
RESOLUTION = r"(?i)(\d{3,5})\s*[x×]\s*(\d{3,5})(.*)$"
PANEL = r"(?i)\b((?:LTPO\s+)?(?:Super\s+|Dynamic\s+)?(?:AMOLED|OLED|IPS\s+LCD|LCD|TFT)(?:\s*2X)?)\b"
HERTZ = r"(?i)(?:(\d{1,3})\s*[-–]\s*)?(\d{2,3})\s?Hz\b"
GLASS = r"(?i)^(?:scratch[- ]resistant\s+)?(.+?)\s+cover glass\b"
NITS = r"(?i)(?:up to\s+)?(\d[\d,]*)\s*nits?(?:\s*\(([^)]+)\))?"
DEPTH = r"(?i)(\d{1,2})[- ]bit(?: depth)?(?:\s+for\s+([\d.,]+\s*(?:million|billion|thousand))\s+colou?rs)?"
SUPPORT = r"^([A-Za-z][\w+\-/ ]{1,28}?)\s+[sS]upport$"
_AXIS = r"(\d+(?:\.\d+)?)\s*(height|width|depth)?\s*"
SIZES3 = rf"(?i){_AXIS}[x×]\s*{_AXIS}[x×]\s*{_AXIS}\(?(mm|cm|in(?:ches)?)\b"
WEIGHT = r"(?i)(\d+(?:[.,]\d+)?)\s*(kg|g|oz|lbs?)\b"
MAH = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*mAh\b"
HOURS = r"(?i)(\d+\+?)[- ]hours?\s+battery life"
LENS = r"(?i)(\d{1,3}(?:\.\d)?)\s?MP\s+(?:[\w-]+\s+){0,2}?(ultra-?wide|wide|telephoto|periscope|macro|main|depth)\b"
APERTURE, VIEW = r"(?i)[ƒf]/\s*(\d(?:\.\d+)?)\s+aperture", r"(?i)(\d{2,3})\s*°\s*(?:[a-z-]+\s+)?field of view"
MODE = r"(?i)(\d+[Kp])\s+video recording at\s+([\d/]+)\s*FPS"
IP = r"(?i)\b(IP\s?\d{2}[A-Z]?(?:\s*(?:/|,|and)\s*IP\s?\d{2}[A-Z]?)*)"
SYSTEM = r"\b(Android|iOS|iPadOS|HarmonyOS|Windows|macOS|Tizen|One UI|HyperOS|MIUI|ColorOS|OxygenOS)\s*(\d+(?:\.\d+)?)?"
RUNS = r"(?i)^(?:launched with|launches with|ships with|runs|preinstalled|pre-installed|operating system\s*:)\s+(.{2,60})$"
USB = r"(?i)\bUSB[\s-]*(?:Type[\s-]*)?C\b\s*(\d(?:\.\d)?)?"
BUTTON = r"(?i)\b(?:buttons?|controls?)\b"
WIFI = r"(?i)\bWi-?Fi\s*(\d+[A-Za-z]?)(?:\s*\((802\.11[\w/]+)\))?"
SIM = r"(?i)\b((?:dual|single|triple)[\s-]*SIM\b(?:\s*\([^)]{1,60}\))?)"
POSITIONING = r"(?i)^(?:(?:GPS|GLONASS|Galileo|BeiDou|QZSS|NavIC|SBAS)(?:,\s*|$))+$"
BANDS = {
    "gsm": r"(?i)^GSM(?:/EDGE)?\s*:\s*(.+)$", "umts": r"(?i)^UMTS[^:]*:\s*(?:Bands?\s+)?(.+)$", "lte": r"(?i)^LTE\s*:\s*(?:Bands?\s+)?(.+)$",
    "sub6": r"(?i)^5G\s+Sub-?\s?6[^:]*:\s*(?:Bands?\s+)?(.+)$", "mmwave": r"(?i)^5G\s+mmWave\s*:\s*(?:Bands?\s+)?(.+)$", "5g": r"(?i)^5G\s+([^:]+)$",
}
NOT_A_PROCESSOR = r"(?i)co-?processor|security|modem|titan|neural|tpu|gpu\b"
STORAGE = r"(?i)^\d+\s?(?:GB|TB)(?:\s*(?:/|,|\||or)\s*\d+\s?(?:GB|TB))*$"
LABEL_VALUE = r"^([A-Za-z][\w /&+\-()]{1,38}[\w)])\s*:\s*(\S.*)$"
GAIN = r"(?i)^Conversational Gain\s*:\s*(.+?)(?:\.?\s*See)?$"

def T() -> Column:  # noqa: N802
    """The text of a line; a column can't be made before there is a session."""
    return F.col("text")


def has(pattern: str) -> Column:
    return T().rlike(pattern)


def part(pattern: str, group: int = 1, of: Column | None = None) -> Column:
    return F.regexp_extract(T() if of is None else of, pattern, group)


def plain(c: Column) -> Column:
    return F.regexp_replace(c, ",", ".")


def bare(c: Column, of: str = ",") -> Column:
    return F.regexp_replace(c, of, "")


def expand_bands(text: Column) -> Column:
    """B1/2/3 as B1, B2, B3: a number without letters takes those of the last token that has some."""
    tokens = F.filter(F.transform(F.split(text, "[/,]"), lambda t: F.trim(t)), lambda t: t != "")
    start = F.struct(F.lit("").alias("letters"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        own = F.regexp_extract(t, r"^([A-Za-z]+)\d", 1)
        letters = F.when(own != "", own).otherwise(acc["letters"])
        return F.struct(letters.alias("letters"), F.array_append(acc["out"], F.when((own == "") & t.rlike(r"^\d+$"), F.concat(acc["letters"], t)).otherwise(t)).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: F.array_join(acc["out"], ", "))


def section_roles(heading: Column) -> Column:
    """Meanings of a heading: a front camera is no rear one, a policy of updates is no system."""
    text = F.trim(F.regexp_replace(F.coalesce(heading, F.lit("")), r"\s+", " "))
    found = F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(r)) for r, p in ROLES.items()]))
    found = F.when(F.array_contains(found, "front_camera"), F.array_remove(found, "rear_camera")).otherwise(found)
    return F.when(F.array_contains(found, "updates"), F.array_remove(found, "os")).otherwise(found)


def is_heading(text: Column, bold: Column) -> Column:
    """Bold, of five words at most, without a digit."""
    return bold & (F.size(F.split(F.trim(text), r"\s+")) <= 5) & ~text.rlike(r"\d")


def list_target(heading: Column, sub: Column) -> Column:
    out = F.lit(None).cast("string")
    for h, s, canonical in reversed(LIST_TARGETS):
        met = heading.rlike("(?i)" + h) if s is None else heading.rlike("(?i)" + h) & F.coalesce(sub.rlike("(?i)" + s), F.lit(False))
        out = F.when(met, canonical).otherwise(out)
    return out


@dataclass(frozen=True)
class Rule:
    """ways: (condition, value) in order of preference, each an expression over a line; a value is a string, or an array of them.
    pick: first line, the one of greatest rank, each line, or join of the distinct values of all lines."""

    role: str
    canonical: str | Column
    label: str | Column
    ways: tuple[tuple[Column, Column], ...]
    unit: str | Column | None = None
    pick: str = "first"
    rank: Column | None = None
    boolean: bool = False
    join: str = "; "
    generations: tuple[str, ...] = ()


def _rules() -> list[Rule]:
    yes = F.lit("Yes")
    one = lambda pattern, value=None: ((has(pattern), part(pattern) if value is None else value),)
    rest, low = part(RESOLUTION, 3), F.lower(T())
    axes = [(part(SIZES3, 2 * i + 1), F.lower(part(SIZES3, 2 * i + 2))) for i in range(3)]
    named = (axes[0][1] != "") & (axes[1][1] != "") & (axes[2][1] != "")
    metric = has(SIZES3) & F.lower(part(SIZES3, 7)).isin("mm", "cm")
    inches = F.when(F.lower(part(SIZES3, 7)).startswith("in"), "in").otherwise(F.lower(part(SIZES3, 7)))

    def axis(i: int, name: str) -> tuple[tuple[Column, Column], ...]:
        value = F.when(named, F.coalesce(*[F.when(label == name, size) for size, label in axes])).otherwise(axes[i][0])
        return (metric, value), (has(SIZES3), value)

    typical, notmin = has(MAH) & has(r"(?i)typical|rated"), has(MAH) & ~has(r"(?i)^\s*(?:minimum|min\.)")
    least = bare(part(r"(?i)(?:minimum|min\.)\s*(\d[\d,]*)\s*mAh"))
    storage = F.regexp_replace(F.regexp_replace(F.upper(T()), r"\s*(?:/|,|\||\bOR\b)\s*", " / "), r"(\d)\s?(GB|TB)", "$1 $2")
    current, start = F.col("lens"), has("(?i)^" + LENS[4:])
    lens_name = F.concat(F.upper(F.substring(current, 1, 1)), F.substring(current, F.lit(2), F.length(current)))
    of_lens = lambda tail: F.concat(current, F.lit("_camera_" + tail))
    lens_label = lambda tail: F.concat(lens_name, F.lit(" camera " + tail))
    inside = current.isNotNull() & ~start
    lenses = F.transform(F.regexp_extract_all(T(), F.lit(LENS), 0), lambda m: F.concat(F.regexp_extract(m, LENS, 1), F.lit(" MP "), F.regexp_replace(F.lower(F.regexp_extract(m, LENS, 2)), "ultra-wide", "ultrawide")))
    hits = F.regexp_extract_all(T(), F.lit(NITS), 0)
    hdr = lambda m: F.lower(F.regexp_extract(m, NITS, 2)).contains("hdr")
    nits = lambda keep: F.transform(F.filter(hits, keep), lambda m: bare(F.regexp_extract(m, NITS, 1)))
    sub = F.lower(F.coalesce(F.col("sub"), F.lit("")))
    side = F.when(sub.contains("front"), "front").otherwise("rear")
    zoom, hertz = r"(?i)zoom up to\s+(\d+)x", F.when(part(HERTZ) != "", F.concat(part(HERTZ), F.lit("-"), part(HERTZ, 2))).otherwise(part(HERTZ, 2))
    wireless = has(r"(?i)wireless charging")
    gsm = F.regexp_extract(part(BANDS["gsm"]), r"\(([^)]+)\)", 1)
    bands = lambda k: one(BANDS[k], expand_bands(part(BANDS[k])))
    five = ((has(BANDS["5g"]) & ~T().contains(":"), F.regexp_replace(F.trim(part(BANDS["5g"])), r"(?i)\bSub\s?-?\s?6\s?GHz\b", "Sub-6 GHz")),)
    chip = r"(?i)^(.+?)\s+security\s+(?:co)?processor"
    return [
        Rule("display", "display_size", "Display size", one(SIZE, plain(part(SIZE))), "in"),
        Rule("display", "display_resolution", "Display resolution", one(RESOLUTION, F.concat(part(RESOLUTION), F.lit(" x "), part(RESOLUTION, 2))), "pixels"),
        Rule("display", "display_type", "Display type", ((has(RESOLUTION), part(PANEL, 1, rest)), (has(PANEL), part(PANEL)))),
        Rule("display", "display_ppi", "Pixel density", one(RESOLUTION, part(r"(?i)(\d{2,4})\s*PPI\b", 1, rest)), "ppi"),
        Rule("display", "display_aspect_ratio", "Display aspect ratio", one(r"(?i)(\d{1,2}(?:\.\d+)?\s*:\s*\d{1,2}(?:\.\d+)?)\s+aspect ratio", bare(part(r"(?i)(\d{1,2}(?:\.\d+)?\s*:\s*\d{1,2}(?:\.\d+)?)\s+aspect ratio"), r"\s+"))),
        Rule("display", "refresh_rate", "Refresh rate", one(HERTZ, hertz), "Hz", "max", part(HERTZ, 2).try_cast("int")),
        Rule("display", "cover_glass", "Cover glass", one(GLASS)),
        Rule("display", "peak_brightness", "Peak brightness", ((F.exists(hits, lambda m: ~hdr(m)), nits(lambda m: ~hdr(m))),), "nits", "each"),
        Rule("display", "hdr_brightness", "HDR brightness", ((F.exists(hits, hdr), nits(hdr)),), "nits", "each"),
        Rule("display", "contrast_ratio", "Contrast ratio", one(r"(?i)([>≥<~]?\s*\d[\d,]*\s*:\s*1)\s+contrast", bare(part(r"(?i)([>≥<~]?\s*\d[\d,]*\s*:\s*1)\s+contrast"), r"\s+"))),
        Rule("display", "color_depth", "Color depth", one(DEPTH, F.concat(part(DEPTH), F.lit("-bit")))),
        Rule("display", "number_of_colors", "Number of colors", one(DEPTH, part(DEPTH, 2))),
        *[Rule("body", f"product_{name}", f"Product {name}", axis(i, name), inches) for i, name in enumerate(("height", "width", "depth"))],
        Rule("body", "net_weight", "Net weight", ((has(WEIGHT) & F.lower(part(WEIGHT, 2)).isin("g", "kg"), plain(part(WEIGHT))),), F.lower(part(WEIGHT, 2))),
        Rule("battery", "battery_capacity", "Battery capacity", ((typical, bare(part(MAH))), (notmin, bare(part(MAH)))), "mAh"),
        Rule("battery", "battery_capacity_min", "Minimum battery capacity", ((typical, least), (notmin, least)), "mAh"),
        Rule("battery", "charging_power", "Charging power", ((has(r"(\d{2,3})\s?W\b") & ~low.contains("wireless") & F.lower(F.col("around")).contains("charg"), part(r"(\d{2,3})\s?W\b")),), "W"),
        Rule("battery", "fast_charging", "Fast charging", one(r"(?i)fast charging\s*[-–—:]\s*(.+)$")),
        Rule("battery", "wireless_charging", "Wireless charging", ((wireless, yes),), boolean=True),
        Rule("battery", "wireless_charging_standard", "Wireless charging standard", ((wireless, part(r"\(([A-Za-z0-9]+)[- ]certified\)")),)),
        Rule("battery", "battery_life_power_saving", "Battery life (power saving)", ((has(HOURS) & low.contains(" with "), part(HOURS)),), "h", "each"),
        Rule("battery", "battery_life", "Battery life", ((has(HOURS) & ~low.contains(" with "), part(HOURS)),), "h", "each"),
        Rule("memory", "ram", "RAM", one(r"(?i)(\d{1,3})\s*(GB|MB)\s+(?:of\s+)?(?:RAM|memory)\b"), F.upper(part(r"(?i)(\d{1,3})\s*(GB|MB)\s+(?:of\s+)?(?:RAM|memory)\b", 2))),
        Rule("memory", "storage", "Storage", one(STORAGE, storage)),
        Rule("processor", "security_coprocessor", "Security coprocessor", one(chip), pick="each"),
        Rule("processor", "processor", "Processor", ((~has(chip) & ~has(NOT_A_PROCESSOR) & (F.length(T()) <= 60) & has("[A-Za-z]"), T()),)),
        Rule("rear_camera", "rear_camera", "Rear camera", ((has(LENS), lenses),), pick="join", join=" + "),
        Rule("rear_camera", of_lens("autofocus"), lens_label("autofocus"), ((start & has("(?i)with autofocus"), yes),), pick="each", boolean=True),
        Rule("rear_camera", of_lens("phase_detection"), lens_label("phase detection"), ((start & has(r"\b((?:Octa|Quad|Dual)\s+PD)\b"), part(r"\b((?:Octa|Quad|Dual)\s+PD)\b")),), pick="each"),
        Rule("rear_camera", of_lens("aperture"), lens_label("aperture"), ((inside & has(APERTURE), F.concat(F.lit("ƒ/"), part(APERTURE))),), pick="each"),
        Rule("rear_camera", of_lens("field_of_view"), lens_label("field of view"), ((inside & has(VIEW), part(VIEW)),), "°", "each"),
        Rule("rear_camera", of_lens("sensor_size"), lens_label("sensor size"), ((inside & has(r"""(?i)(\d+/\d+(?:\.\d+)?"?)\s*(?:image\s+)?sensor size"""), part(r"""(?i)(\d+/\d+(?:\.\d+)?"?)\s*(?:image\s+)?sensor size""")),), pick="each"),
        Rule("rear_camera", of_lens("optical_zoom"), lens_label("optical zoom"), ((inside & has(r"(?i)(\d+(?:\.\d)?x)\s+optical zoom"), part(r"(?i)(\d+(?:\.\d)?x)\s+optical zoom")),), pick="each"),
        Rule("rear_camera", "max_zoom", "Max zoom", one(zoom, F.concat(part(zoom), F.lit("x"))), pick="max", rank=part(zoom).try_cast("int")),
        Rule("front_camera", "front_camera", "Front camera", one(r"(?i)(\d{1,3}(?:\.\d)?)\s?MP\b", F.concat(part(r"(?i)(\d{1,3}(?:\.\d)?)\s?MP\b"), F.lit(" MP")))),
        Rule("front_camera", "front_camera_autofocus", "Front camera autofocus", one(r"(?i)(\d{1,3}(?:\.\d)?)\s?MP\b", F.when(has("(?i)with autofocus"), yes).otherwise("")), boolean=True),
        Rule("front_camera", "front_camera_aperture", "Front camera aperture", one(APERTURE, F.concat(F.lit("ƒ/"), part(APERTURE)))),
        Rule("front_camera", "front_camera_field_of_view", "Front camera field of view", one(VIEW), "°"),
        Rule("video", F.concat(side, F.lit("_video_recording")), F.concat(F.initcap(side), F.lit(" video recording")), ((has(MODE) & ((sub == "") | sub.contains("rear") | sub.contains("front")), F.array(F.concat(part(MODE), F.lit(" at "), part(MODE, 2), F.lit(" FPS")))),), pick="join"),
        Rule("video", "slow_motion_video", "Slow-motion video", one(r"(?i)slo-?mo\b.*?up to\s+(\d+)\s*FPS"), "FPS"),
        Rule("video", "hdr_video_recording", "HDR video recording", one(r"(?i)(\d+-bit)\s+HDR video")),
        Rule("durability", "ip_rating", "IP rating", one(IP, F.regexp_replace(F.upper(F.regexp_replace(F.regexp_replace(part(IP), r"\s+", " "), r"(?i)\bIP\s?", "IP")), "AND", ","))),
        Rule("durability", "cover_glass", "Cover glass", one(GLASS)),
        Rule("os", "operating_system", "Operating system", ((has(RUNS), F.regexp_replace(part(RUNS), r"^[ .]+|[ .]+$", "")), (has(SYSTEM), F.trim(F.concat(part(SYSTEM), F.lit(" "), part(SYSTEM, 2)))))),
        Rule("updates", "software_update_support", "Software update support", one(r"(?i)(\d+)\s+years?\s+of\b.*\bupdates?"), "years"),
        Rule("ports", "usb", "USB", one(USB, F.trim(F.concat(F.lit("USB Type-C "), part(USB))))),
        Rule("media", "microphone_count", "Microphones", one(r"(?i)(\d+)\s+microphones?")),
        Rule("media", "speakers", "Speakers", one(r"(?i)^(stereo|mono|dual)\s+speakers?", F.initcap(part(r"(?i)^(stereo|mono|dual)\s+speakers?")))),
        Rule("wireless", "wifi", "Wi-Fi", one(WIFI, F.concat(F.lit("Wi-Fi "), part(WIFI), F.when(part(WIFI, 2) != "", F.concat(F.lit(" ("), part(WIFI, 2), F.lit(")"))).otherwise("")))),
        Rule("wireless", "wifi_bands", "Wi-Fi bands", one(WIFI, F.regexp_replace(F.regexp_replace(part(r"(?i)(\d[\d.]*\s?GHz(?:\s?\+\s?\d[\d.]*\s?GHz)+)"), r"(\d)GHz", "$1 GHz"), r"\s*\+\s*", " + "))),
        Rule("wireless", "wifi_mimo", "Wi-Fi MIMO", one(WIFI, part(r"(?i)(\d+x\d+(?:\+\d+x\d+)?)\s+MIMO"))),
        Rule("wireless", "bluetooth", "Bluetooth", one(r"(?i)\bBluetooth\s*(?:v|version\s*)?(\d(?:\.\d)?)", F.concat(F.lit("Bluetooth "), part(r"(?i)\bBluetooth\s*(?:v|version\s*)?(\d(?:\.\d)?)")))),
        Rule("wireless", "nfc", "NFC", ((has(r"(?i)^NFC\b"), yes),), boolean=True),
        Rule("wireless", "uwb", "Ultra-wideband (UWB)", ((has(r"(?i)ultra-?\s?wide-?band|\bUWB\b"), yes),), boolean=True),
        Rule("wireless", "gnss_dual_band", "Dual-band GNSS", ((has(r"(?i)dual[- ]band\s+GNSS"), yes),), boolean=True),
        Rule("wireless", "gnss", "GNSS / positioning", one(POSITIONING, F.regexp_replace(T(), r",\s*", "; ")), pick="each"),
        *[Rule(role, "sim", "SIM", one(SIM)) for role in ("wireless", "network")],
        *[Rule(role, "esim", "eSIM", ((has(r"(?i)\beSIM\b"), yes),), boolean=True) for role in ("wireless", "network")],
        Rule("network", "gsm_bands", "GSM bands", one(BANDS["gsm"], F.when(gsm != "", gsm).otherwise(part(BANDS["gsm"]))), generations=("2G",)),
        Rule("network", "umts_bands", "UMTS/HSPA bands", bands("umts"), generations=("3G",)),
        Rule("network", "lte_bands", "LTE bands", bands("lte"), generations=("4G", "LTE")),
        Rule("network", "nr_sub6_bands", "5G Sub-6 bands", bands("sub6"), generations=("5G",)),
        Rule("network", "nr_mmwave_bands", "5G mmWave bands", bands("mmwave"), generations=("5G",)),
        Rule("network", "network_5g_type", "5G type", five, pick="each", generations=("5G",)),
        Rule("network", "model_number", "Model number", one(r"(?i)^Model\s+([A-Za-z0-9-]{3,20})$")),
        Rule("accessibility", "hearing_aid_compatible", "Hearing aid compatible", ((has(r"(?i)hearing aid[- ]compatible"), yes),), boolean=True),
        Rule("accessibility", "conversational_gain", "Conversational gain", one(GAIN, F.regexp_replace(part(GAIN), r"[. ]+$", "")), pick="each"),
        Rule("colors", "color", "Color", (((F.length(T()) <= 40) & ~has(POINTER), F.array(T())),), pick="join"),
    ]


KEY = ("entity", "section")
_FACT = ("entity", "section", "sub", "canonical", "label", "value", "unit", "boolean", "seq")


def merge_continuations(lines: DataFrame) -> DataFrame:
    """Lines (entity, section, seq, text, bold) with wrapped ones rejoined: a line that opens with a colon, slash or comma goes on the line
    before it, unless either is a heading; the seq of a joined line is that of its first part."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    heading = is_heading(T(), F.col("bold"))
    mark = F.substring(T(), 1, 1)
    rows = lines.select(*KEY, "seq", T(), F.coalesce("bold", F.lit(False)).alias("bold")).withColumn("heading", heading)
    goes_on = mark.isin(":", "/", ",") & ~F.col("heading") & F.coalesce(~F.lag("heading").over(order), F.lit(False))
    rows = rows.withColumn("start", F.when(~goes_on, F.col("seq"))).withColumn("first", F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("start").isNull() & (mark == ":"), F.concat(F.lit(" "), T())).otherwise(T()).alias("text"))))
    joined = rows.groupBy(*KEY, F.col("first").alias("seq")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.min_by("bold", "seq").alias("bold"), F.min_by("heading", "seq").alias("heading"))
    return joined.withColumn("text", F.trim("text"))


def _lines(lines: DataFrame) -> DataFrame:
    """Lines dealt by section, rejoined, in groups at sub-headings, with what rules need to know about the lines around."""
    rows = lines.filter("entity is not null and section is not null and seq is not null and text is not null").withColumn("text", F.trim(F.regexp_replace(T(), r"\s+", " "))).filter("text <> ''")
    rows = merge_continuations(rows.dropDuplicates(["entity", "section", "seq"]).repartition(*KEY))
    order = Window.partitionBy(*KEY).orderBy("seq")
    sub = F.col("heading") & (F.lower(T()) != F.lower("section"))
    rows = rows.withColumn("sub", F.last(F.when(sub, T()), ignorenulls=True).over(order)).withColumn("group", F.sum(sub.cast("int")).over(order))
    within = Window.partitionBy(*KEY, "group").orderBy("seq")
    rows = rows.withColumn("roles", section_roles(F.col("section")))
    begins = F.when(has("(?i)^" + LENS[4:]), F.regexp_replace(F.lower(part("(?i)^" + LENS[4:], 2)), "ultra-wide", "ultrawide"))
    body = rows.filter("not heading")
    weighed = F.max((has(WEIGHT) & F.lower(part(WEIGHT, 2)).isin("g", "kg")).cast("int")).over(Window.partitionBy(*KEY, "group")) == 1
    return body.withColumn("weighed", weighed).withColumn("around", F.concat_ws(" ", F.lag(T()).over(within), T(), F.lead(T()).over(within))).withColumn("lens", F.last(begins, ignorenulls=True).over(within))


def _hits(rows: DataFrame) -> DataFrame:
    """A row for each rule that a line meets (rule null: none), with whether the line was picked for it and whether it was for any."""
    out = []
    for i, r in enumerate(_rules()):
        text = lambda c: F.lit(c) if isinstance(c, str) else c
        for way, (met, value) in enumerate(r.ways):
            several = r.pick == "join" or r.unit is not None and isinstance(r.unit, str) and r.unit == "nits"
            earlier = [~m for m, _ in r.ways[:way]]
            for m in earlier:
                met = met & m
            values = value if several else F.array(value)
            out.append(F.when(F.array_contains("roles", r.role) & met, F.struct(
                F.lit(i).alias("rule"), F.lit(way).alias("way"), F.coalesce(r.rank, F.lit(0)).alias("rank") if r.rank is not None else F.lit(0).alias("rank"),
                text(r.canonical).alias("canonical"), text(r.label).alias("label"), values.alias("values"), (F.lit(None).cast("string") if r.unit is None else text(r.unit)).alias("unit"),
                F.lit(r.boolean).alias("boolean"), F.lit(r.pick).alias("pick"), F.lit(r.join).alias("sep"), F.array(*map(F.lit, r.generations)).cast("array<string>").alias("generations"),
            )))
    rows = rows.withColumn("hit", F.explode_outer(F.array_compact(F.array(*out)))).select("*", "hit.*").drop("hit")
    best = F.row_number().over(Window.partitionBy(*KEY, "group", "rule").orderBy("way", F.desc("rank"), "seq")) == 1
    rows = rows.withColumn("picked", F.col("rule").isNotNull() & (F.col("pick").isin("each", "join") | best))
    rows = rows.withColumn("values", F.filter(F.transform("values", lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != ""))
    line = Window.partitionBy(*KEY, "seq")
    return rows.withColumn("used", F.max((F.col("picked") & (F.size("values") > 0)).cast("int")).over(line) == 1).withColumn("nth", F.row_number().over(line.orderBy("rule")))


def _noted(hits: DataFrame) -> DataFrame:
    """hits with note and fact of each line that no rule took (once): part of a list, a note that it restates something, or a reason to reject it."""
    rest = hits.withColumn("left", ~F.col("used") & (F.col("nth") == 1)).withColumn("target", list_target(F.col("section"), F.col("sub")))
    role = lambda r: F.array_contains("roles", r)
    support, known = has(SUPPORT), lookup_canonical(part(LABEL_VALUE))
    says = F.concat(part(SUPPORT), F.lit(" support"))
    rest = rest.withColumn("known", F.when(F.col("left") & has(LABEL_VALUE), known))
    note = (
        F.when(~F.col("left"), None).when(role("body") & has(SIZES3), "merged:same dimensions in another unit")
        .when(role("body") & has(WEIGHT) & F.col("weighed"), "merged:same weight in another unit")
        .when(role("display") & support, "support")
        .when(role("display") & has(r"^\([^()]{2,24}\)$"), "merged:parenthetical qualifier of the preceding display value")
        .when(role("ports") & has(BUTTON), "buttons")
        .when(has(LINK) | has(POINTER), "rejected:link or navigation text, no characteristic")
        .when(has(r"(?i)\b(?:documentation|documents?|manuals?)\b") & (F.length(T()) < 60), "rejected:documentation pointer, no characteristic")
        .when((F.length(T()) < 2) | ~has("[A-Za-z0-9]"), "rejected:no content")
        .when(F.col("target").isNotNull() & F.col("known").isNotNull(), "known")
        .when(F.col("target").isNull() & has(LABEL_VALUE), "labelled")
        .when(F.col("target").isNull() & support, "support")
        .when(F.length(T()) > ITEM_CHARS, "rejected:long marketing prose, not a structured characteristic")
        .otherwise("item")
    )
    rest = rest.withColumn("note", note)
    # A list takes its items in order while they fit; an item that doesn't leaves room for a shorter one after it.
    order = Window.partitionBy(*KEY, "group", F.coalesce(F.col("note") == "item", F.lit(False))).orderBy("seq")
    size = F.struct(F.lit(0).alias("size"), F.lit(False).alias("kept"))

    def step(acc: Column, n: Column) -> Column:
        fits = acc["size"] + n + 2 <= LIST_CHARS
        return F.struct(F.when(fits, acc["size"] + n + 2).otherwise(acc["size"]).alias("size"), fits.alias("kept"))

    so_far = F.collect_list(F.length(T())).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rest = rest.withColumn("kept", F.aggregate(so_far, size, step)["kept"])
    rest = rest.withColumn("note", F.when((F.col("note") == "item") & ~F.col("kept"), f"rejected:list length cap ({LIST_CHARS} chars) reached").otherwise(F.col("note")))
    short = F.substring(part(LABEL_VALUE, 2), 1, VALUE_CHARS)
    heading = F.coalesce("sub", "section")
    fact = (
        F.when(F.col("note") == "support", F.struct(resolve_canonical(says).alias("canonical"), says.alias("label"), F.lit("Yes").alias("value")))
        .when(F.col("note") == "known", F.struct(F.col("known").alias("canonical"), label_for(F.col("known")).alias("label"), F.trim(short).alias("value")))
        .when(F.col("note") == "labelled", F.struct(resolve_canonical(F.trim(part(LABEL_VALUE))).alias("canonical"), F.trim(part(LABEL_VALUE)).alias("label"), F.trim(short).alias("value")))
        .when(F.col("note") == "buttons", F.struct(F.lit("buttons").alias("canonical"), F.lit("Buttons").alias("label"), T().alias("value")))
        .when(F.col("note") == "item", F.struct(F.coalesce("target", resolve_canonical(heading)).alias("canonical"), F.when(F.col("target").isNull(), heading).otherwise(label_for(F.col("target"))).alias("label"), T().alias("value")))
    )
    return rest.withColumn("fact", fact)


def read_sections(lines: DataFrame) -> DataFrame:
    """Facts entity, section, sub, canonical, label, value, unit, boolean, seq of the lines (entity, section, seq, text, bold).

    Rows without entity, section, seq or text are left out, as are blank lines; of rows that share a seq one is read. No rows give no
    facts; other columns are not read."""
    rows = _noted(_hits(_lines(lines))).withColumn("picked", F.col("picked") & (F.size("values") > 0))
    none, no = F.lit(None).cast("string"), F.lit(False)
    group = Window.partitionBy(*KEY, "group")

    def gathered(which: Column, keys: tuple[str, ...], value: str) -> tuple[Column, Column]:
        """The values of the rows of a group that `which` marks, in their order, and whether a row is the first of them."""
        w = Window.partitionBy(*KEY, "group", *keys)
        all_of = F.array_sort(F.collect_list(F.when(which, F.struct("seq", F.col(value).alias("v")))).over(w))
        return all_of, which & (F.col("seq") == F.min(F.when(which, F.col("seq"))).over(w))

    def fact(canonical: Column, label: Column, value: Column, unit: Column, boolean: Column) -> Column:
        return F.struct(canonical.alias("canonical"), label.alias("label"), value.alias("value"), unit.alias("unit"), boolean.alias("boolean"))

    lists, first = gathered(F.col("picked") & (F.col("pick") == "join"), ("rule",), "values")
    items, item = gathered(F.col("note").isin("buttons", "item"), ("note",), "fact")
    made = F.col("picked") & (F.size("generations") > 0)
    networks = F.array_sort(F.collect_list(F.when(made, F.struct("rule", "generations"))).over(group))
    last = made & (F.struct("seq", "rule") == F.max(F.when(made, F.struct("seq", "rule"))).over(group))
    rows = rows.withColumn("lists", lists).withColumn("first", first).withColumn("items", items).withColumn("item", item).withColumn("networks", networks).withColumn("last", last)
    own = F.when(F.col("picked") & (F.col("pick") != "join"), F.transform("values", lambda v: fact(F.col("canonical"), F.col("label"), v, F.col("unit"), F.col("boolean"))))
    joined = F.when(F.col("first"), F.array(fact(F.col("canonical"), F.col("label"), F.expr("array_join(array_distinct(flatten(transform(lists, x -> x.v))), sep)"), none, no)))
    network = F.when(F.col("last"), F.array(fact(F.lit("network_generations"), F.lit("Network generations"), F.expr("array_join(array_distinct(flatten(transform(networks, x -> x.generations))), '; ')"), none, no)))
    alone = F.when(F.col("fact").isNotNull() & ~F.col("note").isin("buttons", "item"), F.array(fact(F.col("fact.canonical"), F.col("fact.label"), F.col("fact.value"), none, F.col("note") == "support")))
    listed = F.when(F.col("item"), F.array(fact(F.col("fact.canonical"), F.col("fact.label"), F.array_join(F.array_distinct(F.transform("items", lambda x: x["v"]["value"])), "; "), none, no)))
    facts = F.flatten(F.array_compact(F.array(own, joined, network, alone, listed)))
    return rows.select(*KEY, "sub", "seq", F.explode(facts).alias("f")).select(*KEY, "sub", "f.*", "seq").select(*_FACT)


def section_ledger(lines: DataFrame) -> DataFrame:
    """entity, section, sub, seq, line, outcome (accepted, merged, rejected or heading), reason of each line: nothing is dropped silently."""
    rows = lines.filter("entity is not null and section is not null and seq is not null and text is not null").withColumn("text", F.trim(F.regexp_replace(T(), r"\s+", " "))).filter("text <> ''")
    heads = merge_continuations(rows.dropDuplicates(["entity", "section", "seq"]).repartition(*KEY)).filter("heading")
    heads = heads.select(*KEY, F.lit(None).cast("string").alias("sub"), "seq", T().alias("line"), F.lit("heading").alias("outcome"), F.lit("sub-section heading (structure, not a value)").alias("reason"))
    rows = _noted(_hits(_lines(lines))).filter("nth = 1")
    tagged = F.coalesce(F.col("note").rlike("^(?:merged|rejected):"), F.lit(False))
    told = rows.select(*KEY, "sub", "seq", T().alias("line"), F.when(tagged, F.substring_index("note", ":", 1)).otherwise("accepted").alias("outcome"), F.when(tagged, F.regexp_replace("note", "^[a-z]+:", "")).otherwise("").alias("reason"))
    return heads.unionByName(told)


def first_facts(facts: DataFrame) -> DataFrame:
    """Of the facts of an entity with one canonical name the first, by section and seq."""
    rest = [c for c in facts.columns if c not in ("entity", "canonical")]
    return facts.groupBy("entity", "canonical").agg(F.min_by(F.struct(*rest), F.struct("section", "seq", "value")).alias("f")).select("entity", "canonical", "f.*").select(*facts.columns)


def model_column(cells: DataFrame) -> DataFrame:
    """Lines (entity, section, seq, text, bold) of the column of a specification table that is the model's.

    cells: entity, section, seq, column, header, text, bold, model. A column whose header names the model exactly is its; of a table whose headers name
    no model at all, lines on which every column agrees hold for it; a table of other models only gives nothing."""
    from ..functions.identity import match_model, parts

    rows = cells.withColumn("_match", match_model(F.col("model"), F.col("header"))).withColumn("_like", F.arrays_overlap(parts(F.col("model")), parts(F.col("header"))))
    of = Window.partitionBy(*KEY)
    rows = rows.withColumn("_own", F.min(F.when(F.col("_match") == "exact", F.col("column"))).over(of)).withColumn("_named", F.max(F.col("_like") | F.col("_match").isin("mismatch", "likely_variant")).over(of))
    rows = rows.withColumn("_columns", F.size(F.collect_set("column").over(of)))
    line = Window.partitionBy(*KEY, "seq", "text")
    agreed = F.size(F.collect_set("column").over(line)) == F.col("_columns")
    rows = rows.withColumn("_agreed", agreed).withColumn("_first", F.col("column") == F.min("column").over(of))
    keep = F.when(F.col("_own").isNotNull(), F.col("column") == F.col("_own")).otherwise(~F.coalesce("_named", F.lit(False)) & F.col("_agreed") & F.col("_first"))
    return rows.filter(keep).select(*KEY, "seq", "text", "bold")


#: Facts that prose may state: attribute, pattern with the value in its first group, unit.
PROSE = (
    ("battery_capacity", r"(?i)(\d[\d,]{2,})\s*mAh\b", "mAh"), ("charging_power", r"(?i)(\d{2,3})\s?W\b[^.]{0,30}?\bcharging", "W"), ("refresh_rate", r"(?i)(\d{2,3})\s?Hz\b[^.]{0,30}?\b(?:refresh|display|screen)", "Hz"), ("net_weight", r"(?i)\bweighs?(?:\s+(?:only|just|in at))?\s+(\d+(?:\.\d+)?)\s*(?:g|grams)\b", "g"),
    ("peak_brightness", r"(?i)(\d[\d,]{2,})\s*nits\b", "nits"), ("ip_rating", r"\b(IP\d{2}[A-Z]?)\b", None),
)


def sibling_value(values: Column, text: Column, model: Column, pattern: str) -> Column:
    """The only different value among matches, else the only one whose match follows the model's last word within 60 characters and without another number, else null."""
    distinct = F.array_distinct(values)
    tail = F.try_element_at(F.filter(F.split(F.coalesce(model, F.lit("")), r"\s+"), lambda w: w != ""), F.lit(-1))
    near = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?<!\w)(?i)\Q"), tail, F.lit(r"\E(?-i)(?!\w)[^.\d]{0,60}" + pattern)), 1))
    return F.when(F.size(distinct) == 1, distinct[0]).when((F.size(distinct) > 1) & (F.size(near) == 1), near[0])


def prose_facts(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """entity, attribute, value, unit that the prose of official pages (entity, model, text) states: only where one value is meant, as pages tell of sibling
    variants too. known (entity, attribute) is left out."""
    def row(name: str, pattern: str, unit: str | None) -> Column:
        found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), 1), lambda v: v)
        return F.struct(F.lit(name).alias("attribute"), bare(sibling_value(found, F.col("text"), F.col("model"), pattern)).alias("value"), F.lit(unit).cast("string").alias("unit"))

    facts = pages.select("entity", F.explode(F.array(*[row(*x) for x in PROSE])).alias("f")).select("entity", "f.*").filter("value is not null").distinct()
    return facts if known is None else facts.join(known.select("entity", "attribute").distinct(), ["entity", "attribute"], "left_anti")
