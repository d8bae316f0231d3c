"""Queries of specification sections: pages composed of supplier columns, whose facts SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..operators import sections as X
from .queries import query, table

# Lines of a page: {s} is a number of two digits, {d} of one, {k} the supplier's key; * marks a bold line.
PAGE = {
    "Display": ("*Display", "6.{d}-inch flat panel", "1080 x 24{s} OLED at 4{s} PPI", "20 : 9 aspect ratio", "Smooth display (60-90 Hz)", "Gaming mode 1-120 Hz", "Scratch-resistant Glass{s} cover glass",
        "Up to 1,{s}0 nits (HDR) and up to 2{s}0 nits (peak brightness)", ">1,000,000:1 contrast ratio", "Full 24-bit depth for 16 million colors", "HDR support", "(flat)"),
    "Dimensions and weight": ("15{s}.0 height x 7{s}.5 width x 8.9 depth (mm)", "6.0 height x 2.8 width x 0.4 depth (in)", "2{s} g", "7.9 oz"),
    "Battery and Charging": ("Typical 5,{s}0 mAh (minimum 4,{s}5 mAh)", "Charging adapter", "{s} W", "Fast charging - up to {s} percent in 30 minutes", "Wireless charging (Qi-certified)", "24+ hour battery life", "72-hour battery life with saver on"),
    "Memory and storage": ("{s} GB RAM", "128GB / 256 gb"),
    "Processor": ("Chip{s} octa-core", "Guard{d} security coprocessor", "Neural engine"),
    "Rear Camera": ("50 MP Octa PD wide camera with autofocus", "ƒ/1.{d} aperture", "8{d}° field of view", '1/1.31" image sensor size', "{s} MP ultra-wide", "5x optical zoom", "Super zoom up to 20x", "Zoom up to 30x"),
    "Front Camera": ("1{d}.5 MP sensor with autofocus", "f/2.2 aperture", "95° ultra field of view"),
    "Video": ("*Rear", "4K video recording at 24/30/60 FPS", "1080p video recording at 30/60 FPS", "Slo-mo support up to 2{s} FPS", "10-bit HDR video", "*Audio", "Stereo recording"),
    "Materials and durability": ("IP 68 and IP 69 rated", "Tough{d} cover glass", "Aluminium frame"),
    "Operating system": ("Launched with Android {s}.",),
    "Security and OS updates": ("{d}7 years of OS and security updates",),
    "Buttons and ports": ("USB Type-C 3.{d}", "Power button", "Volume controls"),
    "Media": ("{s} microphones", "Stereo speakers", "Documentation at example"),
    "Connectivity and location": ("Wi-Fi 7 (802.11be) with 2.4GHz + 5GHz, 2x2+2x2 MIMO", "Bluetooth v5.{d}", "NFC", "Ultra-wideband chip", "Dual band GNSS", "GPS, GLONASS, Galileo", "Thread"),
    "Network": ("Model G{k}X1", "GSM/EDGE: Quad-band (850, 900)", "UMTS/HSPA+/HSDPA: Bands 1,2,4", "LTE", ": Bands B1/2/3", "5G Sub-6: Bands n1/2/{s}", "5G mmWave: Band n258", "5G Sub 6GHz + mmWave", "Dual SIM (nano + eSIM)"),
    "Accessibility": ("Hearing aid compatible", "Conversational Gain: 12 dB. See"),
    "Colors": ("Obsidian", "Porcelain {d}", "See"),
    "Box contents": ("Cable 1 m", "/ adapter"),
    "Warranty": ("Coverage: {s} months", "https://x.example/a", "Max brightness: {s} nits", "Long " + "marketing words " * 10 + "end"),
}
# What the page states: section, sub-heading, name, label, value, unit, boolean, line.
FACTS = (
    ("Display", None, "display_size", "Display size", "6.{d}", "in", False, 2), ("Display", None, "display_resolution", "Display resolution", "1080 x 24{s}", "pixels", False, 3),
    ("Display", None, "display_type", "Display type", "OLED", None, False, 3), ("Display", None, "display_ppi", "Pixel density", "4{s}", "ppi", False, 3), ("Display", None, "display_aspect_ratio", "Display aspect ratio", "20:9", None, False, 4),
    ("Display", None, "refresh_rate", "Refresh rate", "1-120", "Hz", False, 6), ("Display", None, "cover_glass", "Cover glass", "Glass{s}", None, False, 7), ("Display", None, "hdr_brightness", "HDR brightness", "1{s}0", "nits", False, 8),
    ("Display", None, "peak_brightness", "Peak brightness", "2{s}0", "nits", False, 8), ("Display", None, "contrast_ratio", "Contrast ratio", ">1,000,000:1", None, False, 9), ("Display", None, "color_depth", "Color depth", "24-bit", None, False, 10),
    ("Display", None, "number_of_colors", "Number of colors", "16 million", None, False, 10), ("Display", None, "hdr_support", "HDR support", "Yes", None, True, 11), ("Display", None, "display", "Display", "Smooth display (60-90 Hz)", None, False, 5),
    ("Dimensions and weight", None, "product_height", "Product height", "15{s}.0", "mm", False, 1), ("Dimensions and weight", None, "product_width", "Product width", "7{s}.5", "mm", False, 1),
    ("Dimensions and weight", None, "product_depth", "Product depth", "8.9", "mm", False, 1), ("Dimensions and weight", None, "net_weight", "Net weight", "2{s}", "g", False, 3),
    ("Battery and Charging", None, "battery_capacity", "Battery capacity", "5{s}0", "mAh", False, 1), ("Battery and Charging", None, "battery_capacity_min", "Minimum battery capacity", "4{s}5", "mAh", False, 1),
    ("Battery and Charging", None, "battery_features", "Battery features", "Charging adapter", None, False, 2), ("Battery and Charging", None, "charging_power", "Charging power", "{s}", "W", False, 3),
    ("Battery and Charging", None, "fast_charging", "Fast charging", "up to {s} percent in 30 minutes", None, False, 4), ("Battery and Charging", None, "wireless_charging", "Wireless charging", "Yes", None, True, 5),
    ("Battery and Charging", None, "wireless_charging_standard", "Wireless charging standard", "Qi", None, False, 5), ("Battery and Charging", None, "battery_life", "Battery life", "24+", "h", False, 6),
    ("Battery and Charging", None, "battery_life_power_saving", "Battery life (power saving)", "72", "h", False, 7), ("Memory and storage", None, "ram", "RAM", "{s}", "GB", False, 1), ("Memory and storage", None, "storage", "Storage", "128 GB / 256 GB", None, False, 2),
    ("Processor", None, "processor", "Processor", "Chip{s} octa-core", None, False, 1), ("Processor", None, "security_coprocessor", "Security coprocessor", "Guard{d}", None, False, 2), ("Processor", None, "processor", "Processor", "Neural engine", None, False, 3),
    ("Rear Camera", None, "rear_camera", "Rear camera", "50 MP wide + {s} MP ultrawide", None, False, 1), ("Rear Camera", None, "wide_camera_autofocus", "Wide camera autofocus", "Yes", None, True, 1),
    ("Rear Camera", None, "wide_camera_phase_detection", "Wide camera phase detection", "Octa PD", None, False, 1), ("Rear Camera", None, "wide_camera_aperture", "Wide camera aperture", "ƒ/1.{d}", None, False, 2),
    ("Rear Camera", None, "wide_camera_field_of_view", "Wide camera field of view", "8{d}", "°", False, 3), ("Rear Camera", None, "wide_camera_sensor_size", "Wide camera sensor size", '1/1.31"', None, False, 4),
    ("Rear Camera", None, "ultrawide_camera_optical_zoom", "Ultrawide camera optical zoom", "5x", None, False, 6), ("Rear Camera", None, "max_zoom", "Max zoom", "30x", None, False, 8),
    ("Rear Camera", None, "rear_camera_features", "Rear camera features", "Super zoom up to 20x", None, False, 7), ("Front Camera", None, "front_camera", "Front camera", "1{d}.5 MP", None, False, 1),
    ("Front Camera", None, "front_camera_autofocus", "Front camera autofocus", "Yes", None, True, 1), ("Front Camera", None, "front_camera_aperture", "Front camera aperture", "ƒ/2.2", None, False, 2),
    ("Front Camera", None, "front_camera_field_of_view", "Front camera field of view", "95", "°", False, 3), ("Video", "Rear", "rear_video_recording", "Rear video recording", "4K at 24/30/60 FPS; 1080p at 30/60 FPS", None, False, 2),
    ("Video", "Rear", "slow_motion_video", "Slow-motion video", "2{s}", "FPS", False, 4), ("Video", "Rear", "hdr_video_recording", "HDR video recording", "10-bit", None, False, 5),
    ("Video", "Audio", "video_audio_features", "Video audio features", "Stereo recording", None, False, 7), ("Materials and durability", None, "ip_rating", "IP rating", "IP68 , IP69", None, False, 1),
    ("Materials and durability", None, "cover_glass", "Cover glass", "Tough{d}", None, False, 2), ("Materials and durability", None, "materials_and_durability", "Materials and durability", "Aluminium frame", None, False, 3),
    ("Operating system", None, "operating_system", "Operating system", "Android {s}", None, False, 1), ("Security and OS updates", None, "software_update_support", "Software update support", "{d}7", "years", False, 1),
    ("Buttons and ports", None, "usb", "USB", "USB Type-C 3.{d}", None, False, 1), ("Buttons and ports", None, "buttons", "Buttons", "Power button; Volume controls", None, False, 2), ("Media", None, "microphone_count", "Microphones", "{s}", None, False, 1),
    ("Media", None, "speakers", "Speakers", "Stereo", None, False, 2), ("Connectivity and location", None, "wifi", "Wi-Fi", "Wi-Fi 7 (802.11be)", None, False, 1), ("Connectivity and location", None, "wifi_bands", "Wi-Fi bands", "2.4 GHz + 5 GHz", None, False, 1),
    ("Connectivity and location", None, "wifi_mimo", "Wi-Fi MIMO", "2x2+2x2", None, False, 1), ("Connectivity and location", None, "bluetooth", "Bluetooth", "Bluetooth 5.{d}", None, False, 2), ("Connectivity and location", None, "nfc", "NFC", "Yes", None, True, 3),
    ("Connectivity and location", None, "uwb", "Ultra-wideband (UWB)", "Yes", None, True, 4), ("Connectivity and location", None, "gnss_dual_band", "Dual-band GNSS", "Yes", None, True, 5), ("Connectivity and location", None, "gnss", "GNSS / positioning", "GPS; GLONASS; Galileo", None, False, 6),
    ("Connectivity and location", None, "wireless_features", "Wireless features", "Thread", None, False, 7), ("Network", None, "model_number", "Model number", "G{k}X1", None, False, 1), ("Network", None, "gsm_bands", "GSM bands", "850, 900", None, False, 2),
    ("Network", None, "umts_bands", "UMTS/HSPA bands", "1, 2, 4", None, False, 3), ("Network", None, "lte_bands", "LTE bands", "B1, B2, B3", None, False, 4), ("Network", None, "nr_sub6_bands", "5G Sub-6 bands", "n1, n2, n{s}", None, False, 6),
    ("Network", None, "nr_mmwave_bands", "5G mmWave bands", "n258", None, False, 7), ("Network", None, "network_5g_type", "5G type", "Sub-6 GHz + mmWave", None, False, 8), ("Network", None, "sim", "SIM", "Dual SIM (nano + eSIM)", None, False, 9),
    ("Network", None, "esim", "eSIM", "Yes", None, True, 9), ("Network", None, "network_generations", "Network generations", "2G; 3G; 4G; LTE; 5G", None, False, 8), ("Accessibility", None, "hearing_aid_compatible", "Hearing aid compatible", "Yes", None, True, 1),
    ("Accessibility", None, "conversational_gain", "Conversational gain", "12 dB", None, False, 2), ("Colors", None, "color", "Color", "Obsidian; Porcelain {d}", None, False, 1), ("Box contents", None, "package_contents", "Package contents", "Cable 1 m/ adapter", None, False, 1),
    ("Warranty", None, "coverage", "Coverage", "{s} months", None, False, 1), ("Warranty", None, "peak_brightness", "Max brightness", "{s} nits", None, False, 3),
)
# Lines that make no fact: section, line, outcome, reason.
NO_FACT = (
    ("Display", 1, "heading", "sub-section heading (structure, not a value)"), ("Video", 1, "heading", "sub-section heading (structure, not a value)"), ("Video", 6, "heading", "sub-section heading (structure, not a value)"),
    ("Display", 12, "merged", "parenthetical qualifier of the preceding display value"), ("Dimensions and weight", 2, "merged", "same dimensions in another unit"), ("Dimensions and weight", 4, "merged", "same weight in another unit"),
    ("Media", 3, "rejected", "documentation pointer, no characteristic"), ("Colors", 3, "rejected", "link or navigation text, no characteristic"), ("Warranty", 2, "rejected", "link or navigation text, no characteristic"),
    ("Warranty", 4, "rejected", "long marketing prose, not a structured characteristic"),
)


def sql_text(v) -> str:  # noqa: ANN001
    return "NULL" if v is None else str(v) if isinstance(v, bool | int) else "'" + v.replace("'", "''") + "'"


def sql_rows(rows) -> str:  # noqa: ANN001
    return ", ".join("(" + ", ".join(map(sql_text, r)) + ")" for r in rows)


def _filled(c):  # noqa: ANN001, ANN202
    for mark, value in (("{s}", (F.col("s_nationkey") + 10).cast("string")), ("{d}", (F.col("s_nationkey") % 10).cast("string")), ("{k}", F.col("s_suppkey").cast("string"))):
        c = F.replace(c, F.lit(mark), value)
    return c


FILLED = "replace(replace(replace({0}, '{{s}}', (s_nationkey + 10)::VARCHAR), '{{d}}', (s_nationkey % 10)::VARCHAR), '{{k}}', s_suppkey::VARCHAR)"


def _page(spark, d) -> DataFrame:  # noqa: ANN001
    rows = [(section, i, t.removeprefix("*"), t.startswith("*")) for section, lines in PAGE.items() for i, t in enumerate(lines, 1)]
    lines = F.array(*[F.struct(F.lit(a).alias("section"), F.lit(i).alias("seq"), F.lit(t).alias("text"), F.lit(b).alias("bold")) for a, i, t, b in rows])
    page = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), "s_suppkey", "s_nationkey", F.explode(lines).alias("l"))
    return page.select("entity", "l.section", "l.seq", _filled(F.col("l.text")).alias("text"), "l.bold")


_VALUES = f"(VALUES {sql_rows(FACTS)}) AS f(section, sub, canonical, label, value, unit, boolean, seq)"


@query(f"SELECT s_suppkey AS entity, section, sub, canonical, label, {FILLED.format('value')} AS value, unit, boolean, seq FROM supplier, {_VALUES}")
def section_facts(spark, d):  # noqa: ANN001, ANN201
    return X.read_sections(_page(spark, d))


@query(f"""SELECT entity, canonical, arg_min(value, (section, seq, value)) AS value, arg_min(section, (section, seq, value)) AS section FROM
(SELECT s_suppkey AS entity, section, canonical, {FILLED.format('value')} AS value, seq FROM supplier, {_VALUES}) GROUP BY entity, canonical""")
def section_first_facts(spark, d):  # noqa: ANN001, ANN201
    return X.first_facts(X.read_sections(_page(spark, d))).select("entity", "canonical", "value", "section")


_LINE_ROWS = [(a, i) for a, lines in PAGE.items() for i in range(1, len(lines) + 1) if (a, i) not in (("Network", 5), ("Box contents", 2))]


@query(f"""SELECT s_suppkey AS entity, l.section, l.seq, coalesce(outcome, 'accepted') AS outcome, coalesce(reason, '') AS reason FROM supplier, (VALUES {sql_rows(_LINE_ROWS)}) AS l(section, seq)
LEFT JOIN (VALUES {sql_rows(NO_FACT)}) AS n(section, seq, outcome, reason) ON n.section = l.section AND n.seq = l.seq""")
def section_outcomes(spark, d):  # noqa: ANN001, ANN201
    return X.section_ledger(_page(spark, d)).select("entity", "section", "seq", "outcome", "reason")


_HEADINGS = (
    ("Front camera", "front_camera", "front_camera_features"), ("Main Camera", "rear_camera", ""), ("Display and screen", "display", ""), ("Security and OS updates", "updates", ""), ("OS", "os", ""), ("Body size", "body,durability", ""),
    ("Sensors", "", "sensors"), ("Audio and media", "media", "media_features"), ("What's included", "box", ""), ("Authentication", "", "authentication"), ("5G and Wi-Fi", "wireless,network", ""), ("Colours", "colors", "color"),
)


@query(f"""SELECT p_partkey, heading, roles, target FROM part JOIN (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {sql_rows(_HEADINGS)}) AS h(heading, roles, target)) ON i = p_partkey % {len(_HEADINGS)}""")
def section_headings(spark, d):  # noqa: ANN001, ANN201
    heading = F.get(F.array(*[F.lit(h) for h, _, _ in _HEADINGS]), (F.col("p_partkey") % len(_HEADINGS)).cast("int"))
    p = table(spark, d, "part").select("p_partkey", heading.alias("heading"))
    return p.select("p_partkey", "heading", F.array_join(X.section_roles(F.col("heading")), ",").alias("roles"), F.coalesce(X.list_target(F.col("heading"), F.lit("")), F.lit("")).alias("target"))


# A label, its canonical name, the label of that name, and its look-up keys.
_LABELS = (
    ("Pixel Density", "display_ppi", "Pixel density", "pixel density"), ("Max brightness (nits)", "peak_brightness", "Peak brightness", "max brightness nits|max brightness"), ("Quick Charge / Fast charging", "fast_charging", "Fast charging", "quick charge fast charging|quick charge|fast charging"),
    ("2 Loudspeaker", "speakers", "Speakers", "2 loudspeaker|loudspeaker"), ("Sensors 2", "sensors", "Sensors", "sensors 2|sensors"), ("Ring diameter (mm)", "ring_diameter", "Ring diameter", "ring diameter"), ("Weight, kg", "weight", "Weight", "weight"), ("***", "unnamed_attribute", "Unnamed attribute", ""),
)


@query(f"""SELECT p_partkey, label, canonical, shown, keys, coalesce(regexp_extract(canonical, '^(wide|macro)_camera_', 1), '') AS lens FROM part JOIN (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {sql_rows(_LABELS)}) AS h(label, canonical, shown, keys)) ON i = p_partkey % {len(_LABELS)}
UNION ALL SELECT p_partkey, 'lens', r || '_camera_aperture', upper(r[1]) || r[2:] || ' camera aperture', 'lens', CASE WHEN r = 'wide' THEN 'wide' ELSE '' END FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'wide' ELSE 'front' END AS r FROM part)""")
def label_catalog(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "part").select("p_partkey", "p_size", F.get(F.array(*[F.lit(r[0]) for r in _LABELS]), (F.col("p_partkey") % len(_LABELS)).cast("int")).alias("label"))
    own = p.select("p_partkey", "label", C.resolve_canonical(F.col("label")).alias("canonical"), F.array_join(C.label_variants(F.col("label")), "|").alias("keys"))
    lens = p.select("p_partkey", F.lit("lens").alias("label"), F.concat(F.when(F.col("p_size") % 2 == 0, "wide").otherwise("front"), F.lit("_camera_aperture")).alias("canonical"), F.lit("lens").alias("keys"))
    out = own.unionByName(lens)
    return out.select("p_partkey", "label", "canonical", C.label_for(F.col("canonical")).alias("shown"), "keys", F.coalesce(C.lens_parts(F.col("canonical"))["role"], F.lit("")).alias("lens"))


@query("""WITH h AS (SELECT p_partkey AS seq, 'attr_' || (p_partkey % 40) AS canonical, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'Label ' || p_partkey END AS label, p_size % 2 = 0 AS boolean FROM part)
SELECT canonical, coalesce(arg_min(coalesce(label, ''), seq), '') = '' AS made, CASE WHEN arg_min(coalesce(label, ''), seq) = '' THEN 'Attr ' || substr(canonical, 6) ELSE arg_min(coalesce(label, ''), seq) END AS label, arg_min(boolean, seq) AS boolean FROM h WHERE canonical NOT IN ('attr_0', 'attr_7') GROUP BY canonical""")
def schema_extension(spark, d):  # noqa: ANN001, ANN201
    p = F.col("p_partkey")
    hints = table(spark, d, "part").select(p.alias("seq"), F.concat(F.lit("attr_"), p % 40).alias("canonical"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("Label "), p)).alias("label"), (F.col("p_size") % 2 == 0).alias("boolean"))
    known = spark.createDataFrame([("attr_0",), ("attr_7",), (None,)], "canonical string")
    return C.extension_definitions(hints, known).select("canonical", F.col("label").startswith("Attr ").alias("made"), "label", "boolean")


@query("""WITH l AS (SELECT p_partkey AS seq, split_part(p_name, ' ', 1) || ' ' || (p_partkey % 5) AS label FROM part), k AS (SELECT seq, label, lower(label) AS key FROM l WHERE lower(label) NOT IN ('red 1', 'blue 2'))
SELECT replace(key, ' ', '_') AS canonical, arg_min(label, seq) AS label, 'discovered' AS scope FROM k GROUP BY key UNION ALL SELECT 'color', NULL, 'schema'""")
def schema_discovered(spark, d):  # noqa: ANN001, ANN201
    labels = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat_ws(" ", F.substring_index("p_name", " ", 1), (F.col("p_partkey") % 5).cast("string")).alias("label"))
    return C.discovered_definitions(labels, spark.createDataFrame([("color", "Red 1"), ("color", "BLUE 2")], "canonical string, alias string"))


# Entity kind, column, header, line, text of tables with a column for each model; and what the model's column states.
_CELLS = (
    ("a", 0, "MX{s}00", 1, "Typical 5,{s}0 mAh"), ("a", 1, "MX{s}99", 1, "Typical 9,999 mAh"), ("b", 0, "Standard", 1, "Typical 4,{s}0 mAh"), ("b", 1, "Large", 1, "Typical 4,{s}0 mAh"), ("b", 0, "Standard", 2, "24+ hour battery life"), ("b", 1, "Large", 2, "30 hour battery life"),
    ("c", 0, "MX{s}99", 1, "Typical 7,777 mAh"), ("c", 1, "MX{s}98", 1, "Typical 8,888 mAh"),
)


@query("SELECT s_suppkey * 10 + k AS entity, 'battery_capacity' AS canonical, c || (s_nationkey + 10) || '0' AS value FROM supplier, (VALUES (0, '5'), (1, '4')) AS v(k, c)")
def model_columns(spark, d):  # noqa: ANN001, ANN201
    cells = F.array(*[F.struct(F.lit("abc".index(k)).alias("k"), F.lit(c).alias("column"), F.lit(h).alias("header"), F.lit(q).alias("seq"), F.lit(t).alias("text")) for k, c, h, q, t in _CELLS])
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.explode(cells).alias("c")).select("s_suppkey", "s_nationkey", "c.*")
    rows = rows.select((F.col("s_suppkey") * 10 + F.col("k")).alias("entity"), F.lit("Battery").alias("section"), "seq", "column", _filled(F.col("header")).alias("header"), _filled(F.col("text")).alias("text"), F.lit(False).alias("bold"), F.concat(F.lit("MX"), F.col("s_nationkey") + 10, F.lit("00")).alias("model"))
    return X.read_sections(X.model_column(rows)).select("entity", "canonical", "value")


_PROSE = "The MX{s}00 has a 5,{s}0 mAh cell. It weighs just 2{s} grams. Up to 120 Hz refresh, or 90 Hz display on others. Rated IP68. The MX{s}00 reaches 1{s}00 nits, the Pro 2{s}00 nits."


@query("""SELECT s_suppkey AS entity, attribute, replace(value, '{s}', (s_nationkey + 10)::VARCHAR) AS value, unit FROM supplier, (VALUES ('battery_capacity', '5{s}0', 'mAh'), ('net_weight', '2{s}', 'g'), ('peak_brightness', '1{s}00', 'nits')) AS v(attribute, value, unit)""")
def prose_facts(spark, d):  # noqa: ANN001, ANN201
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), "s_suppkey", "s_nationkey")
    pages = s.select("entity", F.concat(F.lit("Acme MX"), F.col("s_nationkey") + 10, F.lit("00")).alias("model"), _filled(F.lit(_PROSE)).alias("text"))
    return X.prose_facts(pages, s.select("entity", F.lit("ip_rating").alias("attribute")))
