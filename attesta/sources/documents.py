"""Facts of documents whose text comes page by page, as DataFrame plans: lines are positions of a split, state over lines is a window.

pages: doc_id, page, text, model, document_type. Windows are over one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identity as I
from ..functions import url as U

# Headings of technical sections, how many lines they cover, lines that are pairs, words of instructions.
TECH_LINES = 45
TECH_HEADING = (
    r"(?iu)^\s*(?:\d+(?:\.\d+)*[.)]?\s*)?(?:technical\s+(?:data|specifications?)|specifications?|technische\s+daten|donn[ée]es\s+techniques|caract[ée]ristiques(?:\s+techniques)?|dati\s+tecnici|datos\s+t[ée]cnicos"
    r"|technische\s+gegevens|технические\s+характеристики|технические\s+данные|характеристики|основные\s+технические\s+данные)(?![\p{L}\p{N}_])[^.]{0,40}$"
)
COLON = r"(?u)^([A-Za-zА-Яа-яÀ-ÿ][^:：\n]{1,58}?)\s*[:：]\s*(\S.{0,200})$"
UNIT_LINE = r"(?U)^([^\d:]{3,60}?)\s+(\d[\d.,]*(?:\s?[-–x×/]\s?\d[\d.,]*)*\s?(?:[A-Za-zА-Яа-яµ°Ω%/²³.]{1,10}\b.{0,60})?)$"
INSTRUCTION = r"(?u)[.!?]\s+[A-ZА-Я]|(?i:\b(?:please|make sure|do not|never|always|must|should|bitte|nicht)\b)|(?iu:необходимо|нельзя)"
DANGLING = r"(?iu)(?:^|\s)(?:от|до|в|на|с|по|за|для|при|of|to|in|at|for|and|und|de|du|le)\s*$"
NOTE = r"(?iu)^(?:note|notes|warning|caution|attention|important|tip|примечание|внимание|важно|hinweis|achtung)$"
PROSE_TYPES = ("manual", "instruction", "user_guide", "quick_start_guide")
UNIT = r"(?:°\s?[CF]|%|dB(?:\(A\))?|[kKМмmcdµ]?[mgWVAlL]|kg|кг|мм|см|Вт|кВт|mAh|Ah|Wh|kWh|Hz|kHz|MHz|GHz|rpm|bar|Pa|kPa|N|Nm|s|min|h|inch|in|lb|oz|GB|MB|TB|л|мл|Гц|об/мин)"
PAGE_NUMBER, LANGUAGE, LEADER = r"^\d{1,3}$", r"^[A-Z]{2}$", r"\.{4,}"
SPEC_HEADING = r"(?iu)specifications?|technical\s+data|technical\s+characteristics?|parameters?|характеристик|параметр|спецификац"
CONTACT = r"(?iu)телефон|горяч(?:ей|ая)\s+лини|служба\s+поддержк|эл\.?\s*почта|hotline|customer\s+service|support\s+line|phone\s*(?:number)?|e-?mail"
CONTINUED = rf"(?iu)^[-+]?\d[\d\s.,;:+/x×%\-–—]*{UNIT}?[)\]]+$"


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), " "), lambda w: w != ""))


def is_pair(label: Column, value: Column) -> Column:
    """A label and a value that can be a fact."""
    noise = r"(?iu)^(?:http|www\.|©|\d+$)|\b(?:cookie|privacy|newsletter|subscribe|login|sign in|add to (?:cart|basket))\b"
    return (label != "") & (value != "") & (label != value) & F.length(label).between(2, 90) & (F.length(value) <= 600) & ~label.rlike(noise) & (n_words(label) <= 10) & ~label.rlike("[?!]$")


def scope_pages(pages: DataFrame) -> DataFrame:
    """pages with scope: document_model_page (names the model and no sibling), document_scope (names neither, in a document without siblings), or
    null with a reason; and named: whether any page of the document names the model. A manual may name a model by its stem."""
    model, text = F.col("model"), F.coalesce("text", F.lit(""))
    whole = I.compact(F.coalesce("model", F.lit("")))
    stem = F.regexp_replace(whole, "(?<=[0-9])[A-Z]$", "")
    stemmed = (stem != whole) & (F.length(stem) >= 5) & F.exists(F.regexp_extract_all(text, F.lit(I.TOKEN), 1), lambda t: I.compact(t) == stem)
    code = F.coalesce(U.sku_token(model), model)
    rows = pages.withColumn("has_model", I.sku_kind(model, text).isin("exact", "regional_suffix", "base_only") | stemmed).withColumn("sibling", I.sibling_identifier(code, text) != "")
    doc = Window.partitionBy("doc_id")
    rows = rows.withColumn("mixed", F.max("sibling").over(doc)).withColumn("named", F.max("has_model").over(doc))
    scope = F.when(F.col("has_model") & ~F.col("sibling"), "document_model_page").when(~F.col("has_model") & ~F.col("mixed"), "document_scope")
    reason = F.when(F.col("has_model") & F.col("sibling"), "neighbour_sku_shared_page").when(~F.col("has_model") & F.col("mixed"), "neighbour_sku_ambiguous_page")
    return rows.withColumn("scope", scope).withColumn("reason", reason).drop("has_model", "sibling", "mixed")


def document_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line, text, tech of the lines of pages in order, bullets off, blank lines and technical headings left out.

    tech: the line is one of the 45 after such a heading, over page breaks too."""
    rows = pages.select("doc_id", "page", "document_type", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("line", "raw"))
    rows = rows.withColumn("text", clean(F.regexp_replace(clean(F.col("raw")), r"^[•·▪■\-–*]\s*", ""))).filter("text <> ''").drop("raw")
    t = F.col("text")
    heading = (F.length(t) <= 70) & t.rlike(TECH_HEADING) & ~t.rlike(r"(?:\.{3,}|\s\d+)\s*$") & ~t.rlike(r"(?i)\d\s*(?:mm|kg|v|w|hz)\b")
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    rows = rows.withColumn("heading", heading).withColumn("n", F.row_number().over(order)).withColumn("last", F.last(F.when(F.col("heading"), F.col("n")), ignorenulls=True).over(order))
    return rows.filter("not heading").withColumn("tech", F.coalesce(F.col("n") - F.col("last") <= TECH_LINES, F.lit(False))).drop("heading", "last")


def document_facts(pages: DataFrame) -> DataFrame:
    """doc_id, page, scope, label, value, method of pages that may speak of the model; the first of equal pairs of a document.

    Documents of instructions are read in their technical sections only; one that never names the model gives nothing. Null texts are empty; no rows give no rows."""
    scoped = scope_pages(pages).filter("scope is not null and named")
    lines = document_lines(scoped).join(scoped.select("doc_id", "page", "scope"), ["doc_id", "page"])
    t = F.col("text")
    plain = ~t.rlike(INSTRUCTION)
    l1, l2 = F.regexp_extract(t, COLON, 1), F.regexp_extract(t, UNIT_LINE, 1)
    colon = t.rlike(COLON) & (n_words(l1) <= 6) & plain & ~l1.rlike(r"https?|www\.") & ~F.trim(l1).rlike(NOTE)
    unit = F.col("tech") & t.rlike(UNIT_LINE) & (n_words(l2) <= 7) & plain & ~l2.rlike(DANGLING)
    rows = lines.filter(F.col("tech") | ~F.coalesce("document_type", F.lit("")).isin(*PROSE_TYPES))
    found = F.when(colon, F.struct(F.trim(l1).alias("label"), F.regexp_extract(t, COLON, 2).alias("value"), F.lit("pdf_label_colon").alias("method"))).when(unit, F.struct(F.trim(l2).alias("label"), F.regexp_extract(t, UNIT_LINE, 2).alias("value"), F.lit("pdf_tech_section_line").alias("method")))
    rows = rows.select("doc_id", "page", "n", "scope", found.alias("f")).filter("f is not null").select("doc_id", "page", "n", "scope", "f.*").filter(is_pair(F.col("label"), F.col("value")))
    first = rows.groupBy("doc_id", F.lower("label").alias("_l"), F.lower("value").alias("_v")).agg(F.min_by(F.struct("page", "scope", "label", "value", "method"), "n").alias("r"))
    return first.select("doc_id", "r.*")


def excluded_pages(pages: DataFrame) -> DataFrame:
    """doc_id, reason, n of pages that were left out."""
    return scope_pages(pages).filter("reason is not null").groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


def spec_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block, page_number, heading, label, value of the blocks (between blank lines) of docs (doc_id, text) that prove a structure.

    Pairs are label: value lines, lines that end with a number and a unit, and labels before a line that begins with a number. A block counts
    if it has a heading of specifications and one pair, or two, and pairs are 35 % of its lines or more."""
    blocks = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n")).alias("block", "raw"))
    lines = F.filter(F.transform(F.split("raw", r"\n"), lambda x: clean(x)), lambda x: x != "")
    blocks = blocks.withColumn("all", lines).withColumn("page_number", F.when(F.get("all", 0).rlike(PAGE_NUMBER), F.get("all", 0)))
    body = F.filter(F.when(F.col("page_number").isNotNull(), F.slice("all", 2, 1 << 30)).otherwise(F.col("all")), lambda x: ~x.rlike(LANGUAGE))
    blocks = blocks.withColumn("all", body).filter("size(all) > 0")
    heading = F.get(F.filter("all", lambda x: (F.length(x) <= 60) & ~x.rlike(r"\d") & ~x.rlike(LEADER) & x.rlike(SPEC_HEADING)), 0)
    rows = blocks.select("doc_id", "block", "page_number", F.size("all").alias("n_lines"), heading.alias("heading"), F.posexplode("all").alias("line", "text"))
    order = Window.partitionBy("doc_id", "block").orderBy("line")
    t = F.col("text")
    opens = F.length(F.regexp_replace(t, r"[^(]", "")) > F.length(F.regexp_replace(t, r"[^)]", ""))
    rows = rows.withColumn("opens", opens).withColumn("goes_on", t.rlike(CONTINUED) & F.coalesce(F.lag("opens").over(order), F.lit(False)))
    rows = rows.withColumn("text", F.when(F.coalesce(F.lead("goes_on").over(order), F.lit(False)), F.concat_ws(" ", t, F.lead("text").over(order))).otherwise(t)).filter("not goes_on")
    after = F.lead("text").over(order)
    rows = rows.withColumn("after", after)
    pair, unit = r"^(.{1,120}?)\s*:\s*(.{1,300})$", rf"(?u)^([^:\d]{{1,60}}?)\s+([-+]?\d+(?:[.,]\d+)?\s*{UNIT})\.?$"
    bare = lambda c: F.trim(F.regexp_replace(c, r"^[•▪◦‣·*\-–—]\s+", ""))
    above = ~t.contains(":") & (F.length(t) <= 100) & ~t.rlike(r"\d") & (F.length("after") <= 100) & ~F.col("after").rlike(LEADER) & F.col("after").rlike(r"^[-+]?\d")
    row = lambda a, b: F.struct(bare(a).alias("label"), F.trim(b).alias("value"))
    found = F.when(t.rlike(LEADER), None).when(t.rlike(pair), row(F.regexp_extract(t, pair, 1), F.regexp_extract(t, pair, 2))).when(t.rlike(unit), row(F.regexp_extract(t, unit, 1), F.regexp_extract(t, unit, 2))).when(above, row(t, F.col("after")))
    rows = rows.withColumn("f", found).filter("f is not null").select("doc_id", "block", "page_number", "n_lines", "heading", "line", "f.*")
    rows = rows.filter(plausible_pair(F.col("label"), F.col("value")) & ~F.col("label").rlike(CONTACT))
    n = F.count("*").over(Window.partitionBy("doc_id", "block"))
    rows = rows.withColumn("n", n).filter((F.col("n") >= F.when(F.col("heading").isNotNull(), 1).otherwise(2)) & (F.col("n") >= 0.35 * F.col("n_lines")))
    return rows.select("doc_id", "block", "page_number", "heading", "label", "value")


def plausible_pair(label: Column, value: Column) -> Column:
    """A pair of running text that can be a fact: no sentence, no link, mostly letters in the label, no value that goes on."""
    letters, both = F.length(F.regexp_replace(label, r"[^\p{L}]", "")), F.length(F.regexp_replace(label, r"[^\p{L}\p{N}]", ""))
    return (
        (label != "") & (value != "") & (F.lower(label) != F.lower(value)) & (F.length(label) <= 100) & (F.length(value) <= 500) & (n_words(label) <= 14) & ~F.lower(label).rlike(r"https?://") & (letters > 0) & (letters >= 0.3 * both)
        & ~F.lower(value).rlike(r"(?:,|\b(?:and|or|the|to|with))$") & ~label.rlike(r"[.!?]$") & ~(value.rlike(":$") & (n_words(value) > 1)) & ~F.lower(label).rlike("forgot your password|order process|delivery in|write a review|installment")
    )


def line_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, line, label, value of the lines of docs (doc_id, text): label: value, label ... value, a label before a number on one line or the
    next; a rating before a date is a review's."""
    rows = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n"), lambda x: clean(x)), lambda x: x != "")).alias("line", "text"))
    order = Window.partitionBy("doc_id").orderBy("line")
    rows = rows.withColumn("after", F.lead("text").over(order)).withColumn("later", F.lead("text", 2).over(order))
    t, pair = F.col("text"), r"^(.{1,120}?)(?:\s*:\s*|\s+\.{2,}\s*)(.{1,500})$"
    number = r"(?u)^([^:]{1,100}?[A-Za-zА-Яа-я])\s+([-+]?\d+(?:[.,]\d+)?(?:\s*[x×]\s*\d+(?:[.,]\d+)?){0,3}(?:\s*[A-Za-z°%]+)?)$"
    review = F.col("after").rlike(r"^[1-5](?:[.,]0)?$") & F.coalesce(F.col("later").rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{2,4}$"), F.lit(False))
    above = (F.length(t) <= 100) & ~t.rlike(r"\d") & F.coalesce(F.col("after").rlike(r"^[-+]?\d") & (F.length("after") <= 100) & ~review, F.lit(False))
    row = lambda a, b: F.struct(F.trim(a).alias("label"), F.trim(b).alias("value"))
    found = (
        F.when(t.rlike(pair), row(F.regexp_extract(t, pair, 1), F.regexp_extract(t, pair, 2))).when(t.rlike(number) & ~F.regexp_extract(t, number, 1).rlike(r"\d"), row(F.regexp_extract(t, number, 1), F.regexp_extract(t, number, 2)))
        .when(~t.rlike(number) & above, row(F.regexp_replace(t, ":+$", ""), F.col("after")))
    )
    return rows.withColumn("f", found).filter("f is not null").select("doc_id", "line", "f.*").filter(plausible_pair(F.col("label"), F.col("value")))


IDENTITY_FIELD = r"(?iu)^(?:sku|mpn|gtin\d*|ean(?:\s*code)?|upc|article(?:\s*(?:no|number|code))?|model(?:\s*(?:no|number|code))?|brand|manufacturer|product\s*(?:id|code)|артикул|модель|бренд|производитель|код\s+товара)$"
COMMERCE_FIELD = r"(?iu)\b(?:price|currency|availability|item\s*condition|old\s*price|stock|rating|reviews?|views?|delivery|shipping)\b|цена|валюта|наличие|наличии|доставка|рейтинг|отзыв|просмотр|стоимость"
PRODUCT_FIELD = (
    r"(?iu)\b(?:power|weight|dimensions?|width|height|depth|length|size|capacity|volume|voltage|frequency|material|colou?r|type|control|timer|display|resolution|memory|camera|battery|charging|runtime|temperature|programs?|zones?"
    r"|wlan|wi-?fi|bluetooth|nfc|positioning|accessories|contents?)\b|мощность|вес|габариты|размеры|ширина|высота|глубина|длина|объ[её]м|напряжение|частота|материал|цвет|тип|управление|таймер|температура|программ|комплектация"
)
STRUCTURED = ("json_ld", "html_table", "label_value", "pdf_text", "pdf_spec")


def attribute_kind(label: Column, value: Column, method: Column) -> Column:
    """identity, commerce, product or unknown."""
    measured = value.rlike(rf"(?u)^\s*[-+]?\d+(?:[.,]\d+)?(?:\s*(?:[x×;]|[-–—])\s*[-+]?\d+(?:[.,]\d+)?)*\s*{UNIT}\s*$")
    return (
        F.when(label.rlike(IDENTITY_FIELD), "identity").when(label.rlike(COMMERCE_FIELD) | (label.rlike("^[A-Z]{3}$") & value.rlike(r"^\d+(?:[.,]\d+)?$")), "commerce")
        .when(label.rlike(PRODUCT_FIELD) | measured | method.isin(*STRUCTURED), "product").otherwise("unknown")
    )
