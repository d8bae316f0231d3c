"""Which product a name, an identifier, a title, a URL or a document speaks of, as native expressions."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import url as U

# Words that make another product of a model, names of colours, sizes of memory, page words, endings that are no variant.
MODIFIERS = ("ABSOLUTE", "BUSINESS", "EXTRA", "FE", "FOLD", "LITE", "MAC", "MAX", "MINI", "PLUS", "PRO", "SE", "ULTRA", "XL")
EXTENSIONS = ("air", "lite", "max", "mini", "plus", "pro", "ultra")
COLORS = ("beige", "black", "blue", "bronze", "brown", "cream", "cyan", "gold", "gray", "green", "grey", "orange", "pink", "purple", "red", "rose", "silver", "violet", "white", "yellow")
RAM, STORAGE = (2, 3, 4, 6, 8, 12, 16, 18, 24, 32), (32, 64, 128, 256, 512, 1024, 2048)
ROLE_WORDS = ("SPECS", "SPEC", "SPECIFICATIONS", "SPECIFICATION", "TECH", "TECHNICAL", "OVERVIEW", "FEATURES", "DETAILS")
FILE_ENDINGS = ("ASP", "ASPX", "HTM", "HTML", "PDF", "PHP")
OPERATOR_SHY = ("duckduckgo_html", "duckduckgo_lite")
DOCUMENT_TYPES = (
    ("quick_start_guide", r"quick[\s_-]*start|quick[\s_-]*(?:reference[\s_-]*)?guide|getting[\s_-]*started|start[\s_-]*guide|краткое\s+руководство|быстрый\s+старт|kurzanleitung|schnellstart|guide\s+de\s+d[eé]marrage|guida\s+rapida|gu[ií]a\s+r[aá]pida|(?:^|[_\s-])qsg(?:$|[_\s.-])"),
    ("declaration", r"declaration|conformity|конформ|декларац|konformit|(?:^|[/_\s-])doc[-_]|(?:^|[_\s-])doc(?:$|\.)"),
    ("certificate", r"certificat|сертификат|zertifikat|(?:^|[_\s-])cert(?:$|[_\s.-])"),
    ("safety_document", r"safety|безопасност|sicherheit|s[eé]curit[eé]|(?:^|[_\s-])m?sds(?:$|[_\s.-])"),
    ("datasheet", r"data[\s_-]*sheet|datenblatt|fiche\s+technique|scheda\s+tecnica|ficha\s+t[eé]cnica|техническ\w*\s+(?:данн|паспорт|описан)|технический\s+паспорт"),
    ("spec_sheet", r"spec(?:ification)?s?[\s_-]*sheet|spec(?:ification)?s?[\s_-]*(?:pdf|document)|техническ\w*\s+характеристик"),
    ("user_guide", r"user[\s_-]*guide|owner'?s?[\s_-]*guide|руководство\s+пользователя|benutzerhandbuch|guide\s+(?:de\s+l.)?utilisateur|gu[ií]a\s+del\s+usuario"),
    ("manual", r"manual|bedienungsanleitung|gebrauchsanweisung|manuel|manuale|руководство|паспорт|handbuch"),
    ("instruction", r"instruction|инструкц|anleitung|mode\s+d.emploi|istruzioni|instrucciones|leaflet"),
)
DOCUMENT_FIELDS = {
    "manual": "manual_url", "user_guide": "manual_url", "instruction": "manual_url", "quick_start_guide": "quick_start_guide_url", "datasheet": "datasheet_url", "spec_sheet": "datasheet_url",
    "safety_document": "safety_document_url", "declaration": "declaration_url", "certificate": "certificate_url",
}
INDEX_HINT = r"(?i)manuals?\s*(?:and|&|/)\s*faq|manuals?-and-faqs|user-manuals\b|/manuals/?$|downloads?/?$"
TOKEN = r"([A-Za-z0-9]+(?:[-_/.][A-Za-z0-9]+)*)"

compact = U.compact


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def parts(c: Column) -> Column:
    """Upper-case runs of letters and digits."""
    return F.regexp_extract_all(F.upper(_text(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _mixed(p: Column) -> Column:
    return p.rlike("[A-Z]") & p.rlike("[0-9]")


def _has(tokens: Column, run: Column) -> Column:
    """Whether a run of tokens stands within tokens."""
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - F.size(run), F.lit(0)))
    return (F.size(run) > 0) & F.exists(at, lambda i: F.slice(tokens, i + 1, F.greatest(F.size(run), F.lit(1))) == run)


def compound_match(model: Column, text: Column) -> Column:
    """exact or likely for a model of several words by its words; null for others."""
    wanted, there = parts(model), parts(text)
    strong = F.exists(wanted, lambda p: (F.length(p) >= 5) & _mixed(p) & F.array_contains(there, p))
    met = F.filter(wanted, lambda p: F.array_contains(there, p))
    every = F.forall(wanted, lambda p: F.array_contains(there, p))
    return F.when((F.size(wanted) >= 2) & (F.size(there) > 0), F.when(every | strong, "exact").when((F.size(met) >= 2) & F.exists(met, lambda p: p.rlike("[0-9]")), "likely"))


def _near(a: Column, b: Column) -> Column:
    """Identifiers of nearly one length that agree but for the last two characters or so."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: (i <= F.length(b)) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))
    return (F.length(b) >= 4) & (F.abs(F.length(a) - F.length(b)) <= 2) & (a != b) & (same >= F.greatest(F.lit(3), F.least(F.length(a), F.length(b)) - 2))


def match_model(model: Column, text: Column) -> Column:
    """likely_variant (another suffix follows), exact, likely, mismatch (nearly the same identifier) or unknown."""
    wanted = compact(_text(model))
    tokens = F.regexp_extract_all(_text(text), F.lit(r"(?<!\w)(\w+(?:[./_-]\w+)*)(?!\w)"), 1)

    def varied(t: Column) -> Column:
        p = F.transform(F.filter(F.split(t, "[/_-]+"), lambda x: x != ""), lambda x: compact(x))
        after = lambda i: F.get(p, i + 1)
        return F.exists(F.sequence(F.lit(0), F.size(p)), lambda i: (F.get(p, i) == wanted) & F.coalesce(after(i).rlike("^[A-Z0-9]{1,4}$") & ~after(i).isin(*FILE_ENDINGS), F.lit(False)))

    def is_it(t: Column) -> Column:
        c = compact(t)
        return (c == wanted) | F.array_contains(F.split(F.upper(t), "[/_-]+"), wanted) | (c.startswith(wanted) & F.substring(c, F.length(wanted) + 1, F.length(c)).isin(*FILE_ENDINGS))

    return (
        F.when((wanted == "") | (_text(text) == ""), "unknown").when(F.exists(tokens, varied), "likely_variant").when(F.exists(tokens, is_it), "exact")
        .when(compound_match(model, text).isNotNull(), compound_match(model, text)).when(F.exists(tokens, lambda t: _near(wanted, compact(t))), "mismatch").otherwise("unknown")
    )


def candidate_match(model: Column, title: Column, url: Column) -> Column:
    """match_model of a search result, by title and URL together: a URL that names another variant overrides a title that echoes the query.

    different_variant also where the model is extended by a word of MODIFIERS, where a requested one is missing, or where its number differs."""
    wanted, path = parts(model), F.coalesce(F.try_url_decode(U.path(_text(url))), U.path(_text(url)))
    in_path, in_title, whole = parts(path), parts(title), compact(_text(model))
    leaf = parts(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))
    bare = F.filter(leaf, lambda p: ~p.isin(*ROLE_WORDS) | F.array_contains(wanted, p))
    names_it = (F.size(wanted) > 0) & (bare == wanted)
    rest = lambda p: F.substring(p, F.length(whole) + 1, F.length(p))
    longer = F.exists(in_path, lambda p: p.startswith(whole) & (p != whole) & (rest(p).isin(*MODIFIERS) | (whole.rlike("[0-9]$") & (F.length(p) <= F.length(whole) + 2))))
    index = F.sequence(F.lit(1), F.greatest(F.size(wanted) - 1, F.lit(1)))
    other_number = F.exists(index, lambda i: F.coalesce(F.get(wanted, i).rlike("^[0-9]+$") & (F.length(F.get(wanted, i - 1)) >= 4) & F.exists(
        F.sequence(F.lit(0), F.size(in_path)), lambda k: (F.get(in_path, k) == F.get(wanted, i - 1)) & F.coalesce(F.get(in_path, k + 1).rlike("^[0-9]+$") & (F.get(in_path, k + 1) != F.get(wanted, i)), F.lit(False))), F.lit(False)))

    def follows(tokens: Column, extended: bool) -> Column:
        n = F.size(wanted)
        def here(i: Column) -> Column:
            after = _text(F.get(tokens, i + n))
            modified = after.isin(*MODIFIERS) & ~F.array_contains(wanted, after)
            return (F.slice(tokens, i + 1, F.greatest(n, F.lit(1))) == wanted) & (modified if extended else ~modified)
        return (n > 0) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), here)

    extended = (follows(in_title, True) & ~(follows(in_title, False) & names_it)) | follows(in_path, True)
    by_title = match_model(model, title)
    lacks = lambda tokens: F.exists(index, lambda i: F.coalesce(F.get(wanted, i).isin(*MODIFIERS) & _has(tokens, F.slice(wanted, F.lit(1), F.greatest(i, F.lit(1)))) & ~F.array_contains(tokens, F.get(wanted, i)), F.lit(False)))
    codes = F.filter(wanted, lambda p: (F.length(p) >= 5) & _mixed(p))
    other_code = F.exists(codes, lambda c: F.exists(in_path, lambda p: _near(c, p)) & ~F.array_contains(in_path, c))
    every = F.forall(wanted, lambda p: F.array_contains(in_path, p))
    elsewhere = F.exists(in_title, lambda t: (t != whole) & ~F.array_contains(wanted, t) & (F.length(t) >= 5) & t.rlike("[A-Z]") & t.rlike("[0-9].*[0-9]"))
    return (
        F.when((whole != "") & ~names_it & longer, "different_variant").when(other_number, "different_variant").when(extended, "different_variant").when(other_code, "mismatch")
        .when((by_title != "exact") & (lacks(in_title) | lacks(in_path)), "different_variant").when((by_title == "likely") & (F.size(wanted) >= 2) & every, "exact")
        .when(by_title != "unknown", by_title).when(elsewhere, "unknown").otherwise(match_model(model, path))
    )


def article_matches(article: Column, text: Column) -> Column:
    tokens = F.regexp_extract_all(_text(text), F.lit(r"(?<!\w)(\w+(?:[./_-]\w+)*)(?!\w)"), 1)
    return (compact(_text(article)) != "") & F.exists(tokens, lambda t: compact(t) == compact(_text(article)))


def base_model_in_text(base: Column, text: Column) -> Column:
    """The whole phrase, its words apart or together, and no word after it that makes another product."""
    words = F.regexp_extract_all(_text(base), F.lit(r"(\w+)"), 1)
    ends = rf"(?!\w)(?![\s_-]+(?:{'|'.join(EXTENSIONS)})(?![A-Za-z]))"
    return (F.size(words) > 0) & F.regexp_like(_text(text), F.concat(F.lit(r"(?i)(?<!\w)"), F.array_join(words, r"[\s_-]*"), F.lit(ends)))


def with_identity(rows: DataFrame, name: Column, brand: Column, out: str) -> DataFrame:
    """rows with the column out: struct(brand, base_model, variant_suffix, color, ram, storage, code, confidence) of a product's name.

    Without a brand the first word is it, if it has a letter and is not alone; else the struct is null. A trailing code is kept apart, without
    a meaning. Step by step, as each takes apart what the one before left."""
    columns, v = rows.columns, lambda k: F.col(f"_{k}")
    rows = rows.withColumn("_raw", F.trim(F.regexp_replace(_text(name), r"\s+", " "))).withColumn("_own", F.trim(_text(brand))).withColumn("_first", F.substring_index("_raw", " ", 1))
    rows = rows.withColumn("_brand", F.when(v("own") != "", v("own")).when(v("raw").contains(" ") & v("first").rlike("[A-Za-z]"), v("first")))
    without = F.regexp_replace(v("raw"), F.concat(F.lit(r"(?i)^(.*?)(?<!\w)\Q"), v("own"), F.lit(r"\E(?!\w)")), F.lit("$1 "))
    rows = rows.withColumn("_text", F.when(v("own") != "", without).otherwise(F.substring(v("raw"), F.length(v("first")) + 2, F.length(v("raw")))))
    apart, joined = r"(?i)(?<!\w)(\d{1,2})\s*GB\s*[+/ ]\s*(\d{2,4})\s*GB(?!\w)", r"(?i)(?<!\w)(\d{1,2})\s*(?:GB\s*)?[+/]\s*(\d{2,4})\s*(?:GB)?(?!\w)"

    def fit(p: str) -> Column:
        ram, storage = (F.regexp_extract(v("text"), p, i).try_cast("int") for i in (1, 2))
        return F.coalesce(ram.isin(*RAM) & storage.isin(*STORAGE) & (storage > ram), F.lit(False))

    rows = rows.withColumn("_size", F.when(fit(apart), apart).when(fit(joined), joined))
    gb = lambda i: F.coalesce(*[F.when(v("size") == p, F.concat(F.regexp_extract(v("text"), p, i).cast("int"), F.lit(" GB"))) for p in (apart, joined)])
    rest = F.coalesce(*[F.when(v("size") == p, F.regexp_replace(v("text"), "(?s)^(.*?)" + p, "$1 ")) for p in (apart, joined)], v("text"))
    rows = rows.withColumn("_ram", gb(1)).withColumn("_storage", gb(2)).withColumn("_rest", rest)
    hue = rf"(?i)^(.*)(?<!\w)({'|'.join(COLORS)})(?!\w)"
    rows = rows.withColumn("_color", F.nullif(F.regexp_extract(v("rest"), hue, 2), F.lit(""))).withColumn("_left", F.trim(F.regexp_replace(F.regexp_replace(v("rest"), hue, "$1 "), r"\s+", " ")))
    rows = rows.withColumn("_last", F.regexp_extract(v("left"), r"\s(\S+)$", 1)).withColumn("_plain", F.regexp_replace(v("last"), "[^A-Za-z0-9]", ""))
    rows = rows.withColumn("_code", F.when((F.length(v("plain")) >= 7) & v("plain").rlike("[A-Za-z].*[A-Za-z]") & v("plain").rlike("[0-9].*[0-9]") & (F.upper(v("plain")) == v("plain")), v("last")))
    rows = rows.withColumn("_model", F.nullif(F.regexp_replace(F.when(v("code").isNotNull(), F.regexp_replace(v("left"), r"\s\S+$", "")).otherwise(v("left")), "^[ ,-]+|[ ,-]+$", ""), F.lit("")))
    slash, hyphen = r"^(.+?)/([A-Za-z0-9]{1,4})$", r"^(.+?)-([A-Za-z0-9]{1,3})$"
    by_slash = v("model").rlike(slash) & F.regexp_extract(v("model"), slash, 1).rlike("[0-9]")
    by_hyphen = v("model").rlike(hyphen) & F.regexp_extract(v("model"), hyphen, 1).rlike("[0-9]") & (F.length(compact(F.regexp_extract(v("model"), hyphen, 1))) >= 6)
    cut = lambda i: F.when(by_slash, F.regexp_extract(v("model"), slash, i)).when(by_hyphen, F.regexp_extract(v("model"), hyphen, i))
    rows = rows.withColumn("_base_model", F.coalesce(cut(1), v("model"))).withColumn("_variant_suffix", cut(2))
    rows = rows.withColumn("_confidence", F.when(v("base_model").isNull(), "low").when(v("code").isNull(), "high").otherwise("medium"))
    fields = F.struct(*[v(k).alias(k) for k in ("brand", "base_model", "variant_suffix", "color", "ram", "storage", "code", "confidence")])
    return rows.withColumn(out, F.when(v("brand").isNotNull(), fields)).select(*columns, out)


def compare_identities(a: Column, b: Column, fields: tuple[str, ...] = ("variant_suffix", "color", "ram", "storage")) -> Column:
    """different_model, unknown (a base model is missing), exact_variant (fields agree and none differ) or same_base_model of two identities."""
    key = lambda c: F.lower(F.regexp_replace(_text(c), r"[^\p{L}\p{N}]", ""))
    both = lambda f: (key(a[f]) != "") & (key(b[f]) != "")
    agree = [both(f) & (key(a[f]) == key(b[f])) for f in fields]
    differ = [both(f) & (key(a[f]) != key(b[f])) for f in fields]
    some = lambda cs: F.greatest(*[c.cast("int") for c in cs], F.lit(0)) == 1
    return (
        F.when((key(a["brand"]) == "") | (key(a["brand"]) != key(b["brand"])), "different_model").when((key(a["base_model"]) == "") | (key(b["base_model"]) == ""), "unknown")
        .when(key(a["base_model"]) != key(b["base_model"]), "different_model").when(some(agree) & ~some(differ), "exact_variant").otherwise("same_base_model")
    )


# ---------------------------------------------------------------- stock numbers
def sku_of(model: Column) -> Column:
    """struct(base, suffix) of the identifier in a model's name: what follows its last mark is a suffix if it looks like a market or variant code."""
    raw = U.sku_token(model)
    tail = F.regexp_extract(raw, "[/_-]([A-Za-z0-9]+)$", 1)
    head = F.regexp_replace(raw, "[/_-][A-Za-z0-9]+$", "")
    fit = (tail != "") & _mixed(compact(head)) & (F.length(compact(head)) >= 5) & (raw.rlike("[/_]") | ((U.suffix_kind(tail) == "regional") & (~tail.rlike("^[0-9]+$") | (F.length(tail) <= 2))))
    return F.when(raw.isNotNull(), F.when(fit, F.struct(compact(head).alias("base"), compact(tail).alias("suffix"))).otherwise(F.struct(compact(raw).alias("base"), F.lit("").alias("suffix"))))


SKU_KINDS = ("exact", "regional_suffix", "base_only", "different_suffix", "different_variant", "absent")


def sku_kind(model: Column, text: Column) -> Column:
    """The nearest relation (of SKU_KINDS) of any identifier in a text to that of the model."""
    sku = sku_of(model)
    base, suffix = sku["base"], sku["suffix"]
    slug = lambda t: t.rlike("^[A-Z]{4,}$") | t.rlike("^[0-9]{3,}$")

    def tail(t: Column) -> Column:
        with_suffix = F.when(t.isNull(), 2).when(t == suffix, 0).when(slug(t), 2).otherwise(3)
        without = F.when(t.isNull(), 0).when(U.suffix_kind(t) == "regional", 1).when(slug(t), 0).otherwise(4)
        return F.when(suffix != "", with_suffix).otherwise(without)

    def of_token(token: Column) -> Column:
        p = F.transform(F.filter(F.split(token, "[-_/.]"), lambda x: x != ""), lambda x: compact(x))
        n = F.size(p)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        hits = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i + 1, F.greatest(n, i + 1)), lambda k: F.when(F.array_join(F.slice(p, i + 1, k - i), "") == base, tail(F.get(p, k))).otherwise(5))))
        longer = F.exists(p, lambda x: x.startswith(base) & (x != base))
        return F.least(F.coalesce(F.array_min(hits), F.lit(5)), F.when(longer, 4).otherwise(5))

    rank = F.coalesce(F.array_min(F.transform(F.regexp_extract_all(_text(text), F.lit(TOKEN), 1), of_token)), F.lit(5))
    return F.when(sku.isNull(), "absent").otherwise(F.get(U.strings(SKU_KINDS), rank))


def sku_loosely_in(model: Column, text: Column) -> Column:
    sku, there = sku_of(model), compact(_text(text))
    return F.coalesce(there.contains(F.concat(sku["base"], sku["suffix"])), F.lit(False))


def sibling_identifier(model: Column, text: Column) -> Column:
    """The first identifier of a text that is like the model's but another one; empty if there is none. Likeness is that of difflib."""

    @F.pandas_udf("string")
    def run(models: pd.Series, texts: pd.Series) -> pd.Series:
        import re
        from difflib import SequenceMatcher

        out = []
        for m, t in zip(models, texts, strict=True):
            wanted, found = re.sub("[^A-Za-z0-9]", "", m or "").upper(), ""
            stem = re.sub(r"(?<=\d)[A-Z]$", "", wanted)
            for token in re.findall(TOKEN, t or "") if len(wanted) >= 4 else ():
                c = re.sub("[^A-Za-z0-9]", "", token).upper()
                if c == wanted or (c == stem and len(stem) >= 5) or len(c) < 5 or abs(len(c) - len(wanted)) > 2 or not (re.search("[A-Z]", c) and re.search("[0-9]", c)):
                    continue
                like = SequenceMatcher(None, c, wanted).ratio()
                if c.startswith(wanted) or wanted.startswith(c) or like >= (0.6 if c[:2] == wanted[:2] else 0.75):
                    found = token
                    break
            out.append(found)
        return pd.Series(out, index=models.index, dtype=object)

    return run(_text(model), _text(text))


# ---------------------------------------------------------------- documents
def document_url(url: Column) -> Column:
    """canonical_url without port and without parameters that only bust caches."""
    return U.canonical(url, ("v", "version", "ver", "cache", "cb", "t", "ts", "_"), ("utm_", "_pos", "_sid", "_ss"), port=False)


def document_kind(url: Column, text: Column) -> Column:
    """Type of a document by the label of its link, its file name, then its path; null if nothing tells."""
    path = F.coalesce(F.try_url_decode(U.path(_text(url))), U.path(_text(url)))
    file, name = F.lower(path).rlike(r"\.(?:pdf|doc|docx)$"), F.element_at(F.split(path, "/"), -1)
    label = F.when(F.length(_text(text)) <= F.when(file, 100).otherwise(60), _text(text)).otherwise("")

    def of(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, pattern in reversed(DOCUMENT_TYPES):
            out = F.when(c.rlike("(?i)" + pattern), kind).otherwise(out)
        return F.when(F.trim(c) != "", out)

    return F.coalesce(of(label), of(name), F.when(file, of(path)))


def document_field(kind: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in DOCUMENT_FIELDS.items()))[kind]


def document_index(url: Column, text: Column) -> Column:
    """A hub of many documents."""
    return F.concat(U.path(_text(url)), F.lit(" "), _text(text)).rlike(INDEX_HINT)


def _name_words(model: Column, brand: Column) -> Column:
    sku = sku_of(model)
    skip = F.array(compact(_text(brand)), _text(sku["base"]), F.concat(_text(sku["base"]), _text(sku["suffix"])), _text(sku["suffix"]))
    return F.filter(parts(model), lambda w: (F.length(w) >= 2) & ~F.array_contains(skip, w))


def document_match(model: Column, brand: Column, url: Column, text: Column, from_exact_page: Column) -> Column:
    """struct(match, reason): whether a linked document is of the model, by link text and file name: exact, probable or null."""
    path = F.coalesce(F.try_url_decode(U.path(_text(url))), U.path(_text(url)))
    said = F.concat_ws(" ", _text(text), F.element_at(F.split(path, "/"), -1))
    kind, own, words = sku_kind(model, said), parts(model), _name_words(model, brand)
    prefix = F.regexp_extract(_text(sku_of(model)["base"]), "^([A-Z]+)", 1)
    other = F.exists(F.regexp_extract_all(F.upper(said), F.lit("([A-Z0-9]+)"), 1), lambda t: ((F.length(prefix) < 2) | t.startswith(prefix)) & (F.length(t) >= 5) & t.rlike("[A-Z]") & t.rlike("[0-9].*[0-9]") & ~F.array_contains(own, t) & ~t.rlike("^(?:[0-9]{6,}[A-Z]?|V[0-9]+|[0-9A-F]{6,})$"))
    there = parts(F.concat_ws(" ", _text(text), path))
    named = (F.size(words) >= 2) & F.forall(words, lambda w: F.array_contains(there, w))
    row = lambda m, why: F.struct(F.lit(m).cast("string").alias("match"), F.lit(why).alias("reason"))
    return (
        F.when(kind.isin("exact"), row("exact", "identifier")).when(kind == "regional_suffix", row("exact", "regional suffix")).when(kind.isin("different_suffix", "different_variant"), row(None, "another variant"))
        .when(other, row(None, "another identifier")).when(from_exact_page, row("exact", "linked from the exact page")).when(named, row("probable", "name words")).otherwise(row(None, "not identified"))
    )


def document_verdict(model: Column, brand: Column, status: Column, text: Column) -> Column:
    """struct(match, evidence) of a document by its own text: exact, probable or unverified."""
    kind, suffix, words = sku_kind(model, text), _text(sku_of(model)["suffix"]), _name_words(model, brand)
    whole = compact(_text(model))
    stem = F.regexp_replace(whole, "(?<=[0-9])[A-Z]$", "")
    stemmed = (stem != whole) & (F.length(stem) >= 5) & F.exists(F.regexp_extract_all(_text(text), F.lit(TOKEN), 1), lambda t: compact(t) == stem)
    named = (F.size(words) >= 2) & F.forall(words, lambda w: F.array_contains(parts(text), w))
    row = lambda m, why: F.struct(F.lit(m).alias("match"), (F.lit(why) if isinstance(why, str) else why).alias("evidence"))
    return (
        F.when(_text(status) != "ok", row("unverified", _text(status))).when(kind.isin("exact", "regional_suffix"), row("exact", "document_text"))
        .when((kind == "base_only") & (suffix != "") & (U.suffix_kind(suffix) == "regional"), row("exact", "document_text")).when(kind == "base_only", row("probable", "family_base"))
        .when(stemmed, row("probable", "family_stem")).when(named, row("probable", "family_words")).when(kind.isin("different_suffix", "different_variant"), row("unverified", "different_identifier")).otherwise(row("unverified", "not_in_text"))
    )


# ---------------------------------------------------------------- queries and requests
def locale_region(url: Column) -> Column:
    """Locale in the path, else the country of the host, else its region, else global."""
    pair = r"(?i)/([a-z]{2})[-_]([a-z]{2})(?:/|$)"
    path, host = U.path(_text(url)), F.lower(F.regexp_extract(U.authority(_text(url)), "^([^:]*)", 1))
    labels, lang = F.split(host, "\\."), F.lower(F.regexp_extract(path, r"(?i)^/([a-z]{2})(?:/|$)", 1))
    top, second = F.element_at(labels, -1), F.get(labels, F.size(labels) - 2)
    return (
        F.when(path.rlike(pair), F.concat(F.lower(F.regexp_extract(path, pair, 1)), F.lit("-"), F.upper(F.regexp_extract(path, pair, 2)))).when(F.size(labels) < 2, "unknown")
        .when(F.length(top) == 2, F.concat(F.lit("."), top, F.when(lang != "", F.concat(F.lit(" ("), lang, F.lit(")"))).otherwise("")))
        .when((F.size(labels) >= 3) & second.isin("global", "eu", "cee", "asia"), second).otherwise(F.concat(F.lit("global (."), top, F.lit(")")))
    )


def cache_key(**fields: Column) -> Column:
    """SHA-256 of the request's fields in the order of their names, texts in lower case with single spaces."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(_text(c), r"\s+", " ")))
    return F.sha2(F.to_json(F.struct(*[clean(c).alias(n) for n, c in sorted(fields.items())])), 256)


def brand_roots(brand: Column, market_tld: Column, tlds: tuple[str, ...], limit: int = 12) -> Column:
    """Domains that a brand's name makes: the market's, .com, then others; none for a name of fewer than three characters."""
    slug = F.regexp_replace(F.lower(_text(brand)), "[^a-z0-9]", "")
    ends = F.concat(F.when(_text(market_tld) != "", F.array(market_tld)).otherwise(F.array().cast("array<string>")), U.strings(("com", *tlds)))
    return F.when(F.length(slug) < 3, F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.transform(ends, lambda t: F.concat(slug, F.lit("."), t))), 1, limit))


def strip_operators(query: Column) -> Column:
    """site:domain as the domain, -site:domain as nothing."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(query), r"(?i)-site:\S+", " "), r"(?i)site:(\S+)", "$1"), r"\s+", " "))


def provider_query(provider: Column, query: Column, brand: Column, model: Column) -> Column:
    """The query in a provider's dialect: no operators for those shy of them, no quotes for one, the model quoted for two."""
    plain = F.trim(F.regexp_replace(_text(query), r"\s+", " "))
    plain = F.when(provider.isin(*OPERATOR_SHY), strip_operators(plain)).otherwise(plain)
    quoted = F.concat(F.lit('"'), model, F.lit('"'))
    within = F.exists(F.regexp_extract_all(plain, F.lit('"([^"]+)"'), 1), lambda q: compact(q).contains(compact(_text(model))))
    first = F.concat(F.lit(r"(?i)^(.*?)\Q"), model, F.lit(r"\E"))
    here = F.lower(plain).contains(F.lower(_text(model)))
    put = F.regexp_replace(plain, first, F.concat(F.lit('$1"'), F.regexp_replace(model, r"([\\$])", r"\\$1"), F.lit('"')))
    return (
        F.when(provider == "naver", F.replace(plain, F.lit('"'), F.lit(""))).when(~provider.isin("bing", "google") | (_text(model) == "") | within, plain).when(here, put)
        .when(F.lower(plain).contains("official website") & (_text(brand) != ""), F.concat_ws(" ", plain, quoted)).otherwise(plain)
    )


def product_query(text: Column) -> Column:
    """struct(brand, model) of 'brand model' or 'brand | model'; null if either is missing. The X and A & B brands have two and three words."""
    t = F.trim(F.regexp_replace(_text(text), r"\s+", " "))
    words, piped = F.split(t, " "), F.transform(F.split(t, r"\|"), lambda x: F.trim(x))
    width = F.when((F.lower(F.get(words, 0)) == "the") & (F.size(words) >= 3), 2).when((F.size(words) >= 4) & (F.get(words, 1) == "&"), 3).otherwise(1)
    row = lambda b, m: F.struct(b.alias("brand"), m.alias("model"))
    return F.when(t.contains("|"), F.when((F.get(piped, 0) != "") & (F.get(piped, 1) != ""), row(F.get(piped, 0), F.get(piped, 1)))).when(F.size(words) >= 2, row(F.array_join(F.slice(words, F.lit(1), width), " "), F.array_join(F.slice(words, width + 1, F.size(words)), " ")))


# ---------------------------------------------------------------- display
def display_match(relation: Column, rejected: Column) -> Column:
    return F.when(rejected, "rejected").when(relation == "exact", "exact").when(relation == "likely_variant", "probable").otherwise("weak")


def display_authority(source_type: Column, authority: Column) -> Column:
    """struct(label, group)."""
    row = lambda a, g: F.struct(F.lit(a).alias("label"), F.lit(g).alias("group"))
    ok = F.coalesce(authority == "verified", F.lit(False))
    return F.when(ok & (source_type == "official_document"), row("official support", "official")).when(ok & (source_type == "manufacturer"), row("manufacturer", "official")).when(ok & (source_type == "retailer"), row("authorized dealer", "dealer")).otherwise(row("secondary", "secondary"))


def is_official(source_type: Column, authority: Column) -> Column:
    return F.coalesce((authority == "verified") & source_type.isin("manufacturer", "official_document"), F.lit(False))


def page_role(url: Column, title: Column) -> Column:
    index = document_index(url, title)
    return (
        F.when(F.lower(U.path(_text(url))).rlike(r"\.(?:pdf|doc|docx)$") | (document_kind(url, title).isNotNull() & ~index), "document")
        .when((U.page_kind(_text(url)) == "support") | index, "support").otherwise("product")
    )


def redirected_away(model: Column, wanted_url: Column, final_url: Column) -> Column:
    """A page whose URL named the model led to one that does not."""
    names = lambda u: match_model(model, U.path(_text(u))).isin("exact", "likely_variant", "likely")
    return (_text(final_url) != "") & names(wanted_url) & ~names(final_url)
