"""Text functions: native expressions where Spark has them, Arrow functions where Unicode normalization is needed."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What stands for a missing value, and scripts that a catalogue value never has.
PLACEHOLDERS = ("-", "–", "—", "n/a", "na", "not available", "not specified", "unknown", "нет данных", "не указано", "невідомо", "не вказано")
FOREIGN_SCRIPT = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}]"
MASK = "***REDACTED***"


def blank(c: Column) -> Column:
    """Null, empty or white space: all are the state `missing`."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def concrete(c: Column) -> Column:
    """A value that says something: not blank, no placeholder, no foreign script."""
    return ~blank(c) & ~F.lower(F.trim(c)).isin(*PLACEHOLDERS) & ~c.rlike(FOREIGN_SCRIPT)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def identifier_words(c: Column) -> Column:
    """camelCase and snake_case as words."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[_\\-. ]+", " "))


def tidy_punctuation(c: Column) -> Column:
    """No space before, one after a comma or semicolon, no doubled marks, single spaces."""
    for pattern, new in ((" +([,;:.!?])", "$1"), ("([,;:])\\1+", "$1"), ("([,;])([^ \\d])", "$1 $2"), (" {2,}", " ")):
        c = F.regexp_replace(c, pattern, new)
    return F.trim(c)


def redact(c: Column) -> Column:
    """Mask authorization headers, bearer tokens and values of keys that name secrets; the key stays readable."""
    c = F.regexp_replace(c, "(?i)(authorization[ ]*[:=][ ]*)[^ \\n,;]+( [^ \\n,;]+)?", f"$1{MASK}")
    c = F.regexp_replace(c, "(?i)(bearer +)[a-z0-9._~+/=-]+", f"$1{MASK}")
    return F.regexp_replace(c, "(?i)((?:api_?key|token|secret|password|passwd)[\"']?[ ]*[:=][ ]*)(?:\"[^\"\\n]*\"|'[^'\\n]*'|[^ \\n,;\"']+)", f"$1{MASK}")


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}_]+)"), 1)


def is_list(c: Column) -> Column:
    """Three or more segments of four words at most, on average."""
    parts = F.filter(F.split(c, "[,;/][ \\n\\t]*"), lambda x: F.trim(x) != "")
    n_words = F.aggregate(parts, F.lit(0), lambda a, x: a + F.size(F.filter(F.split(x, "[ \\n\\t]+"), lambda w: w != "")))
    return (F.size(parts) >= 3) & (n_words <= 4 * F.size(parts))


def is_prose(c: Column) -> Column:
    n = F.size(F.filter(F.split(c, "[ \\n\\t]+"), lambda w: w != ""))
    sentence = F.regexp_replace(c, "[. ]+$", "").rlike("[.!?] +\\p{Lu}")
    return ~(is_list(c) & (F.length(c) <= 400)) & ((F.length(c) > 160) | (n >= 12) | ((n >= 6) & sentence))


def utf16_units(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def plural_slavic(n: Column, one: str, few: str, many: str) -> Column:
    """The form that a count takes where it depends on the last digits."""
    ten, hundred = n % 10, n % 100
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


# ---------------------------------------------------------------- Unicode: expressions for ASCII, Arrow functions for the rest
_UNITS = (
    r"(?:°\s*[cf]|[кk]?[вw]т|[вv]|гц|hz|mah|ач|ah|мл|ml|л|l|кг|kg|гр?|g|мм|mm|см|cm|м|m|мин|сек|ч|шт|pcs?|дб|db|"
    r"(?:[швгдт]\s*[xх×]\s*){2}[швгдт]|(?:[hwdlt]\s*[xх×]\s*){2}[hwdlt])"
)  # fixed values: units that a label may end with
_UNIT_ENDS = (rf"\s*[(\[]\s*{_UNITS}\s*[)\]]\s*$", rf"\s*[,;:]\s*{_UNITS}\s*$", rf"\s+{_UNITS}\s*$")


def _fold(text: str) -> str:
    parts = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in parts if not unicodedata.combining(c))


_MISREAD = re.compile("[\u00c2-\u00f4][\x80-\xbf‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€]{1,3}")


def _mojibake(text: str) -> str:
    """UTF-8 that was read as a Western code page, read anew, run by run; what is no UTF-8 stays."""

    def repaired(m: re.Match) -> str:
        for page in ("cp1252", "latin-1"):
            try:
                return m[0].encode(page).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return m[0]

    return _MISREAD.sub(repaired, text)


# Characters that stand for a plain one, or for none.
_PLAIN = {
    " ": "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000",
    "": "\u200b\u200c\u200d\u2060\ufeff\u00ad",
    "'": "‘’‚′ʼ",
    '"': "“”„″",
    "-": "‐‑‒–—―−",
}
_TO_PLAIN = {ord(c): new for new, old in _PLAIN.items() for c in old}


def hygiene(text: str) -> str:
    """Escapes and entities undone (twice), misread UTF-8 repaired, full-width and composed forms plain, one kind of space, quote and dash."""
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    text = _mojibake(html.unescape(html.unescape(text)))
    text = "".join(unicodedata.normalize("NFKC", c) if "\uff01" <= c <= "\uff5e" else c for c in text)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).translate(_TO_PLAIN)).strip()


def _label_key(text: str) -> str:
    """Comparable label: folded case and compatibility forms, ё as е, unit suffixes off, word tokens only."""
    text = unicodedata.normalize("NFKC", text).casefold().replace("ё", "е")
    for _ in range(4):
        cut = text
        for end in _UNIT_ENDS:
            cut = re.sub(end, "", cut)
        if cut == text:
            break
        text = cut
    return " ".join(re.findall(r"\w+", text))


def _compact(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def fold_words(text: str) -> str:
    """Case, accents and punctuation folded: words with single spaces."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", _fold(text).replace("'", ""))).strip()


def _lifted(f, plain, beyond):  # noqa: ANN001, ANN202
    """f where a text matches `beyond`, the expression plain elsewhere: those texts reach Python as nulls."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(x) if isinstance(x, str) else None for x in s], index=s.index, dtype=object)

    return lambda c: F.when(c.rlike(beyond), run(F.when(c.rlike(beyond), c))).otherwise(plain(c))


def _key_ascii(c: Column) -> Column:
    """Up to four unit ends off, as few labels have more than one."""
    c = F.lower(c)
    for _ in range(4):
        for end in _UNIT_ENDS:
            c = F.regexp_replace(c, end, "")
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(\w+)"), 1), " ")


_NOT_ASCII = r"[^\x00-\x7F]"
fold = _lifted(_fold, F.lower, _NOT_ASCII)
clean_text = _lifted(hygiene, lambda c: F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f]+", " ")), r"[^\x00-\x7F]|&|\\u")
label_key = _lifted(_label_key, _key_ascii, _NOT_ASCII)
identity_key = _lifted(_compact, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), _NOT_ASCII)
fold_label = _lifted(fold_words, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "'", ""), r"[^a-z0-9]+", " ")), _NOT_ASCII)


def fold_key(c: Column) -> Column:
    """label_key by expressions alone, for text without compatibility forms; use label_key where they may occur."""
    c = F.regexp_replace(F.lower(c), "ё", "е")
    for _ in range(4):
        for end in _UNIT_ENDS:
            c = F.regexp_replace(c, end, "")
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), 1), " ")
