"""The queries of the ten operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .binary import record_digests
from .decontaminate import NAME, NUMBER, POINT, UNIT, UNITS, leaks
from .jaccard import near_duplicates
from .packing import pack
from .quality import BOILERPLATE, NAVIGATION, quality_figures
from .secrets import secret_spans
from .sharding import shards
from .spans import without_repeats
from .tokens import token_counts
from .warc import warc_round_trip

#: Bytes of text in a shard of op7.
SHARD_BYTES = 4 << 20
TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": lambda s, d: quality_figures(_table(s, d, "documents")),
        "op2_warc": lambda s, d: warc_round_trip(_table(s, d, "pages")),
        "op3_ngram_jaccard": lambda s, d: near_duplicates(_table(s, d, "documents")),
        "op4_token_records": lambda s, d: record_digests(_table(s, d, "documents"), _tokenizer("byte_bpe_50k.json")),
        "op5_best_fit_packing": lambda s, d: pack(_table(s, d, "documents"), _tokenizer("word_bpe_49k.json")),
        "op6_secret_scans": lambda s, d: secret_spans(_table(s, d, "documents")),
        "op7_sharding": lambda s, d: shards(_table(s, d, "documents"), SHARD_BYTES),
        "op8_decontamination": lambda s, d: leaks(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op9_substring_dedup": lambda s, d: without_repeats(_table(s, d, "documents")),
        "op10_token_counts": lambda s, d: token_counts(_table(s, d, "documents"), _tokenizer("byte_bpe_50k.json"), _pattern(), TOKEN_LIMIT),
    }


_WORD = r"[^\x20\x09-\x0D]+"


def _quote(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT rid, line, len(regexp_extract_all(line, '{_WORD}')) AS nw, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS sym, len(regexp_extract_all(line, '!!')) AS bang, len(regexp_extract_all(line, '[|»›•]')) AS sep,
    regexp_matches(line, '[.!?;:…。！？]') AS mark, trim(lower(line), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS low FROM l),
j AS (SELECT *, (sym + bang) * 5 > nw OR (nw >= 10 AND NOT mark) OR sep * 3 > nw OR low IN ({_quote(NAVIGATION)}) OR regexp_matches(low, '{"|".join(BOILERPLATE)}') AS bad FROM m WHERE nw > 0),
a AS (SELECT rid, count(*) - count(DISTINCT line) AS dups, count(*) FILTER (bad) AS failed, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM j GROUP BY rid),
t AS (SELECT rid, generate_subscripts(ws, 1) AS p, ws FROM d WHERE len(ws) >= 3),
w AS (SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS tri FROM t WHERE p + 2 <= len(ws)),
r AS (SELECT rid, p FROM w QUALIFY count(*) OVER (PARTITION BY rid, tri) > 1),
c AS (SELECT rid, count(DISTINCT p + k) AS rep FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid),
f AS (SELECT doc_id, len(ws) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, coalesce(failed, 0) AS n_lines_failed, coalesce(lost, 0)::BIGINT AS lost_chars
    FROM d LEFT JOIN a USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 30 * word_chars AS kept, n_lines_failed, lost_chars FROM f
"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM m
"""

SHARDS_SQL = f"""
WITH h AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash FROM documents),
v AS (SELECT rid, doc_id, n_bytes, k AS depth, hash >> (60 - k) AS prefix FROM h, range(0, 61) AS r(k)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM v GROUP BY ALL),
c AS (SELECT v.*, shard_bytes FROM v JOIN s USING (depth, prefix) WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60)
SELECT doc_id, n_bytes, depth::INTEGER AS depth, prefix, shard_bytes, shard_bytes <= {SHARD_BYTES} AS fits FROM c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY depth) = 1
"""


def _marked(text: str) -> str:
    t = rf"regexp_replace({text}, '([\p{{L}},;:)] )(\p{{Lu}})', '\1{NAME}\2', 'g')"
    t = rf"regexp_replace(lower({t}), '(\p{{N}})[.,](\p{{N}})', '\1{POINT}\2', 'g')"
    t = rf"regexp_replace({t}, '([\p{{N}}{POINT}]+)', ' {NUMBER}\1 ', 'g')"
    t = rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}{NUMBER}-{POINT}]+', ' ', 'g')"
    return rf"trim(regexp_replace({t} || ' ', '({NUMBER}[^ ]*) ({UNITS}) ', '\1 {UNIT}\2 ', 'g'))"


def _windows_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, p - 1 AS at, array_to_string(tk[p:p + 7], ' ') AS win, raw[p:p + 7] AS raw FROM (
        SELECT {key}, raw, tk, generate_subscripts(tk, 1) AS p FROM (SELECT {key}, string_split(m, ' ') AS raw, string_split(regexp_replace(m, '([{NUMBER}-{NAME}])[^ ]+', '\\1', 'g'), ' ') AS tk
        FROM (SELECT {key}, {_marked("coalesce(text, '')")} AS m FROM {table}))) WHERE p + 7 <= len(tk)"""


LEAKS_SQL = f"""
WITH i AS ({_windows_sql("benchmark", "item_id")}), d AS ({_windows_sql("documents", "doc_id")}),
n AS (SELECT item_id, count(*) AS item_windows FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, d.at - i.at AS shift, i.at AS item_at, i.raw AS a, d.raw AS b FROM d JOIN i USING (win)),
c AS (SELECT doc_id, item_id, shift, count(DISTINCT item_at) AS n_windows FROM m GROUP BY ALL),
x AS (SELECT DISTINCT doc_id, item_id, shift, a[k] AS u, b[k] AS v FROM m, range(1, 9) AS r(k) WHERE substr(a[k], 1, 1) IN ('{NUMBER}', '{UNIT}', '{NAME}')),
s AS (SELECT doc_id, item_id, shift, count(*) AS pairs, count(DISTINCT u) AS n_slots, count(*) FILTER (u <> v) AS n_changed FROM x GROUP BY ALL),
j AS (SELECT c.*, item_windows, coalesce(pairs, 0) AS pairs, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed FROM c JOIN n USING (item_id) LEFT JOIN s USING (doc_id, item_id, shift))
SELECT doc_id, item_id, n_windows, item_windows, n_slots, n_changed FROM j WHERE n_windows * 2 >= item_windows AND pairs = n_slots
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, abs(shift), shift DESC) = 1
"""

SPANS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
t AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, ws FROM d),
w AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS win FROM t WHERE p + 49 <= len(ws)),
b AS (SELECT doc_id, p FROM w QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id),
g AS (SELECT t.doc_id, t.p, t.ws[t.p] AS word, b.p AS s FROM t LEFT JOIN b ON t.doc_id = b.doc_id AND t.p = b.p),
k AS (SELECT doc_id, p, word, coalesce(p - max(s) OVER (PARTITION BY doc_id ORDER BY p) < 50, false) AS gone FROM g),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS rest FROM k GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": QUALITY_SQL, "op2_warc": WARC_SQL, "op7_sharding": SHARDS_SQL, "op8_decontamination": LEAKS_SQL, "op9_substring_dedup": SPANS_SQL}
