"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Names, numbers and units become typed placeholders; windows of canonical tokens of documents are hash-joined with those
of benchmark items; a document that covers enough of an item at one alignment, or at a chain of near ones (words were added or dropped), and
fills its slots consistently (equal values of the item meet equal values in the document) holds the item, as it is or re-parameterised.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted

# Marks of slots (private-use characters: number, unit, name; and the separator inside a number), units.
NUMBER, UNIT, NAME, POINT = "\ue000", "\ue001", "\ue002", "\ue003"
RUN = "\ue004"  # parts the names of a run that is one token
UNITS = (
    "mm|cm|m|km|inch|inches|foot|feet|yard|yards|mile|miles|mg|g|kg|gram|grams|lb|lbs|pound|pounds|ounce|ounces|ton|tons|ml|l|liter|liters|litre|litres|gallon|gallons|"
    "second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|dollar|dollars|euro|euros|cent|cents|percent|degree|degrees|watt|watts|volt|volts|mph|kmh"
)
#: Windows of a benchmark up to this number are broadcast (8 bytes of hash and about 200 of tokens each, so 45 MB at most); more are shuffled.
BROADCAST_WINDOWS = 200_000


def annotated(text: Column) -> Column:
    """Tokens parted by single spaces; a slot is its mark and the value in lower case.

    A name is a capitalised word after a word or comma in the same line; a unit is a unit word after a number."""
    t = F.regexp_replace(text, r"([\p{L},;:)] )(\p{Lu})", f"$1{NAME}$2")
    t = F.regexp_replace(F.lower(t), r"(\p{N})[.,](\p{N})", f"$1{POINT}$2")
    t = F.regexp_replace(t, rf"[\p{{N}}{POINT}]+", f" {NUMBER}$0 ")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}{NUMBER}-{POINT}]+", " ")
    return F.trim(F.regexp_replace(F.concat(t, F.lit(" ")), rf"({NUMBER}[^ ]*) ({UNITS}) ", f"$1 {UNIT}$2 "))


def canonical(marked: Column) -> Column:
    return F.regexp_replace(marked, f"([{NUMBER}-{NAME}])[^ ]+", "$1")


def _plain(marked: Column) -> Column:
    return F.regexp_replace(F.translate(marked, NAME, ""), "ß", "ss")


#: Positions are counted in the tokens of a text (PLACED), or in those left when each run of names is one token (JOINED).
PLACED, JOINED = 1, 2


def _forms(rows: DataFrame, key: str) -> DataFrame:
    """key, form, spaces (the ways of counting positions that it is valid in), raw (annotated tokens), tokens of each form of a text.

    Form 0 is the text as it is, valid both ways if no names are adjacent; form 1 has names as plain words and ß, which
    is SS in capitals, as ss, so that case hides nothing; form 2 has runs of names joined."""
    marked = rows.select(key, annotated(F.coalesce("text", F.lit(""))).alias("marked")).filter("marked <> ''")
    marked = marked.select(key, "marked", _plain(F.col("marked")).alias("plain"), F.regexp_replace("marked", f"({NAME}[^ ]+) (?={NAME})", f"$1{RUN}").alias("joined"))

    def form(k: int, spaces: Column | int, raw: str, text: Column) -> Column:
        return F.struct(F.lit(k).alias("form"), (spaces if isinstance(spaces, Column) else F.lit(spaces)).alias("spaces"), F.split(raw, " ").alias("raw"), F.split(canonical(text), " ").alias("tokens"))

    whole = F.col("joined") == F.col("marked")
    forms = F.array_compact(F.array(form(0, F.when(whole, PLACED | JOINED).otherwise(PLACED), "marked", F.col("marked")), F.when(F.col("plain") != F.col("marked"), form(1, PLACED, "marked", F.col("plain"))), F.when(~whole, form(2, JOINED, "joined", F.col("joined")))))
    return marked.select(key, F.explode(forms).alias("f")).select(key, "f.*")


def _windows(forms: DataFrame, n: Column, lengths: list[int]) -> DataFrame:
    """forms with n (one of lengths), at and window (hash) for each run of n tokens.

    Positions are exploded and a window's tokens are picked by index, all within generated code. A window of slots alone is hashed by their
    values: as placeholders, tables of numbers would all meet in one hash."""
    at = forms.withColumn("n", n).filter(F.size("tokens") >= F.col("n")).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("n"))))

    def hashed(k: int) -> Column:
        tokens = [F.get("tokens", F.col("at") + i) for i in range(k)]
        bare = reduce(and_, [t.isin(NUMBER, UNIT, NAME) for t in tokens])  # mostly settled by the first
        return F.when(bare, F.xxhash64(F.lit(NUMBER), *[F.lower(F.get("raw", F.col("at") + i)) for i in range(k)])).otherwise(F.xxhash64(*tokens))

    hashes = {k: hashed(k) for k in lengths}
    return at.withColumn("window", hashes[lengths[0]] if len(lengths) == 1 else F.coalesce(*[F.when(F.col("n") == k, h) for k, h in hashes.items()]))


def _cut(raw: str, at: str) -> Column:
    return F.slice(raw, F.col(at) + 1, F.col("n"))


def _slots(lined: Column) -> Column:
    return F.array_distinct(F.flatten(lined))


def _n_slots(slots: Column) -> Column:
    return F.size(F.array_distinct(F.transform(slots, lambda x: x["value"])))


def _figures(rank: int, places: Column, shift: Column, size: str, slots: Column) -> Column:
    changed = F.size(F.filter(slots, lambda x: F.translate(x["value"], NAME, "") != x["met"] if rank else _plain(x["value"]) != _plain(x["met"])))
    return F.struct(F.lit(rank).alias("rank"), F.size(places).cast("long").alias("n_windows"), (-F.abs(shift)).alias("near"), shift.alias("shift"), F.col(size).alias("item_windows"), _n_slots(slots).cast("long").alias("n_slots"), changed.cast("long").alias("n_changed"))


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 8, cover: tuple[int, int] = (1, 2)) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, n_slots, n_changed for each document that holds an item.

    docs (doc_id, text), benchmark (item_id, text). An item is held if its distinct windows found at one
    alignment are the fraction `cover` of all its windows or more, and every value of its slots always meets the
    same value there; n_changed counts values that differ (0: as it is). Of several alignments the best, then the least, is told.
    If none suffices, alignments that follow each other by up to n tokens are a chain: its windows count together, from the alignment
    with most windows down, without those whose slots contradict the ones before; there a run of names can stand for one name,
    and names also meet as plain words in any case.
    An item of fewer than n tokens is one window of its whole length. Of windows that are nothing but slots only those of equal values meet.
    Null and empty texts hold nothing and are held by nothing. Rows that
    share an id are one document or item; a null doc_id is one document, a null item_id is left out. No rows give no rows;
    other columns are not read.
    """
    num, den = cover
    items = _forms(benchmark.filter("item_id is not null"), "item_id").filter((F.size("tokens") >= n) | (F.col("form") < 2))
    items = _windows(items, F.least(F.size("tokens"), F.lit(n)), list(range(1, n + 1)))
    items = items.select("item_id", "window", F.col("form").alias("item_form"), F.col("spaces").alias("item_spaces"), F.col("at").alias("item_at"), _cut("raw", "at").alias("item_raw"))
    sizes = items.groupBy("item_id").agg(F.countDistinct(F.when(F.col("item_form") == 0, F.col("item_at"))).alias("placed"), F.countDistinct(F.when(F.col("item_spaces").bitwiseAND(JOINED) > 0, F.col("item_at"))).alias("joined"))
    counts = {r["n"]: r["count"] for r in items.groupBy(F.size("item_raw").alias("n")).count().collect()}
    lengths = sorted({*counts, n})
    found = _windows(_forms(docs, "doc_id"), F.lit(n) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))), lengths).drop("tokens")
    if sum(counts.values()) <= BROADCAST_WINDOWS:
        met = found.join(F.broadcast(items), "window").withColumn("raw", _cut("raw", "at"))
    else:
        met = found.withColumn("raw", _cut("raw", "at")).join(items, "window")
    both = F.col("spaces").bitwiseAND(F.col("item_spaces"))
    met = met.filter(both > 0).withColumn("space", F.when(both.bitwiseAND(PLACED) > 0, PLACED).otherwise(JOINED))
    is_slot = lambda raw: F.substring(raw, 1, 1).isin(NUMBER, UNIT, NAME)
    met = met.filter((F.col("n") == n) | ~F.forall("item_raw", is_slot) | (F.transform("item_raw", _plain) == F.transform("raw", _plain)))
    pairs = F.filter(F.arrays_zip("item_raw", "raw"), lambda x: is_slot(x["item_raw"]))
    pairs = F.transform(pairs, lambda x: F.struct(x["item_raw"].alias("value"), F.translate(x["raw"], NAME, "").alias("met")))
    as_is = (F.col("form") == 0) & (F.col("item_form") == 0)
    met = met.select("doc_id", "item_id", "space", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", pairs.alias("pairs"), as_is.alias("as_is"))
    lined = met.groupBy("doc_id", "item_id", "space", "shift").agg(
        F.collect_set("item_at").alias("places"), _slots(F.collect_set("pairs")).alias("slots"), F.collect_set(F.when(F.col("as_is"), F.col("item_at"))).alias("own_places"), _slots(F.collect_set(F.when(F.col("as_is"), F.col("pairs")))).alias("own_slots")
    )
    lined = lined.join(sizes, "item_id")

    def enough(places: str, size: Column) -> Column:
        return F.size(places) * den >= size * num

    own = enough("own_places", F.col("placed")) & (F.size("own_places") > 0) & (F.size("own_slots") == _n_slots(F.col("own_slots")))
    own = F.when(own, _figures(1, F.col("own_places"), F.col("shift"), "placed", F.col("own_slots")))

    by_shift = Window.partitionBy("doc_id", "item_id", "space").orderBy("shift")
    linked = lined.withColumn("apart", (F.col("shift") - F.lag("shift").over(by_shift) > n).cast("int")).withColumn("chain", F.sum(F.coalesce("apart", F.lit(0))).over(by_shift))
    size = F.when(F.col("space") == PLACED, F.col("placed")).otherwise(F.col("joined")).alias("size")
    part = F.struct((-F.size("places")).alias("most"), F.abs("shift").alias("near"), "shift", "places", "slots")
    chains = linked.groupBy("doc_id", "item_id", "space", "chain", size).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(own).alias("own"))

    def taken(acc: Column, x: Column) -> Column:
        slots = F.array_union(acc["slots"], x["slots"])
        fits = F.size(slots) == _n_slots(slots)
        return F.struct(F.when(fits, F.array_union(acc["places"], x["places"])).otherwise(acc["places"]).alias("places"), F.when(fits, slots).otherwise(acc["slots"]).alias("slots"))

    first = F.col("parts")[0]
    none = F.struct(F.slice(first["places"], 1, 0).alias("places"), F.slice(first["slots"], 1, 0).alias("slots"))
    chains = chains.select("doc_id", "item_id", "size", "own", first["shift"].alias("shift"), F.aggregate("parts", none, taken).alias("all"))
    whole = F.when(enough("all.places", F.col("size")) & (F.size("all.places") > 0), _figures(0, F.col("all.places"), F.col("shift"), "size", F.col("all.slots")))
    best = chains.groupBy("doc_id", "item_id").agg(F.max(F.coalesce("own", whole)).alias("best")).filter("best is not null")
    return best.select("doc_id", "item_id", "best.n_windows", "best.item_windows", "best.n_slots", "best.n_changed")


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay. Rows that share a doc_id go together."""
    held = counted(leaks(docs, benchmark).select(F.col("doc_id").alias("held")).distinct(), "held")
    return docs.join(held, docs["doc_id"].eqNullSafe(held["held"]), "left_anti")
