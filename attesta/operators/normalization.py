"""Normalization of the raw pairs of an entity: records, classes, product nodes, and clusters of what says the same."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import normalize as N
from ..functions import url as U

RAW = ("entity", "seq", "label", "value", "method", "section", "source_url", "source_type", "model")
VARIANT_FIELDS, ID_FIELDS = ("color", "colour", "size", "pattern", "material"), ("sku", "mpn", "gtin", "gtin8", "gtin12", "gtin13", "gtin14")
_RECORD = (
    "entity long, seq long, method string, section string, source_url string, source_type string, raw_label string, raw_value string, label string, label_key string, key string, qualified string, "
    "value string, value_key string, kind string, display string, unit string, minimum decimal(18,6), maximum decimal(18,6), boolean boolean, cls string, reason string"
)


def normalized_records(raw: DataFrame) -> DataFrame:
    """A record for each raw pair (entity, seq, label, value, method, section, source_url, source_type, model), row by row.

    Nulls are empty texts; a pair with an empty label is of class UNKNOWN. Repeated rows come repeatedly; no rows give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda x: x if isinstance(x, str) else ""
        for pdf in batches:
            out = []
            for e, seq, raw_label, raw_value, method, section, url, kind, model in pdf.itertuples(index=False):
                label, value = N.label_of(text(raw_label), text(section)), N.value_of(text(raw_value))
                cls, why = N.class_of(label, value, text(method), text(section), text(model))
                done, m = N.finished(label, value, cls), value["measure"] if cls == N.SPEC else None
                label = label | {"label": done["label"], "key": done["key"]}
                name = N.qualified(label)
                key = N.fold_words(name) if label["nested"] or len(label["key"]) <= 2 else label["key"]
                comparable = done["value"] if value["kind"] in ("number", "range", "dimensions") else N.fold_words(done["value"])
                low, high = (N._exact(m["minimum"]), N._exact(m["maximum"])) if m else (None, None)
                out.append((e, seq, text(method), text(section), text(url), text(kind), text(raw_label), text(raw_value), label["label"], key, label["key"], name, done["value"], comparable, value["kind"], done["display"], done["unit"], low, high, value["boolean"], cls, why))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _RECORD.split(", ")])

    return raw.select(*RAW).filter("entity is not null and seq is not null").mapInPandas(run, _RECORD)


def without_template_blocks(records: DataFrame) -> DataFrame:
    """records; pairs of a section with template text are no data, but for measures and scalars of structured data."""
    block = Window.partitionBy("entity", "source_url", "section")
    hit = (F.max((F.col("reason") == "template_text").cast("int")).over(block) == 1) & (F.col("section") != "")
    drop = hit & (F.col("reason") != "template_text") & (F.col("cls") != N.UNKNOWN) & (F.col("method") != "json_ld_field") & ~F.col("kind").isin("number", "range", "dimensions")
    return records.withColumn("_drop", drop).withColumn("cls", F.when(F.col("_drop"), N.UNKNOWN).otherwise(F.col("cls"))).withColumn("reason", F.when(F.col("_drop"), "template_block").otherwise(F.col("reason"))).drop("_drop")


def identity_nodes(records: DataFrame) -> DataFrame:
    """entity, source_url, node, role (product, variant, parent), variant, fields, seqs of the product nodes in structured data.

    Scalars of a source in order make a node until a key comes again. A node with an identifier is a variant if it has a
    variant field or a sibling of another identifier; one without is the parent of siblings that have either."""
    rows = records.filter("method = 'json_ld_field'")
    page = Window.partitionBy("entity", "source_url").orderBy("seq")
    # A node ends before a key that it has already; what it has is folded in the order of the page.
    ordered = rows.groupBy("entity", "source_url").agg(F.array_sort(F.collect_list(F.struct("seq", "key", F.col("value").alias("value")))).alias("all"))
    empty = F.struct(F.array().cast("array<string>").alias("keys"), F.lit(-1).alias("node"), F.array().cast("array<int>").alias("nodes"))

    def step(acc: Column, r: Column) -> Column:
        new = (acc["node"] < 0) | F.array_contains(acc["keys"], r["key"])
        node = F.when(new, acc["node"] + 1).otherwise(acc["node"])
        return F.struct(F.when(new, F.array(r["key"])).otherwise(F.array_append(acc["keys"], r["key"])).alias("keys"), node.alias("node"), F.array_append(acc["nodes"], node).alias("nodes"))

    numbered = ordered.withColumn("nodes", F.aggregate("all", empty, step)["nodes"]).select("entity", "source_url", F.explode(F.arrays_zip("all", "nodes")).alias("r"))
    nodes = numbered.groupBy("entity", "source_url", F.col("r.nodes").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("r.all.key", "r.all.value"))).alias("fields"), F.sort_array(F.collect_list("r.all.seq")).alias("seqs"))
    filled = lambda names: F.coalesce(*[F.nullif(F.col("fields")[n], F.lit("")) for n in names])
    nodes = nodes.withColumn("own", filled(ID_FIELDS)).withColumn("varies", filled(VARIANT_FIELDS))
    all_of = Window.partitionBy("entity", "source_url")
    others = F.size(F.array_remove(F.collect_set("own").over(all_of), F.coalesce("own", F.lit("")))) > 0
    told = F.sum((F.col("own").isNotNull() | F.col("varies").isNotNull()).cast("int")).over(all_of) - (F.col("own").isNotNull() | F.col("varies").isNotNull()).cast("int") > 0
    role = F.when(F.col("own").isNotNull() & (F.col("varies").isNotNull() | others), "variant").when(F.col("own").isNull() & told, "parent").otherwise("product")
    nodes = nodes.withColumn("role", role)
    variant = F.when(F.col("role") == "variant", F.coalesce("varies", F.nullif(F.col("fields")["name"], F.lit("")), "own")).otherwise("")
    return nodes.select("entity", "source_url", "node", "role", variant.alias("variant"), "fields", "seqs")


def _linked(records: DataFrame) -> DataFrame:
    """records with cluster: the least seq of what equal labels, values and units connect; records without a unit join the only unit there is."""
    bucket = ["entity", "label_key", "value_key", "variant"]
    units = F.size(F.collect_set(F.nullif("unit", F.lit(""))).over(Window.partitionBy(*bucket)))
    of_unit = F.min("seq").over(Window.partitionBy(*bucket, "unit"))
    whole = F.min("seq").over(Window.partitionBy(*bucket))
    return records.withColumn("cluster", F.when(units <= 1, whole).otherwise(of_unit))


def _aligned(records: DataFrame) -> DataFrame:
    """Links entity, a, b between clusters whose records stand at one place of sibling pages.

    Pages of one host, last path segment and source type are read in order; runs of four equal values or more with two different ones are the
    same facts in other words. One entity's siblings are compared by one task, as they are what a few pages state."""
    leaf = F.lower(F.element_at(F.split(F.regexp_replace(U.path(F.col("source_url")), "/+$", ""), "/"), -1))
    rows = records.filter(F.col("cls").isin(N.SPEC, N.IDENTITY)).select("entity", "seq", "cluster", "value_key", "variant", "unit", "source_url", "method", "source_type", U.host(F.col("source_url")).alias("host"), leaf.alias("leaf"))
    family = ["entity", "host", "leaf", "source_type"]
    streams = F.size(F.collect_set(F.struct("source_url", "method")).over(Window.partitionBy(*family)))
    long = F.count("*").over(Window.partitionBy(*family, "source_url", "method")) >= 4
    rows = rows.withColumn("streams", streams).withColumn("long", long).filter("streams > 1 and long")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pages, out = [(k, g.sort_values("seq")) for k, g in pdf.groupby(["source_url", "method"], sort=True)], []
        for n, (a, left) in enumerate(pages):
            for b, right in pages[n + 1 :]:
                if a[0] != b[0] and a[1] != b[1]:
                    continue
                x, y = left.to_dict("records"), right.to_dict("records")
                for i, j, size in SequenceMatcher(None, [r["value_key"] for r in x], [r["value_key"] for r in y], autojunk=False).get_matching_blocks():
                    if size >= 4 and len({r["value_key"] for r in x[i : i + size]}) > 1:
                        out += [(p["entity"], p["cluster"], q["cluster"]) for p, q in zip(x[i : i + size], y[j : j + size], strict=True) if p["variant"] == q["variant"] and p["unit"] == q["unit"] and p["cluster"] != q["cluster"]]
        return pd.DataFrame(out, columns=["entity", "a", "b"])

    return rows.groupBy(*family).applyInPandas(links, "entity long, a long, b long")


def normalize_attributes(raw: DataFrame) -> DataFrame:
    """Clusters of the raw pairs of each entity: entity, cluster (least seq), label, label_key, qualified, value, display, unit, kind, cls, reason, variant, n, aliases, evidence.

    The record of the best class, then the least seq, speaks for a cluster; its unit is the first that any has. See normalized_records for nulls."""
    records = without_template_blocks(normalized_records(raw))
    nodes = identity_nodes(records).filter("role = 'variant'").select("entity", F.explode("seqs").alias("seq"), "variant")
    records = records.join(nodes, ["entity", "seq"], "left").withColumn("variant", F.coalesce("variant", F.lit("")))
    records = _linked(records)
    edges = _aligned(records)

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
        return pd.DataFrame({"entity": pdf["entity"].iloc[0], "cluster": list(root), "root": [find(x) for x in root]})

    roots = edges.groupBy("entity").applyInPandas(folded, "entity long, cluster long, root long")
    records = records.join(roots, ["entity", "cluster"], "left").withColumn("cluster", F.coalesce("root", "cluster"))
    rank = F.array_position(F.array(*map(F.lit, N.CLASSES)), F.col("cls"))
    order = F.struct(rank.alias("rank"), F.col("seq"))
    head = F.struct("label", "key", "qualified", "value", "display", "unit", "kind", "cls", "reason", "variant")
    evidence = F.array_sort(F.collect_list(F.struct("seq", "raw_label", "raw_value", "source_url", "method")))
    g = records.groupBy("entity", "cluster").agg(F.min_by(head, order).alias("h"), F.min_by(F.nullif("unit", F.lit("")), F.when(F.col("unit") != "", F.col("seq"))).alias("any_unit"), F.count("*").alias("n"), F.sort_array(F.collect_set("label")).alias("labels"), evidence.alias("evidence"))
    unit = F.coalesce("any_unit", F.lit(""))
    display = F.when((unit != "") & (F.col("h.unit") == ""), F.concat_ws(" ", "h.value", unit)).otherwise(F.col("h.display"))
    return g.select("entity", "cluster", "h.label", F.col("h.key").alias("label_key"), "h.qualified", "h.value", display.alias("display"), unit.alias("unit"), "h.kind", "h.cls", "h.reason", "h.variant", "n", F.array_remove("labels", F.col("h.label")).alias("aliases"), "evidence")
