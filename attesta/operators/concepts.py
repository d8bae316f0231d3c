"""Attributes mapped to concepts, and what a canonical result tells: statuses, coverage, repeated components, collisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.concepts import Concept, map_attribute

IN = ("entity", "id", "category", "label", "aliases", "group_path", "value", "kind", "unit", "boolean", "display", "alternates", "method")
OUT = "entity long, id long, n int, status string, key string, confidence double, value string, unit string, value_type string, unit_status string, method string, converted string, derived_from string, candidates array<string>, reason string"
#: Statuses from the best down.
STATUSES = ("mapped", "ambiguous", "unmapped", "not_a_spec")


def map_concepts(attributes: DataFrame, concepts: list[Concept]) -> DataFrame:
    """Rows entity, id, n, status, key, confidence, value, unit, ... of attributes (entity, id, category, label, aliases, group_path, value, kind,
    unit, boolean, display, alternates, method): one each, and one more for each axis that a label splits dimensions into.

    Row by row, by a table of concepts that each task holds. Null texts are empty, null lists too; rows without entity or id are left out;
    repeated rows come repeatedly; no rows give no rows."""
    names = [f.split()[0] for f in OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda x: x if isinstance(x, str) else ""
        some = lambda x: [t for t in x if isinstance(t, str)] if x is not None and not isinstance(x, float) else []
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = {k: text(r[k]) for k in ("label", "value", "kind", "unit", "display", "method")} | {k: some(r[k]) for k in ("aliases", "group_path", "alternates")} | {"boolean": None if r["boolean"] is None or pd.isna(r["boolean"]) else bool(r["boolean"])}
                out += [(r["entity"], r["id"], n, *(row[k] for k in names[3:])) for n, row in enumerate(map_attribute(a, text(r["category"]), concepts))]
            yield pd.DataFrame(out, columns=names)

    return attributes.select(*IN).filter("entity is not null and id is not null").mapInPandas(run, OUT)


def attribute_status(mapped: DataFrame) -> DataFrame:
    """entity, id, status: the best status of each attribute's rows."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return mapped.groupBy("entity", "id").agg(F.min_by("status", rank).alias("status"))


def mapping_summary(mapped: DataFrame) -> DataFrame:
    """entity, specs, mapped, ambiguous, unmapped, not_a_spec, eligible, keys, coverage of each entity's attributes."""
    status = attribute_status(mapped).groupBy("entity").agg(F.count("*").alias("specs"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    keys = mapped.filter("status = 'mapped'").groupBy("entity").agg(F.countDistinct("key").alias("keys"))
    out = status.withColumn("eligible", F.col("specs") - F.col("not_a_spec")).join(keys, "entity", "left").withColumn("keys", F.coalesce("keys", F.lit(0)))
    return out.withColumn("coverage", F.coalesce(F.round(F.try_divide(F.col("mapped"), F.col("eligible")), 3), F.lit(0.0)))


def repeated_components(mapped: DataFrame, concepts: list[Concept]) -> DataFrame:
    """mapped (with block: the section of a page that a row is from); a component's key that comes again in a block, in the order of id, is a
    secondary component's, with 0.1 less confidence. Derived rows stay."""
    own = (F.col("status") == "mapped") & F.col("key").isin([c.key for c in concepts if c.component]) & F.col("derived_from").isNull()
    nth = F.row_number().over(Window.partitionBy("entity", "block", "key", own).orderBy("id", "n"))
    again = own & (F.col("_nth") > 1)
    out = mapped.withColumn("_nth", nth)
    return out.withColumn("_again", again).withColumn("key", F.when(F.col("_again"), F.concat(F.lit("secondary_component_"), F.col("key"))).otherwise(F.col("key"))).withColumn("confidence", F.when(F.col("_again"), F.round(F.col("confidence") - 0.1, 3)).otherwise(F.col("confidence"))).withColumn("method", F.when(F.col("_again"), "repeated_block_context").otherwise(F.col("method"))).drop("_nth", "_again")


def field_collisions(mapped: DataFrame, concepts: list[Concept]) -> DataFrame:
    """entity, key, members, kind of keys that two attributes or more are mapped to: list_field, same_value, equivalent_after_conversion or
    different_values. mapped has display, what the source wrote."""
    g = mapped.filter("status = 'mapped'").groupBy("entity", "key").agg(
        F.countDistinct("id").alias("members"), F.countDistinct(F.lower("value"), F.coalesce("unit", F.lit(""))).alias("values"), F.countDistinct(F.lower("display")).alias("written"), F.max(F.coalesce("converted", F.lit("")) != "").alias("converted")
    )
    kind = F.when(F.col("key").isin([c.key for c in concepts if c.list_field]), "list_field").when(F.col("values") > 1, "different_values").when((F.col("written") > 1) & F.col("converted"), "equivalent_after_conversion").otherwise("same_value")
    return g.filter("members > 1").select("entity", "key", "members", kind.alias("kind"))
