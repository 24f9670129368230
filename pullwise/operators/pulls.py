"""From pulled cells to one row per run: the category and field masks, records and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import masks


def run_masks(pulled: DataFrame) -> DataFrame:
    """``pulled(run_id, layer, field, ...)`` -> per run the fields and categories pulled, as masks.

    One hash aggregate with map-side combine: the cells shuffle as one number per run and map task, also
    when a single run holds a third of them."""
    bit = masks.field_bit(F.col("layer"), F.col("field"))
    return (pulled.groupBy("run_id").agg(F.bit_or(bit).alias("field_mask"))
            .withColumn("cat_mask", masks.categories_of_fields(F.col("field_mask"))))


def run_pulls(pulled: DataFrame) -> DataFrame:
    """Per run the masks and the exact counts of records and values: a two-level aggregate on (run, layer, row)."""
    bit = masks.field_bit(F.col("layer"), F.col("field"))
    records = (pulled.withColumn("bit", bit).groupBy("run_id", "layer", "row_ix")
               .agg(F.bit_or("bit").alias("m"), F.count(F.lit(1)).alias("cells")))
    return (records.groupBy("run_id")
            .agg(F.bit_or("m").alias("field_mask"), F.count(F.lit(1)).alias("records"),
                 F.sum("cells").alias("fields_pulled"))
            .withColumn("cat_mask", masks.categories_of_fields(F.col("field_mask"))))


def manifests(runs: DataFrame) -> DataFrame:
    """The flat manifest with onward uses as an array."""
    return runs.withColumn("secondary_uses", F.split("secondary_use", ";")).drop("secondary_use")


def runs_with_pulls(runs: DataFrame, pulled: DataFrame, counts: bool = False) -> DataFrame:
    """Every run with what it pulled; runs that pulled nothing keep an empty mask. ``counts`` adds records and values."""
    per_run = run_pulls(pulled) if counts else run_masks(pulled)
    return (manifests(runs).join(per_run, "run_id", "left")
            .fillna(0, ["cat_mask", "field_mask", *(["records", "fields_pulled"] if counts else [])]))


def record_categories(pulled: DataFrame, *keys: str) -> DataFrame:
    """One row per pulled record with the categories it carries as a mask."""
    return (pulled.withColumn("bit", masks.field_bit(F.col("layer"), F.col("field")))
            .groupBy(*keys, "layer", "row_ix").agg(F.bit_or("bit").alias("m"))
            .withColumn("cat_mask", masks.categories_of_fields(F.col("m"))).drop("m"))


def summarise(records: DataFrame, *keys: str) -> DataFrame:
    """Records, layers and records carrying each category, per key: one column per category."""
    layer_bits = {layer: 1 << i for i, layer in enumerate(dims.LAYERS)}
    counts = [F.count_if(masks.has(F.col("cat_mask"), dims.CATEGORY_BIT[c])).alias(c) for c in dims.CATEGORIES]
    out = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("record_count"), F.bit_or("cat_mask").alias("cat_mask"),
        F.bit_or(masks.choose(F.col("layer"), layer_bits, 0)).alias("layer_mask"), *counts)
    slots = sum((F.col(c) for c in dims.CATEGORIES), F.lit(0))
    return out.withColumn("field_slots", slots.cast("bigint"))


def category_counts(summary: DataFrame, *keep: str) -> DataFrame:
    """The category columns of a summary as rows (categories no record carries are absent)."""
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("records")) for c in dims.CATEGORIES])
    return summary.select(*keep, F.inline(cells)).where("records > 0")


def merge_summaries(summary: DataFrame, *keys: str) -> DataFrame:
    """Per-run summaries combined: sums of counts, unions of layers and out-of-scope categories."""
    over = masks.minus(F.col("cat_mask"), masks.allowed_mask(F.col("purpose")))
    return summary.groupBy(*keys).agg(
        F.sum("record_count").alias("record_count"), F.sum("field_slots").alias("field_slots"),
        F.bit_or("layer_mask").alias("layer_mask"), F.bit_or(over).alias("out_of_scope_mask"),
        *[F.sum(c).alias(c) for c in dims.CATEGORIES])
