"""Recorded decisions as pulls and manifests, and whether the recordings still answer today's brief."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import masks, text


def selection(fields: DataFrame) -> DataFrame:
    """fields(decision_id, ref) -> per decision: known references as a mask, unknown ones listed, first seen first."""
    split = fields.withColumns({"_layer": F.split_part("ref", F.lit("/"), F.lit(1)), "_name": F.regexp_extract("ref", "^[^/]*/(.*)$", 1)})
    bit = masks.field_bit(F.col("_layer"), F.col("_name"))
    return split.withColumn("bit", bit).groupBy("decision_id").agg(
        F.bit_or("bit").alias("field_mask"),
        F.array_sort(F.collect_set(F.when(F.col("bit") == 0, F.col("ref")))).alias("unknown_fields"))


def manifests(decisions: DataFrame) -> DataFrame:
    """A decision as the manifest every technique must produce: blanks and zero are nothing, null words no use."""
    some = text.blank_to_null
    has_basis = F.col("lawful_basis_type").isin("consent", "legitimate_use")
    notice = some(F.col("notice_reference"))
    return decisions.withColumns({
        "basis_type": F.when(has_basis, F.col("lawful_basis_type")),
        "basis_reference": F.when(has_basis, some(F.col("lawful_basis_reference"))),
        "secondary_uses": text.real_uses(F.col("secondary_uses")),
        "retention_days": F.when(F.col("retention_days") > 0, F.col("retention_days")),
        "deletion_mechanism": some(F.col("deletion_mechanism")), "notice_reference": notice,
        "accountable_party": some(F.col("accountable_party"))}).drop("lawful_basis_type", "lawful_basis_reference")


def freshness(decisions: DataFrame, tasks_today: DataFrame) -> DataFrame:
    """Per (provider, model, briefing): tasks missing, tasks recorded under another brief, and how many repeats
    it can be replayed for every task (null when a task has none)."""
    agent = ["provider", "model", "briefing"]
    samples = decisions.groupBy(*agent, "task_id").agg(
        F.count(F.lit(1)).alias("samples"), F.max("fingerprint").alias("recorded"))
    today = tasks_today.agg(F.collect_list(F.struct("task_id", "fingerprint"))).scalar()      # the configured tasks
    every = decisions.select(*agent).distinct().select(*agent, F.inline(today))
    grid = every.join(samples, [*agent, "task_id"], "left")
    none = F.col("samples").isNull()
    stale = ~none & (F.col("recorded") != F.col("fingerprint"))
    return grid.groupBy(*agent).agg(
        F.array_sort(F.collect_list(F.when(none, F.col("task_id")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(stale, F.col("task_id")))).alias("stale"),
        F.when(F.count_if(none) == 0, F.min("samples")).alias("max_repeats"))


TASKS_TODAY = [(t, f"brief-{i}") for i, t in enumerate(dims.TASKS)]
