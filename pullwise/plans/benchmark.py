"""Layers -> pulls -> metered costs -> scores, for the two deterministic techniques and the ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.operators import extract, rules

TECHNIQUES = [dims.REFERENCE_TECHNIQUE, *[f"without-{a}" for a in dims.ABLATIONS], dims.BASELINE_TECHNIQUE]


def technique_costs(spark: SparkSession, layers: dict[str, DataFrame], tasks: dict | None = None,
                    techniques: list[str] | None = None, profile: DataFrame | None = None) -> DataFrame:
    """One scored and metered row per technique and task. profile: of the layers, where the caller has worked it out."""
    tasks = tasks or dims.TASKS
    techniques = techniques or TECHNIQUES
    missing = extract.shortfall(layers, tasks)
    if missing:
        raise ValueError(f"nothing to score: {missing}")
    profile = profile if profile is not None else extract.presence_profile(layers, extract.first_subject(layers))
    metered = extract.meter(extract.pull_patterns(spark, profile, extract.technique_requests(tasks, techniques)))
    manifests = spark.createDataFrame(extract.technique_manifests(tasks, techniques), extract.MANIFEST_SCHEMA)
    runs = (manifests.join(metered, ["technique", "task_id"])
            .join(extract.task_rows(spark, tasks).drop("purpose"), "task_id")
            .withColumns({"scope_pulled": F.when(F.col("necessary").isNotNull(), F.col("records")),
                          "scope_necessary": F.col("necessary"),
                          "secondary_uses": F.array().cast("array<string>"),
                          "observed_transport": F.lit(None).cast("boolean")}))
    return extract.with_cost(rules.score_runs(runs))


def ablation_table(costs: DataFrame) -> DataFrame:
    """Per technique: mean score over the tasks and the rules that fell below 1.0 in any of them."""
    low = [F.when(F.min(f"{rules.column_of(r)}_score") < 1.0, F.lit(r)) for r in rules.RULES]
    micro = F.round(F.col("compliance_score") * 1000000).cast("bigint")
    return costs.groupBy("technique").agg(
        (F.round(F.sum(micro) / F.count(F.lit(1)) / 1000.0) / 1000.0).alias("mean_score"),
        F.array_join(F.array_compact(F.array(*low)), ",").alias("rules_below"),
        F.sum("records").alias("records"), F.sum("minor_records").alias("minor_records"))
