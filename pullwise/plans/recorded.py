"""Recorded decisions run as techniques: decision -> requests -> profile -> meter -> score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import masks
from pullwise.operators import decisions, extract, ordinals, rules, scorecard
from pullwise.session import written

NOTHING = {"fetches": 0, "records": 0, "fields_pulled": 0, "field_mask": 0, "minor_records": 0}


def decision_requests(spark: SparkSession, recorded: DataFrame, fields: DataFrame, tasks: dict) -> DataFrame:
    """What every decision asks of every layer: (decision_id, layer, want, scoped). Unknown fields ask for nothing, as does a
    layer of which no known field was named; a decision scopes only where the task has one subject.

    What is unknown is dropped from the sums, not from the references: a filter on those would be worked out for every reference there
    is, before the ones of the decisions asked about are picked."""
    layer, name = F.split_part("ref", F.lit("/"), F.lit(1)), F.regexp_extract("ref", "^[^/]*/(.*)$", 1)
    wanted = fields.select("decision_id", layer.alias("layer"), masks.field_bit(layer, name).alias("bit")).groupBy(
        "decision_id", "layer").agg(F.bit_or("bit").alias("want")).where("want <> 0")
    single = spark.createDataFrame([(t, spec[1]) for t, spec in tasks.items()], "task_id string, single_subject boolean")
    scope = recorded.join(F.broadcast(single), "task_id").select(                               # the configured tasks
        "decision_id", (F.col("single_subject") & (F.col("scope") == "subject")).alias("scoped"))
    return wanted.join(scope, "decision_id")


def decision_costs(spark: SparkSession, layers: dict[str, DataFrame], recorded: DataFrame, fields: DataFrame, tasks: dict | None = None) -> DataFrame:
    """One metered and scored row per recorded decision. The layers are scanned once, whatever the number of decisions."""
    tasks = tasks or dims.TASKS
    profile = written(extract.presence_profile(layers, extract.first_subject(layers)), "profile")
    asked = decision_requests(spark, recorded, fields, tasks).withColumn("needed", F.lit(False))
    metered = extract.meter(extract.answered(profile, asked), "decision_id").drop("necessary", "cat_mask")
    runs = decisions.manifests(recorded).join(metered, "decision_id", "left").fillna(NOTHING).withColumn(
        "cat_mask", masks.categories_of_fields(F.col("field_mask")))
    runs = (runs.join(F.broadcast(extract.task_rows(spark, tasks)), "task_id")
            .join(extract.necessary_records(spark, profile, tasks), "task_id", "left")
            .withColumns({"run_id": F.concat_ws("--", "task_id", F.col("decision_id").cast("string")),
                          "scope_pulled": F.when(F.col("necessary").isNotNull(), F.col("records")), "scope_necessary": F.col("necessary"),
                          "observed_transport": F.lit(None).cast("boolean")}))
    return extract.with_cost(rules.score_runs(runs))


def replayed(recorded: DataFrame, repeats: int, tasks: dict | None = None) -> DataFrame:
    """The decisions that a benchmark of so many repeats replays, with technique and sample: every task of an agent in as many distinct
    samples, as recorded, as its task with the fewest has. Replaying one twice would count as a reproduced decision, so it isn't;
    agents that lack a task aren't replayed."""
    tasks = tasks or dims.TASKS
    agents = recorded.where(F.col("task_id").isin(*tasks)).withColumn("technique", F.concat_ws("/", "provider", "model", "briefing"))
    fewest = agents.groupBy("technique", "task_id").agg(F.count(F.lit(1)).alias("n")).groupBy("technique").agg(
        F.min("n").alias("cap"), F.count(F.lit(1)).alias("answered")).where(F.col("answered") == len(tasks))
    placed = ordinals.numbered(agents, ["technique", "task_id"], "decision_id", "sample")
    return placed.join(fewest.select("technique", F.least("cap", F.lit(repeats)).alias("passes")), "technique").where("sample <= passes")


def replay_stability(spark: SparkSession, layers: dict[str, DataFrame], recorded: DataFrame, fields: DataFrame, repeats: int,
                     tasks: dict | None = None) -> DataFrame:
    """Per recorded agent: how many of its repeats reproduced the first sample's decision, fields and verdict, task by task. Samples are
    answered from one profile of the layers, like all decisions."""
    chosen = written(replayed(recorded, repeats, tasks), "replayed")        # read three times; numbers all decisions
    scored = decision_costs(spark, layers, chosen, fields.join(chosen.select("decision_id"), "decision_id", "left_semi"), tasks)
    keyed = scorecard.with_keys(scorecard.with_task_flags(scored)).withColumn("run_ord", F.col("sample"))
    passes = chosen.groupBy("technique").agg(F.max("passes").alias("passes"))
    return scorecard.stability_table(keyed).join(passes, "technique")
