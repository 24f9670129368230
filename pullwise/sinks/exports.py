"""Writers: layer exports, shaped exports, schedules, scores, and the purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.operators import fhir, hl7, privacy, retention
from pullwise.session import written


def write_layers(layers: dict[str, DataFrame], directory: str) -> DataFrame:
    """One CSV folder per layer in catalogue column order, and a manifest of row counts and columns."""
    spark = next(iter(layers.values())).sparkSession
    manifest = None
    for layer, df in layers.items():
        cols = [f for f in dims.FIELD_CATALOGUE[layer] if f in df.columns]
        path = f"{directory}/{layer}"
        df.select(cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        one = (spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).agg(F.count(F.lit(1)).alias("rows"))
               .select(F.lit(layer).alias("layer"), "rows", F.lit(",".join(cols)).alias("columns")))
        manifest = one if manifest is None else manifest.unionAll(one)
    manifest.coalesce(1).write.mode("overwrite").json(f"{directory}/manifest")
    return spark.read.schema("layer string, rows bigint, columns string").json(f"{directory}/manifest")


def shape_export(layer: str, rows: DataFrame, key: str, when: str) -> tuple[DataFrame | None, DataFrame]:
    """(messages, bundle entries) of exported rows: rows carry run_id, row_ix and ``pseudonymised``."""
    safe = fhir.numbered_rows(layer, privacy.normalise_rows(layer, rows, key, F.col("pseudonymised")))
    messages = None
    if "hl7_v2" in dims.LAYER_STANDARDS[layer]:
        cid = hl7.control_id(layer)
        messages = safe.select("run_id", "n", hl7.message(layer, safe, cid, when).alias("message"))
    return messages, fhir.bundle(layer, safe)


BUCKETS = 1024          # of the runs of an output; what a purge rewrites is the buckets that hold a due run


def write_export(layer: str, rows: DataFrame, directory: str, key: str, when: str, buckets: int = BUCKETS) -> tuple[DataFrame | None, DataFrame]:
    """Messages and resources as tables of (run_id, n, value) under hl7/ and fhir/, in a bounded number of buckets of runs.

    Rows are shaped once; what was written is returned for counting and auditing. ``publish`` makes files of a run."""
    messages, entries = shape_export(layer, rows, key, when)
    entries = written(entries, "entries")
    if messages is not None:
        messages = written(messages, "messages")
        append_output(messages.select("run_id", "n", F.col("message").alias("value")), f"{directory}/hl7/{layer}", buckets)
    append_output(entries.select("run_id", "n", F.col("resource").alias("value")), f"{directory}/fhir/{layer}", buckets)
    return messages, entries


def outputs(directory: str, layers: list[str]) -> list[str]:
    """The tables that ``write_export`` writes for the layers."""
    return [f"{directory}/{kind}/{layer}" for layer in layers for kind in ("hl7", "fhir") if kind == "fhir" or "hl7_v2" in dims.LAYER_STANDARDS[layer]]


def bucket_of(run: str = "run_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(buckets)).cast("int")


def append_output(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Rows go out in ranges of (bucket, run, place): a run is a few files side by side, and a large one isn't one task's."""
    placed = rows.select(bucket_of(buckets=buckets).alias("bucket"), "run_id", F.col("n").cast("bigint").alias("n"), "value")
    placed.repartitionByRange("bucket", "run_id", "n").sortWithinPartitions("bucket", "run_id", "n").write.mode("append").partitionBy("bucket").parquet(path)


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, n, value, bucket) of an output. Rows without a run mark buckets that a purge has emptied."""
    return spark.read.schema("run_id string, n bigint, value string, bucket int").parquet(path).where("run_id is not null")


def publish(spark: SparkSession, path: str, runs: DataFrame, directory: str) -> None:
    """The lines of some runs as text files, a folder per run; segments of a message are lines."""
    lines = read_output(spark, path).join(runs.select("run_id").distinct(), "run_id", "left_semi")
    lines.repartitionByRange("run_id", "n").sortWithinPartitions("run_id", "n").select("run_id", F.replace("value", F.lit("\r"), F.lit("\n")).alias("value")).write.mode(
        "append").partitionBy("run_id").text(directory)


def purge(spark: SparkSession, paths: list[str], retention_table: DataFrame, now: Column, dry_run: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Takes the runs whose retention has run out from every output, and returns the purge events to append to the log.

    Copy on write: of the buckets that hold a due run, what stays is first written aside and then put in their place by one dynamic
    partition overwrite an output; other buckets aren't read. A bucket that nothing stays in keeps one row without a run. A repeated or
    resumed purge finds less to take and is harmless. Older snapshots are the storage's to erase."""
    events = written(retention.purge_events(retention_table, now), "purged")
    if dry_run:
        return events
    due = events.select("run_id").distinct().withColumn("bucket", bucket_of(buckets=buckets))
    touched = written(due.select("bucket").distinct(), "touched")
    for path in paths:                                                                      # two a layer
        here = read_output(spark, path).join(touched, "bucket", "left_semi")
        kept = here.join(due, ["bucket", "run_id"], "left_anti").unionByName(touched, allowMissingColumns=True)
        written(kept, "kept").repartitionByRange("bucket", "run_id", "n").sortWithinPartitions("bucket", "run_id", "n").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return events


def export_events(rows: DataFrame, messages: DataFrame | None, entries: DataFrame, retention_table: DataFrame) -> DataFrame:
    """One export event per run: what was written, whether pseudonymised, and until when it is kept."""
    counts = entries.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    if messages is not None:
        counts = counts.unionAll(messages.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))).groupBy("run_id").agg(F.sum("n").alias("n"))
    flags = rows.groupBy("run_id").agg(F.every("pseudonymised").alias("pseudonymised"))
    joined = counts.join(flags, "run_id").join(retention_table.select("run_id", "purpose", "retention_days", "delete_after"), "run_id", "left")
    kept = F.when(F.col("delete_after").isNull(), "no retention declared").otherwise(
        F.concat(F.lit("erase on or after "), F.date_format("delete_after", "yyyy-MM-dd")))
    note = F.concat(F.when(F.col("pseudonymised"), "pseudonymised").otherwise("RAW"), F.lit(" export; "), kept)
    return joined.select(F.lit("export").alias("event"), "run_id", "purpose", F.col("n").alias("records"), note.alias("note"))


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(path)


def write_retention(schedules: DataFrame, path: str) -> None:
    schedules.write.mode("append").json(path)
