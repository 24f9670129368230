"""Retention schedules and the purge of exports whose retention has run out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise.functions import dates


def schedule(runs: DataFrame, files: DataFrame, written_at: Column) -> DataFrame:
    """One schedule per run that wrote files; no declared retention leaves the erasure date open."""
    per_run = files.groupBy("run_id").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return runs.join(per_run, "run_id").select(
        "run_id", "purpose", "retention_days", written_at.alias("written_at"),
        dates.delete_after(written_at, F.col("retention_days")).alias("delete_after"),
        F.coalesce("deletion_mechanism", F.lit("")).alias("deletion_mechanism"), "files")


def due(retention: DataFrame, now: Column) -> DataFrame:
    return retention.where(dates.due(F.col("delete_after"), now))


def survivors(exports: DataFrame, retention: DataFrame, now: Column) -> DataFrame:
    """Export rows that stay: those of runs not due."""
    return exports.join(due(retention, now).select("run_id"), "run_id", "left_anti")


def purge_events(retention: DataFrame, now: Column) -> DataFrame:
    """One purge event per erased export."""
    n = F.col("files") if dict(retention.dtypes)["files"] in ("int", "bigint") else F.size("files")
    note = F.concat(F.lit("erased "), n.cast("string"), F.lit(" file(s) after "), F.col("retention_days").cast("string"), F.lit(" d"))
    return due(retention, now).select(F.lit("purge").alias("event"), "run_id", "purpose", note.alias("note"))
