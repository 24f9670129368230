"""Readers of the audit log, retention schedules and recorded decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pullwise.functions.text import model_slug

AUDIT_SCHEMA = ("seq bigint, at timestamp, event string, run_id string, technique string, purpose string, source string, "
                "records bigint, subjects array<string>, unattributed bigint, scoped boolean, manifest_sha256 string, "
                "note string, account string, authorisation string, prev_sha256 string")
RETENTION_SCHEMA = ("run_id string, purpose string, retention_days int, written_at timestamp, delete_after timestamp, "
                    "files array<string>, deletion_mechanism string, key_file string, key_holder string")
DECISION = ("struct<fields: array<string>, scope: string, purpose_specified: boolean, secondary_uses: array<string>, "
            "lawful_basis_type: string, lawful_basis_reference: string, retention_days: int, deletion_mechanism: string, "
            "transport_encrypted: boolean, at_rest_encrypted: boolean, access_controlled: boolean, "
            "identifiers_pseudonymised: boolean, notice_reference: string, notice_covers_purpose: boolean, "
            "notice_machine_readable: boolean, audit_log_enabled: boolean, accountable_party: string, "
            "processing_record_kept: boolean>")


def audit_events(spark: SparkSession, path: str) -> DataFrame:
    """The log's JSON lines; blank lines carry no run and are skipped."""
    return spark.read.schema(AUDIT_SCHEMA).json(path).where("run_id is not null")


def event_subjects(events: DataFrame) -> DataFrame:
    return events.select("seq", F.explode("subjects").alias("token"))


def for_run(events: DataFrame, run_id: str) -> DataFrame:
    return events.where(F.col("run_id") == run_id)


def logged_runs(events: DataFrame) -> DataFrame:
    """Runs with an extraction event: the evidence of audit logging."""
    return events.where("event = 'extraction'").select("run_id").distinct()


def retention(spark: SparkSession, directory: str) -> DataFrame:
    """Schedules beside exports, one JSON document each."""
    return (spark.read.schema(RETENTION_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.retention.json")
            .json(directory))


def recorded_decisions(spark: SparkSession, directory: str) -> DataFrame:
    """Recorded decisions, one row per sample. A file counts only if its name carries its own model's slug."""
    schema = (f"provider string, model string, briefing string, "
              f"tasks map<string, struct<fingerprint: string, samples: array<{DECISION}>>>")
    files = (spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(directory)
             .withColumn("file", F.col("_metadata.file_name")))
    expected = F.concat(F.col("provider"), F.lit("--"), model_slug(F.col("model")), F.lit("--"), F.col("briefing"), F.lit(".json"))
    tasks = files.where(F.col("file") == expected).select("provider", "model", "briefing", F.explode("tasks").alias("task_id", "t"))
    return tasks.select("provider", "model", "briefing", "task_id", F.col("t.fingerprint").alias("fingerprint"),
                        F.posexplode("t.samples").alias("sample", "decision"))
