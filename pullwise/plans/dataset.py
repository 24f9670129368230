"""A directory of exported files -> scored techniques, a pseudonymised export, its leak audit and retention."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import crypto, masks
from pullwise.operators import audit, extract, leaks, ordinals, privacy, retention, rules
from pullwise.plans import benchmark
from pullwise.session import written
from pullwise.sinks import exports as sinks
from pullwise.sinks import log
from pullwise.sources.exports import ExportDirectory


@dataclass
class DatasetRun:
    report: DataFrame            # what was made of each file
    costs: DataFrame             # techniques scored and metered
    matrix: DataFrame            # the export's run under every purpose
    audit: DataFrame             # identifiers looked for in what was written
    k: DataFrame                 # k of the exported registration rows
    schedule: DataFrame          # retention of the export
    events: DataFrame            # the events as appended to the log
    subjects: DataFrame          # (seq, token) of the patients that the run's events name


def run(spark: SparkSession, directory: str, out: str, task_id: str, key: str, when: str, now: Column,
        column_map: DataFrame | None = None, buckets: int = sinks.BUCKETS) -> DatasetRun:
    """Scores, export, retention and the log are written under `out`."""
    src = ExportDirectory(spark, directory, column_map)
    layers = src.layers(numbered=True)
    missing = extract.shortfall(layers, dims.TASKS)
    if missing:
        raise ValueError(f"nothing to score: {missing}")
    row = extract.first_subject(layers).first()
    first = spark.createDataFrame([(row[0],)], "subject string")
    profile = written(extract.presence_profile(layers, first), "profile")
    costs = benchmark.technique_costs(spark, layers, profile=profile)
    sinks.write_scores(costs, f"{out}/scores")

    tasks = {**dims.TASKS, **dims.MATRIX_TASKS}
    purpose, single, _, _, needed = tasks[task_id]
    run_id = f"{task_id}--{dims.REFERENCE_TECHNIQUE}"
    pulled = extract.pull_rows(layers, needed, first if single else None)
    raw = {layer: df.withColumns({"run_id": F.lit(run_id), "pseudonymised": F.lit(True)}) for layer, df in pulled.items()}

    messages = entries = None
    for layer, df in raw.items():
        m, e = sinks.write_export(layer, df, out, key, when, buckets)
        if m is not None:
            messages = m if messages is None else messages.unionAll(m)
        entries = e if entries is None else entries.unionAll(e)

    values = reduce(DataFrame.unionAll, [
        df.select("run_id", F.explode(F.array(*[F.col(c) for c in dims.direct_identifiers(layer) if c in df.columns])).alias("value"))
        for layer, df in raw.items()])
    texts = entries.select("run_id", F.sha2("resource", 256).alias("artefact_id"), F.col("resource").alias("text"))
    if messages is not None:
        texts = texts.unionAll(messages.select("run_id", F.sha2("message", 256), "message"))
    found = leaks.find_leaks(values, texts, ["run_id"])

    manifest = spark.createDataFrame([r for r in extract.technique_manifests({task_id: tasks[task_id]}, [dims.REFERENCE_TECHNIQUE])],
                                     extract.MANIFEST_SCHEMA)
    got = profile.agg(F.bit_or(F.col("mask").bitwiseAND(F.lit(dims.task_mask(needed)))).alias("m"))
    runs = manifest.withColumns({
        "cat_mask": masks.categories_of_fields(F.coalesce(got.scalar(), F.lit(0))),
        "secondary_uses": F.array().cast("array<string>"), "scope_pulled": F.lit(None).cast("int"),
        "scope_necessary": F.lit(None).cast("int"), "observed_transport": F.lit(None).cast("boolean")})
    files = spark.createDataFrame([(run_id, f"{kind}/{layer}") for layer in raw for kind in ("hl7", "fhir")], "run_id string, file string")
    schedule = written(retention.schedule(runs, files, now), "schedule")
    sinks.write_retention(schedule, f"{out}/retention")

    every = reduce(DataFrame.unionAll, [df.select("run_id", "pseudonymised") for df in raw.values()])
    audit_key = crypto.audit_key(spark)
    scopes = first.select(F.lit(run_id).alias("run_id"), F.col("subject").alias("scoped_to")) if single else None
    named = [audit.subjects_in(df, layer, audit_key, scopes) for layer, df in raw.items()]
    tokens = reduce(DataFrame.unionAll, [t for t, _ in named]).distinct()
    lost = reduce(DataFrame.unionAll, [n for _, n in named]).groupBy("run_id").agg(F.sum("unattributed").alias("unattributed"))
    read = every.groupBy("run_id").agg(F.count(F.lit(1)).alias("records"))
    extraction = manifest.join(read, "run_id", "left").join(lost, "run_id", "left").select(
        F.lit("extraction").alias("event"), "run_id", "technique", "purpose", F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("unattributed", F.lit(0)).alias("unattributed"), F.lit(single).alias("scoped"), F.lit("").alias("note"))
    export = sinks.export_events(every, messages, entries, schedule).select(
        "event", "run_id", F.lit(dims.REFERENCE_TECHNIQUE).alias("technique"), "purpose", "records", F.lit(0).cast("bigint").alias("unattributed"),
        F.lit(single).alias("scoped"), "note")
    events = logged(extraction.unionByName(export), f"{out}/log", now)
    subjects = events.where("event = 'extraction' or event = 'export'").select("seq", "run_id").join(tokens, "run_id").select("seq", "token")
    subjects.write.mode("append").parquet(f"{out}/log/subjects")

    registration = raw.get(dims.PA)
    k = privacy.k_anonymity(privacy.generalise(registration), "run_id") if registration is not None and any(
        q in registration.columns for q in dims.QUASI_IDENTIFIERS) else spark.createDataFrame([], "run_id string, k bigint")
    return DatasetRun(src.report(), costs, rules.across_purposes(runs), found, k, schedule, events, subjects)


def logged(events: DataFrame, path: str, now: Column) -> DataFrame:
    """Appends events to the log: extractions, then exports, then purges, by run. Returns them as they were appended."""
    before = log.last_seal(events.sparkSession, path)
    order = F.array_position(F.array(*[F.lit(e) for e in ("extraction", "export", "purge")]), F.col("event"))
    numbered = written(ordinals.sequenced(events.withColumn("at", now.cast("timestamp")), order, "run_id", start=before.total if before else 0), "events")
    log.append_log(numbered, path)
    return numbered


RETENTION = "run_id string, purpose string, retention_days int, written_at timestamp, delete_after timestamp, deletion_mechanism string, files array<string>"


def purge_due(spark: SparkSession, out: str, layers: list[str], now: Column, dry_run: bool = False, buckets: int = sinks.BUCKETS) -> DataFrame:
    """Erases what is due by now from everything under `out`, and logs it; runs erased before are left alone. Returns the events."""
    table = spark.read.schema(RETENTION).json(f"{out}/retention")
    if log.exists(spark, f"{out}/purged"):
        table = table.join(spark.read.parquet(f"{out}/purged"), "run_id", "left_anti")
    events = sinks.purge(spark, sinks.outputs(out, layers), table, now, dry_run, buckets)
    if dry_run:
        return events
    known = events.select("event", "run_id", F.lit(dims.REFERENCE_TECHNIQUE).alias("technique"), "purpose", F.lit(0).cast("bigint").alias("records"),
                          F.lit(0).cast("bigint").alias("unattributed"), F.lit(False).alias("scoped"), "note")
    appended = logged(known, f"{out}/log", now)
    events.select("run_id").distinct().write.mode("append").parquet(f"{out}/purged")
    return appended
