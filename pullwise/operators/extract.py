"""Extraction over the layers: what each technique pulls for each task, metered.

The layers are scanned **once**. Every row is reduced to its presence pattern - which catalogue fields it
carries, as a bitmask - and rows are counted per (layer, pattern, task subject, minor?). A layer has at
most ten fields, so this profile holds at most a few thousand rows whatever the layer's size. Every
technique, task and repeat is then answered from the profile: masking the pattern with the fields asked
for gives records, values, distinct fields and categories exactly, so cost no longer grows with
techniques x tasks x repeats.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import masks
from pullwise.functions.dates import minor
from pullwise.functions.numeric import ratio

TODAY = date(2026, 1, 1)


def fetch(layer: DataFrame, fields: list[str], where: dict | None = None) -> DataFrame:
    """Projection and conjunctive equality filter: absent fields are left out, values compare as text,
    a filter on a column the layer lacks yields nothing."""
    cond = reduce(Column.__and__, [F.col(k).cast("string") == str(v) if k in layer.columns else F.lit(False)
                                   for k, v in (where or {}).items()], F.lit(True))
    return layer.where(cond).select(*[f for f in fields if f in layer.columns])


def source_fields(layers: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(layer, catalogue field) pairs a source carries."""
    return [(name, f) for name, df in layers.items() for f in dims.FIELD_CATALOGUE[name] if f in df.columns]


def shortfall(layers: dict[str, DataFrame], tasks: dict) -> str | None:
    """Why a source cannot be scored, or None when it can."""
    if not layers:
        return "no layer was understood"
    needed = {(lay, f) for spec in tasks.values() for lay, fs in spec[4].items() for f in fs}
    if not needed & set(source_fields(layers)):
        return f"none of the {len(needed)} fields the tasks need is carried"
    return None


def first_subject(layers: dict[str, DataFrame]) -> DataFrame:
    """The first patient of the registration layer, as one row (subject)."""
    if dims.PA not in layers or "mrn" not in layers[dims.PA].columns:
        spark = next(iter(layers.values())).sparkSession
        return spark.createDataFrame([(None,)], "subject string")
    return layers[dims.PA].agg(F.min_by(F.col("mrn"), F.col("row_ix")).alias("subject"))


def pull_rows(layers: dict[str, DataFrame], needed: dict[str, tuple[str, ...]], subject: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows a task needs: exactly its fields, of one subject where one is given (a one-row frame)."""
    out = {}
    bound = None if subject is None else bound_to(subject)
    for name, fields in needed.items():
        if name not in layers:
            continue
        df = layers[name]
        if bound is not None:
            df = df.where(F.col(dims.SUBJECT_KEY[name]) == bound)
        out[name] = df.select("row_ix", *[f for f in fields if f in df.columns])
    return out


def bound_to(subject: DataFrame) -> Column:
    """The value of a one-row frame, found once and then a constant in every layer's scan."""
    row = subject.first()
    return F.lit(None if row is None else row[0]).cast("string")


def presence(layer: str, df: DataFrame) -> Column:
    bits = [F.when(F.col(f).isNotNull(), F.lit(dims.FIELD_BIT[layer, f])).otherwise(0)
            for f in dims.FIELD_CATALOGUE[layer] if f in df.columns]
    return sum(bits, F.lit(0)).cast("bigint")


def presence_profile(layers: dict[str, DataFrame], subject: DataFrame, today: date = TODAY) -> DataFrame:
    """(layer, mask, own, minor, n): rows per presence pattern, the bound subject's apart.

    ``subject`` is a one-row frame."""
    parts = []
    bound = bound_to(subject)
    for name, df in layers.items():
        key = dims.SUBJECT_KEY[name]
        own = F.coalesce(F.col(key) == bound, F.lit(False)) if key in df.columns else F.lit(False)
        young = minor(F.col("date_of_birth"), today) if "date_of_birth" in df.columns else F.lit(False)
        parts.append(df.select(F.lit(name).alias("layer"), presence(name, df).alias("mask"), own.alias("own"),
                               young.alias("minor"))
                     .groupBy("layer", "mask", "own", "minor").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionAll, parts)


def technique_requests(tasks: dict, techniques: list[str]) -> list[tuple]:
    """(technique, task_id, layer, want, scoped, needed): what each technique asks for. Pure configuration.

    ``needed`` marks the layers a single-subject task needs, whose own rows are the necessary records."""
    out = []
    for tech in techniques:
        without = tech.removeprefix("without-") if tech.startswith("without-") else None
        for task_id, (_, single, _, _, needed) in tasks.items():
            if tech == dims.BASELINE_TECHNIQUE:
                out += [(tech, task_id, layer, dims.layer_mask(layer), False, single and layer in needed)
                        for layer in dims.LAYERS]
            else:
                for layer, fields in needed.items():
                    want = dims.layer_mask(layer) if without == "field_list" else dims.field_mask(layer, fields)
                    out.append((tech, task_id, layer, want, single and without != "scope", single))
    return out


def technique_manifests(tasks: dict, techniques: list[str], transport_secure: bool | None = None) -> list[tuple]:
    """One flat manifest per technique and task, as the deployment's register lets it be declared."""
    out = []
    for tech in techniques:
        without = tech.removeprefix("without-") if tech.startswith("without-") else None
        for task_id, (purpose, *_rest) in tasks.items():
            tls = transport_secure is not False
            if tech == dims.BASELINE_TECHNIQUE:
                row = (False, None, None, None, None, tls, False, False, False, None, False, False, False, None, False)
            else:
                said = without != "manifest"
                kept = without != "retention"
                ceiling = dims.PURPOSE_POLICY[purpose]["max_retention_days"]
                row = (True, "legitimate_use", dims.LAWFUL_BASES[purpose][0] if said else None,
                       min(dims.TECHNIQUE_RETENTION_DAYS, ceiling) if kept else None,
                       dims.REGISTER["deletion_mechanism"][0] if kept else None,
                       tls, True, True, without != "pseudonymise",
                       dims.REGISTER["notice"][0] if said else None, said, said and dims.NOTICE_MACHINE_READABLE,
                       True, dims.REGISTER["accountable_party"][0] if said else None, said)
            out.append((f"{task_id}--{tech}", tech, task_id, purpose, *row))
    return out


MANIFEST_SCHEMA = (
    "run_id string, technique string, task_id string, purpose string, purpose_specified boolean, basis_type string, "
    "basis_reference string, retention_days int, deletion_mechanism string, transport_encrypted boolean, "
    "at_rest_encrypted boolean, access_controlled boolean, identifiers_pseudonymised boolean, notice_reference string, "
    "notice_covers_purpose boolean, notice_machine_readable boolean, audit_log_enabled boolean, "
    "accountable_party string, processing_record_kept boolean")


def task_rows(spark: SparkSession, tasks: dict) -> DataFrame:
    rows = [(t, p, single, dims.task_mask(needed), dims.category_mask(()), ) for t, (p, single, _, _, needed) in tasks.items()]
    return spark.createDataFrame([r[:4] for r in rows], "task_id string, purpose string, single_subject boolean, needed_mask bigint")


def pull_patterns(spark: SparkSession, profile: DataFrame, requests: list[tuple]) -> DataFrame:
    """Requests answered from the profile: one row per technique, task, layer and pattern; one without rows for a request that
    nothing answers, so no request is lost."""
    asked = spark.createDataFrame(requests, "technique string, task_id string, layer string, want bigint, scoped boolean, needed boolean")
    return answered(profile, asked)


def answered(profile: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests (layer, want, scoped, ...) with the patterns that answer them; the profile is bounded by configuration (at most
    2^10 patterns per layer), requests needn't be."""
    found = profile.select(F.col("layer").alias("of"), "mask", "own", "minor", "n")
    met = asked.join(F.broadcast(found), (F.col("layer") == F.col("of")) & (~F.col("scoped") | F.col("own")), "left")
    return met.drop("of").fillna(0, ["mask", "n"]).fillna(False, ["own", "minor"]).withColumn("got", F.col("mask").bitwiseAND(F.col("want")))


def meter(pulls: DataFrame, *keys: str) -> DataFrame:
    """Records, values, fetches, distinct fields, categories, minors, scope and the necessary records
    (the subject's own rows over the needed layers) per technique and task, or other keys, in one aggregate."""
    dob = dims.FIELD_BIT[dims.PA, "date_of_birth"]
    return pulls.groupBy(*(keys or ("technique", "task_id"))).agg(
        F.count_distinct("layer").alias("fetches"), F.sum("n").alias("records"),
        F.sum(F.col("n") * F.bit_count("got")).alias("fields_pulled"), F.bit_or("got").alias("field_mask"),
        F.sum(F.when(F.col("minor") & masks.has(F.col("got"), dob), F.col("n")).otherwise(0)).alias("minor_records"),
        F.every("scoped").alias("scope_on_subject"),
        F.when(F.bool_or("needed"), F.sum(F.when(F.col("own") & F.col("needed"), F.col("n")).otherwise(0))).alias("necessary"),
    ).withColumn("cat_mask", masks.categories_of_fields(F.col("field_mask")))


def necessary_records(spark: SparkSession, profile: DataFrame, tasks: dict) -> DataFrame:
    """Per single-subject task: the subject's own rows over the layers it needs (null otherwise)."""
    wanted = spark.createDataFrame([(t, lay) for t, spec in tasks.items() if spec[1] for lay in spec[4]],
                                   "task_id string, layer string")
    own = profile.where("own").groupBy("layer").agg(F.sum("n").alias("n"))
    return wanted.join(own, "layer", "left").groupBy("task_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("necessary"))


def coverage_ceiling(spark: SparkSession, profile: DataFrame, tasks: dict) -> DataFrame:
    """Per task: fields needed, of those carried by the source, of those the task can obtain."""
    seen = profile.agg(F.coalesce(F.bit_or("mask"), F.lit(0)).alias("anywhere"),
                       F.coalesce(F.bit_or(F.when(F.col("own"), F.col("mask"))), F.lit(0)).alias("of_subject")).first()    # two numbers
    t = task_rows(spark, tasks).withColumns({"anywhere": F.lit(seen["anywhere"]), "of_subject": F.lit(seen["of_subject"])})
    found = F.col("needed_mask").bitwiseAND(F.col("anywhere"))
    own = F.when(F.col("single_subject"), found.bitwiseAND(F.col("of_subject"))).otherwise(found)
    return t.select("task_id", F.bit_count("needed_mask").alias("needed"), F.bit_count(found).alias("in_source"),
                    F.bit_count(own).alias("reachable"))


def source_ceiling(ceiling: DataFrame) -> DataFrame:
    """The share of needed fields the tasks could obtain; null when all of them."""
    share = ratio(F.sum("reachable"), F.sum("needed"))
    return ceiling.agg(F.sum("needed").alias("needed"), F.sum("in_source").alias("in_source"),
                       F.sum("reachable").alias("reachable"), F.when(share < 1.0, share).alias("ceiling"))


def with_cost(metered: DataFrame) -> DataFrame:
    """Coverage, excess and record excess beside the counts. Needs ``needed_mask`` and ``necessary``."""
    distinct, needed = F.bit_count("field_mask"), F.bit_count("needed_mask")
    matched = F.bit_count(F.col("field_mask").bitwiseAND(F.col("needed_mask")))
    return metered.withColumns({
        "distinct_fields": distinct, "needed_fields": needed, "matched_fields": matched,
        "coverage": ratio(matched, needed), "excess_ratio": ratio(distinct, needed),
        "record_excess": ratio(F.col("records"), F.col("necessary"))})


def combine(costs: DataFrame, *keys: str) -> DataFrame:
    """Micro-averages over runs; record excess only over runs with a scope."""
    scoped = F.col("necessary").isNotNull()
    sums = costs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in (
            "fetches", "records", "fields_pulled", "distinct_fields", "needed_fields", "matched_fields", "necessary")],
        F.sum(F.when(scoped, F.col("records"))).alias("scoped_records"))
    return sums.withColumns({
        "coverage": ratio(F.col("matched_fields"), F.col("needed_fields")),
        "excess_ratio": ratio(F.col("distinct_fields"), F.col("needed_fields")),
        "record_excess": ratio(F.col("scoped_records"), F.col("necessary"))})


def per_pass(combined: DataFrame, passes: Column, *counts: str) -> DataFrame:
    """Counts divided by the passes, halves to even; ratios unchanged."""
    return combined.withColumns({c: F.bround(F.col(c) / passes).cast("bigint") for c in counts})
