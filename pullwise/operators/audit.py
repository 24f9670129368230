"""The hash-chained audit log and the reports derived from it.

The log is a table of events (one row each), with the patients an event names in a long table
(seq, token) rather than in an array: a run that read everyone is many rows, never one huge cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import crypto, dates, masks
from pullwise.operators.ordinals import with_previous
from pullwise.session import written

CHAIN_LENGTH = 256          # events per chain, so building one is a bounded fold; anchors tie the chains together


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def chain_of(seq: Column, length: int = CHAIN_LENGTH) -> Column:
    return F.floor(seq / F.lit(length))


def build_chains(events: DataFrame, body: Column, seq: str = "seq", length: int = CHAIN_LENGTH, scope: str | None = None) -> DataFrame:
    """(chain, seq, prev_sha256, line): every line carries the hash of the line before it in its chain. ``scope``: a column whose
    values have chains of their own; it comes first.

    ``body`` is the event as a JSON object. Linking is sequential inside a chain and parallel across
    chains; a chain holds at most ``length`` events because it is a range of the unique sequence number."""
    keys = [scope, "chain"] if scope else ["chain"]
    rows = events.select(*keys[:-1], chain_of(F.col(seq), length).alias("chain"), F.struct(F.col(seq).alias("seq"), body.alias("body")).alias("e"))
    ordered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("es"))
    empty = F.array().cast("array<struct<seq:bigint,line:string>>")

    def link(out, e):                                               # each line named once, so it is hashed once
        prev = F.when(F.size(out) == 0, F.lit("")).otherwise(sha256(F.try_element_at(out, F.lit(-1))["line"]))
        line = F.concat(F.substring(e["body"], F.lit(1), F.length(e["body"]) - 1), F.lit(',"prev_sha256":"'), prev, F.lit('"}'))
        return F.concat(out, F.array(F.struct(e["seq"].cast("bigint").alias("seq"), line.alias("line"))))

    folded = ordered.select(*keys, F.aggregate("es", empty, link).alias("out"))
    prev = lambda x, i: F.when(i == 0, F.lit("")).otherwise(F.substring(x["line"], -66, 64))  # noqa: E731     it ends with the hash and "}
    made = F.transform("out", lambda x, i: F.struct(x["seq"].alias("seq"), prev(x, i).alias("prev_sha256"), x["line"].alias("line")))
    return folded.select(*keys, F.inline(made))


def verify_chains(lines: DataFrame, key: str = "chain", seq: str = "seq", block: int = 65536) -> DataFrame:
    """Per chain: intact?, and the index of the first line whose link is broken.

    Every line is checked against its own predecessor, in parallel; a chain of any length is cut into
    blocks and only block ends are matched across them."""
    linked = with_previous(lines, [key], seq, "line", "before", "index", block)
    want = F.when(F.col("before").isNull(), F.lit("")).otherwise(sha256(F.col("before")))
    broken = F.coalesce(F.get_json_object("line", "$.prev_sha256"), F.lit("")) != want
    return linked.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.min(F.when(broken, F.col("index"))).alias("broken_at")) \
        .withColumn("intact", F.col("broken_at").isNull())


def anchor_chains(lines: DataFrame, fan: int = 256) -> DataFrame:
    """(level, node, hash, n): at level 0 the hash of each chain's last line, above it hashes of up to ``fan`` nodes below, up to one
    root. Kept apart from the log, they show a chain that is gone, swapped or rewritten as a whole."""
    heads = written(lines.groupBy("chain").agg(sha256(F.max_by("line", "seq")).alias("hash"), F.count(F.lit(1)).alias("n"))
                    .select(F.lit(0).alias("level"), F.col("chain").alias("node"), "hash", "n"), "heads")
    top = heads.agg(F.max("node")).first()[0]
    levels, level = [heads], 0
    while top is not None and (top > 0 or level == 0):
        level, top = level + 1, top // fan
        below = levels[-1].groupBy(F.floor(F.col("node") / F.lit(fan)).alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("parts"))          # at most fan of them
        levels.append(below.select(F.lit(level).alias("level"), "node", sha256(F.array_join(F.transform("parts", lambda p: p["hash"]), "")).alias("hash"),
                                   F.size("parts").cast("bigint").alias("n")))
    return reduce(DataFrame.unionAll, levels)


def verify_anchors(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per chain: intact, changed (another last hash or number of lines), missing, or added since the anchors were taken."""
    now = lines.groupBy("chain").agg(sha256(F.max_by("line", "seq")).alias("hash_now"), F.count(F.lit(1)).alias("n_now"))
    then = anchors.where("level = 0").select(F.col("node").alias("chain"), "hash", "n")
    status = (F.when(F.col("hash_now").isNull(), "missing").when(F.col("hash").isNull(), "added")
              .when((F.col("hash") == F.col("hash_now")) & (F.col("n") == F.col("n_now")), "intact").otherwise("changed"))
    return then.join(now, "chain", "full").select("chain", status.alias("status"))


def event_body() -> Column:
    """An event as a JSON object, without the link to the line before."""
    return F.to_json(F.struct("seq", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), "event", "run_id",
                              "technique", "purpose", "records", "unattributed", "scoped", "note"))


def subjects_in(rows: DataFrame, layer: str, key: str, scopes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(run_id, token) of the patients the rows carry, and (run_id, unattributed) rows without a key.

    ``scopes(run_id, scoped_to)``: a run filtered to one patient always names that patient, and its keyless
    rows are that patient's."""
    name = dims.SUBJECT_KEY[layer]
    value = F.nullif(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit(None).cast("string")
    keyed = rows.select("run_id", value.alias("subject"))
    scoped_to = F.lit(None).cast("string")
    if scopes is not None:
        keyed, scoped_to = keyed.join(scopes, "run_id", "left"), F.col("scoped_to")
        named = keyed.select("run_id", "subject").unionAll(scopes.select("run_id", "scoped_to"))
    else:
        named = keyed
    tokens = named.where("subject is not null").distinct().select("run_id", crypto.token(F.col("subject"), key, crypto.WHOLE).alias("token"))
    lost = keyed.groupBy("run_id").agg(F.count_if(F.col("subject").isNull() & scoped_to.isNull()).alias("unattributed"))
    return tokens, lost


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last n events (a report of its own)."""
    return events.orderBy(F.col("seq").desc()).limit(n)


def run_facts(events: DataFrame) -> DataFrame:
    """One row per run: its extraction (else first) event, last export, last purge. Partial aggregation on seq."""
    is_a = lambda kind: F.col("event") == kind
    pick = F.struct("at", "technique", "purpose", "scoped", "records", "unattributed", "note", "seq")
    return events.groupBy("run_id").agg(
        F.min_by(F.when(is_a("extraction"), pick), F.when(is_a("extraction"), F.col("seq"))).alias("extraction"),
        F.min_by(pick, "seq").alias("first"),
        F.max_by(F.when(is_a("export"), pick), F.when(is_a("export"), F.col("seq"))).alias("export"),
        F.max_by(F.when(is_a("purge"), F.col("at")), F.when(is_a("purge"), F.col("seq"))).alias("erased_at"))


def access_activities(events: DataFrame, subjects: DataFrame, run_masks: DataFrame, retention: DataFrame) -> DataFrame:
    """What the log says about every patient: one row per (token, run) that read them.

    ``subjects(seq, token)``; ``run_masks(run_id, field_mask)``; ``retention(run_id, delete_after)``."""
    touched = events.select("seq", "run_id").join(subjects, "seq").select("token", "run_id").distinct()
    facts = run_facts(events).join(run_masks.select("run_id", "field_mask"), "run_id", "left").join(
        retention.select("run_id", "delete_after"), "run_id", "left")
    main = F.coalesce(F.col("extraction"), F.col("first"))
    cats = F.when(F.col("extraction").isNotNull(), masks.categories_of_fields(F.coalesce("field_mask", F.lit(0)))).otherwise(0)
    note = F.col("export.note")
    facts = facts.select(
        "run_id", main["at"].alias("at"), main["technique"].alias("technique"), main["purpose"].alias("purpose"),
        cats.alias("cat_mask"), F.col("export").isNotNull().alias("exported"),
        (note.contains("pseudonymised") & ~note.contains("RAW")).alias("pseudonymised"),
        F.col("delete_after").alias("erase_after"), "erased_at")
    return touched.join(facts, "run_id")


def access_totals(activities: DataFrame) -> DataFrame:
    """Per patient: activities per purpose and the categories read."""
    return activities.groupBy("token").agg(
        F.count(F.lit(1)).alias("activities"),
        *[F.count_if(F.col("purpose") == p).alias(p) for p in dims.PURPOSES],
        F.bit_or("cat_mask").alias("cat_mask"))


def unattributed_runs(events: DataFrame) -> DataFrame:
    """Runs that read keyless records without being scoped to one patient."""
    return events.where((F.col("event") == "extraction") & (F.col("unattributed") > 0) & ~F.col("scoped")).agg(
        F.count_distinct("run_id").alias("unattributed_runs"))


def processing_record(events: DataFrame, subjects: DataFrame, run_masks: DataFrame) -> DataFrame:
    """The record of processing activities, one row per purpose; purposes with no events are listed too.

    Events are aggregated per (purpose, run) before the run's fields are joined, and distinct patients are
    counted by a two-level aggregate, so a purpose or a run with most of the log is never one task's work."""
    kind = lambda k: F.col("event") == k
    per_run = events.groupBy("purpose", "run_id").agg(
        F.count_if(kind("extraction")).alias("runs"), F.sum(F.when(kind("extraction"), F.col("records")).otherwise(0)).alias("records"),
        F.count_if(kind("export")).alias("exports"), F.count_if(kind("export") & F.col("note").contains("RAW")).alias("raw_exports"),
        F.count_if(kind("purge")).alias("erasures"), F.min("at").alias("first"), F.max("at").alias("last"),
        F.collect_set(F.when(kind("extraction"), F.col("technique"))).alias("techniques"))
    fields = F.when(F.col("runs") > 0, F.coalesce("field_mask", F.lit(0).cast("bigint"))).otherwise(0)
    by_purpose = per_run.join(run_masks.select("run_id", "field_mask"), "run_id", "left").groupBy("purpose").agg(
        *[F.sum(c).alias(c) for c in ("runs", "records", "exports", "raw_exports", "erasures")],
        F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or(fields).alias("field_mask"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("techniques")))).alias("techniques"))
    read = events.where(kind("extraction")).select("seq", "purpose").join(subjects, "seq")
    patients = read.groupBy("purpose").agg(F.count_distinct("token").alias("patients"))
    spark = events.sparkSession
    purposes = spark.createDataFrame(
        [(p, dims.LAWFUL_BASES[p][0], dims.PURPOSE_POLICY[p]["max_retention_days"]) for p in dims.PURPOSES],
        "purpose string, lawful_basis string, retention_ceiling_days int")
    return (purposes.join(by_purpose, "purpose", "left").join(patients, "purpose", "left")
            .fillna(0, ["runs", "records", "exports", "raw_exports", "erasures", "patients", "field_mask"]))


def field_listing(field_mask: Column) -> Column:
    """'category: field, field; ...' of a field mask, categories and fields sorted and distinct."""
    parts = []
    for c in sorted(dims.CATEGORIES):
        names = sorted({f for layer, fs in dims.FIELD_CATALOGUE.items() for f, cat in fs.items() if cat == c})
        bits = {n: sum(b for (layer, f), b in dims.FIELD_BIT.items() if f == n and dims.FIELD_CATALOGUE[layer][f] == c) for n in names}
        listed = F.concat_ws(", ", *[F.when(masks.has(field_mask, bits[n]), F.lit(n)) for n in names])
        parts.append(F.when(listed != "", F.concat(F.lit(f"{c}: "), listed)))
    return F.concat_ws("; ", *parts)


def subject_reads(events: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per technique and patient: extraction runs that read them, of how many."""
    extractions = events.where("event = 'extraction'").select("seq", "run_id", "technique")
    pairs = extractions.join(subjects, "seq").select("technique", "run_id", "token").distinct()
    runs = extractions.groupBy("technique", "run_id").agg(F.lit(1).alias("one")).groupBy("technique").agg(F.count(F.lit(1)).alias("runs"))
    return pairs.groupBy("technique", "token").agg(F.count(F.lit(1)).alias("runs_touching")).join(runs, "technique")


# --- breach ------------------------------------------------------------------------------------------
# fixed values: the gradings and consequences a breach notice leads with
SEVERITY = ("high -- identifiable clinical data", "high -- identifiable personal data",
            "moderate -- sensitive data, identifiers pseudonymised", "low -- pseudonymised administrative data")


def exposed_exports(exposures: DataFrame, events: DataFrame, run_masks: DataFrame, retention: DataFrame, now: Column) -> DataFrame:
    """Per exposed (breach, run): what its last export held. Runs the log has no export of are ``unknown``."""
    facts = run_facts(events)
    joined = (exposures.distinct().join(facts, "run_id", "left").join(run_masks.select("run_id", "field_mask"), "run_id", "left")
              .join(retention.select("run_id", "delete_after"), "run_id", "left"))
    known = F.col("export").isNotNull()
    scoped = F.coalesce(F.col("extraction.scoped"), F.lit(False))
    cats = F.when(F.col("extraction").isNotNull(), masks.categories_of_fields(F.coalesce("field_mask", F.lit(0)))).otherwise(0)
    return joined.select(
        "breach_id", "run_id", known.alias("known"), F.col("export.seq").alias("export_seq"), F.col("export.purpose").alias("purpose"),
        F.col("export.records").alias("records"), (~F.col("export.note").contains("RAW")).alias("pseudonymised"),
        F.when(known, cats).otherwise(0).alias("cat_mask"), (known & dates.overdue(F.col("delete_after"), now)).alias("overdue"),
        F.when(known & ~scoped, F.col("export.unattributed")).otherwise(0).alias("unattributed"))


def affected_tokens(exports: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct (breach, token) of the patients the exposed exports held."""
    return (exports.where("known").select("breach_id", F.col("export_seq").alias("seq")).join(subjects, "seq")
            .select("breach_id", "token").distinct())


def assess_breaches(exports: DataFrame, affected: DataFrame, discovered_at: Column) -> DataFrame:
    """One assessment per breach."""
    has = lambda c: masks.has(F.col("cat_mask"), dims.CATEGORY_BIT[c])
    raw = F.col("known") & ~F.col("pseudonymised") & has(dims.DI)
    per = exports.groupBy("breach_id").agg(
        F.count_if("known").alias("exports"), F.count_if(~F.col("known")).alias("unknown"),
        F.coalesce(F.bool_or(raw), F.lit(False)).alias("raw_identifiers"), F.bit_or("cat_mask").alias("cat_mask"),
        F.count_if("overdue").alias("overdue"), F.sum("unattributed").alias("unattributed"))
    counted = affected.groupBy("breach_id").agg(F.count(F.lit(1)).alias("affected"))
    severity = (F.when(F.col("raw_identifiers") & has(dims.CL), SEVERITY[0]).when(F.col("raw_identifiers"), SEVERITY[1])
                .when(has(dims.CL) | has(dims.FI), SEVERITY[2]).otherwise(SEVERITY[3]))
    impact = (F.when(F.col("raw_identifiers") & has(dims.CL), "health information linkable")
              .when(F.col("raw_identifiers") & has(dims.CO), "unwanted contact").when(F.col("raw_identifiers"), "impersonation")
              .otherwise("low risk, codes only"))
    steps = F.concat_ws(",", F.lit("beware of calls"), F.when(has(dims.FI), "check statements"),
                        F.when(F.col("raw_identifiers"), "report contact"))
    return per.join(counted, "breach_id", "left").fillna(0, ["affected"]).withColumns({
        "severity": severity, "impact": impact, "safety_steps": steps, "report_due": dates.report_due(discovered_at)})


def intimations(affected: DataFrame, notices: DataFrame) -> DataFrame:
    """Per breach: patients due a notice, notices sent to patients, the last of them."""
    due = affected.groupBy("breach_id").agg(F.count(F.lit(1)).alias("due"))
    sent = notices.where("recipient <> 'board'").groupBy("breach_id").agg(
        F.count(F.lit(1)).alias("sent"), F.max("at").alias("last_sent"))
    return due.join(sent, "breach_id", "left").fillna(0, ["sent"])


def resolve(affected: DataFrame, register: DataFrame, token: Column) -> DataFrame:
    """Record numbers behind the affected tokens, from the register the key holder has."""
    return affected.join(register.select(F.col("mrn"), token.alias("token")), "token").select("breach_id", "mrn")
