"""The stored log and the purge, end to end: appends that are verified, forged logs held against kept seals, outputs after a purge."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import crypto
from pullwise.operators import audit
from pullwise.registry.base import query, with_views
from pullwise.registry.interop import KEY, WHEN
from pullwise.registry.reports import token_sql
from pullwise.session import shared_folder
from pullwise.sinks import exports as sinks
from pullwise.sinks import log

PART = 250          # events of an append
DUE = "1996-06-30 00:00:00"


def folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def parts(seq: str = "seq"):
    return F.floor(F.col(seq) / PART)


APPENDS = f"""
parts as (select dense_rank() over (order by seq // {PART}) - 1 as batch, * from audit_events)"""


@query("log_verified", with_views("""
select batch, count(*) as n, true as intact, true as linked, true as consistent from parts group by 1""", "audit_events", extra=APPENDS))
def log_verified(t):
    """The log stored in appends, and each append verified: its lines, its link and its place in all appends."""
    path = folder(t, "log")
    log.append_log(t["audit_events"], path, parts())
    return log.verify_log(t.spark, path)


@query("log_forged", with_views("""
select batch, count(*) filter (where seq % 997 = 7) = 0 as intact, case when batch > (select max(batch) - 2 from parts) then 'truncated'
 when batch >= (select min(batch) from parts where seq % 997 = 7) then 'rewritten' else 'agrees' end as status from parts group by 1""", "audit_events", extra=APPENDS))
def log_forged(t):
    """Lines edited in place, and a log written anew without its last appends, held against the seals that were kept."""
    path, edited, forged = folder(t, "log"), folder(t, "edited"), folder(t, "forged")
    events = t["audit_events"]
    log.append_log(events, path, parts())
    kept = t.spark.read.parquet(f"{path}/seals")
    lines = t.spark.read.parquet(f"{path}/lines")
    lines.withColumn("line", F.when(F.col("seq") % 997 == 7, F.replace("line", F.lit('"event"'), F.lit('"Event"'))).otherwise(F.col("line"))).write.parquet(f"{edited}/lines")
    kept.write.parquet(f"{edited}/seals")
    last = kept.agg(F.max("batch")).first()[0]
    covered = lines.where(F.col("batch") <= last - 2).select("seq")
    changed = events.join(covered, "seq", "left_semi").withColumn("note", F.when(F.col("seq") % 997 == 7, F.lit("nothing here")).otherwise(F.col("note")))
    log.append_log(changed, forged, parts())
    return log.verify_log(t.spark, edited).select("batch", "intact").join(log.verify_against(t.spark, forged, kept), "batch")


@query("purged_outputs", with_views(f"""
select x.run_id, case when g.run_id is null then count(*) else 0 end as messages, g.run_id is not null as erased from export_{dims.PA} x
 left join (select run_id from retention where delete_after <= timestamp '{DUE}') g on g.run_id = x.run_id group by x.run_id, g.run_id""",
    f"export_{dims.PA}", "retention"))
def purged_outputs(t):
    """Messages that each registration export has left after the purge, and whether the purge says so."""
    out = folder(t, "outputs")
    raw = t[f"export_{dims.PA}"]
    sinks.write_export(dims.PA, raw, out, KEY, WHEN, buckets=16)
    paths = sinks.outputs(out, [dims.PA])
    events = sinks.purge(t.spark, paths, t["retention"], F.lit(DUE).cast("timestamp_ntz"), buckets=16)
    left = sinks.read_output(t.spark, paths[0]).groupBy("run_id").agg(F.count(F.lit(1)).alias("messages"))
    return raw.select("run_id").distinct().join(left, "run_id", "left").join(events.select("run_id", F.lit(True).alias("erased")), "run_id", "left").select(
        "run_id", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("erased", F.lit(False)).alias("erased"))


SCOPED = "(select run_id, min(mrn) as scoped_to from x where row_ix % 4 = 1 group by 1)"


@query("row_subjects", with_views(f"""
select r.run_id, (select count(distinct s) from (select {token_sql('mrn', crypto.DEV_AUDIT_KEY)} as s, run_id from x union all
  select {token_sql('scoped_to', crypto.DEV_AUDIT_KEY)}, run_id from scopes) n where n.run_id = r.run_id) as subjects,
 count(*) filter (where mrn is null and c.scoped_to is null) as unattributed
from x r left join scopes c on c.run_id = r.run_id group by r.run_id""", f"export_{dims.PA}",
    extra=f"x as (select run_id, row_ix, case when row_ix % 3 = 0 then null else mrn end as mrn from export_{dims.PA}), scopes as {SCOPED}"))
def row_subjects(t):
    """Patients that the rows of each run name, and rows without one; a run scoped to a patient names that patient, whose rows its keyless ones are."""
    rows = t[f"export_{dims.PA}"].select("run_id", "row_ix", F.when(F.col("row_ix") % 3 != 0, F.col("mrn")).alias("mrn"))
    scopes = rows.where("row_ix % 4 = 1").groupBy("run_id").agg(F.min("mrn").alias("scoped_to"))
    tokens, lost = audit.subjects_in(rows, dims.PA, crypto.audit_key(t.spark), scopes)
    named = tokens.groupBy("run_id").agg(F.count_distinct("token").alias("subjects"))
    return lost.join(named, "run_id", "left").select("run_id", F.coalesce("subjects", F.lit(0)).alias("subjects"), "unattributed")
