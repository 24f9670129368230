"""Extraction, metering and coverage over the five layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions.dates import age_on, minor
from pullwise.operators import extract, pulls
from pullwise.plans import benchmark
from pullwise.registry import ingestion  # noqa: F401  its views of decisions
from pullwise.registry.base import query, with_views
from pullwise.registry.scoring import RUN_SETS, scored_sql
from pullwise.registry.techniques import mean3
from pullwise.sources.tables import add_view

LAYER_TABLES = dims.LAYERS


def cells_sql() -> str:
    """Every non-null value of every layer, as (layer, row_ix, subj, field)."""
    parts = []
    for layer in dims.LAYERS:
        fields = list(dims.FIELD_CATALOGUE[layer])
        names = ", ".join(f"'{f}'" for f in fields)
        vals = ", ".join(f"cast({f} as varchar)" for f in fields)
        parts.append(f"select layer, row_ix, subj, field from (select '{layer}' as layer, row_ix, {dims.SUBJECT_KEY[layer]} as subj, "
                     f"unnest([{names}]) as field, unnest([{vals}]) as v from {layer}) where v is not null")
    return "cells as (" + " union all ".join(parts) + ")"


def rows_sql() -> str:
    return "layer_rows as (" + " union all ".join(
        f"select '{layer}' as layer, row_ix, {dims.SUBJECT_KEY[layer]} as subj from {layer}" for layer in dims.LAYERS) + ")"


def technique_sql(tasks: dict) -> str:
    names = ", ".join(f"('{t}')" for t in benchmark.TECHNIQUES)
    ids = ", ".join(f"'{t}'" for t in tasks)
    return f"""
first_subject as (select mrn from patient_administration order by row_ix limit 1),
techniques(technique) as (values {names}),
the_tasks as (select * from tasks where task_id in ({ids})),
req_layer as (
 select technique, t.task_id, l.layer, t.single_subject and technique not in ('without-scope', 'unconstrained') as scoped
 from techniques, the_tasks t, (select distinct layer from field_catalogue) l
 where technique = 'unconstrained' or exists (select 1 from task_needed n where n.task_id = t.task_id and n.layer = l.layer)),
req as (
 select q.*, c.field, c.category from req_layer q join field_catalogue c using (layer)
 where q.technique in ('unconstrained', 'without-field_list')
  or exists (select 1 from task_needed n where n.task_id = q.task_id and n.layer = q.layer and n.field = c.field)),
{cells_sql()},
{rows_sql()},
got as (select technique, task_id, q.layer, row_ix, q.field, q.category from req q join cells c on c.layer = q.layer and c.field = q.field
 and (not q.scoped or c.subj = (select mrn from first_subject))),
rec as (select technique, task_id, count(*) as records, count(distinct q.layer) as fetches from req_layer q join layer_rows r on r.layer = q.layer
 and (not q.scoped or r.subj = (select mrn from first_subject)) group by 1, 2),
val as (select technique, task_id, count(*) as fields_pulled, count(distinct layer || '/' || field) as distinct_fields,
  count(distinct case when exists (select 1 from task_needed n where n.task_id = got.task_id and n.layer = got.layer and n.field = got.field) then layer || '/' || field end) as matched_fields
 from got group by 1, 2),
need as (select task_id, count(*) as needed_fields from task_needed group by 1),
necessary as (select t.task_id, (select count(*) from layer_rows r where r.subj = (select mrn from first_subject)
  and r.layer in (select layer from task_needed n where n.task_id = t.task_id)) as necessary from the_tasks t where t.single_subject),
pulled as (select distinct task_id || '--' || technique as run_id, category from got),
runs as (
 select t.task_id || '--' || technique as run_id, technique, t.task_id, t.purpose, technique <> 'unconstrained' as purpose_specified,
  case when technique <> 'unconstrained' then 'legitimate_use' end as basis_type,
  case when technique not in ('unconstrained', 'without-manifest') then 'cited' end as basis_reference,
  case when technique not in ('unconstrained', 'without-retention') then 30 end as retention_days,
  case when technique not in ('unconstrained', 'without-retention') then 'cited' end as deletion_mechanism,
  true as transport_encrypted, technique <> 'unconstrained' as at_rest_encrypted, technique <> 'unconstrained' as access_controlled,
  technique not in ('unconstrained', 'without-pseudonymise') as identifiers_pseudonymised,
  case when technique not in ('unconstrained', 'without-manifest') then 'cited' end as notice_reference,
  technique not in ('unconstrained', 'without-manifest') as notice_covers_purpose, technique <> 'unconstrained' as audit_log_enabled,
  case when technique not in ('unconstrained', 'without-manifest') then 'cited' end as accountable_party,
  technique not in ('unconstrained', 'without-manifest') as processing_record_kept, cast(null as varchar) as secondary_use,
  case when n.necessary is not null then r.records end as scope_pulled, n.necessary as scope_necessary
 from techniques cross join the_tasks t join rec r using (technique, task_id) left join necessary n using (task_id))
"""


TECH_VIEWS = (*LAYER_TABLES, "field_catalogue", "tasks", "task_needed", "purpose_policy", "purpose_allowed")
COST_COLUMNS = ["technique", "task_id", "compliance_score", "fetches", "records", "fields_pulled", "distinct_fields",
                "needed_fields", "matched_fields", "necessary", "coverage", "excess_ratio", "record_excess"]


@query("technique_costs", with_views("""
select technique, task_id, s.score::double as compliance_score, r.fetches, r.records, v.fields_pulled, v.distinct_fields::int as distinct_fields, n.needed_fields::int as needed_fields, v.matched_fields::int as matched_fields,
 k.necessary, round(v.matched_fields * 1.0 / n.needed_fields, 3)::double as coverage, round(v.distinct_fields * 1.0 / n.needed_fields, 3)::double as excess_ratio,
 (case when k.necessary > 0 then round(r.records * 1.0 / k.necessary, 3) end)::double as record_excess
from scored s join rec r using (technique, task_id) left join val v using (technique, task_id) join need n using (task_id) left join necessary k using (task_id)
""", *TECH_VIEWS, extra=technique_sql(dims.TASKS) + "," + RUN_SETS + "," + scored_sql("runs")))
def technique_costs(t):
    """How compliant and how excessive each technique's pull is, per task (the flagship query)."""
    return benchmark.technique_costs(t.spark, t.layers()).select(*COST_COLUMNS)


@query("ablation", with_views("""
select technique, """ + mean3("score") + """ as mean_score, concat_ws(',', case when min(dm) < 1 then 'DM-01' end, case when min(lb) < 1 then 'LB-01' end,
 case when min(sl) < 1 then 'SL-01' end, case when min(ss) < 1 then 'SS-01' end, case when min(pl) < 1 then 'PL-01' end,
 case when min(nt) < 1 then 'NT-01' end, case when min(ac) < 1 then 'AC-01' end) as rules_below,
 sum(r.records)::bigint as records, sum(coalesce(m.minors, 0))::bigint as minor_records
from scored s join rec r using (technique, task_id) left join young m using (technique, task_id) group by 1""",
    *TECH_VIEWS, extra=technique_sql(dims.TASKS) + "," + RUN_SETS + "," + scored_sql("runs") + """,
young as (select technique, task_id, count(*) as minors from got join patient_administration p on p.row_ix = got.row_ix
 where got.layer = 'patient_administration' and got.field = 'date_of_birth' and date_diff('year', cast(p.date_of_birth as date), date '2026-01-01')
  - (case when strftime(cast(p.date_of_birth as date), '%m%d') > '0101' then 1 else 0 end) < 18 group by 1, 2)"""))
def ablation(t):
    """The reference technique minus one design choice at a time."""
    return benchmark.ablation_table(benchmark.technique_costs(t.spark, t.layers()))


@query("technique_totals", with_views("""
select technique, count(*) as runs, sum(r.fetches)::bigint as fetches, sum(r.records)::bigint as records, sum(v.fields_pulled)::bigint as fields_pulled,
 round(sum(v.matched_fields) / sum(n.needed_fields), 3)::double as coverage, round(sum(v.distinct_fields) / sum(n.needed_fields), 3)::double as excess_ratio,
 round(sum(r.records) filter (where k.necessary is not null) / nullif(sum(k.necessary), 0), 3)::double as record_excess
from rec r join val v using (technique, task_id) join need n using (task_id) left join necessary k using (task_id) group by 1
""", *TECH_VIEWS, extra=technique_sql(dims.TASKS)))
def technique_totals(t):
    """One pass of the workload per technique: micro-averaged cost."""
    return extract.combine(benchmark.technique_costs(t.spark, t.layers()), "technique").select(
        "technique", "runs", "fetches", "records", "fields_pulled", "coverage", "excess_ratio", "record_excess")


@query("coverage_ceiling", with_views("""
select t.task_id, (select count(*) from task_needed n where n.task_id = t.task_id)::int as needed,
 (select count(*) from task_needed n where n.task_id = t.task_id and exists (select 1 from seen s where s.layer = n.layer and s.field = n.field))::int as in_source,
 (select count(*) from task_needed n where n.task_id = t.task_id and exists (select 1 from seen s where s.layer = n.layer and s.field = n.field and (not t.single_subject or s.own)))::int as reachable
from tasks t""", *LAYER_TABLES, "tasks", "task_needed", extra=cells_sql() + """,
seen as (select layer, field, bool_or(subj = (select mrn from patient_administration order by row_ix limit 1)) as own from cells group by 1, 2)"""))
def coverage_ceiling(t):
    """What each task could obtain from the source."""
    layers = t.layers()
    profile = extract.presence_profile(layers, extract.first_subject(layers))
    return extract.coverage_ceiling(t.spark, profile, {**dims.TASKS, **dims.INJECTION_TASKS})


@query("subject_scope", with_views("""
select t.task_id, (select mrn from patient_administration order by row_ix limit 1) as subject,
 (select count(*) from layer_rows r where r.subj = (select mrn from patient_administration order by row_ix limit 1)
   and r.layer in (select layer from task_needed n where n.task_id = t.task_id)) as necessary
from tasks t where t.single_subject""", *LAYER_TABLES, "tasks", "task_needed", extra=rows_sql()))
def subject_scope(t):
    """Each single-subject task bound to the first patient, and that patient's own records."""
    layers = t.layers()
    subject = extract.first_subject(layers)
    profile = extract.presence_profile(layers, subject)
    return extract.necessary_records(t.spark, profile, {**dims.TASKS, **dims.INJECTION_TASKS}).withColumn(
        "subject", extract.bound_to(subject))


@query("source_ceiling", with_views("""
select sum(needed)::bigint as needed, sum(in_source)::bigint as in_source, sum(reachable)::bigint as reachable,
 case when sum(reachable) < sum(needed) then round(sum(reachable) * 1.0 / sum(needed), 3)::double end as ceiling from (
select (select count(*) from task_needed n where n.task_id = t.task_id) as needed,
 (select count(*) from task_needed n where n.task_id = t.task_id and exists (select 1 from seen s where s.layer = n.layer and s.field = n.field)) as in_source,
 (select count(*) from task_needed n where n.task_id = t.task_id and exists (select 1 from seen s where s.layer = n.layer and s.field = n.field and (not t.single_subject or s.own))) as reachable
from tasks t)""", *LAYER_TABLES, "tasks", "task_needed", extra=cells_sql() + """,
seen as (select layer, field, bool_or(subj = (select mrn from patient_administration order by row_ix limit 1)) as own from cells group by 1, 2)"""))
def source_ceiling(t):
    """The share of the needed fields that all tasks together could obtain."""
    return extract.source_ceiling(coverage_ceiling(t))


@query("scan_project_filter", with_views("""
select mrn, medication, lab_result from clinical_ehr where medication = 'MED-3' and attending_clinician = 'Dr. 11'""", dims.EHR))
def scan_project_filter(t):
    """A projected, filtered layer scan; a field the layer lacks is left out."""
    return extract.fetch(t[dims.EHR], ["mrn", "medication", "lab_result", "pincode"],
                         {"medication": "MED-3", "attending_clinician": "Dr. 11"})


@query("subject_join", with_views("""
select p.mrn, count(distinct e.row_ix) as encounters, count(distinct f.row_ix) as invoices from patient_administration p
left join clinical_ehr e on e.mrn = p.mrn left join administrative_financial f on f.mrn = p.mrn group by 1""", dims.PA, dims.EHR, dims.FIN))
def subject_join(t):
    """Rows of each patient across layers: counted per key before joining, so one-to-many never multiplies."""
    def counted(layer, name):
        return t[layer].groupBy(F.col(dims.SUBJECT_KEY[layer]).alias("mrn")).agg(F.count(F.lit(1)).alias(name))
    return (t[dims.PA].select("mrn").join(counted(dims.EHR, "encounters"), "mrn", "left")
            .join(counted(dims.FIN, "invoices"), "mrn", "left").fillna(0))


RUN_COST = """
need as (select task_id, count(*) as needed_fields from task_needed group by 1),
got as (select run_id, count(*) as fields_pulled, count(distinct layer || '/' || field) as distinct_fields, count(distinct layer) as fetches,
 count(distinct layer || '#' || row_ix) as records from pulled group by 1),
hit as (select p.run_id, count(distinct p.layer || '/' || p.field) as matched_fields from pulled p join runs r using (run_id)
 join task_needed n on n.task_id = r.task_id and n.layer = p.layer and n.field = p.field group by 1),
cost as (select r.run_id, r.technique, coalesce(g.fetches, 0) as fetches, coalesce(g.records, 0) as records, coalesce(g.fields_pulled, 0) as fields_pulled,
  coalesce(g.distinct_fields, 0) as distinct_fields, n.needed_fields, coalesce(h.matched_fields, 0) as matched_fields, r.scope_necessary as necessary
 from runs r join need n on n.task_id = r.task_id left join got g on g.run_id = r.run_id left join hit h on h.run_id = r.run_id)
"""


def run_costs(t):
    from pullwise.functions.masks import choose, has
    tasks = {**dims.TASKS, **dims.INJECTION_TASKS}
    runs = pulls.runs_with_pulls(t["runs"], t["pulled"], counts=True)
    fetched = sum((has(F.col("field_mask"), dims.layer_mask(layer)).cast("int") for layer in dims.LAYERS), F.lit(0))
    return extract.with_cost(runs.withColumns({
        "needed_mask": choose(F.col("task_id"), {k: dims.task_mask(v[4]) for k, v in tasks.items()}, 0).cast("bigint"),
        "necessary": F.col("scope_necessary"), "fetches": fetched}))


@query("meter_cost", with_views("""
select run_id, fetches::int as fetches, records, fields_pulled, distinct_fields::int as distinct_fields, matched_fields::int as matched_fields,
 round(matched_fields * 1.0 / needed_fields, 3)::double as coverage, round(distinct_fields * 1.0 / needed_fields, 3)::double as excess_ratio,
 (case when necessary > 0 then round(records * 1.0 / necessary, 3) end)::double as record_excess from cost""",
    "runs", "pulled", "task_needed", extra=RUN_COST))
def meter_cost(t):
    """The metered cost of every run."""
    return run_costs(t).select("run_id", "fetches", "records", "fields_pulled", "distinct_fields", "matched_fields",
                               "coverage", "excess_ratio", "record_excess")


@query("meter_combined", with_views("""
select technique, round_even(sum(records) / 100.0, 0)::bigint as records, round_even(sum(fields_pulled) / 100.0, 0)::bigint as fields_pulled,
 round(sum(matched_fields) / sum(needed_fields), 3)::double as coverage, round(sum(distinct_fields) / sum(needed_fields), 3)::double as excess_ratio,
 round(sum(records) filter (where necessary is not null) / sum(necessary), 3)::double as record_excess from cost group by 1""",
    "runs", "pulled", "task_needed", extra=RUN_COST))
def meter_combined(t):
    """Costs combined per technique (micro-averages), counts per pass of a hundred runs."""
    combined = extract.combine(run_costs(t), "technique")
    return extract.per_pass(combined, F.lit(100.0), "records", "fields_pulled").select(
        "technique", "records", "fields_pulled", "coverage", "excess_ratio", "record_excess")


@query("scale_cost", with_views("""
select y as year, sum(n) over (order by y)::bigint as records_read, sum(own) over (order by y)::bigint as records_needed,
 (case when sum(own) over (order by y) > 0 then round(sum(n) over (order by y) / sum(own) over (order by y), 3) end)::double as excess
from (select substr(encounter_datetime, 1, 4) as y, count(*) as n, count(*) filter (where mrn = (select min(mrn) from clinical_ehr)) as own
 from clinical_ehr group by 1)""", dims.EHR))
def scale_cost(t):
    """Records a baseline reads over records needed as the data grows year by year."""
    from pyspark.sql import Window
    from pullwise.functions.numeric import ratio
    subject = t[dims.EHR].agg(F.min("mrn")).scalar()
    yearly = t[dims.EHR].groupBy(F.substring("encounter_datetime", 1, 4).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("mrn") == subject).alias("own"))
    upto = Window.orderBy("year")            # one row per year
    return (yearly.withColumns({"records_read": F.sum("n").over(upto), "records_needed": F.sum("own").over(upto)})
            .withColumn("excess", ratio(F.col("records_read"), F.col("records_needed"))).drop("n", "own"))


@query("minors", with_views("""
select admission_ward, count(*) as patients, count(*) filter (where date_diff('year', d, date '2026-01-01') - (case when strftime(d, '%m%d') > '0101' then 1 else 0 end) < 18) as minors,
 max(date_diff('year', d, date '2026-01-01') - (case when strftime(d, '%m%d') > '0101' then 1 else 0 end))::int as oldest
from (select *, cast(date_of_birth as date) as d from patient_administration) group by 1""", dims.PA))
def minors(t):
    """Records of patients under eighteen, per ward: a finding, not a deduction."""
    dob = F.col("date_of_birth")
    return t[dims.PA].groupBy("admission_ward").agg(
        F.count(F.lit(1)).alias("patients"), F.count_if(minor(dob, extract.TODAY)).alias("minors"),
        F.max(age_on(dob, extract.TODAY)).alias("oldest"))


@query("source_coverage", with_views("""
select layer, field, count(*) as rows_carrying from cells group by 1, 2""", *LAYER_TABLES, extra=cells_sql()))
def source_coverage(t):
    """Which catalogue fields each layer carries, and in how many rows."""
    from functools import reduce
    parts = []
    for name, df in t.layers().items():
        have = [f for lay, f in extract.source_fields({name: df})]
        one = df.agg(*[F.count(f).alias(f) for f in have])
        parts.append(one.select(F.lit(name).alias("layer"), F.inline(F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f).alias("rows_carrying")) for f in have]))))
    return reduce(lambda a, b: a.unionAll(b), parts).where("rows_carrying > 0")


add_view("recorded", """
select d.*, case when decision_id % 3 = 1 then 'all' else 'subject' end as scope, decision_id % 9 <> 4 as purpose_specified, decision_id % 5 <> 2 as transport_encrypted,
 decision_id % 7 <> 3 as at_rest_encrypted, decision_id % 4 <> 1 as access_controlled, decision_id % 2 = 0 as identifiers_pseudonymised,
 decision_id % 6 <> 5 as notice_covers_purpose, false as notice_machine_readable, decision_id % 8 <> 6 as audit_log_enabled, decision_id % 3 <> 0 as processing_record_kept
from {decisions} d""")


DECISIONS_SQL = f"""
first_subject as (select mrn from patient_administration order by row_ix limit 1),
{cells_sql()},
{rows_sql()},
layer_n as (select layer, count(*) as n, count(*) filter (where subj = (select mrn from first_subject)) as own from layer_rows group by 1),
field_n as (select layer, field, count(*) as n, count(*) filter (where subj = (select mrn from first_subject)) as own from cells group by 1, 2),
sel as (select distinct d.decision_id, r.task_id, c.layer, c.field, c.category, r.scope = 'subject' and t.single_subject as scoped
 from decision_fields d join field_catalogue c on d.ref = c.layer || '/' || c.field join recorded r using (decision_id) join tasks t using (task_id)),
met as (select decision_id, count(*) as fetches, sum(coalesce(case when scoped then own else n end, 0)) as records
 from (select distinct decision_id, layer, scoped from sel) left join layer_n using (layer) group by 1),
got as (select s.*, coalesce(case when scoped then f.own else f.n end, 0) as n from sel s left join field_n f using (layer, field)),
val as (select decision_id, sum(n) as fields_pulled, count(*) filter (where n > 0) as distinct_fields,
 count(*) filter (where n > 0 and exists (select 1 from task_needed x where x.task_id = got.task_id and x.layer = got.layer and x.field = got.field)) as matched_fields from got group by 1),
necessary as (select t.task_id, (select count(*) from layer_rows r where r.subj = (select mrn from first_subject)
  and r.layer in (select layer from task_needed n where n.task_id = t.task_id)) as necessary from tasks t where t.single_subject),
pulled as (select distinct task_id || '--' || decision_id as run_id, category from got where n > 0),
runs as (select r.task_id || '--' || decision_id as run_id, r.task_id, t.purpose, purpose_specified, case when lawful_basis_type <> 'none' then lawful_basis_type end as basis_type,
 case when lawful_basis_type <> 'none' then nullif(trim(lawful_basis_reference), '') end as basis_reference, nullif(retention_days, 0) as retention_days,
 nullif(deletion_mechanism, '') as deletion_mechanism, transport_encrypted, at_rest_encrypted, access_controlled, identifiers_pseudonymised,
 nullif(trim(notice_reference), '') as notice_reference, notice_covers_purpose, notice_machine_readable, m.decision_id is not null and scope = 'subject' and t.single_subject as scope_on_subject, audit_log_enabled, nullif(accountable_party, '') as accountable_party, processing_record_kept,
 case uses when 'n/a;research registry' then 'research registry' when ' billing_settlement ' then 'billing_settlement' end as secondary_use,
 case when k.necessary is not null then coalesce(m.records, 0) end as scope_pulled, k.necessary as scope_necessary
 from recorded r join tasks t using (task_id) left join met m using (decision_id) left join necessary k using (task_id))""" + "," + RUN_SETS + "," + scored_sql("runs")


@query("decision_costs", with_views("""
select r.decision_id, r.task_id, s.score::double as compliance_score, coalesce(m.fetches, 0) as fetches, coalesce(m.records, 0)::bigint as records, coalesce(v.fields_pulled, 0)::bigint as fields_pulled,
 coalesce(v.distinct_fields, 0)::int as distinct_fields, n.needed_fields::int as needed_fields, coalesce(v.matched_fields, 0)::int as matched_fields, k.necessary::bigint as necessary
from scored s join recorded r on s.run_id = r.task_id || '--' || r.decision_id left join met m on m.decision_id = r.decision_id left join val v on v.decision_id = r.decision_id
join (select task_id, count(*) as needed_fields from task_needed group by 1) n on n.task_id = r.task_id left join necessary k on k.task_id = r.task_id
""", *LAYER_TABLES, "field_catalogue", "tasks", "task_needed", "purpose_policy", "purpose_allowed", "recorded", "decision_fields", extra=DECISIONS_SQL))
def decision_costs(t):
    """What each recorded decision pulled, at what cost, and how compliant it was."""
    from pullwise.plans import recorded
    rows = t["recorded"].withColumn("secondary_uses", F.split("uses", ";"))
    return recorded.decision_costs(t.spark, t.layers(), rows, t["decision_fields"]).select(
        "decision_id", "task_id", "compliance_score", "fetches", "records", "fields_pulled", "distinct_fields", "needed_fields", "matched_fields", "necessary")


REPEATS = 5


@query("recorded_stability", with_views("""
select technique, max(cap) as passes, sum(repeat_runs)::bigint as repeat_runs, sum(stable_runs)::bigint as stable_runs, sum(stable_fields)::bigint as stable_fields,
 sum(verdict_stable_runs)::bigint as verdict_stable_runs, count(*) filter (where repeat_runs = stable_runs) as stable_tasks,
 min(d) as distinct_min, max(d) as distinct_max, round(sum(d) / count(*) * 10) / 10.0 as distinct_mean,
 case when sum(repeat_runs) > 0 then round(sum(stable_runs) / sum(repeat_runs), 6) else 1.0 end as determinism from per group by 1""",
    *LAYER_TABLES, "field_catalogue", "tasks", "task_needed", "purpose_policy", "purpose_allowed", "recorded", "decision_fields", "tasks_today", extra=DECISIONS_SQL + f""",
agent as (select *, concat_ws('/', provider, model, briefing) as technique, task_id || '--' || decision_id as run_id from recorded),
caps as (select technique, least(min(n), {REPEATS}) as cap from (select technique, task_id, count(*) as n from agent group by 1, 2)
 group by 1 having count(*) = (select count(*) from tasks_today)),
sample as (select * from (select a.technique, a.task_id, a.run_id, c.cap, row_number() over (partition by a.technique, a.task_id order by a.decision_id) as sample
 from agent a join caps c using (technique)) where sample <= cap),
run_fields as (select task_id || '--' || decision_id as run_id, string_agg(distinct layer || '/' || field, ',' order by layer || '/' || field) as fields from got where n > 0 group by 1),
bench as (select s.* exclude (task_id), t.task_id, t.trap, coalesce(f.fields, '') as fields, a.technique as agent, a.sample, a.cap,
  case when t.trap then s.n_over = 0 and s.secondary_use is null and coalesce(s.retention_days <= s.max_days, false) and (not t.trap_on_scope or s.scope_on_subject) end as held,
  concat_ws('|', coalesce(f.fields, ''), purpose_specified, basis_type, basis_type is not null and basis_reference is not null,
   coalesce(retention_days, -1), deletion_mechanism is not null, transport_encrypted, at_rest_encrypted, access_controlled, identifiers_pseudonymised,
   notice_reference is not null, notice_reference is not null and notice_covers_purpose, notice_reference is not null and notice_machine_readable,
   audit_log_enabled, accountable_party is not null, processing_record_kept, coalesce(secondary_use, '')) as decision
 from sample a join scored s on s.run_id = a.run_id join tasks t on t.task_id = a.task_id left join run_fields f on f.run_id = a.run_id),
bench_v as (select *, concat_ws('|', has_records and dm >= 1, not has_records, lb = 1, sl = 1, ss = 1, pl = 1, nt = 1, ac = 1, held) as verdict from bench),
firsts as (select *, first_value(decision) over g as d1, first_value(fields) over g as f1, first_value(verdict) over g as v1 from bench_v window g as (partition by agent, task_id order by sample)),
per as (select agent as technique, task_id, max(cap) as cap, count(*) filter (where sample > 1) as repeat_runs, count(*) filter (where sample > 1 and decision = d1) as stable_runs,
 count(*) filter (where sample > 1 and fields = f1) as stable_fields, count(*) filter (where sample > 1 and verdict = v1) as verdict_stable_runs, count(distinct decision) as d from firsts group by 1, 2)"""))
def recorded_stability(t):
    """Recorded agents replayed sample by sample: what repeats reproduced of the first sample's decision."""
    from pullwise.plans import recorded
    rows = t["recorded"].withColumn("secondary_uses", F.split("uses", ";"))
    return recorded.replay_stability(t.spark, t.layers(), rows, t["decision_fields"], REPEATS)
