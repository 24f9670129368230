"""Rules, purpose matrix, claims and summaries over runs and what they pulled."""

from __future__ import annotations

from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import masks
from pullwise.operators import claims, pulls, rules
from pullwise.registry.base import query, with_views

# Shared SQL: per run category sets, then the seven rules written with plain sets and CASE.
RUN_SETS = """
run_cat as (select distinct run_id, category from pulled),
run_n as (select run_id, count(*) as cats from run_cat group by 1),
run_purpose as (select r.run_id, p.purpose from runs r, purpose_policy p),
run_use as (select run_id, unnest(string_split(secondary_use, ';')) as u from runs where secondary_use is not null),
over_by_purpose as (
 select c.run_id, p.purpose, count(*) filter (where a.category is null) as n_over,
  coalesce(string_agg(c.category, ', ' order by c.category) filter (where a.category is null), '') as over_list
 from run_cat c cross join purpose_policy p
 left join purpose_allowed a on a.purpose = p.purpose and a.category = c.category group by 1, 2),
outside as (select p.purpose, 6 - count(*) as n_out from purpose_policy p join purpose_allowed a using (purpose) group by 1),
use_bad as (
 select u.run_id, bool_or(p.purpose is null or coalesce(o.n_over, 0) > 0) as bad
 from run_use u left join purpose_policy p on p.purpose = u.u
 left join over_by_purpose o on o.run_id = u.run_id and o.purpose = u.u group by 1)
"""


def scored_sql(source: str, name: str = "scored") -> str:
    """CTEs scoring the manifests in ``source`` (columns of runs; ``covers`` and ``purpose`` may differ)."""
    return f"""
{name}_base as (
 select r.*, n.cats is not null as has_records, coalesce(o.n_over, 0) as n_over, coalesce(o.over_list, '') as over_list,
  x.n_out, p.max_days, p.pseudonymise and exists (select 1 from run_cat c where c.run_id = r.run_id and c.category = 'direct_identifier') as ask_pseudo,
  b.bad
 from {source} r join purpose_policy p on p.purpose = r.purpose join outside x on x.purpose = r.purpose
 left join run_n n on n.run_id = r.run_id
 left join over_by_purpose o on o.run_id = r.run_id and o.purpose = r.purpose
 left join use_bad b on b.run_id = r.run_id),
{name}_rules as (
 select *,
  case when not has_records then 1.0 else round(least(1.0 - n_over * 1.0 / n_out,
    case when scope_pulled is null or scope_pulled <= scope_necessary or scope_pulled = 0 then 1.0
         else scope_necessary * 1.0 / scope_pulled end), 6) end as dm,
  case when basis_type is null then 0.0 when basis_reference is null then 0.5 else 1.0 end as lb,
  (case when retention_days is not null and retention_days <= max_days then 0.5 else 0.0 end)
   + (case when deletion_mechanism is not null then 0.5 else 0.0 end) as sl,
  (transport_encrypted::int + at_rest_encrypted::int + access_controlled::int
   + case when ask_pseudo then identifiers_pseudonymised::int else 0 end) * 1.0 / (case when ask_pseudo then 4 else 3 end) as ss,
  case when not purpose_specified then 0.0 when bad is null then 1.0 when bad then 0.25 else 0.5 end as pl,
  case when notice_reference is null then 0.0 when not notice_covers_purpose then 0.5 else 1.0 end as nt,
  (audit_log_enabled::int + (accountable_party is not null)::int + processing_record_kept::int) / 3.0 as ac
 from {name}_base),
{name} as (
 select *, (dm >= 1.0)::int + (lb = 1.0)::int + (sl = 1.0)::int + (ss = 1.0)::int + (pl = 1.0)::int + (nt = 1.0)::int + (ac = 1.0)::int
   - (not has_records)::int as passes,
  case when has_records then 7 else 6 end as applicable,
  round((case when has_records then dm else 0.0 end + lb + sl + ss + pl + nt + ac) / case when has_records then 7 else 6 end, 3) as score
 from {name}_rules)
"""


def scored(t, *, findings=False):
    return rules.score_runs(pulls.runs_with_pulls(t["runs"], t["pulled"]), findings)


@query("rule_scores", with_views("""
select run_id, 'DM-01' as rule_id, case when not has_records then 'not_applicable' when dm >= 1.0 then 'pass' else 'fail' end as status, dm::double as score from scored
union all select run_id, 'LB-01', case when lb = 1.0 then 'pass' else 'fail' end, lb::double from scored
union all select run_id, 'SL-01', case when sl = 1.0 then 'pass' else 'fail' end, sl::double from scored
union all select run_id, 'SS-01', case when ss = 1.0 then 'pass' else 'fail' end, round(ss, 6)::double from scored
union all select run_id, 'PL-01', case when pl = 1.0 then 'pass' else 'fail' end, pl::double from scored
union all select run_id, 'NT-01', case when nt = 1.0 then 'pass' else 'fail' end, nt::double from scored
union all select run_id, 'AC-01', case when ac = 1.0 then 'pass' else 'fail' end, round(ac, 6)::double from scored
""", "runs", "pulled", "purpose_policy", "purpose_allowed", extra=RUN_SETS + "," + scored_sql("runs")))
def rule_scores(t):
    """Every run under every rule."""
    return rules.rule_rows(scored(t), "run_id").withColumn("score", F.round("score", 6))


@query("compliance_report", with_views("""
select run_id, purpose, score::double as compliance_score, round(passes * 1.0 / applicable, 3)::double as pass_rate,
 passes::int as rules_passed, applicable::int as rules_applicable
from scored""", "runs", "pulled", "purpose_policy", "purpose_allowed", extra=RUN_SETS + "," + scored_sql("runs")))
def compliance_report(t):
    """Weighted score, pass rate and passes per run."""
    return scored(t).select("run_id", "purpose", "compliance_score", "pass_rate", "rules_passed", "rules_applicable")


@query("rule_findings", with_views("""
select run_id, 'out of scope: ' || c.category as finding from run_cat c join runs r using (run_id)
where not exists (select 1 from purpose_allowed a where a.purpose = r.purpose and a.category = c.category)
union all
select run_id, 'records read beyond the subject''s: ' || (scope_pulled - scope_necessary)::varchar
from scored where has_records and scope_pulled > scope_necessary and scope_pulled > 0
union all select run_id, 'no records to assess' from scored where not has_records
""", "runs", "pulled", "purpose_policy", "purpose_allowed", extra=RUN_SETS + "," + scored_sql("runs")))
def rule_findings(t):
    """What the minimisation rule found, one row per finding."""
    return scored(t, findings=True).select("run_id", F.explode("dm_findings").alias("finding"))


@query("purpose_matrix", with_views("""
select run_id, purpose, is_declared, score::double as compliance_score, passes::int as rules_passed,
 over_list as out_of_scope, case when score = 1.0 then 'lawful for this purpose'
  when over_list <> '' and sl < 1.0 then 'out of scope: ' || over_list || '; retention exceeds ' || max_days::varchar || 'd limit'
  when over_list <> '' then 'out of scope: ' || over_list
  when sl < 1.0 then 'retention exceeds ' || max_days::varchar || 'd limit'
  else concat_ws(', ', case when has_records and dm < 1.0 then 'DM-01' end, case when lb < 1.0 then 'LB-01' end,
   case when ss < 1.0 then 'SS-01' end, case when pl < 1.0 then 'PL-01' end, case when nt < 1.0 then 'NT-01' end,
   case when ac < 1.0 then 'AC-01' end) || ' fail' end as verdict
from scored order by run_id, is_declared desc, purpose""", "runs", "pulled", "purpose_policy", "purpose_allowed",
                                   extra=RUN_SETS + """,
variants as (select r.* replace (p.purpose as purpose, r.notice_covers_purpose and p.purpose = r.purpose as notice_covers_purpose),
 p.purpose = r.purpose as is_declared from runs r cross join purpose_policy p),""" + scored_sql("variants")))
def purpose_matrix(t):
    """Every run re-scored under every purpose, with the reader's verdict."""
    return rules.across_purposes(pulls.runs_with_pulls(t["runs"], t["pulled"])).select(
        "run_id", "purpose", "is_declared", "compliance_score", "rules_passed",
        F.array_join("out_of_scope", ", ").alias("out_of_scope"), "verdict")


@query("purpose_nesting", with_views("""
select a.purpose as purpose, b.purpose as other, count(distinct c.run_id) as runs_only_here
from purpose_policy a join purpose_policy b on a.purpose <> b.purpose
left join run_cat c on c.category in (select category from purpose_allowed where purpose = a.purpose)
 and c.category not in (select category from purpose_allowed where purpose = b.purpose)
group by 1, 2""", "pulled", "purpose_policy", "purpose_allowed", extra="run_cat as (select distinct run_id, category from pulled)"))
def purpose_nesting(t):
    """No purpose's scope holds another's: for each ordered pair, the runs that carry a category only the first allows."""
    pairs = [(a, b, dims.allowed_mask(a) & ~dims.allowed_mask(b)) for a in dims.PURPOSES for b in dims.PURPOSES if a != b]
    per_run = pulls.run_masks(t["pulled"]).select("cat_mask")
    counts = per_run.agg(*[F.count_if(masks.has(F.col("cat_mask"), m)).alias(f"n{i}") for i, (_, _, m) in enumerate(pairs)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("purpose"), F.lit(b).alias("other"), F.col(f"n{i}").alias("runs_only_here"))
        for i, (a, b, _) in enumerate(pairs)])))


CLAIM_SQL = """
claim as (
 select run_id, purpose, technique, 'transport encryption' as control, 'True' as declared, coalesce(observed_transport, true) as ok, true as demo from runs where transport_encrypted
 union all select run_id, purpose, technique, 'encryption at rest', 'True', true, false from runs where at_rest_encrypted
 union all select run_id, purpose, technique, 'access control', 'True', true, false from runs where access_controlled
 union all select run_id, purpose, technique, 'pseudonymisation on export', 'True', true, true from runs where identifiers_pseudonymised
 union all select run_id, purpose, technique, 'deletion mechanism', deletion_mechanism, regexp_matches(deletion_mechanism, '(?i)(^|[^A-Za-z0-9])PURGE-01([^A-Za-z0-9]|$)'), true from runs where deletion_mechanism is not null
 union all select run_id, purpose, technique, 'privacy notice', notice_reference, regexp_matches(notice_reference, '(?i)(^|[^A-Za-z0-9])NOTICE-REG-2026([^A-Za-z0-9]|$)'), false from runs where notice_reference is not null
 union all select run_id, purpose, technique, 'machine-readable notice', 'True', true, false from runs where notice_reference is not null and notice_machine_readable
 union all select run_id, purpose, technique, 'audit log', 'True', true, true from runs where audit_log_enabled
 union all select run_id, purpose, technique, 'accountable party', accountable_party, regexp_matches(accountable_party, '(?i)(^|[^A-Za-z0-9])DPO([^A-Za-z0-9]|$)'), false from runs where accountable_party is not null
 union all select run_id, purpose, technique, 'record of processing', 'True', true, true from runs where processing_record_kept
 union all select run_id, purpose, technique, 'lawful-basis reference', basis_reference,
  regexp_matches(basis_reference, '(?i)(^|[^A-Za-z0-9])' || case purpose when 'care_coordination' then 'LU-CARE' when 'billing_settlement' then 'LU-BILL' else 'LU-REG' end || '([^A-Za-z0-9]|$)'), false
  from runs where basis_type is not null and basis_reference is not null)
"""


@query("claim_verdicts", with_views("""
select run_id, control, declared, ok as substantiated, case when ok and demo then 'demonstrated' when ok then 'attested' else '' end as basis
from claim""", "runs", extra=CLAIM_SQL))
def claim_verdicts(t):
    """Every control a run declares, checked against the register and the observation."""
    return claims.claim_rows(pulls.manifests(t["runs"]), "run_id")


@query("veracity", with_views("""
select r.run_id, count(c.control)::int as declared, (count(*) filter (where c.ok))::int as substantiated,
 (count(*) filter (where c.ok and c.demo))::int as demonstrated, (count(*) filter (where c.ok and not c.demo))::int as attested,
 (case when count(c.control) > 0 then round(count(*) filter (where c.ok) * 1.0 / count(c.control), 3) end)::double as veracity
from runs r left join claim c using (run_id) group by 1""", "runs", extra=CLAIM_SQL))
def veracity(t):
    """Substantiated over declared, per run."""
    return claims.with_veracity(pulls.manifests(t["runs"])).select(
        "run_id", "declared", "substantiated", "demonstrated", "attested", "veracity")


@query("substantiated_score", with_views("""
select s.run_id, s.score::double as declared_score, b.score::double as substantiated_score
from scored s join backed b using (run_id)""", "runs", "pulled", "purpose_policy", "purpose_allowed",
                                        extra=RUN_SETS + "," + CLAIM_SQL + """,
bad as (select run_id, control from claim where not ok),
kept as (select r.* replace (
  transport_encrypted and not exists (select 1 from bad b where b.run_id = r.run_id and control = 'transport encryption') as transport_encrypted,
  case when not exists (select 1 from bad b where b.run_id = r.run_id and control = 'privacy notice') then notice_reference end as notice_reference,
  case when not exists (select 1 from bad b where b.run_id = r.run_id and control = 'accountable party') then accountable_party end as accountable_party,
  case when not exists (select 1 from bad b where b.run_id = r.run_id and control = 'lawful-basis reference') then basis_reference end as basis_reference)
 from runs r),""" + scored_sql("runs") + "," + scored_sql("kept", "backed")))
def substantiated_score(t):
    """The score again after removing claims the deployment cannot back."""
    base = pulls.runs_with_pulls(t["runs"], t["pulled"])
    said = rules.score_runs(base).withColumn("declared_score", F.col("compliance_score")).select(
        *base.columns, "declared_score")
    return rules.score_runs(claims.substantiate(said)).select(
        "run_id", "declared_score", F.col("compliance_score").alias("substantiated_score"))


@query("behaviour_paperwork", with_views("""
select run_id, round((case when has_records then dm else 0 end + pl + (case when retention_days is not null and retention_days <= max_days then 1.0 else 0.0 end))
  / case when has_records then 3 else 2 end, 6)::double as behaviour_score,
 round((lb + nt + ss + ac + (deletion_mechanism is not null)::int) / 5, 6)::double as paperwork_score
from scored""", "runs", "pulled", "purpose_policy", "purpose_allowed", extra=RUN_SETS + "," + scored_sql("runs")))
def behaviour_paperwork(t):
    """What a run did, and what its manifest cites."""
    return rules.split_scores(scored(t)).select(
        "run_id", F.round("behaviour_score", 6).alias("behaviour_score"), F.round("paperwork_score", 6).alias("paperwork_score"))


@query("category_summary", with_views("""
select p.run_id, c.category, count(*) as records from (select distinct run_id, layer, row_ix, category from pulled) c
join runs p using (run_id) group by 1, 2""", "runs", "pulled"))
def category_summary(t):
    """Records of each run carrying each category."""
    records = pulls.record_categories(t["pulled"], "run_id")
    return pulls.category_counts(pulls.summarise(records, "run_id"), "run_id")


@query("merged_summary", with_views("""
select purpose, (select count(*) from (select distinct run_id, layer, row_ix from pulled) d join runs r2 using (run_id) where r2.purpose = r.purpose) as record_count,
 count(*) as field_slots,
 string_agg(distinct layer, ',' order by layer) as layers,
 coalesce(string_agg(distinct case when a.category is null then c.category end, ',' order by case when a.category is null then c.category end), '') as out_of_scope
from (select distinct run_id, layer, row_ix, category from pulled) c join runs r using (run_id)
left join purpose_allowed a using (purpose, category) group by purpose""", "runs", "pulled", "purpose_allowed"))
def merged_summary(t):
    """Per-run summaries merged per purpose: sums of counts, unions of layers and out-of-scope categories."""
    records = pulls.record_categories(t["pulled"], "run_id")
    per_run = pulls.summarise(records, "run_id").join(t["runs"].select("run_id", "purpose"), "run_id")
    layers = F.array_compact(F.array(*[
        F.when(F.col("layer_mask").bitwiseAND(1 << dims.LAYERS.index(layer)) != 0, F.lit(layer)) for layer in sorted(dims.LAYERS)]))
    return pulls.merge_summaries(per_run, "purpose").select(
        "purpose", "record_count", "field_slots", F.array_join(layers, ",").alias("layers"),
        masks.category_list(F.col("out_of_scope_mask")).alias("out_of_scope"))
