"""Audit log, retention, breach, access reports and access decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import crypto, masks
from pullwise.operators import access, audit, pulls, retention
from pullwise.registry.base import query, with_views
from pullwise.registry.interop import token_sql
from pullwise.sources.tables import add_view

NOW = "2024-01-10 00:00:00"

add_view("event_subjects", """
select event_id as seq, 'MRN' || lpad(cast(user_id as string),7,'0') as subject_mrn from {events}
union select event_id, 'MRN' || lpad(cast(cast(floor(user_id / 2.0) as bigint) as string),7,'0') from {events}""")
add_view("exposures", """
select distinct 'B-' || lpad(cast(seq % 23 as string),2,'0') as breach_id, run_id from {audit_events} where event = 'export'
union select distinct 'B-' || lpad(cast(seq % 23 as string),2,'0'), 'run-lost-' || cast(seq % 11 as string) from {audit_events}""")
add_view("notices", """
select 'B-' || lpad(cast(event_id % 23 as string),2,'0') as breach_id,
 case when event_id % 9 = 0 then 'board' else 'MRN' || lpad(cast(user_id as string),7,'0') end as recipient, ts as at from {events}""")

TOK = token_sql("subject_mrn", crypto.DEV_AUDIT_KEY, crypto.WHOLE)
SUBJ = f"subj as (select seq, {TOK} as token from event_subjects)"
BODY = """'{"seq":' || seq::varchar || ',"at":"' || strftime(audit_events.at, '%Y-%m-%dT%H:%M:%S.%f') || '","event":"' || event || '","run_id":"' || run_id
 || '","technique":"' || technique || '","purpose":"' || purpose || '","records":' || records::varchar || ',"unattributed":' || unattributed::varchar
 || ',"scoped":' || scoped::varchar || ',"note":"' || note || '"'"""
CHAIN = f"""bodies as (select seq, floor(seq / 256.0)::bigint as chain, row_number() over (partition by floor(seq / 256.0) order by seq) as rn, {BODY} as body from audit_events),
chained as (
 select chain, seq, rn, '' as prev_sha256, body || ',"prev_sha256":""}}' as line from bodies where rn = 1
 union all
 select b.chain, b.seq, b.rn, sha256(c.line), b.body || ',"prev_sha256":"' || sha256(c.line) || '"}}' from chained c join bodies b on b.chain = c.chain and b.rn = c.rn + 1)"""


def subjects(t):
    return t["event_subjects"].select("seq", crypto.token(F.col("subject_mrn"), crypto.audit_key(t.spark), crypto.WHOLE).alias("token"))


def masks_of_runs(t):
    return pulls.run_masks(t["pulled"])


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("audit_chain_build", with_views("select chain, seq, prev_sha256, line from chained", "audit_events", extra=CHAIN, recursive=True))
def audit_chain_build(t):
    """The audit log with every line carrying the hash of the line before."""
    return audit.build_chains(t["audit_events"], audit.event_body())


@query("audit_chain_verify", with_views("""
select chain, count(*) as lines, min(rn - 1) filter (where p <> want) as broken_at, min(rn - 1) filter (where p <> want) is null as intact
from (select *, json_extract_string(line, '$.prev_sha256') as p, coalesce(sha256(lag(line) over (partition by chain order by seq)), '') as want from tampered) group by 1""",
    "audit_events", extra=CHAIN + """,
tampered as (select chain, seq, rn, case when seq % 701 = 5 then replace(line, '"records":', '"records":9') else line end as line from chained)""", recursive=True))
def audit_chain_verify(t):
    """Chains checked after some lines were edited: the first broken index."""
    lines = audit.build_chains(t["audit_events"], audit.event_body())
    edited = F.when(F.col("seq") % 701 == 5, F.replace(F.col("line"), F.lit('"records":'), F.lit('"records":9'))).otherwise(F.col("line"))
    return audit.verify_chains(lines.withColumn("line", edited), block=100)


@query("audit_tail", with_views("""
select seq, event, run_id, records from audit_events order by seq desc limit 20""", "audit_events"))
def audit_tail(t):
    """The last twenty events."""
    return audit.tail(t["audit_events"], 20).select("seq", "event", "run_id", "records")


# a manifest's fields, in sorted order
MANIFEST_FIELDS = ("access_controlled", "accountable_party", "at_rest_encrypted", "audit_log_enabled", "basis_reference", "basis_type",
                   "deletion_mechanism", "identifiers_pseudonymised", "notice_covers_purpose", "notice_reference", "processing_record_kept",
                   "purpose", "purpose_specified", "retention_days", "run_id", "secondary_use", "transport_encrypted")


@query("manifest_digests", with_views(f"""
select run_id, substr(sha256(to_json({{{', '.join(f"'{f}': {f}" for f in MANIFEST_FIELDS)}}})::varchar), 1, 16) as digest from runs""", "runs"))
def manifest_digests(t):
    """A stable digest of each manifest as declared, over every field."""
    return t["runs"].select("run_id", crypto.manifest_digest(*MANIFEST_FIELDS).alias("digest"))


@query("audit_anchors", with_views("""
select 0 as level, chain as node, hash, n from head union all select 1, node, hash, n from one
union all select 2, 0, sha256(string_agg(hash, '' order by node)), count(*) from one having count(*) > 1""", "audit_events", extra=CHAIN + """,
head as (select chain, sha256(max_by(line, seq)) as hash, count(*) as n from chained group by 1),
one as (select floor(chain / 256.0)::bigint as node, sha256(string_agg(hash, '' order by chain)) as hash, count(*) as n from head group by 1)""", recursive=True))
def audit_anchors(t):
    """The chains' last hashes, tied together into one root."""
    return audit.anchor_chains(audit.build_chains(t["audit_events"], audit.event_body()))


@query("audit_chain_missing", with_views("""
select chain, case when chain % 5 = 3 then 'missing' else 'changed' end as status from (select distinct chain from bodies)
where chain % 5 = 3 or chain % 5 = 1""", "audit_events", extra=f"bodies as (select floor(seq / 256.0)::bigint as chain from audit_events)"))
def audit_chain_missing(t):
    """Whole chains deleted and others rewritten from their first line, found by the anchors."""
    events = t["audit_events"]
    lines = audit.build_chains(events, audit.event_body())
    anchors = audit.anchor_chains(lines)
    forged = audit.build_chains(events.withColumn("records", F.when(audit.chain_of(F.col("seq")) % 5 == 1, F.col("records") + 1).otherwise(F.col("records"))),
                                audit.event_body())
    return audit.verify_anchors(forged.where("chain % 5 <> 3"), anchors).where("status <> 'intact'").select("chain", "status")


FACTS = """
ex as (select run_id, min(seq) as s from audit_events where event = 'extraction' group by 1),
fs as (select run_id, min(seq) as s from audit_events group by 1),
xp as (select run_id, max(seq) as s from audit_events where event = 'export' group by 1),
pg as (select run_id, max(seq) as s from audit_events where event = 'purge' group by 1),
cats as (select run_id, string_agg(distinct category, ',' order by category) as cats from pulled group by 1)
"""


def activities(t):
    return audit.access_activities(t["audit_events"], subjects(t), masks_of_runs(t), t["retention"])


@query("access_summary", with_views("""
select d.token, d.run_id, strftime(e.at, '%Y-%m-%d %H:%M:%S') as at, e.technique, e.purpose, case when x.s is not null then coalesce(c.cats, '') else '' end as categories,
 p.s is not null as exported, v.note like '%pseudonymised%' and v.note not like '%RAW%' as pseudonymised,
 strftime(r.delete_after, '%Y-%m-%d %H:%M:%S') as erase_after, strftime(z.at, '%Y-%m-%d %H:%M:%S') as erased_at
from (select distinct token, run_id from audit_events join subj using (seq)) d
left join ex x using (run_id) join fs f using (run_id) left join xp p using (run_id) left join pg g using (run_id) left join cats c using (run_id)
join audit_events e on e.seq = coalesce(x.s, f.s) left join audit_events v on v.seq = p.s left join audit_events z on z.seq = g.s
left join retention r on r.run_id = d.run_id""", "audit_events", "event_subjects", "pulled", "retention", extra=SUBJ + "," + FACTS))
def access_summary(t):
    """Every extraction that read each patient, with what was read, exported and erased."""
    return activities(t).select(
        "token", "run_id", ts("at").alias("at"), "technique", "purpose", masks.category_list(F.col("cat_mask")).alias("categories"),
        "exported", "pseudonymised", ts("erase_after").alias("erase_after"), ts("erased_at").alias("erased_at"))


@query("access_totals", with_views("""
select token, count(*) as activities, count(*) filter (where purpose = 'care_coordination') as care_coordination,
 count(*) filter (where purpose = 'billing_settlement') as billing_settlement, count(*) filter (where purpose = 'patient_registration') as patient_registration,
 (select count(distinct run_id) from audit_events where event = 'extraction' and unattributed > 0 and not scoped) as unattributed_runs
from (select distinct token, run_id from audit_events join subj using (seq)) d left join ex x using (run_id) join fs f using (run_id)
join audit_events e on e.seq = coalesce(x.s, f.s) group by 1""", "audit_events", "event_subjects", "pulled", "retention", extra=SUBJ + "," + FACTS))
def access_totals(t):
    """Purposes a patient's records were read for, beside the runs the log cannot attribute."""
    return audit.access_totals(activities(t)).drop("cat_mask").withColumn(
        "unattributed_runs", audit.unattributed_runs(t["audit_events"]).scalar())


@query("processing_record", with_views("""
select p.purpose, case p.purpose when 'care_coordination' then 'LU-CARE' when 'billing_settlement' then 'LU-BILL' else 'LU-REG' end as lawful_basis,
 p.max_days as retention_ceiling_days, count(*) filter (where event = 'extraction') as runs, sum(records) filter (where event = 'extraction')::bigint as records,
 (select count(distinct token) from audit_events a join subj using (seq) where a.purpose = p.purpose and a.event = 'extraction') as patients,
 string_agg(distinct technique, ',' order by technique) filter (where event = 'extraction') as techniques,
 count(*) filter (where event = 'export') as exports, count(*) filter (where event = 'export' and note like '%RAW%') as raw_exports,
 count(*) filter (where event = 'purge') as erasures, strftime(min(e.at), '%Y-%m-%d %H:%M:%S') as first, strftime(max(e.at), '%Y-%m-%d %H:%M:%S') as last,
 (select string_agg(category || ': ' || fields, '; ' order by category) from (select category, string_agg(distinct field, ', ' order by field) as fields
   from pulled where run_id in (select run_id from audit_events a where a.purpose = p.purpose and a.event = 'extraction') group by 1)) as fields
from purpose_policy p left join audit_events e using (purpose) group by 1, 2, 3""", "audit_events", "event_subjects", "pulled", "purpose_policy", extra=SUBJ))
def processing_record(t):
    """The record of processing activities, from the log."""
    return audit.processing_record(t["audit_events"], subjects(t), masks_of_runs(t)).select(
        "purpose", "lawful_basis", "retention_ceiling_days", "runs", "records", "patients", F.array_join("techniques", ",").alias("techniques"),
        "exports", "raw_exports", "erasures", ts("first").alias("first"), ts("last").alias("last"),
        audit.field_listing(F.col("field_mask")).alias("fields"))


@query("subject_reads", with_views("""
select * from (select technique, token, count(distinct run_id) as runs_touching from audit_events join subj using (seq) where event = 'extraction' group by 1, 2)
join (select technique, count(distinct run_id) as runs from audit_events where event = 'extraction' group by 1) using (technique)""",
    "audit_events", "event_subjects", extra=SUBJ))
def subject_reads(t):
    """Runs of each technique that touched each patient, of how many."""
    return audit.subject_reads(t["audit_events"], subjects(t))


BREACH = FACTS + f""",
known as (select b.breach_id, b.run_id, v.seq as export_seq, v.purpose, v.records, v.note not like '%RAW%' as pseudonymised, v.unattributed, coalesce(e.scoped, false) as scoped, x.s as ex_seq,
  coalesce(r.delete_after < timestamp '{NOW}', false) as overdue
 from exposures b join xp p using (run_id) join audit_events v on v.seq = p.s left join ex x using (run_id) left join audit_events e on e.seq = x.s left join retention r on r.run_id = b.run_id),
bcat as (select distinct k.breach_id, k.pseudonymised, p.category from known k join pulled p on p.run_id = k.run_id where k.ex_seq is not null),
hit as (select distinct k.breach_id, s.token from known k join subj s on s.seq = k.export_seq),
raw as (select b.breach_id, coalesce(bool_or(not c.pseudonymised and c.category = 'direct_identifier'), false) as raw_identifiers,
  coalesce(string_agg(distinct c.category, ',' order by c.category), '') as categories,
  coalesce(bool_or(c.category = 'clinical'), false) as clin, coalesce(bool_or(c.category = 'financial'), false) as fin, coalesce(bool_or(c.category = 'contact'), false) as con
 from (select distinct breach_id from exposures) b left join bcat c using (breach_id) group by 1)
"""
B_VIEWS = ("audit_events", "event_subjects", "pulled", "retention", "exposures", "notices")


def breach_parts(t):
    exports = audit.exposed_exports(t["exposures"], t["audit_events"], masks_of_runs(t), t["retention"], F.lit(NOW).cast("timestamp_ntz"))
    return exports, audit.affected_tokens(exports, subjects(t))


@query("breach_assessment", with_views(f"""
select r.breach_id, (select count(*) from known k where k.breach_id = r.breach_id) as exports,
 (select count(*) from exposures e where e.breach_id = r.breach_id and e.run_id not in (select run_id from xp)) as unknown,
 (select count(*) from hit h where h.breach_id = r.breach_id) as affected, raw_identifiers, categories,
 (select count(*) from known k where k.breach_id = r.breach_id and overdue) as overdue,
 coalesce((select sum(unattributed) from known k where k.breach_id = r.breach_id and not scoped), 0)::bigint as unattributed,
 case when raw_identifiers and clin then 'high -- identifiable clinical data' when raw_identifiers then 'high -- identifiable personal data'
  when clin or fin then 'moderate -- sensitive data, identifiers pseudonymised' else 'low -- pseudonymised administrative data' end as severity,
 case when raw_identifiers and clin then 'health information linkable' when raw_identifiers and con then 'unwanted contact'
  when raw_identifiers then 'impersonation' else 'low risk, codes only' end as impact,
 concat_ws(',', 'beware of calls', case when fin then 'check statements' end, case when raw_identifiers then 'report contact' end) as safety_steps,
 strftime(timestamp '{NOW}' + interval 72 hour, '%Y-%m-%d %H:%M:%S') as report_due from raw r""", *B_VIEWS, extra=SUBJ + "," + BREACH))
def breach_assessment(t):
    """What each breach exposed, how severe it is and when the report falls due."""
    exports, affected = breach_parts(t)
    return audit.assess_breaches(exports, affected, F.lit(NOW).cast("timestamp_ntz")).select(
        "breach_id", "exports", "unknown", "affected", "raw_identifiers", masks.category_list(F.col("cat_mask")).alias("categories"),
        "overdue", "unattributed", "severity", "impact", "safety_steps", ts("report_due").alias("report_due"))


@query("breach_resolve", with_views(f"""
select h.breach_id, p.mrn from hit h join (select mrn, {token_sql('mrn', crypto.DEV_AUDIT_KEY, crypto.WHOLE)} as token from patient_administration) p using (token)""",
    *B_VIEWS, dims.PA, extra=SUBJ + "," + BREACH))
def breach_resolve(t):
    """Record numbers to notify, resolved from the register."""
    _, affected = breach_parts(t)
    return audit.resolve(affected, t[dims.PA], crypto.token(F.col("mrn"), crypto.audit_key(t.spark), crypto.WHOLE))


@query("breach_notices", with_views("""
select b.breach_id, b.due, coalesce(s.sent, 0) as sent, strftime(s.last, '%Y-%m-%d %H:%M:%S') as last_sent
from (select breach_id, count(*) as due from hit group by 1) b left join (select breach_id, count(*) as sent, max(notices.at) as last from notices where recipient <> 'board' group by 1) s using (breach_id)""",
    *B_VIEWS, extra=SUBJ + "," + BREACH))
def breach_notices(t):
    """Patients due a notice and notices sent."""
    _, affected = breach_parts(t)
    return audit.intimations(affected, t["notices"]).select("breach_id", "due", "sent", ts("last_sent").alias("last_sent"))


@query("retention_due", with_views("""
select run_id, 'purge' as event, purpose, 'erased ' || files::varchar || ' file(s) after ' || retention_days::varchar || ' d' as note
from retention where delete_after <= timestamp '1996-06-30 00:00:00'""", "retention"))
def retention_due(t):
    """Exports whose retention has run out, as the purge events they give rise to."""
    return retention.purge_events(t["retention"], F.lit("1996-06-30 00:00:00").cast("timestamp_ntz")).select(
        "run_id", "event", "purpose", "note")


@query("retention_survivors", with_views("""
select p.run_id, count(*) as cells from pulled p where not exists (select 1 from retention r where r.run_id = p.run_id and r.delete_after <= timestamp '1996-06-30 00:00:00') group by 1""",
    "pulled", "retention"))
def retention_survivors(t):
    """What stays after the purge."""
    cells = t["pulled"].groupBy("run_id").agg(F.count(F.lit(1)).alias("cells"))       # a run's rows stay or go together: sorted as one
    return retention.survivors(cells, t["retention"], F.lit("1996-06-30 00:00:00").cast("timestamp_ntz"))


# --- access decisions ----------------------------------------------------------------------------------
DECIDE = """
wanted as (select request_id, role, purpose, unnest(string_split(artefacts, ';')) as artefact from access_requests),
unknown as (select request_id, string_agg(artefact, ',' order by artefact) as names from wanted where artefact not in (select artefact from artefacts) group by 1),
cat as (
 select request_id, unnest(string_split(categories, ';')) as category from access_requests where categories is not null
 union select w.request_id, a.category from wanted w join access_requests q using (request_id) join artefacts a using (artefact) where q.categories is null),
excess as (select c.request_id, string_agg(c.category, ',' order by c.category) as names from cat c join access_requests q using (request_id)
 where not exists (select 1 from purpose_allowed p where p.purpose = q.purpose and p.category = c.category) group by 1),
outside as (select request_id, string_agg(distinct artefact, ',' order by artefact) as names from wanted w
 where not exists (select 1 from role_artefacts r where r.role = w.role and r.artefact = w.artefact) group by 1),
decided as (select q.request_id, q.role, q.purpose,
 case when u.names is not null then 'SS-01' when not exists (select 1 from role_purposes p where p.role = q.role and p.purpose = q.purpose) then 'PL-01'
  when e.names is not null then 'DM-01' when o.names is not null then 'SS-01' end as rule_id, u.names as un, e.names as en, o.names as onames
 from access_requests q left join unknown u using (request_id) left join excess e using (request_id) left join outside o using (request_id))
"""


def decided(t):
    req = t["access_requests"].withColumns({"artefacts": F.split("artefacts", ";"), "categories": F.split("categories", ";")})
    return access.authorise(req)


@query("access_decisions", with_views("""
select request_id, rule_id, rule_id is null as allowed, case when un is not null then un when rule_id = 'SS-01' then onames else '' end as denied_artefacts,
 case when rule_id = 'DM-01' then en else '' end as denied_categories from decided""",
    "access_requests", "artefacts", "role_artefacts", "role_purposes", "purpose_allowed", extra=DECIDE))
def access_decisions(t):
    """Every access request decided, with the rule that declined it."""
    return decided(t).select("request_id", "rule_id", "allowed", F.array_join("denied_artefacts", ",").alias("denied_artefacts"),
                             F.array_join("denied_categories", ",").alias("denied_categories"))


@query("access_report", with_views("""
select role, purpose, count(*) as requests, count(*) filter (where rule_id is null) as allowed, count(*) filter (where rule_id = 'PL-01') as by_purpose,
 count(*) filter (where rule_id = 'DM-01') as by_category, count(*) filter (where rule_id = 'SS-01') as by_artefact from decided group by 1, 2""",
    "access_requests", "artefacts", "role_artefacts", "role_purposes", "purpose_allowed", extra=DECIDE))
def access_report(t):
    """Decisions per role and purpose."""
    by = lambda r: F.count_if(F.col("rule_id") == r)
    return decided(t).groupBy("role", "purpose").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed"), by("PL-01").alias("by_purpose"),
        by("DM-01").alias("by_category"), by("SS-01").alias("by_artefact"))


@query("role_scopes", with_views("""
select role, (select count(distinct run_id) from run_cat join runs using (run_id)) as runs,
 coalesce((select string_agg(category, ',' order by category) from seen s where not exists (
  select 1 from role_purposes p join purpose_allowed a using (purpose) where p.role = q.role and a.category = s.category
   and s.category in (select category from role_artefacts ra join artefacts ar using (artefact) where ra.role = q.role))), '') as withheld
from (select distinct role from role_purposes) q""",
    "runs", "pulled", "role_purposes", "role_artefacts", "artefacts", "purpose_allowed",
    extra="run_cat as (select distinct run_id, category from pulled), seen as (select distinct category from run_cat join runs using (run_id))"))
def role_scopes(t):
    """Runs whose records each role may look at, and the categories it would be withheld."""
    per_run = pulls.run_masks(t["pulled"]).join(t["runs"].select("run_id"), "run_id", "left_semi")
    totals = per_run.agg(F.count(F.lit(1)).alias("runs"), F.bit_or("cat_mask").alias("cat_mask"))
    cells = [F.struct(F.lit(r).alias("role"), F.col("runs"), masks.category_list(
        F.col("cat_mask").bitwiseAND(access.role_scope(r)["withheld"])).alias("withheld")) for r in dims.ROLES]
    return totals.select(F.inline(F.array(*cells)))


add_view("function_asks", """
select event_id, case event_id % 3 when 0 then 'reception' when 1 then 'nurse' else 'administrator' end as role, f.function_id
from {events} join {functions} f on f.fn_ord = cast(floor(event_id / 3.0) as bigint) % 32""")


@query("role_functions", with_views("""
select a.role, f.fn_group as function_group, count(*) as asked, count(*) filter (where
 exists (select 1 from role_purposes p where p.role = a.role and p.purpose = f.purpose)
 and not exists (select 1 from function_categories c where c.function_id = f.function_id and not exists (select 1 from purpose_allowed x where x.purpose = f.purpose and x.category = c.category))
 and not exists (select 1 from function_artefacts g where g.function_id = f.function_id and not exists (select 1 from role_artefacts y where y.role = a.role and y.artefact = g.artefact))) as permitted
from function_asks a join functions f using (function_id) group by 1, 2""",
    "function_asks", "functions", "role_purposes", "role_artefacts", "function_artefacts", "function_categories", "purpose_allowed"))
def role_functions(t):
    """Requests for staff functions, and how many the role may use, per group of functions."""
    asked = t["function_asks"].groupBy("role", "function_id").agg(F.count(F.lit(1)).alias("n"))
    gated = access.authorise(access.function_requests(asked, F.col("function_id")))
    return gated.groupBy("role", "function_group").agg(
        F.sum("n").alias("asked"), F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)).alias("permitted"))


