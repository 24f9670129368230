"""Files recognised by their headers, values cleaned, layers of several files, recorded decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import dates, masks, numeric
from pullwise.functions.text import header_key
from pullwise.operators import decisions, ingest
from pullwise.registry.base import query, with_views
from pullwise.sources.tables import add_view, values

MAPPED = """
mapped as (
 select h.file, h.header_ord, h.header, coalesce(o.field, s.field) = '' is true as blanked,
  case when coalesce(o.field, s.field) = '' then null else coalesce(o.field, s.field, h.header) end as name
 from file_headers h left join (select * from column_map where file is not null) o on o.file = h.file and o.header = h.header
 left join (select * from column_map where file is null) s on s.header = h.header),
dn as (select distinct file, name from mapped where name is not null and name <> ''),
hits as (select d.file, c.layer, min(c.layer_ord) as lo, count(*) as hits from dn d join field_catalogue c on c.field = d.name group by 1, 2),
best as (select * from (select *, row_number() over (partition by file order by hits desc, lo) as rn from hits) where rn = 1),
named as (select file, count(*) as names from dn group by 1),
verdict as (
 select f.file, b.layer, coalesce(round(b.hits * 1.0 / n.names, 3), 0)::double as confidence,
  coalesce((select string_agg(m.name, ',' order by m.header_ord, m.name) from mapped m where m.file = f.file and not m.blanked and exists (select 1 from field_catalogue c where c.layer = b.layer and c.field = m.name)), '') as recognised,
  coalesce((select string_agg(m.name, ',' order by m.header_ord, m.name) from mapped m where m.file = f.file and not m.blanked and not exists (select 1 from field_catalogue c where c.layer = b.layer and c.field = m.name)), '') as not_understood,
  coalesce((select string_agg(m.header, ',' order by m.header_ord, m.header) from mapped m where m.file = f.file and m.blanked), '') as blanked
 from (select distinct file from file_headers) f left join best b on b.file = f.file left join named n on n.file = f.file)
"""


@query("infer_layer", with_views("""
select file, layer, confidence, recognised, not_understood, blanked,
 case when layer is null then 'no catalogue field' when replace(replace(recognised, 'mrn', ''), ',', '') = '' then 'only a shared key'
  when confidence < 0.5 then 'too few columns understood' end as reason from verdict""", "file_headers", "column_map", "field_catalogue", extra=MAPPED))
def infer_layer(t):
    """Each file's layer from its headers under the column map, or why it is not read."""
    v = ingest.read_verdicts(t["file_headers"], t["column_map"])
    return v.select("file", "layer", "confidence", *[F.array_join(c, ",").alias(c) for c in ("recognised", "not_understood", "blanked")], "reason")


@query("mapping_template", with_views("""
select m.file, m.name as header, case when m.name in ('mrn', 'subject_mrn') and m.name <> case when b.layer = 'infrastructure_integration' then 'subject_mrn' else 'mrn' end
  then case when b.layer = 'infrastructure_integration' then 'subject_mrn' else 'mrn' end else '' end as field
from mapped m left join best b on b.file = m.file where not m.blanked and not exists (select 1 from field_catalogue c where c.layer = b.layer and c.field = m.name)""",
    "file_headers", "column_map", "field_catalogue", extra=MAPPED))
def mapping_template(t):
    """Headers a person still has to map, with the key to use where another layer's key was given."""
    return ingest.template_rows(t["file_headers"], t["column_map"])


add_view("raw_values", """
select o_orderkey as row_ix, 'file-' || cast(o_custkey % 40 as string) as source_file,
 case o_orderkey % 6 when 0 then substr(d,9,2) || '/' || substr(d,6,2) || '/' || substr(d,1,4) when 1 then substr(d,1,10)
  when 2 then substr(d,1,10) || 'T' || substr(d,12,8) when 3 then 'not a date' when 4 then null
  else substr(d,9,2) || '-' || substr(d,6,2) || '-' || substr(d,1,4) end as encounter_datetime,
 case o_orderkey % 5 when 0 then cast(w as string) || '.50' when 1 then 'pending' when 2 then null
  when 3 then substr(cast(w as string), 1, length(cast(w as string)) - 3) || ',' || substr(cast(w as string), length(cast(w as string)) - 2, 3) || '.25'
  else cast(w as string) end as billed_amount
from (select *, cast(o_orderdate as string) as d, 1000 + cast(floor(o_totalprice) as bigint) as w from {orders}) o""")


@query("date_normalise", with_views("""
select row_ix, coalesce(strftime(coalesce(try_strptime(encounter_datetime, '%Y-%m-%d'), try_strptime(encounter_datetime, '%Y-%m-%dT%H:%M:%S'),
 try_strptime(encounter_datetime, '%d/%m/%Y'), try_strptime(encounter_datetime, '%d-%m-%Y')), '%Y-%m-%dT%H:%M:%S'), encounter_datetime) as encounter_datetime
from raw_values""", "raw_values"))
def date_normalise(t):
    """Dates in ISO form, ISO read first, then day first; the rest as written."""
    return t["raw_values"].select("row_ix", dates.normalise_date(F.col("encounter_datetime"), True).alias("encounter_datetime"))


@query("number_normalise", with_views("""
select row_ix, try_cast(replace(billed_amount, ',', '') as double) as amount, billed_amount as as_written from raw_values""", "raw_values"))
def number_normalise(t):
    """Amounts parsed beside the text they were written as."""
    return t["raw_values"].select("row_ix", numeric.parse_number(F.col("billed_amount")).alias("amount"), F.col("billed_amount").alias("as_written"))


@query("unparsed_counts", with_views("""
select source_file, count(*) as rows, count(*) filter (where encounter_datetime = 'not a date') as unparsed_encounter_datetime,
 count(*) filter (where billed_amount = 'pending') as unparsed_billed_amount from raw_values group by 1""", "raw_values"))
def unparsed_counts(t):
    """Values left as written, per file."""
    return ingest.unparsed_counts(t["raw_values"].drop("row_ix"), "source_file")


add_view("loose_rows", """
select row_ix, mrn, primary_diagnosis, case when row_ix % 97 = 5 then 'haemolysed' else cast(lab_result as string) end as lab_result,
 case when row_ix % 53 = 7 then 'B-12' else null end as bed_no from {clinical_ehr}""")


@query("row_validation", with_views("""
select row_ix, case when try_cast(lab_result as double) is null then 'lab_result' else 'bed_no' end as field,
 case when try_cast(lab_result as double) is null then 'Input should be a valid number, unable to parse string as a number' else 'Extra inputs are not permitted' end as problem
from loose_rows where try_cast(lab_result as double) is null or bed_no is not null""", "loose_rows"))
def row_validation(t):
    """Rows that do not fit their layer, with the first problem of each."""
    return ingest.validation_errors(dims.EHR, t["loose_rows"])


def concept_files(t):
    """The clinical layer as four files, one per concept, with different columns."""
    e = t[dims.EHR]
    return {"conditions.csv": e.select("mrn", "primary_diagnosis"), "medications.csv": e.select("mrn", "medication"),
            "allergies.csv": e.where("allergy is not null").select("mrn", "allergy"),
            "observations.csv": e.select("mrn", "lab_result", "encounter_datetime")}


@query("stack_files", with_views("""
select 'allergies' as ask, 'allergies.csv' as source_file, count(*) as rows, count(allergy) as values_read from clinical_ehr where allergy is not null
union all select 'two concepts', 'conditions.csv', count(*), 0 from clinical_ehr
union all select 'two concepts', 'medications.csv', count(*), count(medication) from clinical_ehr
union all select 'key only', 'conditions.csv', count(*), 0 from clinical_ehr union all select 'key only', 'medications.csv', count(*), 0 from clinical_ehr
union all select 'key only', 'allergies.csv', count(*), 0 from clinical_ehr where allergy is not null
union all select 'key only', 'observations.csv', count(*), 0 from clinical_ehr""", dims.EHR))
def stack_files(t):
    """Rows a fetch reads from a layer of several files: only files carrying what was asked for."""
    files = concept_files(t)

    def ask(name, fields, value):
        got = ingest.fetch_stacked(dims.EHR, files, fields)
        n = F.count(value) if value else F.lit(0).cast("bigint")
        return got.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), n.alias("values_read")).select(
            F.lit(name).alias("ask"), "source_file", "rows", "values_read")
    return (ask("allergies", ["mrn", "allergy"], "allergy").unionAll(ask("two concepts", ["primary_diagnosis", "medication"], "medication"))
            .unionAll(ask("key only", ["mrn"], None)))


add_view("shown_headers", """
select l_orderkey as page, l_linenumber as ord, case l_suppkey % 5 when 0 then '  Patient   Number ' when 1 then 'AMOUNT DUE'
 when 2 then 'Allergies' when 3 then 'Date Of Birth' else 'Bed' end as header from {lineitem}""")
add_view("field_aliases", values("shown, field", [("patient number", "mrn"), ("Amount due", "billed_amount"), ("allergies", "allergy"),
                                                  ("date of birth", "date_of_birth")]))


@query("header_alias", with_views("""
select h.page, h.ord, h.header, coalesce(a.field, h.header) as field from shown_headers h
left join field_aliases a on lower(regexp_replace(trim(a.shown), '\\s+', ' ', 'g')) = lower(regexp_replace(trim(h.header), '\\s+', ' ', 'g'))""",
    "shown_headers", "field_aliases"))
def header_alias(t):
    """Displayed headers mapped to fields, whatever their case and spacing."""
    aliases = t["field_aliases"].select(header_key(F.col("shown")).alias("k"), "field")
    return (t["shown_headers"].withColumn("k", header_key(F.col("header"))).join(aliases, "k", "left")
            .select("page", "ord", "header", F.coalesce("field", "header").alias("field")))


# --- recorded decisions --------------------------------------------------------------------------------
add_view("decisions", """
select o_orderkey as decision_id, 'provider-' || cast(o_custkey % 5 as string) as provider, 'Model ' || cast(o_custkey % 3 as string) || '.x' as model,
 case o_custkey % 4 when 0 then 'unaided' when 1 then 'informed' else 'policy' end as briefing,
 case o_orderkey % 8 when 0 then 'patient-summary' when 1 then 'ward-census' when 2 then 'medication-review' when 3 then 'appointment-reminder'
  when 4 then 'claim-reconciliation' when 5 then 'desk-registration' when 6 then 'ward-summary-registry' else 'consultant-file' end as task_id,
 case when o_custkey % 15 = 4 and o_orderkey % 8 = 5 then 'old brief' else 'brief-' || cast(o_orderkey % 8 as string) end as fingerprint,
 case o_orderkey % 3 when 0 then 'none' when 1 then 'consent' else 'legitimate_use' end as lawful_basis_type,
 case when o_orderkey % 2 = 0 then '  ' else ' LU-CARE ' end as lawful_basis_reference, cast(o_orderkey % 7 as int) * 20 as retention_days,
 case when o_orderkey % 4 = 0 then '' else 'PURGE-01' end as deletion_mechanism, case when o_orderkey % 5 = 0 then ' ' else 'NOTICE-REG-2026' end as notice_reference,
 case when o_orderkey % 6 = 0 then '' else 'DPO' end as accountable_party,
 case o_orderkey % 4 when 0 then 'None' when 1 then 'n/a;research registry' when 2 then ' billing_settlement ' else '' end as uses
from {orders} where not (o_custkey % 15 = 7 and o_orderkey % 8 = 3)""")
add_view("decision_fields", """
select l_orderkey as decision_id, case when l_suppkey % 11 = 0 then c.layer || '/unknown_' || c.field when l_suppkey % 13 = 0 then c.field else c.layer || '/' || c.field end as ref
from {lineitem} join {field_catalogue} c on c.layer_ord = l_partkey % 5 and c.field_ord = l_linenumber % 5""")
add_view("tasks_today", values("task_id, fingerprint", decisions.TASKS_TODAY))


@query("decision_manifests", with_views("""
select decision_id, case when lawful_basis_type <> 'none' then lawful_basis_type end as basis_type,
 case when lawful_basis_type <> 'none' then nullif(trim(lawful_basis_reference), '') end as basis_reference, nullif(retention_days, 0) as retention_days,
 nullif(deletion_mechanism, '') as deletion_mechanism, nullif(trim(notice_reference), '') as notice_reference, nullif(accountable_party, '') as accountable_party,
 case uses when 'n/a;research registry' then 'research registry' when ' billing_settlement ' then 'billing_settlement' else '' end as secondary_uses from decisions""", "decisions"))
def decision_manifests(t):
    """Decisions as manifests."""
    d = t["decisions"].withColumn("secondary_uses", F.split("uses", ";"))
    return decisions.manifests(d).select("decision_id", "basis_type", "basis_reference", "retention_days", "deletion_mechanism", "notice_reference",
                                         "accountable_party", F.array_join("secondary_uses", ";").alias("secondary_uses"))


@query("decision_fields", with_views("""
select decision_id, coalesce(string_agg(distinct c.layer || '/' || c.field, ',' order by c.layer || '/' || c.field) filter (where c.field is not null), '') as known,
 coalesce(string_agg(distinct ref, ',' order by ref) filter (where c.field is null), '') as unknown
from (select *, case when c.field is null then d.ref end as x from decision_fields d left join field_catalogue c on d.ref = c.layer || '/' || c.field) c group by 1""",
    "decision_fields", "field_catalogue"))
def decision_fields(t):
    """Fields each decision asked for, split into known and unknown references."""
    return decisions.selection(t["decision_fields"]).select(
        "decision_id", F.array_join(masks.field_names(F.col("field_mask")), ",").alias("known"), F.array_join("unknown_fields", ",").alias("unknown"))


@query("stale_decisions", with_views("""
select a.provider, a.model, a.briefing, coalesce(string_agg(t.task_id, ',' order by t.task_id) filter (where s.n is null), '') as missing,
 coalesce(string_agg(t.task_id, ',' order by t.task_id) filter (where s.fp <> t.fingerprint), '') as stale, case when count(*) filter (where s.n is null) = 0 then min(s.n) end as max_repeats
from (select distinct provider, model, briefing from decisions) a cross join tasks_today t
left join (select provider, model, briefing, task_id, count(*) as n, max(fingerprint) as fp from decisions group by all) s
 on s.provider = a.provider and s.model = a.model and s.briefing = a.briefing and s.task_id = t.task_id group by 1, 2, 3""", "decisions", "tasks_today"))
def stale_decisions(t):
    """Agents whose recordings are missing or answer an older brief, and how often they can be replayed."""
    return decisions.freshness(t["decisions"], t["tasks_today"]).select(
        "provider", "model", "briefing", F.array_join("missing", ",").alias("missing"), F.array_join("stale", ",").alias("stale"), "max_repeats")
