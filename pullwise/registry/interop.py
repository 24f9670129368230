"""Privacy and shaping of exports, and the search for identifiers in what was written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import crypto, text
from pullwise.operators import fhir, hl7, leaks, privacy
from pullwise.registry.base import query, with_views
from pullwise.session import written
from pullwise.sources.tables import add_view

KEY = "export-key-for-checks"
WHEN = "20260101000000"

# An export is a run; each run exports many rows, and the runs' manifests declare pseudonymisation or not.
for _layer in dims.LAYERS:
    add_view(f"export_{_layer}", "select 'run-' || lpad(cast(row_ix % 500 as string),8,'0') as run_id, "
             "(row_ix % 500) % 7 < 3 as pseudonymised, * from {" + _layer + "}")


def token_sql(v: str, key: str = KEY, digits: int = 12) -> str:
    inner, outer = crypto.pads(key)
    return f"('PSN-' || substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({v})))), 1, {digits}))"


def rows_sql(layer: str) -> str:
    """CTE ``x``: the exported rows, pseudonymised and generalised where declared, numbered per run."""
    repl = [f"case when pseudonymised and {c} is not null then {token_sql(c)} else {c} end as {c}" for c in dims.direct_identifiers(layer)]
    if layer == dims.PA:
        repl += ["case when pseudonymised then substr(date_of_birth, 1, 4) else date_of_birth end as date_of_birth",
                 "case when pseudonymised then substr(pincode, 1, 3) || 'XXX' else pincode end as pincode"]
    return (f"x as (select * replace ({', '.join(repl)}), row_number() over (partition by run_id order by {', '.join(['e.row_ix', *ties_of(layer, 'e.')])}) as n "
            f"from export_{layer} e)")


def ties_of(layer: str, prefix: str = "") -> list[str]:
    """Columns that order rows sharing a row index (order lines may repeat)."""
    return [prefix + f for f in dims.FIELD_CATALOGUE[layer]] if layer == dims.ANC else []


def exported_rows(layer, rows):
    return fhir.numbered_rows(layer, privacy.normalise_rows(layer, rows, KEY, F.col("pseudonymised")), tuple(ties_of(layer)))


def exported(t, layer):
    return exported_rows(layer, t[f"export_{layer}"])


def seg_sql(name: str, fields: dict[int, str]) -> str:
    """A segment as SQL text: positional list, trailing empties trimmed."""
    cells = ", ".join(f"coalesce({fields[i]}, '')" if i in fields else "''" for i in range(1, max(fields) + 1))
    return f"rtrim('{name}|' || array_to_string([{cells}], '|'), '|')"


def cond(expr: str, when: str) -> str:
    return f"case when {when} then chr(13) || {expr} else '' end"


D = "replace(replace(replace({0}, '-', ''), ':', ''), 'T', '')"
HEAD = "'MSH|^~\\&|EXTRACTION|HIS|||" + WHEN + "||{0}|' || run_id || '-{1}-' || n::varchar || '|P|2.5'"
PID_FULL = seg_sql("PID", {
    1: "'1'", 3: "mrn || '^^^HIS^MR'",
    5: "case when contains(full_name, ' ') then split_part(full_name, ' ', -1) || '^' || array_to_string(string_split(full_name, ' ')[:-2], ' ') else full_name end",
    7: D.format("date_of_birth"), 8: "sex", 11: "coalesce(street_address, '') || '^^^^' || coalesce(pincode, '')",
    13: "coalesce(phone, '') || '^^^' || coalesce(email, '')"})
PID_MRN = seg_sql("PID", {1: "'1'", 3: "mrn || '^^^HIS^MR'"})
MESSAGE_SQL = {
    dims.PA: HEAD.format("ADT^A04^ADT_A01", dims.PA) + " || " + cond(
        seg_sql("EVN", {1: "'A04'", 2: D.format("admission_datetime")}), "admission_datetime is not null")
    + " || chr(13) || " + PID_FULL + " || chr(13) || " + seg_sql(
        "PV1", {1: "'1'", 2: "'I'", 3: "admission_ward", 44: D.format("admission_datetime")}),
    dims.EHR: HEAD.format("ORM^O01^ORM_O01", dims.EHR) + " || chr(13) || " + PID_MRN + " || chr(13) || " + seg_sql(
        "PV1", {1: "'1'", 7: "attending_clinician", 44: D.format("encounter_datetime")})
    + " || " + cond(seg_sql("AL1", {1: "'1'", 3: "allergy"}), "allergy is not null")
    + " || chr(13) || " + seg_sql("DG1", {1: "'1'", 3: "primary_diagnosis"})
    + " || chr(13) || " + seg_sql("OBX", {1: "'1'", 2: "'NM'", 3: "'LAB'", 5: "lab_result::varchar"}),
    dims.ANC: HEAD.format("ORU^R01^ORU_R01", dims.ANC) + " || chr(13) || " + PID_MRN + " || chr(13) || " + seg_sql(
        "OBR", {1: "'1'", 2: "order_id", 4: "imaging_modality", 15: "specimen_type"})
    + " || chr(13) || " + seg_sql("OBX", {1: "'1'", 2: "'NM'", 3: "'RESULT'", 5: "result_value::varchar"})
    + " || chr(13) || " + seg_sql("NTE", {1: "'1'", 3: "report_text"}),
    dims.FIN: HEAD.format("DFT^P03^DFT_P03", dims.FIN) + " || chr(13) || " + PID_MRN + " || chr(13) || " + seg_sql(
        "FT1", {1: "'1'", 2: "invoice_id", 6: "'CG'", 11: "billed_amount::varchar"})
    + " || chr(13) || " + seg_sql("IN1", {1: "'1'", 4: "payer_name", 36: "insurance_policy_no"}),
}
SHORT = {dims.PA: "hl7_adt", dims.EHR: "hl7_orm", dims.ANC: "hl7_oru", dims.FIN: "hl7_dft"}


def _hl7_query(layer):
    @query(SHORT[layer], with_views(f"select row_ix, run_id || '-{layer}-' || n::varchar as control_id, {MESSAGE_SQL[layer]} as message from x",
                                    f"export_{layer}", extra=rows_sql(layer)))
    def run(t):
        df = exported(t, layer)
        return df.select("row_ix", hl7.control_id(layer).alias("control_id"),
                         hl7.message(layer, df, hl7.control_id(layer), WHEN).alias("message"))
    run.__doc__ = f"One HL7 v2 {hl7.MESSAGE_OF[layer]} message per exported row."


for _layer in SHORT:
    _hl7_query(_layer)


# --- FHIR ------------------------------------------------------------------------------------------
def s(v):
    return f"'\"' || {v} || '\"'"


SUBJ = "'{\"identifier\":{\"system\":\"urn:his:mrn\",\"value\":' || " + s("mrn") + " || '}}'"
ENC_CLASS = {True: '{"system":"http://terminology.hl7.org/CodeSystem/v3-ActCode","code":"IMP","display":"inpatient encounter"}',
             False: '{"system":"http://terminology.hl7.org/CodeSystem/v3-NullFlavor","code":"UNK","display":"unknown"}'}
FHIR_SQL = {
    dims.PA: [("Patient", "true",
               "'{\"resourceType\":\"Patient\",\"identifier\":[{\"system\":\"urn:his:mrn\",\"value\":' || " + s("mrn")
               + " || '}],\"name\":[{\"text\":' || " + s("full_name") + " || '}],\"birthDate\":' || " + s("date_of_birth")
               + " || ',\"gender\":' || case sex when 'F' then '\"female\"' when 'M' then '\"male\"' else '\"other\"' end || ',\"telecom\":[{\"system\":\"phone\",\"value\":' || "
               + s("phone") + " || '},{\"system\":\"email\",\"value\":' || " + s("email") + " || '}],\"address\":[{\"line\":[' || "
               + s("street_address") + " || '],\"postalCode\":' || " + s("pincode") + " || '}]}'"),
              ("Encounter", "true",
               "'{\"resourceType\":\"Encounter\",\"status\":\"in-progress\",\"subject\":' || " + SUBJ
               + " || coalesce(',\"period\":{\"start\":\"' || admission_datetime || '\"}', '') || ',\"class\":" + ENC_CLASS[True]
               + ",\"location\":[{\"location\":{\"display\":' || " + s("admission_ward") + " || '}}]}'")],
    dims.EHR: [("Encounter", "true",
                "'{\"resourceType\":\"Encounter\",\"status\":\"in-progress\",\"subject\":' || " + SUBJ
                + " || ',\"period\":{\"start\":' || " + s("encounter_datetime") + " || '},\"class\":" + ENC_CLASS[False]
                + ",\"participant\":[{\"individual\":{\"display\":' || " + s("attending_clinician") + " || '}}]}'"),
               ("Condition", "true", "'{\"resourceType\":\"Condition\",\"subject\":' || " + SUBJ + " || ',\"code\":{\"text\":' || "
                + s("primary_diagnosis") + " || '}}'"),
               ("MedicationRequest", "true", "'{\"resourceType\":\"MedicationRequest\",\"status\":\"active\",\"intent\":\"order\",\"subject\":' || "
                + SUBJ + " || ',\"medicationCodeableConcept\":{\"text\":' || " + s("medication") + " || '}}'"),
               ("AllergyIntolerance", "allergy is not null", "'{\"resourceType\":\"AllergyIntolerance\",\"patient\":' || " + SUBJ
                + " || ',\"code\":{\"text\":' || " + s("allergy") + " || '}}'"),
               ("Observation", "true", "'{\"resourceType\":\"Observation\",\"status\":\"final\",\"subject\":' || " + SUBJ
                + " || ',\"code\":{\"text\":\"laboratory result\"},\"valueQuantity\":{\"value\":' || lab_result::varchar || '}}'")],
    dims.ANC: [("ServiceRequest", "true", "'{\"resourceType\":\"ServiceRequest\",\"status\":\"active\",\"intent\":\"order\",\"subject\":' || " + SUBJ
                + " || ',\"identifier\":[{\"value\":' || " + s("order_id") + " || '}],\"code\":{\"text\":' || " + s("imaging_modality")
                + " || '},\"specimen\":[{\"display\":' || " + s("specimen_type") + " || '}]}'"),
               ("Observation", "true", "'{\"resourceType\":\"Observation\",\"status\":\"final\",\"subject\":' || " + SUBJ
                + " || ',\"code\":{\"text\":\"result\"},\"valueQuantity\":{\"value\":' || result_value::varchar || '}}'"),
               ("DiagnosticReport", "true", "'{\"resourceType\":\"DiagnosticReport\",\"status\":\"final\",\"subject\":' || " + SUBJ
                + " || ',\"conclusion\":' || " + s("report_text") + " || ',\"code\":{\"text\":' || " + s("imaging_modality") + " || '}}'")],
    dims.FIN: [("Invoice", "true", "'{\"resourceType\":\"Invoice\",\"status\":\"issued\",\"subject\":' || " + SUBJ
                + " || ',\"identifier\":[{\"value\":' || " + s("invoice_id") + " || '}],\"totalGross\":{\"value\":' || billed_amount::varchar || ',\"currency\":\"INR\"}}'"),
               ("Coverage", "true", "'{\"resourceType\":\"Coverage\",\"status\":\"active\",\"beneficiary\":' || " + SUBJ
                + " || ',\"payor\":[{\"display\":' || " + s("payer_name") + " || '}],\"subscriberId\":' || " + s("insurance_policy_no") + " || '}'")],
    dims.INF: [("AuditEvent", "true",
                "'{\"resourceType\":\"AuditEvent\",\"type\":{\"system\":\"http://dicom.nema.org/resources/ontology/DCM\",\"code\":\"110110\",\"display\":\"Patient Record\"},\"source\":{\"observer\":{\"display\":' || "
                + s("source_system") + " || '}},\"agent\":[{\"requestor\":true,\"role\":[{\"text\":' || " + s("actor_role") + " || '}],\"name\":' || " + s("source_system")
                + " || '}],\"id\":' || " + s("audit_event_id") + " || ',\"action\":\"' || case action when 'read' then 'R' when 'create' then 'C' when 'update' then 'U' else 'E' end || '\",\"recorded\":' || "
                + s("event_timestamp") + " || ',\"entity\":[{\"what\":{\"identifier\":{\"system\":\"urn:his:mrn\",\"value\":' || " + s("subject_mrn") + " || '}}}]}'")],
}
FHIR_NAME = {dims.PA: "fhir_patient", dims.EHR: "fhir_clinical", dims.ANC: "fhir_ancillary", dims.FIN: "fhir_financial",
             dims.INF: "fhir_audit"}
UUID_SQL = ("substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || "
            "substr('89ab89ab89ab89ab', position(substr(h,17,1) in '0123456789abcdef'), 1) || substr(h,18,3) || '-' || substr(h,21,12)")


def shaped_sql(layer: str) -> str:
    parts = " union all ".join(
        f"select run_id, row_ix, n * 8 + {i} as ord, '{kind}' as resource_type, {made} as body from x where {when}"
        for i, (kind, when, made) in enumerate(FHIR_SQL[layer]))
    return f"""shaped as ({parts}),
numbered as (select *, row_number() over (partition by run_id order by ord) - 1 as pos from shaped),
hashed as (select *, sha1(from_hex('{crypto.UUID_NAMESPACE_URL}') || encode(run_id || '/' || pos::varchar)) as h from numbered),
entries as (select run_id, row_ix, pos, resource_type, 'urn:uuid:' || {UUID_SQL} as full_url,
  case when resource_type = 'AuditEvent' then body else substr(body, 1, length(body) - 1) || ',"id":"' || {UUID_SQL} || '"}}' end as resource from hashed)"""


def _fhir_query(layer):
    @query(FHIR_NAME[layer], with_views("select run_id, row_ix, pos as n, resource_type, full_url, resource from entries",
                                        f"export_{layer}", extra=rows_sql(layer) + "," + shaped_sql(layer)))
    def run(t):
        return fhir.bundle(layer, exported(t, layer), "row_ix")


for _layer in FHIR_NAME:
    _fhir_query(_layer)


@query("pseudonymise", with_views(
    f"select row_ix, {token_sql('mrn')} as mrn, {token_sql('full_name')} as full_name, {token_sql('phone')} as phone, email from patient_administration", dims.PA))
def pseudonymise(t):
    """Direct identifiers of registration rows as keyed tokens."""
    return privacy.pseudonymise(dims.PA, t[dims.PA], KEY).select("row_ix", "mrn", "full_name", "phone", "email")


@query("generalise_k_anonymity", with_views("""
select admission_ward, (select min(n) from g where g.admission_ward = w.admission_ward) as k, sum(n)::bigint as k_rows, count(*) as groups from g w group by 1""",
    dims.PA, extra="""g as (select admission_ward, substr(date_of_birth, 1, 4) as y, sex, substr(regexp_replace(pincode, '[^0-9]', '', 'g'), 1, 3) || 'XXX' as p, count(*) as n
 from patient_administration group by all)"""))
def generalise_k_anonymity(t):
    """k of the generalised registration export, per ward."""
    return privacy.k_anonymity(privacy.generalise(t[dims.PA]), "admission_ward")


COUNTS_SQL = " union all ".join(
    f"select run_id, '{layer}' as layer, {'count(*)' if layer in MESSAGE_SQL else '0'} as hl7_messages, "
    f"sum({' + '.join(f'({when})::int' for _, when, _ in FHIR_SQL[layer])})::bigint as fhir_resources, "
    f"'{','.join(privacy.skipped_standards(layer))}' as skipped from export_{layer} group by 1" for layer in dims.LAYERS)


@query("export_counts", with_views(COUNTS_SQL, *[f"export_{layer}" for layer in dims.LAYERS]))
def export_counts(t):
    """Messages and resources of every export and layer, and the standards not shaped."""
    parts = []
    for layer in dims.LAYERS:
        rows = t[f"export_{layer}"]
        messages = F.count(F.lit(1)) if layer in hl7.MESSAGE_OF else F.lit(0).cast("bigint")
        parts.append(rows.groupBy("run_id").agg(messages.alias("hl7_messages"), F.sum(fhir.count_resources(layer, rows)).alias("fhir_resources")).select(
            "run_id", F.lit(layer).alias("layer"), "hl7_messages", "fhir_resources", F.lit(",".join(privacy.skipped_standards(layer))).alias("skipped")))
    return reduce(lambda a, b: a.unionAll(b), parts)


@query("export_samples", with_views(f"select run_id, {MESSAGE_SQL[dims.FIN]} as message from x where n = 1", f"export_{dims.FIN}", extra=rows_sql(dims.FIN)))
def export_samples(t):
    """The first message of every billing export, for a reader: the first row is found before anything is shaped."""
    first = t[f"export_{dims.FIN}"].groupBy("run_id").agg(F.min_by(F.struct("*"), "row_ix").alias("r")).select("r.*")
    row = privacy.normalise_rows(dims.FIN, first, KEY, F.col("pseudonymised")).withColumn("n", F.lit(1))
    return row.select("run_id", hl7.message(dims.FIN, row, hl7.control_id(dims.FIN), WHEN).alias("message"))


@query("export_resource_samples", with_views("""
select run_id, resource_type, resource from entries where pos = 0""", f"export_{dims.PA}", extra=rows_sql(dims.PA) + "," + shaped_sql(dims.PA)))
def export_resource_samples(t):
    """The first resource of every registration export, for a reader: the first row that makes one is found before anything is shaped."""
    rows = t[f"export_{dims.PA}"]
    first = rows.where(fhir.count_resources(dims.PA, rows) > 0).groupBy("run_id").agg(F.min_by(F.struct("*"), "row_ix").alias("r")).select("r.*")
    made = fhir.bundle(dims.PA, exported_rows(dims.PA, first))
    return made.where("n = 0").select("run_id", "resource_type", "resource")


@query("token_share", with_views(f"""
select run_id, count(mrn) as identifiers, count(*) filter (where mrn like 'PSN-%') as tokens from x group by 1""", f"export_{dims.PA}", extra=rows_sql(dims.PA)))
def token_share(t):
    """Record numbers in each registration export, and how many of them are tokens."""
    return exported(t, dims.PA).groupBy("run_id").agg(F.count("mrn").alias("identifiers"), F.count_if(crypto.is_token(F.col("mrn"))).alias("tokens"))


# --- leak searches ---------------------------------------------------------------------------------------
NORM = "' ' || regexp_replace({0}, '[^a-z0-9]+', ' ', 'g') || ' '"
LEAK_SQL = """
values_n as (select *, regexp_replace(value, '[^0-9]', '', 'g') as dg, list_filter(string_split(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') as ws from probe),
art as (select *, ' ' || regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g') || ' ' as tn,
 list_filter(list_transform(regexp_split_to_array(text, '[|^~&\\\\\\r\\n"{}\\[\\],:]'), lambda f: regexp_replace(f, '[^0-9]', '', 'g')), lambda d: d <> '') as df from artefact_texts)
"""
FOUND = """(len(ws) > 0 and len(list_filter(ws, lambda w: contains(a.tn, ' ' || w || ' '))) = len(ws))
 or (length(dg) >= 7 and length(dg) >= length(replace(value, ' ', '')) - 4 and len(list_filter(a.df, lambda d: contains(d, dg))) > 0)"""


@query("leak_audit", with_views(f"""
select value, exists (select 1 from art a where {FOUND}) as leaked from values_n v""", extra=r"""
artefact_texts as (select doc_id, text from documents),
mails as (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) as v from documents),
cards as (select distinct unnest(regexp_extract_all(text, '[0-9]{16}')) as v from documents),
probe as (select v as value from mails union select reverse(v) from mails union select split_part(v, '@', 2) || ' ' || split_part(v, '@', 1) from mails
 union select v from cards union select reverse(v) from cards
 union select substr(v,1,4) || '-' || substr(v,5,4) || '-' || substr(v,9,4) || '-' || substr(v,13,4) from cards),""" + LEAK_SQL))
def leak_audit(t):
    """Which identifiers, also re-ordered or re-punctuated, can be found in the documents."""
    docs = t["documents"]
    mails = docs.where(F.col("text").contains("@")).select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), 0)).alias("v")).distinct()
    cards = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]{16}"), 0)).alias("v")).distinct()
    v = F.col("v")
    groups = F.concat_ws("-", *[F.substring(v, i, 4) for i in (1, 5, 9, 13)])
    swapped = F.concat(F.split_part(v, F.lit("@"), F.lit(2)), F.lit(" "), F.split_part(v, F.lit("@"), F.lit(1)))
    probes = mails.select(F.explode(F.array(v, F.reverse(v), swapped)).alias("value")).unionAll(
        cards.select(F.explode(F.array(v, F.reverse(v), groups)).alias("value")))
    return leaks.find_leaks(probes, docs.select(F.col("doc_id").alias("artefact_id"), "text"))


@query("export_audit", with_views(f"""
select p.run_id, count(*) as identifier_values, count(*) filter (where exists (select 1 from art a where a.run_id = p.run_id and ({FOUND}))) as leaked,
 (select count(*) from artefact_texts a where a.run_id = p.run_id) as artefacts_checked,
 (select min(c) from (select count(*) as c from x where x.run_id = p.run_id group by date_of_birth, sex, pincode)) as k,
 (select count(*) from x where x.run_id = p.run_id) as k_rows
from values_n p group by p.run_id""", f"export_{dims.PA}", extra=rows_sql(dims.PA) + "," + shaped_sql(dims.PA) + f""",
artefact_texts as (select run_id, {MESSAGE_SQL[dims.PA]} as text from x union all select run_id, body from shaped),
probe as (select distinct run_id, mrn as value from export_patient_administration union select run_id, full_name from export_patient_administration
 union select run_id, phone from export_patient_administration),""" + LEAK_SQL))
def export_audit(t):
    """Every registration export searched for the raw identifiers it was made from, with its k."""
    raw = t[f"export_{dims.PA}"]
    rows = written(exported(t, dims.PA), "rows")
    msgs = rows.select("run_id", F.concat(F.lit("m"), F.col("row_ix").cast("string")).alias("artefact_id"),
                       hl7.message(dims.PA, rows, hl7.control_id(dims.PA), WHEN).alias("text"))
    res = fhir.shape(dims.PA, rows, "run_id", "n").select(
        "run_id", F.concat(F.lit("r"), (F.col("n") * 8 + F.col("position")).cast("string")).alias("artefact_id"),
        F.col("resource").alias("text"))
    artefacts = written(msgs.unionAll(res), "artefacts")
    probes = raw.select("run_id", F.explode(F.array(*[F.col(c) for c in dims.direct_identifiers(dims.PA)])).alias("value"))
    found = leaks.find_leaks(probes, artefacts, ["run_id"]).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("identifier_values"), F.count_if("leaked").alias("leaked"))
    checked = artefacts.groupBy("run_id").agg(F.count(F.lit(1)).alias("artefacts_checked"))
    k = privacy.k_anonymity(rows, "run_id").drop("groups")
    k = k.drop("k_rows").join(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("k_rows")), "run_id")     # all registration rows
    return k.join(found, "run_id", "left").join(checked, "run_id", "left").fillna(0, ["identifier_values", "leaked", "artefacts_checked"])


@query("exact_leak_scan", with_views("""
select v.value, d.doc_id as artefact_id from v join documents d on contains(d.text, v.value)""", extra=r"""
v as (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) as value from documents)"""))
def exact_leak_scan(t):
    """Known identifiers occurring verbatim in the documents."""
    docs = t["documents"]
    mails = docs.where(F.col("text").contains("@")).select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), 0)).alias("value"))
    return leaks.exact_leaks(mails, docs.select(F.col("doc_id").alias("artefact_id"), "text"))


@query("subject_tokens", with_views(f"""
select run_id, count(distinct subject) as subjects, count(*) filter (where subject is null) as unattributed from (
 select run_id, {token_sql('subject_mrn', crypto.DEV_AUDIT_KEY)} as subject from audit_events) group by 1""", "audit_events"))
def subject_tokens(t):
    """Distinct patients each run's events name, as audit tokens."""
    key = crypto.audit_key(t.spark)
    tok = t["audit_events"].select("run_id", crypto.token(F.col("subject_mrn"), key, crypto.WHOLE).alias("subject"))
    return tok.groupBy("run_id").agg(F.count_distinct("subject").alias("subjects"),
                                     F.count_if(F.col("subject").isNull()).alias("unattributed"))


@query("masked_numbers", with_views("""
select row_ix, 'MRN' || repeat('*', length(mrn) - 5) || right(mrn, 2) as masked,
 repeat('*', length(phone) - 2) || right(phone, 2) as phone from patient_administration""", dims.PA))
def masked_numbers(t):
    """Record and phone numbers as shown to a reader."""
    return t[dims.PA].select("row_ix", text.mask_value(F.col("mrn")).alias("masked"), text.mask_value(F.col("phone")).alias("phone"))
