"""Bindings of the engine's inputs onto a directory of parquet tables.

Each view is one SQL text that Spark and any ANSI engine can run. In Spark the names in braces are
replaced by DataFrames (so pruning and pushdown reach the parquet scans); ``ctes`` renders the same
text as a WITH list over plain table names.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from pullwise import dims
from pullwise.session import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _lit(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def values(columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) as t({columns})"


def _tasks():
    return {**dims.TASKS, **dims.INJECTION_TASKS}


DIM_VIEWS = {
    "field_catalogue": values("layer_ord, layer, field_ord, field, category", dims.catalogue_rows()),
    "categories": values("category", [(c,) for c in dims.CATEGORIES]),
    "purpose_policy": values("purpose, max_days, pseudonymise",
                             [(p, v["max_retention_days"], v["pseudonymise"]) for p, v in dims.PURPOSE_POLICY.items()]),
    "purpose_allowed": values("purpose, category",
                              [(p, c) for p, v in dims.PURPOSE_POLICY.items() for c in v["allowed"]]),
    "tasks": values("task_ord, task_id, purpose, single_subject, trap, trap_on_scope",
                    [(i, t, p, s, tr, ts) for i, (t, (p, s, tr, ts, _)) in enumerate(_tasks().items())]),
    "task_needed": values("task_id, layer, field",
                          [(t, lay, f) for t, spec in _tasks().items() for lay, fs in spec[4].items() for f in fs]),
    "artefacts": values("artefact, layer, category",
                        [(a, lay, c) for a, (lay, cs) in dims.ARTEFACTS.items() for c in cs]),
    "role_purposes": values("role, purpose", [(r, p) for r, v in dims.ROLES.items() for p in v["purposes"]]),
    "role_artefacts": values("role, artefact", [(r, a) for r, v in dims.ROLES.items() for a in v["artefacts"]]),
    "functions": values("fn_ord, function_id, fn_group, purpose",
                        [(i, f, v[0], v[1]) for i, (f, v) in enumerate(dims.FUNCTIONS.items())]),
    "function_artefacts": values("function_id, artefact", [(f, a) for f, v in dims.FUNCTIONS.items() for a in v[2]]),
    "function_categories": values("function_id, category",
                                  [(f, c) for f, v in dims.FUNCTIONS.items() for c in (v[3] or sorted(
                                      {c for a in v[2] for c in dims.ARTEFACTS[a][1]}))]),
    "function_steps": values("function_id, step_ord, layer, action",
                             [(f, i, s[0], s[2]) for f, steps in dims.FUNCTION_STEPS.items()
                              for i, s in enumerate(steps)]),
    "function_fields": values("function_id, step_ord, layer, field",
                              [(f, i, s[0], x) for f, steps in dims.FUNCTION_STEPS.items()
                               for i, s in enumerate(steps) for x in s[1]]),
    "action_names": values("action_ord, action, name_ord, shown",
                           [(i, a, k, n) for i, (a, ns) in enumerate(dims.ACTIONS.items()) for k, n in enumerate(ns)]),
}

LAYER_VIEWS = {
    dims.PA: """
select c_custkey as row_ix, 'MRN' || lpad(cast(c_custkey as string),7,'0') as mrn, 'Asha ' || c_name as full_name,
 '+91-9' || lpad(cast(c_custkey as string),9,'0') as phone, 'p' || cast(c_custkey as string) || '@example.in' as email,
 cast(c_custkey % 97 as string) || ' Main Road, ' || n_name as street_address,
 cast(date '1930-01-01' + cast((c_custkey*37) % 34000 as int) as string) as date_of_birth,
 case when c_custkey % 100 = 0 then 'O' when c_custkey % 2 = 0 then 'F' else 'M' end as sex,
 cast(100000 + (c_custkey*7919) % 800000 as string) as pincode,
 c_mktsegment as admission_ward, substr(cast(fo as string),1,10) || 'T00:00:00' as admission_datetime
 from {customer} join {nation} on c_nationkey = n_nationkey
 left join (select o_custkey, min(o_orderdate) as fo from {orders} group by o_custkey) f on o_custkey = c_custkey""",
    dims.EHR: """
select o_orderkey as row_ix, 'MRN' || lpad(cast(o_custkey as string),7,'0') as mrn, o_orderpriority as primary_diagnosis,
 'MED-' || cast(o_orderkey % 8 as string) as medication, o_totalprice as lab_result,
 case when o_orderkey % 4 = 0 then 'Penicillin' when o_orderkey % 4 = 1 then 'Latex' else null end as allergy,
 substr(cast(o_orderdate as string),1,10) || 'T00:00:00' as encounter_datetime,
 'Dr. ' || cast(o_orderkey % 50 as string) as attending_clinician from {orders}""",
    dims.ANC: """
select l_orderkey * 8 + l_linenumber as row_ix, 'MRN' || lpad(cast(o_custkey as string),7,'0') as mrn,
 'ORD' || lpad(cast(l_orderkey as string),8,'0') || '-' || cast(l_linenumber as string) as order_id,
 l_returnflag as specimen_type, l_quantity as result_value, l_linestatus as imaging_modality, p_type as report_text
 from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey""",
    dims.FIN: """
select o_orderkey as row_ix, 'MRN' || lpad(cast(o_custkey as string),7,'0') as mrn,
 'INV' || lpad(cast(o_orderkey as string),8,'0') as invoice_id, o_totalprice as billed_amount,
 'PL' || lpad(cast(o_custkey % 1000 as string),8,'0') as insurance_policy_no,
 case o_orderstatus when 'F' then 'Self-pay' when 'O' then 'CGHS' else 'PM-JAY' end as payer_name from {orders}""",
    dims.INF: """
select event_id as row_ix, 'EVT' || lpad(cast(event_id as string),9,'0') as audit_event_id,
 replace(substr(cast(ts as string),1,19),' ','T') as event_timestamp,
 case event_id % 4 when 0 then 'reception' when 1 then 'nurse' when 2 then 'administrator' else 'clinician' end as actor_role,
 case event_type when 'view' then 'read' when 'click' then 'read' when 'signup' then 'create'
   when 'purchase' then 'update' else 'export' end as action,
 case event_id % 3 when 0 then 'registration' when 1 then 'ehr' else 'billing' end as source_system,
 'MRN' || lpad(cast(user_id as string),7,'0') as subject_mrn from {events}""",
}

FACT_VIEWS = {
    "runs": """
select 'run-' || lpad(cast(o_orderkey as string),8,'0') as run_id, o_orderkey as run_ord,
 case when o_custkey % 14 = 0 then 'compliance-aware' when o_custkey % 14 = 1 then 'unconstrained'
  else 'model-' || cast(cast(floor((o_custkey % 14 - 2) / 3.0) as int) as string) || '/' ||
   case (o_custkey % 14 - 2) % 3 when 0 then 'unaided' when 1 then 'informed' else 'policy' end end as technique,
 case o_orderkey % 3
  when 0 then case cast(floor(o_orderkey / 3.0) as bigint) % 7 when 1 then 'ward-census' when 2 then 'medication-review'
   when 3 then 'ward-summary-registry' when 4 then 'consultant-file' when 5 then 'injected-onward' else 'patient-summary' end
  when 1 then case cast(floor(o_orderkey / 3.0) as bigint) % 2 when 0 then 'claim-reconciliation' else 'injected-billing' end
  else case cast(floor(o_orderkey / 3.0) as bigint) % 3 when 0 then 'appointment-reminder'
   when 1 then 'desk-registration' else 'injected-scope' end end as task_id,
 case o_orderkey % 3 when 0 then 'care_coordination' when 1 then 'billing_settlement' else 'patient_registration' end as purpose,
 o_orderkey % 11 <> 0 as purpose_specified,
 case when o_orderkey % 5 = 0 then null else cast((o_orderkey*7) % 400 as int) end as retention_days,
 case when o_orderkey % 4 = 0 then null else 'PURGE-01 scheduled purge' end as deletion_mechanism,
 case o_orderkey % 3 when 0 then null when 1 then 'consent' else 'legitimate_use' end as basis_type,
 case when o_orderkey % 6 in (1,2) then case o_orderkey % 4 when 0 then 'LU-CARE on file' when 1 then 'see lu-bill'
   else 'LU-REG, desk form' end else null end as basis_reference,
 o_orderkey % 2 = 0 as transport_encrypted, o_orderkey % 3 = 0 as at_rest_encrypted,
 o_orderkey % 5 <> 1 as access_controlled, o_orderkey % 7 < 3 as identifiers_pseudonymised,
 case when o_orderkey % 8 = 0 then null when o_orderkey % 8 = 5 then 'poster in the hall' else 'NOTICE-REG-2026' end as notice_reference,
 o_orderkey % 9 <> 0 as notice_covers_purpose, o_orderkey % 4 = 2 as notice_machine_readable,
 o_orderkey % 2 = 1 as audit_log_enabled,
 case when o_orderkey % 10 < 4 then 'DPO' when o_orderkey % 10 = 4 then 'endpoint team' else null end as accountable_party,
 o_orderkey % 3 = 1 as processing_record_kept,
 case o_orderkey % 13 when 0 then 'research registry' when 1 then 'billing_settlement'
  when 2 then 'patient_registration;billing_settlement' else null end as secondary_use,
 case when o_orderkey % 4 = 1 then null else cast(o_orderkey % 9 as int) end as scope_pulled,
 case when o_orderkey % 4 = 1 then null else cast(o_orderkey % 6 as int) end as scope_necessary,
 o_orderkey % 5 <> 4 as scope_on_subject,
 case when o_orderkey % 10 = 6 then false else null end as observed_transport,
 cast(floor(o_totalprice) as bigint) % 1000 as elapsed_ms, o_orderdate as written_at
 from {orders}""",
    "pulled": """
select 'run-' || lpad(cast(l_orderkey as string),8,'0') as run_id, l_linenumber as row_ix, c.layer, c.field, c.category
 from {lineitem} join {field_catalogue} c on c.layer_ord = l_partkey % 5 and (l_suppkey + c.field_ord) % 3 = 0""",
    "audit_events": """
select event_id as seq, ts as at, case event_id % 4 when 3 then 'purge' when 2 then 'export' else 'extraction' end as event,
 'run-' || lpad(cast(cast(floor(event_id / 4.0) as bigint) % 500 as string),8,'0') as run_id,
 case event_id % 3 when 0 then 'care_coordination' when 1 then 'billing_settlement' else 'patient_registration' end as purpose,
 case when event_id % 10 = 0 then 'unconstrained' else 'compliance-aware' end as technique,
 cast(floor(value) as int) as records, 'MRN' || lpad(cast(user_id as string),7,'0') as subject_mrn,
 case when event_id % 17 = 0 then 1 else 0 end as unattributed, event_id % 5 = 0 as scoped,
 case when event_id % 4 = 2 and event_id % 6 = 0 then 'RAW export' when event_id % 4 = 2 then 'pseudonymised export' else '' end as note
 from {events}""",
    "retention": """
select run_id, purpose, retention_days, written_at,
 case when retention_days is null then null else written_at + retention_days * interval '1' day end as delete_after,
 coalesce(deletion_mechanism, '') as deletion_mechanism, 1 + run_ord % 3 as files from {runs}""",
    "access_requests": """
select event_id as request_id,
 case event_id % 3 when 0 then 'reception' when 1 then 'nurse' else 'administrator' end as role,
 case cast(floor(event_id / 3.0) as bigint) % 3 when 0 then 'care_coordination' when 1 then 'billing_settlement'
  else 'patient_registration' end as purpose,
 a.artefact || case when event_id % 5 = 0 then ';' || b.artefact when event_id % 41 = 0 then ';fhir:Basic' else '' end as artefacts,
 case when event_id % 6 = 1 then 'direct_identifier;quasi_identifier' else null end as categories
 from {events} join {artefact_names} a on a.artefact_ord = event_id % 27
 join {artefact_names} b on b.artefact_ord = (event_id * 7 + 3) % 27""",
    "file_headers": """
select 'export-' || lpad(cast(l_orderkey as string),8,'0') || '.csv' as file, l_linenumber as header_ord,
 case when l_suppkey % 7 = 0 then 'X_' || l_returnflag || cast(l_linenumber as string)
  when l_suppkey % 7 = 1 then upper(c.field) || ' CODE' else c.field end as header
 from {lineitem} join {field_catalogue} c on c.layer_ord = l_orderkey % 5 and c.field_ord = l_linenumber % 5""",
    "column_map": """
select cast(null as string) as file, upper(field) || ' CODE' as header, min(field) as field
 from {field_catalogue} where category <> 'administrative' group by upper(field) || ' CODE'
 union all
 select 'export-' || lpad(cast(o_orderkey as string),8,'0') || '.csv' as file,
  case when o_orderkey % 2 = 0 then 'X_R1' else 'PHONE CODE' end as header, '' as field
 from {orders} where o_orderkey % 3 = 0""",
}
DIM_VIEWS["artefact_names"] = values("artefact_ord, artefact", list(enumerate(dims.ARTEFACTS)))

VIEWS: dict[str, str] = {**DIM_VIEWS, **LAYER_VIEWS, **FACT_VIEWS}
# Dimensions that every row is paired with, written ``[[dimension alias]]`` in a view's text: an array of literals
# exploded per row in Spark (no join at all), a product with the small table elsewhere.
EACH: dict[str, tuple[str, list]] = {
    "field_catalogue": ("layer_ord, layer, field_ord, field, category", dims.catalogue_rows()),
    "action_names": ("action_ord, action, name_ord, shown",
                     [(i, a, k, n) for i, (a, ns) in enumerate(dims.ACTIONS.items()) for k, n in enumerate(ns)]),
}
_EACH = re.compile(r"\[\[(\w+) (\w+)\]\]")


def _spark_text(text: str) -> str:
    def explode(m):
        columns, rows = EACH[m[1]]
        names = columns.split(", ")
        cells = ", ".join("struct(" + ", ".join(f"{_lit(v)} as {n}" for n, v in zip(names, r)) + ")" for r in rows)
        return f"lateral view inline(array({cells})) {m[2]} as {columns}"
    return _EACH.sub(explode, text)


def add_view(name: str, text: str, each: tuple[str, list] | None = None) -> None:
    VIEWS[name] = text
    if each is not None:
        EACH[name] = each
    _depends.cache_clear()


@lru_cache(maxsize=None)
def _depends(name: str) -> tuple[str, ...]:
    text = VIEWS[name]
    each = {m[1] for m in _EACH.finditer(text)}
    return tuple(n for n in (*TABLES, *VIEWS) if "{" + n + "}" in text or n in each)


def ctes(*names: str) -> str:
    """A WITH list (without the keyword) of the named views and everything they read, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for d in _depends(name):
            visit(d)
        order.append(name)

    for n in names:
        visit(n)
    out = []
    for n in order:
        text = VIEWS[n]
        for d in _depends(n):
            text = text.replace("{" + d + "}", d)
        text = _EACH.sub(r"cross join \1 \2", text)
        out.append(f"{n} as ({text})")
    return ",\n".join(out)


class Tables:
    """Named DataFrames over one data directory: parquet tables and the views above."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        ship(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = _spark_text(VIEWS[name])
                each = _EACH.search(VIEWS[name]) is not None
                df = self.spark.sql(text, **{d: self._spread(d) if each else self[d] for d in _depends(name) if "{" + d + "}" in text})
            self._made[name] = df
        return self._made[name]

    def _spread(self, name: str) -> DataFrame:
        """A table whose rows are about to be multiplied, over all tasks: its file is small and would be one or two splits."""
        return self[name].repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def layers(self) -> dict[str, DataFrame]:
        return {layer: self[layer] for layer in dims.LAYERS}
