"""Smaller reports: fields per layer, slot values, best modules, use of the register, logged runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import masks, text
from pullwise.operators import access, claims, pulls, split
from pullwise.registry.base import query, with_views
from pullwise.registry.scoring import CLAIM_SQL
from pullwise.sources import logs, pages
from pullwise.sources.tables import add_view

DATE_SHAPE = r"\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"      # fixed value: the shape a date answer needs


@query("fields_by_layer", with_views("""
select run_id, layer, string_agg(distinct field, ',' order by field) as fields from pulled group by 1, 2""", "pulled"))
def fields_by_layer(t):
    """What each run pulled, as the log records it: fields per layer, sorted."""
    m = pulls.run_masks(t["pulled"])
    cells = [F.struct(F.lit(layer).alias("layer"), F.array_join(masks.field_names(F.col("field_mask"), layer), ",").alias("fields")) for layer in dims.LAYERS]
    return m.select("run_id", F.inline(F.array(*cells))).where("fields <> ''")


@query("slot_values", with_views(r"""
select row_ix, regexp_full_match(trim(encounter_datetime), '(?i)(\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})') as fits,
 nullif(regexp_extract('seen on ' || encounter_datetime || ', paid', '(?i)(\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})', 1), '') as found from raw_values""", "raw_values"))
def slot_values(t):
    """Answers that have a slot's shape, and slot values found inside longer texts."""
    said = F.concat(F.lit("seen on "), F.col("encounter_datetime"), F.lit(", paid"))
    return t["raw_values"].select("row_ix", text.fits(F.col("encounter_datetime"), DATE_SHAPE).alias("fits"),
                                  text.found_in(said, DATE_SHAPE).alias("found"))


add_view("rated_modules", """
select site, ord, title, path, layer, ((site * 5 + ord * 3) % 4) / 4.0 as confidence from {nav_modules} where crawl = 'after'""")


@query("best_modules", with_views("""
select site, layer, title, path, confidence::double as confidence from (
 select *, row_number() over (partition by site, layer order by confidence desc, ord) as rn from rated_modules) where rn = 1""", "rated_modules"))
def best_modules(t):
    """The most confident module of each layer, per site."""
    rated = t["rated_modules"].withColumn("confidence", F.col("confidence").cast("double"))
    return pages.best_module(rated, "site").select("site", "layer", "title", "path", "confidence")


@query("register_use", with_views("""
select control, case when ok and demo then 'demonstrated' when ok then 'attested' else '' end as basis, count(*) as runs from claim group by 1, 2""", "runs", extra=CLAIM_SQL))
def register_use(t):
    """How many runs rest on each control of the register, and on what evidence."""
    return claims.claim_rows(pulls.manifests(t["runs"])).groupBy("control", "basis").agg(F.count(F.lit(1)).alias("runs"))


@query("unbacked_examples", with_views("""
select technique, control, declared, count(*) as runs from claim where not ok group by 1, 2, 3""", "runs", extra=CLAIM_SQL))
def unbacked_examples(t):
    """Distinct declarations the register does not back, per technique."""
    rows = claims.claim_rows(pulls.manifests(t["runs"]), "technique").where("not substantiated")
    return rows.groupBy("technique", "control", "declared").agg(F.count(F.lit(1)).alias("runs"))


@query("logged_runs", with_views("""
select r.run_id, r.audit_log_enabled as declared, exists (select 1 from audit_events e where e.run_id = r.run_id and e.event = 'extraction') as logged from runs r""",
    "runs", "audit_events"))
def logged_runs(t):
    """Runs that declare an audit log, beside whether the log holds their extraction."""
    seen = logs.logged_runs(t["audit_events"]).withColumn("logged", F.lit(True))
    return t["runs"].join(seen, "run_id", "left").select("run_id", F.col("audit_log_enabled").alias("declared"), F.coalesce("logged", F.lit(False)).alias("logged"))


@query("breach_categories", with_views("""
select run_id, string_agg(distinct case category when 'direct_identifier' then 'details that identify you' when 'quasi_identifier' then 'details such as date of birth'
 when 'contact' then 'contact details' when 'clinical' then 'clinical information' when 'financial' then 'billing information' else 'visit and admission details' end, '; '
 order by case category when 'direct_identifier' then 'details that identify you' when 'quasi_identifier' then 'details such as date of birth'
 when 'contact' then 'contact details' when 'clinical' then 'clinical information' when 'financial' then 'billing information' else 'visit and admission details' end) as exposed
from pulled where run_id in (select run_id from audit_events where event = 'export') group by 1""", "pulled", "audit_events"))
def breach_categories(t):
    """What each exported run's files hold, in plain words."""
    exported = t["audit_events"].where("event = 'export'").select("run_id").distinct()
    plain = F.array_sort(F.transform(masks.category_names(F.col("cat_mask")), text.plain_category))
    return pulls.run_masks(t["pulled"]).join(exported, "run_id", "left_semi").select("run_id", F.array_join(plain, "; ").alias("exposed"))




@query("first_pass_totals", with_views("""
select technique, (select count(*) from (select distinct run_id, layer, row_ix from pulled) d join first_runs f2 using (run_id) where f2.technique = f.technique) as record_count,
 count(*) as field_slots from first_runs f join (select distinct run_id, layer, row_ix, category from pulled) c using (run_id) group by 1""", "runs", "pulled",
    extra="first_runs as (select technique, arg_min(run_id, run_ord) as run_id from runs group by technique, task_id)"))
def first_pass_totals(t):
    """What one pass of the workload pulled: each technique's first run of every task, merged."""
    first = t["runs"].groupBy("technique", "task_id").agg(F.min_by("run_id", "run_ord").alias("run_id"))
    records = pulls.record_categories(t["pulled"].join(first, "run_id", "left_semi"), "run_id")
    per_run = pulls.summarise(records, "run_id").join(first.join(t["runs"].select("run_id", "purpose"), "run_id"), "run_id")
    return pulls.merge_summaries(per_run, "technique").select("technique", "record_count", "field_slots")


@query("reference_categories", with_views("""
select coalesce(c.category, 'uncatalogued') as category, count(*) as refs, count(distinct decision_id) as decisions
from decision_fields d left join field_catalogue c on d.ref = c.layer || '/' || c.field group by 1""", "decision_fields", "field_catalogue"))
def reference_categories(t):
    """What recorded decisions asked for, by category; references that the catalogue doesn't know are uncatalogued."""
    layer, name = F.split_part("ref", F.lit("/"), F.lit(1)), F.regexp_extract("ref", "^[^/]*/(.*)$", 1)
    return t["decision_fields"].groupBy(masks.field_category(layer, name).alias("category")).agg(
        F.count(F.lit(1)).alias("refs"), F.count_distinct("decision_id").alias("decisions"))


@query("unassigned_requests", with_views("""
select artefact, count(*) as requests from (select unnest(string_split(artefacts, ';')) as artefact from access_requests)
where artefact in (select artefact from artefact_names) and artefact not in (select artefact from role_artefacts) group by 1""",
    "access_requests", "artefact_names", "role_artefacts"))
def unassigned_requests(t):
    """Requests for artefacts that no role has been given."""
    asked = t["access_requests"].select(F.explode(F.split("artefacts", ";")).alias("artefact"))
    return asked.where(F.col("artefact").isin(*access.unassigned_artefacts())).groupBy("artefact").agg(F.count(F.lit(1)).alias("requests"))


@query("technique_names", with_views("""
select rtrim(split_part(technique || ', as recorded', ' ', 1), ',') as short, count(*) as runs from runs group by 1""", "runs"))
def technique_names(t):
    """Runs by the short name of their technique, as reports shorten a described one."""
    described = F.concat("technique", F.lit(", as recorded"))
    return t["runs"].groupBy(text.short_technique(described).alias("short")).agg(F.count(F.lit(1)).alias("runs"))


@query("module_read_limited", with_views("""
select payer_name, least(count(*), 25) as rows from split_right group by 1""", "split_right"))
def module_read_limited(t):
    """Rows that reads of a module with a reader's limit of 25 give, per payer asked for."""
    right = t["split_right"]
    payers = sorted(r[0] for r in right.select("payer_name").distinct().collect() if r[0] is not None)          # the few payers
    reads = [split.read_module(right, None, ["payer_name"], "insurance_policy_no", {"payer_name": p}, limit=25) for p in payers]
    return reduce(DataFrame.unionAll, reads).groupBy("payer_name").agg(F.count(F.lit(1)).alias("rows"))
