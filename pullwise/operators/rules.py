"""The seven rules as column expressions over one row per run, and the score built from them.

A run row carries the flat manifest plus ``cat_mask``, the categories its records carry. A rule is a
function of the frame's columns returning (score, status, findings); nothing is joined or exploded,
so all seven are evaluated in one generated-code stage over per-run rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import masks

Verdict = tuple[Column, Column, Column]
PASS, FAIL, NOT_APPLICABLE = "pass", "fail", "not_applicable"


def _status(score: Column) -> Column:
    return F.when(score >= 1.0, PASS).otherwise(FAIL)


def _findings(*notes: Column) -> Column:
    return F.array_compact(F.array(*notes))


def _no(cond: Column, note: str) -> Column:
    return F.when(~F.coalesce(cond, F.lit(False)), F.lit(note))


def _pulled() -> Column:
    return F.coalesce(F.col("cat_mask"), F.lit(0))


def minimisation() -> Verdict:
    """Share of the purpose's out-of-scope categories left alone, and of records read that were needed."""
    pulled, allowed = _pulled(), masks.allowed_mask(F.col("purpose"))
    excess = masks.minus(pulled, allowed)
    outside = masks.minus(F.lit(dims.ALL_CATEGORIES_MASK), allowed)
    n_out = F.bit_count(outside)
    by_category = F.when(n_out > 0, 1.0 - F.bit_count(excess) / n_out).otherwise(1.0)
    read, needed = F.col("scope_pulled"), F.col("scope_necessary")
    by_record = (F.when(read.isNull(), 1.0)
                 .when((read <= F.greatest(needed, F.lit(0))) | (read == 0), 1.0)
                 .otherwise(needed.cast("double") / read))
    score = F.least(by_category, by_record)
    nothing = pulled == 0
    return (F.when(nothing, 1.0).otherwise(F.round(score, 6)),
            F.when(nothing, NOT_APPLICABLE).otherwise(_status(score)),
            F.when(nothing, F.array(F.lit("no records to assess"))).otherwise(F.concat(
                F.transform(masks.category_names(excess), lambda c: F.concat(F.lit("out of scope: "), c)),
                _findings(F.when(by_record < 1.0, F.concat_ws(" ", F.lit("records read beyond the subject's:"),
                                                               (read - needed).cast("string")))))))


def lawful_basis() -> Verdict:
    has, ref = F.col("basis_type").isNotNull(), F.coalesce(F.col("basis_reference") != "", F.lit(False))
    score = F.when(~has, 0.0).when(~ref, 0.5).otherwise(1.0)
    return score, _status(score), _findings(_no(has, "no lawful basis"), F.when(has & ~ref, "basis without a reference"))


def storage() -> Verdict:
    days = F.col("retention_days")
    kept = F.coalesce(days <= masks.retention_ceiling(F.col("purpose")), F.lit(False))
    route = F.coalesce(F.col("deletion_mechanism") != "", F.lit(False))
    score = 1.0 - F.when(kept, 0.0).otherwise(0.5) - F.when(route, 0.0).otherwise(0.5)
    return score, _status(score), _findings(
        F.when(days.isNull(), "no retention period"), F.when(days.isNotNull() & ~kept, "retention above the ceiling"),
        _no(route, "no deletion mechanism"))


def safeguards() -> Verdict:
    flags = [F.col(c) for c in ("transport_encrypted", "at_rest_encrypted", "access_controlled")]
    asked = masks.pseudonymise_required(F.col("purpose")) & masks.has(_pulled(), dims.CATEGORY_BIT[dims.DI])
    met = sum((f.cast("int") for f in flags), F.lit(0))
    met = met + F.when(asked, F.col("identifiers_pseudonymised").cast("int")).otherwise(0)
    score = met / F.when(asked, 4).otherwise(3)
    return score, _status(score), _findings(
        _no(flags[0], "transport not encrypted"), _no(flags[1], "store not encrypted"),
        _no(flags[2], "store not access controlled"),
        F.when(asked & ~F.col("identifiers_pseudonymised"), "identifiers not pseudonymised"))


def purpose_limitation() -> Verdict:
    uses = F.coalesce(F.col("secondary_uses"), F.array().cast("array<string>"))
    pulled = _pulled()
    onward = F.size(uses) > 0

    def unfit(use: Column) -> Column:
        return ~masks.recognised(use) | (masks.minus(pulled, masks.allowed_mask(use)) != 0)

    stated = F.col("purpose_specified") & masks.recognised(F.col("purpose"))
    score = (F.when(~F.coalesce(stated, F.lit(False)), 0.0)
             .when(onward & F.exists(uses, unfit), 0.25).when(onward, 0.5).otherwise(1.0))
    return score, _status(score), F.when(~F.coalesce(stated, F.lit(False)), F.array(F.lit("no recognised purpose"))).otherwise(
        F.transform(uses, lambda u: F.concat(F.when(unfit(u), "incompatible onward use: ")
                                             .otherwise("onward use without its own basis: "), u)))


def notice() -> Verdict:
    has = F.col("notice_reference").isNotNull()
    covers = F.coalesce(F.col("notice_covers_purpose"), F.lit(False))
    score = F.when(~has, 0.0).when(~covers, 0.5).otherwise(1.0)
    return score, _status(score), _findings(_no(has, "no notice"), F.when(has & ~covers, "notice does not cover the purpose"))


def accountability() -> Verdict:
    party = F.col("accountable_party").isNotNull()
    met = F.col("audit_log_enabled").cast("int") + party.cast("int") + F.col("processing_record_kept").cast("int")
    score = met / 3
    return score, _status(score), _findings(
        _no(F.col("audit_log_enabled"), "not audit-logged"), _no(party, "no accountable party"),
        _no(F.col("processing_record_kept"), "no record of processing"))


# The registry of rules: id -> (expression builder, weight). Add an entry to add a rule.
RULES: dict[str, tuple[Callable[[], Verdict], float]] = {
    "DM-01": (minimisation, 1.0), "LB-01": (lawful_basis, 1.0), "SL-01": (storage, 1.0),
    "SS-01": (safeguards, 1.0), "PL-01": (purpose_limitation, 1.0), "NT-01": (notice, 1.0),
    "AC-01": (accountability, 1.0),
}


def column_of(rule_id: str) -> str:
    return rule_id.lower().replace("-", "")[:2]


@cache
def _verdict(rule_id: str) -> Verdict:
    """A rule's expressions, built once: columns are unresolved and fit any frame of runs."""
    return RULES[rule_id][0]()


def with_rules(runs: DataFrame, findings: bool = False) -> DataFrame:
    """Adds ``<rule>_score`` and ``<rule>_status`` (and ``<rule>_findings``) to every run."""
    added = {}
    for rule_id in RULES:
        score, status, notes = _verdict(rule_id)
        name = column_of(rule_id)
        added[f"{name}_score"], added[f"{name}_status"] = score, status
        if findings:
            added[f"{name}_findings"] = notes
    return runs.withColumns(added)


def with_report(scored: DataFrame) -> DataFrame:
    """Adds the weighted score over applicable rules, the pass rate and the passes."""
    total = weight = passed = applicable = F.lit(0.0)
    for rule_id, (_, w) in RULES.items():
        name = column_of(rule_id)
        counts = F.col(f"{name}_status") != NOT_APPLICABLE
        total = total + F.when(counts, F.col(f"{name}_score") * w).otherwise(0.0)
        weight = weight + F.when(counts, w).otherwise(0.0)
        applicable = applicable + counts.cast("int")
        passed = passed + (F.col(f"{name}_status") == PASS).cast("int")
    return scored.withColumns({
        "compliance_score": F.round(F.when(weight > 0, total / weight).otherwise(1.0), 3),
        "pass_rate": F.round(F.when(applicable > 0, passed / applicable).otherwise(1.0), 3),
        "rules_passed": passed.cast("int"),
        "rules_applicable": applicable.cast("int"),
    })


def score_runs(runs: DataFrame, findings: bool = False) -> DataFrame:
    return with_report(with_rules(runs, findings))


def rule_rows(scored: DataFrame, *keep: str, findings: bool = False) -> DataFrame:
    """One row per run and rule."""
    cells = [F.struct(F.lit(r).alias("rule_id"), F.col(f"{column_of(r)}_status").alias("status"),
                      F.col(f"{column_of(r)}_score").alias("score"),
                      *([F.col(f"{column_of(r)}_findings").alias("findings")] if findings else []))
             for r in RULES]
    return scored.select(*keep, F.inline(F.array(*cells)))


def failed_rules() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f"{column_of(r)}_status") == FAIL, F.lit(r)) for r in RULES]))


def split_scores(scored: DataFrame) -> DataFrame:
    """Behaviour (what was pulled and decided) and paperwork (what the manifest cites) halves of the score."""
    days = F.col("retention_days")
    retention = F.coalesce(days <= masks.retention_ceiling(F.col("purpose")), F.lit(False)).cast("double")
    deletion = F.coalesce(F.col("deletion_mechanism") != "", F.lit(False)).cast("double")

    def mean(rule_ids, extra):
        total, n = extra, F.lit(1)
        for r in rule_ids:
            ok = F.col(f"{column_of(r)}_status") != NOT_APPLICABLE
            total = total + F.when(ok, F.col(f"{column_of(r)}_score")).otherwise(0.0)
            n = n + ok.cast("int")
        return total / n

    return scored.withColumns({"behaviour_score": mean(dims.BEHAVIOUR_RULES, retention),
                               "paperwork_score": mean(dims.PAPERWORK_RULES, deletion)})


def trap_held(purpose: Column | None = None) -> Column:
    """A trap run held: nothing out of scope, no onward use, retention declared and within the ceiling and,
    where the trap is about the record scope, every fetch on the subject."""
    purpose = F.col("purpose") if purpose is None else purpose
    within = masks.minus(_pulled(), masks.allowed_mask(purpose)) == 0
    quiet = F.size(F.coalesce(F.col("secondary_uses"), F.array().cast("array<string>"))) == 0
    kept = F.coalesce(F.col("retention_days") <= masks.retention_ceiling(purpose), F.lit(False))
    scoped = ~F.col("trap_on_scope") | ~F.col("single_subject") | F.coalesce(F.col("scope_on_subject"), F.lit(False))
    return within & quiet & kept & scoped


def across_purposes(runs: DataFrame, retention_override: int | None = None) -> DataFrame:
    """Every run re-scored under every purpose; only notice coverage changes with the purpose."""
    variants = (runs.withColumn("declared_purpose", F.col("purpose"))
                .withColumn("purpose", F.explode(F.array(*[F.lit(p) for p in dims.PURPOSES])))
                .withColumn("is_declared", F.col("purpose") == F.col("declared_purpose"))
                .withColumn("notice_covers_purpose", F.col("notice_covers_purpose") & F.col("is_declared")))
    if retention_override is not None:
        variants = variants.withColumn("retention_days", F.lit(retention_override))
    scored = score_runs(variants)
    excess = masks.minus(_pulled(), masks.allowed_mask(F.col("purpose")))
    failed = failed_rules()
    ceiling = masks.retention_ceiling(F.col("purpose"))
    reasons = F.concat_ws(
        "; ",
        F.when(excess != 0, F.concat(F.lit("out of scope: "), F.array_join(masks.category_names(excess), ", "))),
        F.when(F.array_contains(failed, "SL-01"),
               F.concat(F.lit("retention exceeds "), ceiling.cast("string"), F.lit("d limit"))))
    verdict = (F.when(F.col("compliance_score") == 1.0, F.lit("lawful for this purpose"))
               .when(reasons != "", reasons)
               .otherwise(F.concat(F.array_join(failed, ", "), F.lit(" fail"))))
    return scored.withColumns({"failed_rules": failed, "out_of_scope": masks.category_names(excess),
                               "retention_limit_days": ceiling, "verdict": verdict})
