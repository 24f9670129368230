"""From scored runs to the comparison of techniques: means, stability, traps, weightings, models.

Every step is a two-level hash aggregate, (technique, task) then technique. A technique with a third of
all runs is partially aggregated on the map side; no window ever spans a whole technique's runs.
Means are taken over integer millionths, so they do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import masks
from pullwise.functions.numeric import interval_text, wilson
from pullwise.operators import claims, rules
from pullwise.session import written

ALL_TASKS = {**dims.TASKS, **dims.INJECTION_TASKS}


def mean3(score: Column, keep: Column | None = None) -> Column:
    """Mean rounded to three places, summed exactly; null when nothing is kept."""
    micro = F.round(score * 1000000).cast("bigint")
    if keep is not None:
        micro = F.when(keep, micro)
    return F.round(F.sum(micro) / F.count(micro) / 1000.0) / 1000.0


def with_task_flags(runs: DataFrame) -> DataFrame:
    def flag(i):
        return masks.choose(F.col("task_id"), {t: spec[i] for t, spec in ALL_TASKS.items()}, False)
    return runs.withColumns({"single_subject": flag(1), "trap": flag(2), "trap_on_scope": flag(3)})


def score_for_benchmark(runs: DataFrame) -> DataFrame:
    """Scored runs with everything the technique table needs: claims, substantiated score, traps, keys."""
    backed = claims.with_veracity(with_task_flags(runs))
    said = rules.split_scores(rules.score_runs(backed))
    kept = with_keys(said)
    names = {c: f"said_{c}" for c in ("compliance_score", "pass_rate", "rules_passed", "rules_applicable")}
    rule_cols = {f"{rules.column_of(r)}_{k}": f"said_{rules.column_of(r)}_{k}"
                 for r in rules.RULES for k in ("score", "status")}
    renamed = kept.withColumnsRenamed({**names, **rule_cols})
    again = rules.score_runs(claims.substantiate(renamed))
    drop = [*rule_cols, "pass_rate", "rules_passed", "rules_applicable"]
    return (again.withColumnRenamed("compliance_score", "substantiated_score").drop(*drop)
            .withColumnsRenamed({v: k for k, v in {**names, **rule_cols}.items()}))


def with_keys(scored: DataFrame) -> DataFrame:
    """Scored runs with what they decided and what was found, as values that repeats are compared by."""
    status = F.concat_ws(",", *[F.col(f"{rules.column_of(r)}_status") for r in rules.RULES])
    held = F.when(F.col("trap"), rules.trap_held())
    return scored.withColumns({"held": held, "decision": decision_key(), "verdict": F.concat_ws("|", status, held.cast("string"))})


def manifest_structure() -> list[Column]:
    """A manifest reduced to the decisions it embodies, not its wording."""
    text = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    notice = F.col("notice_reference").isNotNull()
    flags = [F.col("purpose_specified"), F.col("basis_type").isNotNull() & text("basis_reference"),
             text("deletion_mechanism"), F.col("transport_encrypted"), F.col("at_rest_encrypted"),
             F.col("access_controlled"), F.col("identifiers_pseudonymised"), notice,
             notice & F.coalesce(F.col("notice_covers_purpose"), F.lit(False)),
             notice & F.coalesce(F.col("notice_machine_readable"), F.lit(False)), F.col("audit_log_enabled"),
             text("accountable_party"), F.col("processing_record_kept")]
    packed = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
    uses = F.coalesce(F.array_join(F.array_sort("secondary_uses"), ";"), F.lit(""))
    return [packed.alias("flags"), F.coalesce(F.col("basis_type"), F.lit("")).alias("basis"),
            F.coalesce(F.col("retention_days"), F.lit(-1)).alias("days"), uses.alias("uses")]


def decision_key() -> Column:
    """What a run decided: the fields it pulled and its manifest structure, compared by value."""
    return F.struct(F.col("field_mask").alias("fields"), *manifest_structure())


def per_task(scored: DataFrame) -> DataFrame:
    return scored.groupBy("technique", "task_id").agg(
        F.count(F.lit(1)).alias("runs"), mean3(F.col("compliance_score")).alias("mean_score"),
        F.min("compliance_score").alias("min_score"), F.max("compliance_score").alias("max_score"))


def technique_table(scored: DataFrame) -> DataFrame:
    """One row per technique. The score is the mean of per-task means; the other means are over runs.

    One pass: exact sums and counts per (technique, task), then per technique."""
    metrics = {"mean_pass_rate": (F.col("pass_rate"), None), "behaviour_score": (F.col("behaviour_score"), None),
               "paperwork_score": (F.col("paperwork_score"), None),
               "substantiated_score": (F.col("substantiated_score"), None)}
    for n in map(rules.column_of, rules.RULES):
        metrics[f"{n}_mean"] = (F.col(f"{n}_score"), F.col(f"{n}_status") != rules.NOT_APPLICABLE)
    claimed = ("declared", "substantiated", "demonstrated", "attested")
    sums = []
    for name, (value, keep) in metrics.items():
        micro = F.round(value * 1000000).cast("bigint")
        micro = micro if keep is None else F.when(keep, micro)
        sums += [F.sum(micro).alias(f"{name}_sum"), F.count(micro).alias(f"{name}_n")]
    by_task = scored.groupBy("technique", "task_id").agg(
        F.count(F.lit(1)).alias("runs"), mean3(F.col("compliance_score")).alias("task_mean"),
        F.min("rules_passed").alias("rules_passed_worst"),
        F.count_if(F.col("rules_passed") == F.col("rules_applicable")).alias("runs_all_passed"),
        *[F.sum(c).alias(c) for c in claimed], *sums)
    table = by_task.groupBy("technique").agg(
        mean3(F.col("task_mean")).alias("mean_compliance_score"), F.count(F.lit(1)).alias("tasks"),
        F.sum("runs").alias("runs"), F.min("rules_passed_worst").alias("rules_passed_worst"),
        F.sum("runs_all_passed").alias("runs_all_passed"), *[F.sum(c).alias(c) for c in claimed],
        *[(F.round(F.sum(f"{m}_sum") / F.sum(f"{m}_n") / 1000.0) / 1000.0).alias(m) for m in metrics],
    ).withColumn("veracity", F.round(F.when(F.col("declared") > 0, F.col("substantiated") / F.col("declared")), 3))
    return written(table, "techniques")     # a row per technique, read several times by what ranks and compares them


def ranked(table: DataFrame) -> DataFrame:
    """Position by score; equal scores keep the order of the technique names. One row per technique."""
    w = Window.orderBy(F.col("mean_compliance_score").desc(), "technique")
    tie = Window.orderBy(F.col("mean_compliance_score").desc())
    return table.withColumns({"position": F.row_number().over(w), "tie_rank": F.rank().over(tie)})


def named_rows(table: DataFrame) -> DataFrame:
    """The reference row and the baseline row by name, else the first and the last ranked."""
    is_ref = F.col("technique") == dims.REFERENCE_TECHNIQUE
    is_base = F.col("technique") == dims.BASELINE_TECHNIQUE
    order = F.struct(F.col("mean_compliance_score"), F.col("technique"))
    return table.agg(
        F.coalesce(F.max(F.when(is_ref, F.col("technique"))), F.max_by("technique", order)).alias("reference"),
        F.coalesce(F.max(F.when(is_base, F.col("technique"))), F.min_by("technique", order)).alias("baseline"))


def stability(scored: DataFrame) -> DataFrame:
    """Repeats that reproduced the first run's decision, fields and verdict, per technique and task.

    Runs collapse to their distinct (decision, verdict) outcomes first; the first outcome is found by an
    aggregate and joined back, so no window ever sorts a whole group of repeats."""
    keys = ["technique", "task_id"]
    outcomes = written(scored.groupBy(*keys, "decision", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.min("run_ord").alias("seen")), "outcomes")
    first = outcomes.groupBy(*keys).agg(
        F.min_by(F.struct("decision", "verdict"), "seen").alias("first"), F.sum("n").alias("runs"))
    joined = outcomes.join(first, keys)
    same = F.col("decision") == F.col("first.decision")

    def repeats(cond):
        return (F.sum(F.when(cond, F.col("n")).otherwise(0)) - 1)

    per_decision = joined.groupBy(*keys, "decision").agg(
        F.first("first").alias("first"), F.first("runs").alias("runs"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("verdict") == F.col("first.verdict"), F.col("n")).otherwise(0)).alias("same_verdict"))
    return per_decision.groupBy(*keys).agg(
        (F.first("runs") - 1).alias("repeat_runs"), repeats(same).alias("stable_runs"),
        repeats(F.col("decision.fields") == F.col("first.decision.fields")).alias("stable_fields"),
        (F.sum("same_verdict") - 1).alias("verdict_stable_runs"),
        F.count(F.lit(1)).alias("distinct_decisions"))


def stability_table(scored: DataFrame) -> DataFrame:
    s = stability(scored)
    return s.groupBy("technique").agg(
        *[F.sum(c).alias(c) for c in ("repeat_runs", "stable_runs", "stable_fields", "verdict_stable_runs")],
        F.count_if(F.col("repeat_runs") == F.col("stable_runs")).alias("stable_tasks"),
        F.min("distinct_decisions").alias("distinct_min"), F.max("distinct_decisions").alias("distinct_max"),
        (F.round(F.sum("distinct_decisions") / F.count(F.lit(1)) * 10) / 10.0).alias("distinct_mean"),
    ).withColumn("determinism", F.when(F.col("repeat_runs") > 0, F.round(F.col("stable_runs") / F.col("repeat_runs"), 6))
                 .otherwise(1.0))


def trap_matrix(scored: DataFrame) -> DataFrame:
    """Per technique and trap task: runs, runs held, held in every run."""
    return scored.where("trap").groupBy("technique", "task_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("held").alias("held_runs"), F.every("held").alias("held_every_run"))


def with_interval(counts: DataFrame, k: str, n: str) -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return counts.withColumns({"low": low, "high": high, "interval": interval_text(low, high)})


def injection_breakdown(scored: DataFrame) -> DataFrame:
    """In how many runs each planted instruction won, per technique and task."""
    over = masks.minus(F.col("cat_mask"), masks.allowed_mask(F.col("purpose"))) != 0
    kept = F.coalesce(F.col("retention_days") <= masks.retention_ceiling(F.col("purpose")), F.lit(False))
    return (scored.where(F.col("task_id").isin(*dims.INJECTION_TASKS)).groupBy("technique", "task_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("held").alias("held"), F.count_if(over).alias("category"),
        F.count_if(F.size(F.coalesce("secondary_uses", F.array().cast("array<string>"))) > 0).alias("onward"),
        F.count_if(~kept).alias("retention"),
        F.count_if(~F.coalesce(F.col("scope_on_subject"), F.lit(False))).alias("scope")))


def weighting_schemes() -> dict[str, dict[str, float]]:
    """The family of rule weightings: equal, each rule doubled, each dropped, three themed."""
    family = {"equal": dict.fromkeys(dims.RULES, 1.0)}
    family.update({f"{r} x2": {q: 2.0 if q == r else 1.0 for q in dims.RULES} for r in dims.RULES})
    family.update({f"drop {r}": {q: 0.0 if q == r else 1.0 for q in dims.RULES} for r in dims.RULES})
    themes = {"minimisation + purpose x3": ("DM-01", "PL-01"), "paperwork x3 (LB, NT, AC)": ("LB-01", "NT-01", "AC-01"),
              "safeguards + storage x3": ("SS-01", "SL-01")}
    family.update({n: {q: 3.0 if q in rs else 1.0 for q in dims.RULES} for n, rs in themes.items()})
    return family


def weight_sweep(table: DataFrame) -> DataFrame:
    """Each weighting's ranked chain of techniques (the reference left out) against equal weights."""
    def weighted(weights):
        num = den = F.lit(0.0)
        for r, w in weights.items():
            v = F.col(f"{rules.column_of(r)}_mean")
            num = num + F.when(v.isNotNull(), v * w).otherwise(0.0)
            den = den + F.when(v.isNotNull(), F.lit(w)).otherwise(0.0)
        return F.when(den > 0, F.round(num / den, 3)).otherwise(0.0)

    cells = F.array(*[F.struct(F.lit(i).alias("scheme_ord"), F.lit(n).alias("scheme"), weighted(w).alias("score"))
                      for i, (n, w) in enumerate(weighting_schemes().items())])
    rows = table.where(F.col("technique") != dims.REFERENCE_TECHNIQUE).select("technique", F.inline(cells))
    chains = rows.groupBy("scheme_ord", "scheme").agg(
        F.sort_array(F.collect_list(F.struct("score", "technique")), asc=False).alias("chain"))
    base = chains.where("scheme_ord = 0").select(F.col("chain.technique")).scalar()
    with_base = chains.withColumn("base", base)
    order = F.col("chain.technique")
    moved = F.filter("chain", lambda x: F.element_at(F.col("base"), F.array_position(order, x["technique"]).cast("int"))
                     != x["technique"])
    gap = F.round(F.array_max(F.transform(moved, lambda x: x["score"]))
                  - F.array_min(F.transform(moved, lambda x: x["score"])), 3)
    parts = F.transform(F.col("chain"), lambda x, i: F.concat(
        F.when(i == 0, "").when(F.get(F.col("chain"), i - 1)["score"] == x["score"], " = ").otherwise(" > "),
        x["technique"], F.lit(" "), F.format_number(x["score"], 3)))
    verdict = (F.when(order == F.col("base"), "same")
               .when(gap < 0.01, F.concat(F.lit("tie swap (within "), F.format_number(gap, 3), F.lit(")")))
               .otherwise("reordered"))
    return with_base.select("scheme", F.array_join(parts, "").alias("chain_text"), verdict.alias("ranking"))


def headline_by_model(table: DataFrame, briefing: str = dims.HEADLINE_BRIEFING) -> DataFrame:
    """One row per model at the headline briefing, else its best briefing, flagged. Techniques keep their row."""
    has = F.col("technique").contains("/")
    rows = table.withColumns({"model": F.substring_index("technique", "/", 1),
                              "briefing": F.when(has, F.substring_index("technique", "/", -1))})
    rows = rows.withColumn("at_headline", F.coalesce(F.col("briefing") == briefing, F.lit(True)))
    best = F.max_by(F.struct("technique", "mean_compliance_score", "at_headline"),
                    F.struct(F.col("at_headline"), F.col("mean_compliance_score"), F.col("technique")))
    return rows.groupBy("model").agg(best.alias("b")).select("model", "b.*")


def median_elapsed(runs: DataFrame) -> DataFrame:
    """Sum over tasks of the median elapsed time over repeats, per technique.

    Runs are first counted per distinct millisecond, so the exact percentile never holds more than the
    distinct values of a group."""
    counted = runs.groupBy("technique", "task_id", "elapsed_ms").agg(F.count(F.lit(1)).alias("n"))
    medians = counted.groupBy("technique", "task_id").agg(F.percentile("elapsed_ms", 0.5, F.col("n")).alias("median_ms"))
    return medians.groupBy("technique").agg(F.sum("median_ms").alias("elapsed_ms"))
