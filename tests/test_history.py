"""Confirmed labels over many crawls, relevance for roles, replayed samples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.operators import access, drift
from pullwise.plans import recorded
from pullwise.registry import all_queries


def test_meanings_follow_chains_of_any_length(spark):
    rows = [(1, f"{2000 + i}", f"Label {i}", f"label  {i - 1}") for i in range(1, 60)] + [(1, "2000", "LABEL 0", "full_name")]
    rows += [(2, "1", "a", "b"), (2, "2", "B", "C"), (2, "3", "c", "a"), (2, "1", "d", "c"), (2, "1", "e", "phone")]       # round and round
    rows += [(3, "1", "x", "phone"), (3, "2", "x", "email"), (3, "1", "self", "self")]                                    # the latest holds
    got = {(r.site, r.key): r.means for r in drift.meanings(spark.createDataFrame(rows, "site long, version string, shown string, means string")).collect()}
    want = {(1, f"label {i}"): "full_name" for i in range(60)} | {(2, "e"): "phone", (3, "x"): "email"}
    assert got == want


def test_no_confirmations(spark):
    assert drift.meanings(spark.createDataFrame([], "site long, version string, shown string, means string")).count() == 0


def test_reach_of_roles_is_what_their_functions_touch():
    for role in dims.ROLES:
        fields, actions, layers = drift.reach(role)
        steps = [s for fn in access.permitted_functions(role) for s in dims.FUNCTION_STEPS.get(fn, ())]
        assert {f for f in drift.FIELD_NAMES if fields & drift.NAME_BIT[f]} == {f for s in steps for f in s[1]}
        assert {a for a, b in drift.ACTION_BIT.items() if actions & b} == {s[2] for s in steps if s[2]}
        assert {x for x, b in drift.LAYER_BIT.items() if layers & b} == {s[0] for s in steps}


def test_repeats_are_capped_by_the_task_with_fewest_samples(spark):
    rng = random.Random(3)
    tasks = list(dims.TASKS)
    counts = {("m", "a"): {t: rng.randrange(2, 9) for t in tasks}, ("m", "b"): {t: 4 for t in tasks}, ("n", "a"): {t: 3 for t in tasks[1:]}}
    rows, i = [], 100
    for (model, briefing), per in counts.items():
        for t, n in per.items():
            for _ in range(n):
                rows.append((i, "p", model, briefing, t))
                i += rng.randrange(1, 5)
    rows.append((i, "p", "m", "b", "another task"))
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "decision_id long, provider string, model string, briefing string, task_id string")
    for repeats in (1, 3, 50):
        got = {}
        for r in recorded.replayed(frame, repeats).collect():
            got.setdefault((r.technique, r.task_id), []).append((r.sample, r.decision_id))
        want = {}
        for key in (("m", "a"), ("m", "b")):
            cap = min(repeats, *counts[key].values())
            for t in tasks:
                ids = sorted(d for d, _, m, b, task in rows if (m, b, task) == (*key, t))
                want[f"p/{key[0]}/{key[1]}", t] = list(enumerate(ids[:cap], 1))
        assert {k: sorted(v) for k, v in got.items()} == want


def test_stability_of_replayed_samples(spark):
    """The first sample's decision comes again in the second and not in the third."""
    from pullwise.operators import scorecard
    rows = [("t", "task", i, d, v) for i, (d, v) in enumerate([("x", "p"), ("x", "p"), ("y", "p"), ("x", "f")], 1)]
    runs = spark.createDataFrame(rows, "technique string, task_id string, run_ord int, d string, verdict string").withColumn("decision", F.struct(F.col("d").alias("fields")))
    r = scorecard.stability_table(runs).collect()[0]
    assert (r.repeat_runs, r.stable_runs, r.stable_fields, r.verdict_stable_runs, r.stable_tasks, r.distinct_max) == (3, 2, 2, 2, 0, 2)


def test_references_are_summed_before_unknown_ones_are_dropped(spark):
    """A layer of which only unknown fields are named asks for nothing, and no reference is read before its decision is picked."""
    layer, fields = next(iter(dims.FIELD_CATALOGUE.items()))
    a, b = list(fields)[:2]
    refs = [(1, f"{layer}/{a}"), (1, f"{layer}/{a}"), (1, f"{layer}/{b}"), (1, f"{layer}/unknown"), (2, f"{layer}/unknown"), (2, "nowhere/x"), (2, a), (2, None),
            (3, f"{layer}/{b}"), (4, f"{layer}/{a}")]
    frame = spark.createDataFrame(refs, "decision_id long, ref string")
    task = next(t for t, spec in dims.TASKS.items() if spec[1])
    rows = spark.createDataFrame([(i, task, "subject" if i == 1 else "all") for i in (1, 2, 3)], "decision_id long, task_id string, scope string")
    picked = frame.join(F.broadcast(rows.select("decision_id")), "decision_id", "left_semi")
    asked = recorded.decision_requests(spark, rows, picked, dims.TASKS)
    bit = dims.FIELD_BIT
    assert {tuple(r) for r in asked.select("decision_id", "layer", "want", "scoped").collect()} == {
        (1, layer, bit[layer, a] | bit[layer, b], True), (3, layer, bit[layer, b], False)}
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Filter" in line and "ref#" in line] == []


def test_replay_scans_layers_and_decisions_once(spark, monkeypatch):
    from pullwise.operators import scorecard
    steps = []
    for module in (recorded, scorecard):
        def seen(df, part="part", stored=module.written):
            steps.append(df)
            return stored(df, part)
        monkeypatch.setattr(module, "written", seen)
    steps.append(all_queries()["recorded_stability"].run(spark, "/root/testdata/sf0.001"))
    scans = [line for df in steps for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet [" in line]
    assert sum("FileScan parquet [l_" in line for line in scans) == 2          # one layer's rows, and the references
    # decisions are placed, counted by block and counted by agent; three layers read orders once each, one of them for the first encounter
    assert sum("FileScan parquet [o_" in line for line in scans) <= 3 + 4


def test_common_words_are_not_paired_with_every_function(spark):
    """100 000 names share a word; requests with it and a rare one meet the few functions that know the rare one."""
    from pullwise.operators import recognise
    vocabulary = spark.range(100_000).selectExpr("concat('f', id) as function_id", "concat('patient widgetry', lpad(id % 50000, 5, '0'), ' form') as name")
    asked = [(i, f"the patient form widgetry{i * 7:05d} today") for i in range(60)] + [(60, "nothing known"), (61, "widgetry00003")]
    seen = []
    plain = recognise._candidates

    def counted(lists, knows, bonus):
        found = plain(lists, knows, bonus)
        seen.append(found.count())
        return found
    recognise._candidates = counted
    try:
        rows = recognise.recognise(spark.createDataFrame(asked, "id long, text string"), vocabulary).collect()
    finally:
        recognise._candidates = plain
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add((r.function_id, r.score))
    assert set(got) == set(range(60)) | {61} and all(len({s for _, s in g}) == 1 for g in got.values())
    assert all({f"f{i * 7}", f"f{i * 7 + 50_000}"} <= {f for f, _ in got[i]} for i in range(60))
    assert max(seen) <= 20 * len(rows)


DRIFT = ("buttons", "fields", "history", "impact", "modules", "relevant", "roles", "unmapped", "merged")


@pytest.mark.parametrize("name", DRIFT)
def test_no_crawl_is_broadcast(spark, monkeypatch, name):
    """Only the fixed vocabulary (joined by ``_k``) is: whatever grows with the sites is sorted and merged, however small its files are."""
    steps, stored = [], drift.written

    def seen(df, part="part"):
        steps.append(df)
        return stored(df, part)

    monkeypatch.setattr(drift, "written", seen)
    steps.append(all_queries()[f"drift_{name}"].run(spark, "/root/testdata/sf0.001"))
    joins = [line for df in steps for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Broadcast" in line and "Join" in line]
    assert [line for line in joins if "_k" not in line] == []


def test_impact_gathers_no_places(spark):
    """A field changed if the places of one crawl aren't those of the other; that is found without an array of places per field."""
    rng = random.Random(7)
    layer, names = next((x, list(fs)) for x, fs in dims.FIELD_CATALOGUE.items())
    modules = [(s, crawl, o, f"M{o}", f"/m/{o}", layer) for s in range(40) for crawl in ("before", "after") for o in range(2)]
    fields = [(s, crawl, rng.randrange(2), rng.choice(["list page", "record page"]), i, n, rng.choice([n, n, None]))
              for s in range(40) for crawl in ("before", "after") for i, n in enumerate(names * 2) if rng.random() < 0.9]
    fields += [r for s in range(40, 60) for crawl in ("before", "after") for r in [(s, crawl, 0, "list page", i, n, None) for i, n in enumerate(names)]]
    modules += [(s, crawl, 0, "M0", "/m/0", layer) for s in range(40, 60) for crawl in ("before", "after")]
    found = drift.impact(drift.Crawls(spark.createDataFrame(modules, "site long, crawl string, ord int, title string, path string, layer string"),
                                      spark.createDataFrame(fields, "site long, crawl string, ord int, screen string, f_ord int, name string, label string"),
                                      spark.createDataFrame([], "site long, crawl string, ord int, screen string, c_ord int, label string")))
    want = {}
    for s in range(60):
        places = {(crawl, n): {(o, sc, la) for s1, c1, o, sc, _, n1, la in fields if (s1, c1, n1) == (s, crawl, n)} for crawl in ("before", "after") for n in names}
        has, same = {n for n in names if places["after", n]}, {n for n in names if places["before", n] == places["after", n]}
        for f, steps in dims.FUNCTION_STEPS.items():
            need = {(x, n) for x, ns, _ in steps for n in ns}
            lost = any(a for _, _, a in steps) or any(x != layer or n not in has for x, n in need)
            want[s, f] = "withheld" if lost else "unchanged" if all(n in same for _, n in need) else "re-worded"
    assert {(r.site, r.function_id): r.status for r in found.collect()} == want
    assert "collect_set" not in found._jdf.queryExecution().executedPlan().toString()


def test_multiplied_rows_come_from_all_tasks(spark):
    from pullwise.sources.tables import Tables
    spread = Tables(spark, "/root/testdata/sf0.001")["rated_modules"]
    per = spread.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_are_dealt_out_by_site_alone(spark, monkeypatch):
    """Rows of a site meet whatever else they are compared by, so no join or grouping deals them out anew; a site's travel as one array."""
    steps, stored = [], drift.written

    def seen(df, part="part"):
        steps.append(df)
        return stored(df, part)

    layer, names = next((x, list(fs)) for x, fs in dims.FIELD_CATALOGUE.items())
    modules = [(s, c, o, f"M{o}", f"/m/{o}", layer) for s in range(30) for c in ("2024", "2026") for o in range(2) if (s % 4, c, o) != (1, "2026", 0)]
    fields = [(s, "2024", i % 2, "list page", i, n, n) for s in range(30) for i, n in enumerate(names)]
    fields += [(s, "2026", 1 if s % 4 == 1 else i % 2, "list page", i, "Col " + n if i == 2 else n, n) for s in range(30) for i, n in enumerate(names) if s % 3 or i != 3]
    controls = [(s, c, 1, "list page", 0, "Zz") for s in range(30) for c in ("2024", "2026")]
    confirmed = [(s, "2026", "Col " + names[2], names[2]) for s in range(0, 30, 2)]
    frame = spark.createDataFrame
    known = drift.meanings(frame(confirmed, "site long, version string, shown string, means string"))
    monkeypatch.setattr(drift, "meanings", lambda _: known)
    monkeypatch.setattr(drift, "written", seen)
    c = drift.between(frame(modules, "site long, crawl string, ord int, title string, path string, layer string"),
                      frame(fields, "site long, crawl string, ord int, screen string, f_ord int, name string, label string"),
                      frame(controls, "site long, crawl string, ord int, screen string, c_ord int, label string"), None, "2024", "2026")
    changes, buttons, unmapped = drift.field_changes(c), drift.button_changes(c), drift.unmapped(c)
    gone = {(s, n) for s in range(30) for i, n in enumerate(names) if i == 2 and s % 2 or i == 3 and s % 3 == 0}
    assert {(r.site, r.field) for r in changes.where("change = 'gone'").collect()} == gone
    # where module 0 went, what is left is module 1's, which never had the renamed field
    assert {(r.site, r.shown): r.proposal for r in unmapped.collect()} == {
        (s, "Col " + names[2]): names[2] if s % 4 == 3 else names[3] if s % 3 == 0 else None for s in range(1, 30, 2)}
    steps += [changes, buttons, unmapped]
    moved = [line for df in steps for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    loose = [line for line in moved if not re.search(r"hashpartitioning\(site#\w+, \d+\)", line)]
    assert moved and [line for line in loose if not re.search(r"hashpartitioning\(site#\w+, crawl#\w+, ord#\w+, \d+\)", line)] == []
    assert len(loose) <= 2          # one mask of fields per module, summed up before it moves
