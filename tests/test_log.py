"""The stored log and the purge: appends, seals, forged and cut logs, buckets rewritten."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pullwise import session
from pullwise.operators import ordinals
from pullwise.sinks import exports as sinks
from pullwise.sinks import log


def events(spark, first, last):
    return spark.range(first, last).select(
        F.col("id").alias("seq"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("at"), F.lit("export").alias("event"), F.lit("run-1").alias("run_id"),
        F.lit("t").alias("technique"), F.lit("p").alias("purpose"), F.lit(1).alias("records"), F.lit(0).alias("unattributed"), F.lit(True).alias("scoped"), F.lit("").alias("note"))


def verdicts(spark, path):
    return [(r.n, r.intact, r.linked, r.consistent) for r in log.verify_log(spark, path).orderBy("batch").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def peaks_of(roots):
    """The peaks by height, by splitting the roots as the bits of their number say."""
    def node(some):
        return some[0] if len(some) == 1 else sha(node(some[:len(some) // 2]) + node(some[len(some) // 2:]))
    out, at = {}, 0
    for h in reversed(range(len(roots).bit_length())):
        if len(roots) >> h & 1:
            out[h] = node(roots[at:at + (1 << h)])
            at += 1 << h
    return out


def test_peaks_of_seals():
    seal, roots = None, []
    for i in range(70):
        roots.append(sha(f"root {i}"))
        seal = log.next_seal(seal, 3, roots[-1], "x")
        assert {h: p for h, p in enumerate(seal.peaks) if p is not None} == peaks_of(roots) and seal.batch == i and seal.total == 3 * (i + 1)


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 3000])
def test_mountain_range_holds_all_complete_nodes(spark, n):
    roots = [sha(f"{i}") for i in range(n)]
    got = {(r.height, r.place): r.hash for r in log.mountain_range(spark.createDataFrame(list(enumerate(roots)), "batch bigint, root string")).collect()}
    want, level, height = {}, roots, 0
    while level:
        want |= {(height, i): h for i, h in enumerate(level)}
        level, height = [sha(level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)], height + 1
    assert got == want


def test_log_is_chained_and_sealed_when_written(spark, tmp_path):
    path = str(tmp_path / "log")
    for first, last in ((0, 300), (300, 310), (310, 900)):
        log.append_log(events(spark, first, last), path)
    assert verdicts(spark, path) == [(300, True, True, True), (10, True, True, True), (590, True, True, True)]
    kept = spark.read.parquet(f"{path}/seals")
    assert {r.batch: r.status for r in log.verify_against(spark, path, kept).collect()} == {0: "agrees", 1: "agrees", 2: "agrees"}
    lines = spark.read.parquet(f"{path}/lines")
    edit = F.when(F.col("seq") == 305, F.replace("line", F.lit('"records":1'), F.lit('"records":2'))).otherwise(F.col("line"))
    for name, some, want in (("edited", lines.withColumn("line", edit), [(True, True), (False, False), (True, False)]),
                             ("dropped", lines.where("seq <> 899"), [(True, True), (True, True), (False, False)]),
                             ("gone", lines.where("batch <> 1"), [(True, True), (False, False), (True, False)])):
        some.write.parquet(f"{tmp_path}/{name}/lines")
        kept.write.parquet(f"{tmp_path}/{name}/seals")
        assert [(r[1], r[3]) for r in verdicts(spark, f"{tmp_path}/{name}")] == want, name


def test_lines_are_stored_once(spark, tmp_path, monkeypatch):
    """An append writes its lines where they stay, and works its roots out from there; every line carries the hash of the one before."""
    kept, path = [], str(tmp_path / "log")
    monkeypatch.setattr(log, "written", lambda df, name="part": kept.append(name) or session.written(df, name))
    log.append_log(events(spark, 0, 300), path, F.floor(F.col("seq") / 280))
    log.append_log(events(spark, 300, 310), path)
    assert "lines" not in kept and verdicts(spark, path) == [(280, True, True, True), (20, True, True, True), (10, True, True, True)]
    chains = {}
    for r in spark.read.parquet(f"{path}/lines").orderBy("seq").collect():
        before = chains.get((r.batch, r.chain))
        assert r.prev_sha256 == (sha(before) if before else "") and r.line.endswith(f',"prev_sha256":"{r.prev_sha256}"}}')
        chains[r.batch, r.chain] = r.line


def test_a_failed_append_leaves_nothing_that_counts(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append_log(events(spark, 0, 20), path)
    spark.read.parquet(f"{path}/lines").withColumns({"batch": F.lit(1).cast("bigint"), "append": F.lit("unsealed")}).write.mode("append").parquet(f"{path}/lines")
    log.append_log(events(spark, 20, 25), path)
    assert verdicts(spark, path) == [(20, True, True, True), (5, True, True, True)]
    assert log.append_log(events(spark, 0, 0), path) == [] and len(verdicts(spark, path)) == 2


def test_a_thousand_appends_in_a_constant_number_of_jobs(spark, tmp_path):
    def jobs(path):
        name = f"verify {path}"
        spark.sparkContext.setJobGroup(name, name)
        rows = log.verify_log(spark, path).collect()
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, n
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    log.append_log(events(spark, 0, 60), few, F.floor(F.col("seq") / 20))
    seals = log.append_log(events(spark, 0, 20_000), many, F.floor(F.col("seq") / 20))
    assert len(seals) == 1000
    (_, n_few), (rows, n_many) = jobs(few), jobs(many)
    assert len(rows) == 1000 and all(r.intact and r.linked and r.consistent and r.n == 20 for r in rows)
    assert n_many <= n_few + 4
    # a log written anew up to append 800, with one event of append 500 changed: kept seals tell
    forged = str(tmp_path / "forged")
    log.append_log(events(spark, 0, 16_000).withColumn("records", F.when(F.col("seq") == 10_001, 9).otherwise(F.col("records"))), forged, F.floor(F.col("seq") / 20))
    assert all(r.intact and r.linked and r.consistent for r in log.verify_log(spark, forged).collect())
    status = {r.batch: r.status for r in log.verify_against(spark, forged, spark.read.parquet(f"{many}/seals")).collect()}
    assert status == {b: "agrees" if b < 500 else "rewritten" if b < 800 else "truncated" for b in range(1000)}


def test_due_runs_are_taken_from_every_output(spark, tmp_path):
    paths = [str(tmp_path / "hl7" / "a"), str(tmp_path / "fhir" / "a")]
    rng = random.Random(1)
    rows = [(f"run-{i}", n, f"line {i} {n}") for i in range(12) for n in range(rng.choice([1, 5, 400]))]
    for p in paths:
        sinks.append_output(spark.createDataFrame(rows, "run_id string, n int, value string"), p, 5)
    table = spark.createDataFrame([(f"run-{i}", "p", 30, f"2026-{i + 1:02d}-01 00:00:00") for i in range(12)],
                                  "run_id string, purpose string, retention_days int, delete_after string").withColumn(
        "delete_after", F.col("delete_after").cast("timestamp")).withColumns({"written_at": F.lit(None).cast("timestamp"), "files": F.array(F.lit("f"))})
    for month, left in ((2, 10), (2, 10), (11, 1), (12, 0)):
        now = F.lit(f"2026-{month:02d}-15 00:00:00").cast("timestamp")
        assert sinks.purge(spark, paths, table, now, dry_run=True, buckets=5).count() == 12 - left
        sinks.purge(spark, paths, table, now, buckets=5)
        for p in paths:
            stays = [r for r in rows if int(r[0][4:]) >= 12 - left]
            assert sorted((r.run_id, r.n, r.value) for r in sinks.read_output(spark, p).collect()) == sorted(stays)
            assert not any(f"line {i} " in r.value for i in range(12 - left) for r in spark.read.parquet(p).where("value is not null").collect())


def test_rows_are_numbered_in_an_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("_v"))
    got = ordinals.sequenced(rows, "k", start=10).orderBy("k").collect()
    assert [r.seq for r in got] == list(range(10, 5010)) and got[0]._v == "x"
