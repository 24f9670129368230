"""A directory of files end to end: no raw identifier in anything that is written."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pullwise import dims, session
from pullwise.plans import dataset
from pullwise.sinks import exports as sinks
from pullwise.sinks import log


def test_dataset_path(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "reg.csv").write_text("mrn,full_name,date_of_birth,sex,phone,admission_ward,note\n" + "".join(
        f"MRN000{i},Asha Rao{i},14/03/19{50 + i},F,98000000{i:02d},W{i % 3},x\n" for i in range(10, 30)))
    (d / "dx.csv").write_text("mrn,primary_diagnosis,medication\n" + "".join(f"MRN000{i},Flu,M{i}\n" for i in range(10, 20)))
    (d / "al.csv").write_text("mrn,allergy\nMRN00025,Latex\n")
    out = dataset.run(spark, str(d), str(tmp_path / "out"), "care-pull", "k3y", "20260101000000", F.lit(datetime(2026, 1, 1)))
    assert {r.file: r.rows for r in out.report.collect()} == {"reg.csv": 20, "dx.csv": 10, "al.csv": 1}
    costs = {(r.technique, r.task_id): r for r in out.costs.collect()}
    ours, wide = costs[dims.REFERENCE_TECHNIQUE, "patient-summary"], costs[dims.BASELINE_TECHNIQUE, "patient-summary"]
    assert ours.compliance_score == 1.0 and wide.compliance_score < 0.2 and ours.records == 2 and wide.records == 31
    assert ours.coverage < 1.0                                  # the first patient has no allergy on file
    assert out.audit.count() > 0 and out.audit.where("leaked").count() == 0
    matrix = {r.purpose: r for r in out.matrix.collect()}
    assert matrix[dims.CARE].verdict == "lawful for this purpose" and "out of scope" in matrix[dims.BILL].verdict
    assert out.schedule.collect()[0].delete_after == datetime(2026, 1, 31)
    e = out.events.orderBy("seq").collect()
    assert [(x.seq, x.event, x.records, x.unattributed) for x in e] == [(0, "extraction", 31, 0), (1, "export", e[1].records, 0)] and e[1].records > 30
    assert e[1].note == "pseudonymised export; erase on or after 2026-01-31" and out.subjects.count() == 40
    assert {len(r.token) for r in out.subjects.collect()} == {4 + 64}
    text = "\n".join(r.value for path in sinks.outputs(str(tmp_path / "out"), [dims.PA, dims.EHR]) for r in sinks.read_output(spark, path).collect())
    assert "MRN000" not in text and "Asha" not in text and "PSN-" in text and "14/03" not in text
    assert out.k.collect()[0].k_rows == 20
    assert {r.technique for r in spark.read.json(f"{tmp_path}/out/scores").collect()} >= {dims.REFERENCE_TECHNIQUE}

    where, layers = str(tmp_path / "out"), [dims.PA, dims.EHR]
    day = lambda m, d: F.lit(datetime(2026, m, d))
    assert dataset.purge_due(spark, where, layers, day(1, 30)).count() == 0
    assert dataset.purge_due(spark, where, layers, day(1, 31), dry_run=True).count() == 1
    purged = dataset.purge_due(spark, where, layers, day(1, 31)).collect()
    assert [(x.seq, x.event) for x in purged] == [(2, "purge")] and "erased" in purged[0].note
    assert all(sinks.read_output(spark, path).count() == 0 for path in sinks.outputs(where, layers))
    assert dataset.purge_due(spark, where, layers, day(3, 1)).count() == 0                 # once only
    assert all(r.intact and r.linked and r.consistent for r in log.verify_log(spark, f"{where}/log").collect())
    lines = [json.loads(r.line) for r in spark.read.parquet(f"{where}/log/lines").orderBy("seq").collect()]
    assert [x["event"] for x in lines] == ["extraction", "export", "purge"] and "MRN" not in json.dumps(lines)


def test_nothing_to_score(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="nothing to score"):
        dataset.run(spark, str(tmp_path), str(tmp_path / "o"), "care-pull", "k", "20260101000000", F.lit(datetime(2026, 1, 1)))


def test_cluster_settings_grow_with_the_input():
    small, large = session.cluster_settings(1 << 30, 16), session.cluster_settings(100 << 40, 8000)
    assert small["spark.sql.shuffle.partitions"] == "32" and large["spark.sql.shuffle.partitions"] == str(100 << 13)
