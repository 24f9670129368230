"""Boundary scores of the rules, the purpose matrix and the claims."""

import random

import pytest
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.operators import claims, extract, rules

COMPLIANT = dict(run_id="r", purpose=dims.CARE, purpose_specified=True, secondary_uses=[], basis_type="legitimate_use",
                 basis_reference="LU-CARE", retention_days=30, deletion_mechanism="PURGE-01", transport_encrypted=True,
                 at_rest_encrypted=True, access_controlled=True, identifiers_pseudonymised=True, notice_reference="NOTICE-REG-2026",
                 notice_covers_purpose=True, notice_machine_readable=True, audit_log_enabled=True, accountable_party="DPO",
                 processing_record_kept=True, scope_pulled=None, scope_necessary=None, observed_transport=None,
                 cat_mask=dims.category_mask([dims.DI, dims.CL]))
SCHEMA = ("run_id string, purpose string, purpose_specified boolean, secondary_uses array<string>, basis_type string, "
          "basis_reference string, retention_days int, deletion_mechanism string, transport_encrypted boolean, at_rest_encrypted boolean, "
          "access_controlled boolean, identifiers_pseudonymised boolean, notice_reference string, notice_covers_purpose boolean, "
          "notice_machine_readable boolean, audit_log_enabled boolean, accountable_party string, processing_record_kept boolean, "
          "scope_pulled int, scope_necessary int, observed_transport boolean, cat_mask int")


def frame(spark, *changes):
    rows = [{**COMPLIANT, "run_id": str(i), **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[k] for k in COMPLIANT) for r in rows], SCHEMA)


def score(spark, **change):
    return rules.score_runs(frame(spark, change)).collect()[0]


def test_compliant_run_passes_everything(spark):
    r = score(spark)
    assert r.compliance_score == 1.0 and r.pass_rate == 1.0 and r.rules_passed == 7


CASES = [
    ("dm", dict(cat_mask=0), 1.0, "not_applicable"),
    ("dm", dict(cat_mask=dims.category_mask([dims.CL, dims.FI])), 0.5, "fail"),
    ("dm", dict(cat_mask=dims.category_mask([dims.CL, dims.FI, dims.DI, dims.QI, dims.AD])), 0.5, "fail"),   # not compensatory
    ("dm", dict(scope_pulled=10, scope_necessary=2), 0.2, "fail"),
    ("dm", dict(scope_pulled=0, scope_necessary=0), 1.0, "pass"),
    ("dm", dict(scope_pulled=4, scope_necessary=2, cat_mask=dims.category_mask([dims.FI, dims.CO])), 0.0, "fail"),
    ("lb", dict(basis_type=None), 0.0, "fail"), ("lb", dict(basis_reference=None), 0.5, "fail"),
    ("sl", dict(retention_days=91), 0.5, "fail"), ("sl", dict(retention_days=90), 1.0, "pass"),
    ("sl", dict(retention_days=None, deletion_mechanism=None), 0.0, "fail"),
    ("ss", dict(identifiers_pseudonymised=False), 0.75, "fail"),
    ("ss", dict(identifiers_pseudonymised=False, cat_mask=dims.category_mask([dims.CL])), 1.0, "pass"),
    ("ss", dict(identifiers_pseudonymised=False, purpose=dims.BILL), 1.0, "pass"),
    ("pl", dict(purpose_specified=False), 0.0, "fail"), ("pl", dict(secondary_uses=["research registry"]), 0.25, "fail"),
    ("pl", dict(secondary_uses=[dims.REG], cat_mask=dims.category_mask([dims.DI])), 0.5, "fail"),
    ("pl", dict(secondary_uses=[dims.BILL]), 0.25, "fail"), ("pl", dict(purpose="marketing"), 0.0, "fail"),
    ("nt", dict(notice_reference=None), 0.0, "fail"), ("nt", dict(notice_covers_purpose=False), 0.5, "fail"),
    ("ac", dict(accountable_party=None, audit_log_enabled=False), 1 / 3, "fail"),
]


def test_boundary_scores(spark):
    got = {int(r.run_id): r for r in rules.score_runs(frame(spark, *[c[1] for c in CASES])).collect()}
    for i, (rule, change, want, status) in enumerate(CASES):
        assert got[i][f"{rule}_score"] == pytest.approx(want, abs=1e-6), (rule, change)
        assert got[i][f"{rule}_status"] == status, (rule, change)


def test_findings(spark):
    r = rules.score_runs(frame(spark, dict(cat_mask=dims.category_mask([dims.FI]), retention_days=None)), findings=True).collect()[0]
    assert r.dm_findings == ["out of scope: financial"] and r.sl_findings == ["no retention period"]


def test_random_manifests_against_plain_python(spark):
    rng = random.Random(7)
    changes = []
    for _ in range(200):
        changes.append(dict(
            purpose=rng.choice(dims.PURPOSES), cat_mask=rng.randrange(64), retention_days=rng.choice([None, 10, 90, 180, 365, 400]),
            deletion_mechanism=rng.choice([None, "x"]), transport_encrypted=rng.random() < .5, at_rest_encrypted=rng.random() < .5,
            identifiers_pseudonymised=rng.random() < .5, secondary_uses=rng.choice([[], [dims.BILL], ["other"], [dims.REG, dims.CARE]]),
            basis_reference=rng.choice([None, "LU-CARE"]), notice_reference=rng.choice([None, "n"])))
    got = {int(r.run_id): r for r in rules.score_runs(frame(spark, *changes)).collect()}
    for i, c in enumerate(changes):
        m = {**COMPLIANT, **c}
        cats = {x for x in dims.CATEGORIES if m["cat_mask"] & dims.CATEGORY_BIT[x]}
        pol = dims.PURPOSE_POLICY[m["purpose"]]
        allowed = set(pol["allowed"])
        want = []
        if cats:
            want.append(1 - len(cats - allowed) / len(set(dims.CATEGORIES) - allowed))
        want.append(1.0 if m["basis_reference"] else 0.5)
        want.append(1 - 0.5 * (m["retention_days"] is None or m["retention_days"] > pol["max_retention_days"]) - 0.5 * (not m["deletion_mechanism"]))
        checks = [m["transport_encrypted"], m["at_rest_encrypted"], True]
        if pol["pseudonymise"] and dims.DI in cats:
            checks.append(m["identifiers_pseudonymised"])
        want.append(sum(checks) / len(checks))
        bad = [u for u in m["secondary_uses"] if u not in dims.PURPOSES or cats - set(dims.PURPOSE_POLICY[u]["allowed"])]
        want.append(1.0 if not m["secondary_uses"] else 0.25 if bad else 0.5)
        want.append(1.0 if m["notice_reference"] else 0.0)
        want.append(1.0)
        assert got[i].compliance_score == pytest.approx(sum(want) / len(want), abs=6e-4), c


def test_purpose_scopes_do_not_nest():
    for a in dims.PURPOSES:
        for b in dims.PURPOSES:
            assert a == b or dims.allowed_mask(a) & ~dims.allowed_mask(b)


@pytest.mark.parametrize("task,want", [("care-pull", (1.0, 0.786, 0.857)), ("billing-pull", (1.0, 0.786, 0.857))])
def test_purpose_matrix_of_the_two_pulls(spark, task, want):
    purpose, *_, needed = dims.MATRIX_TASKS[task]
    cats = dims.category_mask({dims.FIELD_CATALOGUE[lay][f] for lay, fs in needed.items() for f in fs})
    days = 365 if purpose == dims.BILL else 90
    out = {r.purpose: r for r in rules.across_purposes(frame(spark, dict(
        purpose=purpose, cat_mask=cats, retention_days=min(days, 30)))).collect()}
    assert out[purpose].compliance_score == 1.0 and out[purpose].verdict == "lawful for this purpose"
    others = sorted(r.compliance_score for p, r in out.items() if p != purpose)
    assert all(s < 1.0 for s in others)
    other = dims.BILL if purpose == dims.CARE else dims.CARE
    assert "out of scope" in out[other].verdict
    assert out[dims.REG].compliance_score == want[2] and out[other].compliance_score == want[1]


def test_claims_need_citation_and_observation(spark):
    rows = claims.claim_rows(frame(spark, dict(accountable_party="endpoint team", observed_transport=False, basis_reference="lu-care, s.7")), "run_id").collect()
    ok = {r.control: r.substantiated for r in rows}
    assert ok["accountable party"] is False and ok["transport encryption"] is False and ok["lawful-basis reference"] is True
    v = claims.with_veracity(frame(spark, {}, dict(observed_transport=False))).orderBy("run_id").collect()
    assert (v[0].declared, v[0].substantiated, v[0].demonstrated) == (11, 11, 5) and v[0].veracity == 1.0 and v[1].substantiated == 10
    s = claims.substantiate(frame(spark, dict(notice_reference="poster"))).collect()[0]
    assert s.notice_reference is None and s.accountable_party == "DPO"


def test_empty_register_backs_nothing(spark):
    v = claims.with_veracity(frame(spark, {}), register={}, lawful_bases={}, machine_readable=False).collect()[0]
    assert v.substantiated == 0 and v.declared == 11


def test_metering_algebra(spark):
    rows = [("t", 1, 4, 10, 5, 3, 3, None, 4), ("t", 1, 6, 10, 5, 3, 2, 2, 6)]
    df = spark.createDataFrame([r[:8] for r in rows], "technique string, fetches int, records int, fields_pulled int, distinct_fields int, needed_fields int, matched_fields int, necessary int")
    c = extract.combine(df, "technique").collect()[0]
    assert c.excess_ratio == 1.667 and c.coverage == 0.833 and c.record_excess == 3.0
    p = extract.per_pass(extract.combine(df, "technique"), F.lit(4), "records").collect()[0]
    assert p.records == 2          # 10 / 4 = 2.5, halves to even


def test_source_without_needed_fields_is_not_scored(spark):
    df = spark.createDataFrame([("a",)], "insurance_policy_no string")
    assert extract.shortfall({dims.FIN: df}, dims.TASKS) is not None
    assert extract.shortfall({}, dims.TASKS) == "no layer was understood"
