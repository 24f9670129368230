"""Ingestion of hand-written directories, exports, leak searches, shaping."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pullwise import dims, session
from pullwise.functions import text
from pullwise.operators import fhir, hl7, ingest, leaks, ordinals, privacy
from pullwise.sinks import exports as sinks
from pullwise.sources.exports import ExportDirectory, load_column_map
from pullwise.sources.heads import heads



def write(folder, **files):
    for name, body in files.items():
        (folder / name.replace("__", ".")).write_text(body)
    return str(folder)


def test_leading_zeros_blanks_and_subject_filter(spark, tmp_path):
    d = write(tmp_path, reg__csv="mrn,full_name,phone\n000123,Asha Rao,98\n,No Key,\n", clin__csv="mrn,primary_diagnosis,medication\n000123,Flu,\n")
    src = ExportDirectory(spark, d)
    assert src.accepted == ["clin.csv", "reg.csv"]
    rows = src.fetch(dims.PA, ["mrn", "full_name"], {"mrn": "000123"}).collect()
    assert [(r.mrn, r.full_name) for r in rows] == [("000123", "Asha Rao")]
    assert src.layer(dims.EHR).collect()[0].medication is None
    assert src.fetch(dims.PA, ["mrn"], {"nope": "1"}).count() == 0


def test_wide_file_is_refused_until_mapped_or_blanked(spark, tmp_path):
    heads = ["Id", "BIRTHDATE", "SSN", "DRIVERS", "FIRST", "LAST", "MARITAL", "RACE"]
    d = write(tmp_path, patients__csv=",".join(heads) + "\n" + ",".join("x" * 8) + "\n")
    part = {"Id": "mrn", "BIRTHDATE": "date_of_birth", "FIRST": "full_name"}
    cm = lambda m: spark.createDataFrame([(None, k, v) for k, v in m.items()], "file string, header string, field string")
    assert ExportDirectory(spark, d, cm(part)).refused() == {"patients.csv": ingest.LOW_CONFIDENCE}
    rest = {h: "" for h in heads if h not in part}
    src = ExportDirectory(spark, d, cm({**part, **rest}))
    assert src.accepted == ["patients.csv"] and src.layer(dims.PA).columns == ["source_file", "mrn", "date_of_birth", "full_name"]


def test_key_only_file_is_refused(spark, tmp_path):
    d = write(tmp_path, careplans__csv="PATIENT,DESCRIPTION\n1,x\n")
    cm = spark.createDataFrame([(None, "PATIENT", "mrn")], "file string, header string, field string")
    assert ExportDirectory(spark, d, cm).refused() == {"careplans.csv": ingest.ONLY_KEY}


def test_column_map_file_and_override(spark, tmp_path):
    d = write(tmp_path, conditions__csv="P,D\n1,flu\n", careplans__csv="P,D\n1,walk\n",
              column_map__json=json.dumps({"_note": "x", "map": {"P": "mrn", "D": "primary_diagnosis"}, "files": {"careplans.csv": {"D": ""}}}))
    cm = load_column_map(spark, f"{d}/column_map.json")
    src = ExportDirectory(spark, d, cm)
    assert src.accepted == ["conditions.csv"]
    assert set(src.refused()) == {"careplans.csv"}


def test_concept_files_are_stacked_and_pruned(spark, tmp_path):
    d = write(tmp_path, allergies__csv="mrn,allergy\n1,Latex\n", conditions__csv="mrn,primary_diagnosis\n1,Flu\n2,Cold\n1,Gout\n",
              medications__csv="mrn,medication\n1,A\n2,B\n")
    src = ExportDirectory(spark, d)
    assert src.layer(dims.EHR).count() == 6
    assert src.fetch(dims.EHR, ["mrn", "allergy"]).count() == 1
    assert src.fetch(dims.EHR, ["mrn"]).count() == 6
    assert {r.source_file: r.rows for r in ingest.rows_by_file(src.fetch(dims.EHR, ["mrn"], {"mrn": "1"})).collect()} == {
        "allergies.csv": 1, "conditions.csv": 2, "medications.csv": 1}


def test_files_by_month_concatenate_and_report(spark, tmp_path):
    head = "mrn,full_name,date_of_birth,extra\n"
    d = write(tmp_path, reg_jan__csv=head + "1,A,14/03/1988,x\n2,B,not a date,x\n", reg_feb__csv=head + "3,C,1990-01-02,x\n")
    src = ExportDirectory(spark, d)
    assert {r.mrn: r.date_of_birth for r in src.layer(dims.PA).collect()} == {"1": "1988-03-14", "2": "not a date", "3": "1990-01-02"}
    rep = {r.file: r for r in src.report().collect()}
    assert rep["reg_jan.csv"].rows == 2 and rep["reg_jan.csv"].unparsed == 1 and rep["reg_jan.csv"].not_understood == ["extra"]
    assert rep["reg_jan.csv"].confidence == 0.75


def test_json_records_flatten_and_sidecars_are_skipped(spark, tmp_path):
    d = write(tmp_path, adm__json=json.dumps([{"mrn": "007", "admission_ward": "W1", "who": {"name": "Z"}}, {"mrn": 8, "admission_ward": None}]),
              manifest__json=json.dumps([{"mrn": 1}]), notes__json=json.dumps({"a": 1}))
    src = ExportDirectory(spark, d)
    assert src.accepted == ["adm.json"]
    assert {h.header for h in src.headers.collect()} == {"mrn", "admission_ward", "who.name"}
    assert sorted((r.mrn, r.admission_ward) for r in src.layer(dims.PA).collect()) == [("007", "W1"), ("8", None)]


def test_numbered_and_previous_match_windows_at_any_block(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < .7 else f"k{i % 5}", i, f"v{i}") for i in rng.sample(range(5000), 1200)]
    df = spark.createDataFrame(rows, "k string, o bigint, v string")
    by_key = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((o, v))
    want = {(k, o): (i + 1, lst[i - 1][1] if i else None) for k, lst in by_key.items() for i, (o, _) in enumerate(lst)}
    for block in (1, 7, 100, 65536):
        n = {(r.k, r.o): r.n for r in ordinals.numbered(df, ["k"], "o", block=block).collect()}
        p = {(r.k, r.o): (r.ix + 1, r.before) for r in ordinals.with_previous(df, ["k"], "o", "v", "before", "ix", block).collect()}
        assert n == {k: v[0] for k, v in want.items()} and p == want


def _brute(values, texts):
    out = {}
    for v in values:
        ws = re.sub(r"[^a-z0-9]+", " ", v.casefold()).split()
        dg = re.sub(r"\D", "", v)
        hit = False
        if len(dg) >= 7 and len(dg) >= len(v.replace(" ", "")) - 4:
            hit = any(dg in re.sub(r"\D", "", f) for t in texts for f in re.split(r'[|^~&\\\r\n"{}\[\],:]', t))
        norm = [" " + re.sub(r"[^a-z0-9]+", " ", t.casefold()) + " " for t in texts]
        out[v] = hit or bool(ws) and any(all(f" {w} " in t for w in ws) for t in norm)
    return out


@pytest.mark.parametrize("hot", [1, 3, 100000])
def test_leaks_match_brute_force(spark, hot):
    rng = random.Random(5)
    names = ["Asha", "Rao", "Meera", "Straße", "Iyer", "Khan", "Lee"]
    texts = [f"PID|1||{rng.choice(names)}^{rng.choice(names)}|+91 98{rng.randrange(10**3):03d}-{rng.randrange(10**5):05d}|{rng.randrange(10**4)}" for _ in range(60)]
    texts += ["", "no identifiers, 12:34:56", '{"a":"9812345","b":"678"}']
    values = [f"{a} {b}" for a in names for b in names] + ["+91 98123-45678", "9812345678", "", "   ", "STRASSE", "Rao"]
    values += [re.search(r"\+91[^|]*", t)[0].replace("-", " ") for t in texts[:20]] + ["9812345 678"]
    v = spark.createDataFrame([(x,) for x in values], "value string")
    a = spark.createDataFrame(list(enumerate(texts)), "artefact_id int, text string")
    got = {r.value: r.leaked for r in leaks.find_leaks(v, a, hot=hot).collect()}
    want = _brute({x for x in values if x}, texts)
    assert got == want


def test_postings_are_numbers(spark, monkeypatch):
    """An occurrence of a wanted word is stored as a number: nothing to encrypt or decrypt for each, and no joins that broadcast them."""
    values = ["Rao Meera 12", "meera, rao", "Iyer Khan", "khan 12 iyer", "nobody here"]
    texts = ["Meera 7 Rao", "12 rao; meera", "Khan 12", "Iyer", "12 12 12"]
    kept = {}

    def written(df, name="part"):
        kept[name] = df.dtypes
        return session.written(df, name)
    monkeypatch.setattr(leaks, "written", written, raising=False)
    v = spark.createDataFrame([(x,) for x in values], "value string")
    a = spark.createDataFrame(list(enumerate(texts)), "artefact_id int, text string")
    found = leaks.find_leaks(v, a)
    assert {r.value: r.leaked for r in found.collect()} == _brute(values, texts)
    assert kept["postings"] == [("artefact_id", "int"), ("number", "bigint")] and not any(t == "string" for _, t in kept["lookups"])
    spread = [p for p in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in p and "number" in p]
    assert spread and all("strategy=merge" in p for p in spread)


def test_exact_leaks_match_contains(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab1é ") for _ in range(rng.randrange(0, 300))) for _ in range(80)]
    values = ["".join(rng.choice("ab1é ") for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    values = [v for v in values if v.strip()]
    got = {(r.value, r.artefact_id) for r in leaks.exact_leaks(
        spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(list(enumerate(texts)), "artefact_id int, text string")).collect()}
    assert got == {(v, i) for v in values for i, t in enumerate(texts) if v in t}


def test_k_anonymity(spark):
    df = spark.createDataFrame([("1988-03-14", "F", "560001"), ("1988-07-01", "F", "560099"), (None, None, None), ("1990-01-01", "M", "56")],
                               "date_of_birth string, sex string, pincode string")
    r = privacy.k_anonymity(privacy.generalise(df)).collect()[0]
    assert (r.k, r.k_rows, r.groups) == (1, 3, 2)
    assert [x.pincode for x in privacy.generalise(df).collect()] == ["560XXX", "560XXX", None, "56"]
    empty = privacy.k_anonymity(df.where("sex is null")).collect()[0]
    assert empty.k is None


def pa_row(spark, **v):
    cols = list(dims.FIELD_CATALOGUE[dims.PA])
    return spark.createDataFrame([(*[v.get(c) for c in cols], "r", 1)], ", ".join(f"{c} string" for c in cols) + ", run_id string, n int")


def test_hl7_segments(spark):
    def msg(layer, df):
        return df.select(hl7.message(layer, df, hl7.control_id(layer), "20260101000000").alias("m")).collect()[0].m.split("\r")
    m = msg(dims.PA, pa_row(spark))
    assert [s[:3] for s in m] == ["MSH", "PID"] and m[1] == "PID|1"
    m = msg(dims.PA, pa_row(spark, mrn="M1", full_name="Asha Devi Rao", pincode="560001"))
    assert m[1] == "PID|1||M1^^^HIS^MR||Rao^Asha Devi||||||^^^^560001"
    m = msg(dims.PA, pa_row(spark, full_name="PSN-1", admission_ward="W4"))
    assert m[1] == "PID|1||||PSN-1" and m[2] == "PV1|1|I|W4"
    fin = spark.createDataFrame([("r", 1, "M1", None)], "run_id string, n int, mrn string, invoice_id string")
    assert msg(dims.FIN, fin)[2] == "FT1|1|||||CG"


def test_fhir_mandatory_elements(spark):
    def res(layer, df):
        return [json.loads(r.resource) for r in fhir.shape(layer, df).collect()]
    assert res(dims.PA, pa_row(spark)) == []
    enc = res(dims.PA, pa_row(spark, admission_datetime="2026-01-01T00:00:00"))[0]
    assert enc["class"]["code"] == "UNK" and enc["subject"] == {"display": "not in extract"}
    fin = spark.createDataFrame([(None, "PL1")], "mrn string, insurance_policy_no string")
    cov = res(dims.FIN, fin)
    assert len(cov) == 1 and cov[0]["payor"] == [{"display": "not in extract"}] and cov[0]["subscriberId"] == "PL1"


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("run-1", True, 1, "MRN1", "Asha Rao", "1988-03-14"), ("run-2", False, 2, "MRN2", "Meera Iyer", "1990-01-01")],
                                 "run_id string, pseudonymised boolean, row_ix bigint, mrn string, full_name string, date_of_birth string")
    sinks.write_export(dims.PA, rows, str(tmp_path), "secret", "20260101000000")
    sinks.publish(spark, f"{tmp_path}/hl7/{dims.PA}", rows, f"{tmp_path}/files")
    texts = spark.read.text(f"{tmp_path}/files").groupBy("run_id").agg(F.concat_ws("\n", F.collect_list("value")).alias("t"))
    got = {r.run_id: r.t for r in texts.collect()}
    assert "MRN1" not in got["run-1"] and "Asha" not in got["run-1"] and "Iyer^Meera" in got["run-2"]
    manifest = sinks.write_layers({dims.PA: rows.drop("run_id", "pseudonymised", "row_ix")}, f"{tmp_path}/layers").collect()[0]
    assert manifest.rows == 2 and manifest.columns == "mrn,full_name,date_of_birth"
    messages, entries = sinks.shape_export(dims.PA, rows, "secret", "20260101000000")
    sched = spark.sql("select 'run-1' as run_id, 'care_coordination' as purpose, 30 as retention_days, timestamp'2026-02-01' as delete_after")
    ev = {r.run_id: r for r in sinks.export_events(rows, messages, entries, sched).collect()}
    assert ev["run-1"].note == "pseudonymised export; erase on or after 2026-02-01" and ev["run-2"].note == "RAW export; no retention declared"
    assert ev["run-1"].records == 2


def test_casefold(spark):
    df = spark.createDataFrame([("Straße ﬁne",)], "v string")
    assert df.select(text.normalise_text(F.col("v"))).collect()[0][0] == " strasse fine "


def bytes_read(spark):
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    return stats.getLong("bytesRead") or 0


def test_headers_cost_a_few_buffers_whatever_the_files_size(spark, tmp_path):
    line = "000123,Asha Rao,1988-03-14," + "x" * 200 + "\n"
    (tmp_path / "reg.csv").write_text("mrn,full_name,date_of_birth,more\n" + line * 900_000)
    (tmp_path / "b.json").write_text("[" + ",".join(['{"mrn": "1", "phone": "2"}'] * 1_000_000) + "]")
    assert (tmp_path / "reg.csv").stat().st_size > 200_000_000
    before = bytes_read(spark)
    found = heads(spark, str(tmp_path), "*.csv") + heads(spark, str(tmp_path), "*.json", '"')
    assert [(h.name, h.head, h.bytes) for h in found] == [("reg.csv", "mrn,full_name,date_of_birth,more", (tmp_path / "reg.csv").stat().st_size),
                                                          ("b.json", "[{", (tmp_path / "b.json").stat().st_size)]
    assert bytes_read(spark) - before < 1 << 20


def test_classifying_reads_heads_only(spark, tmp_path):
    line = "000123,Asha Rao,1988-03-14," + "x" * 200 + "\n"
    for i in range(3):
        (tmp_path / f"reg{i}.csv").write_text("mrn,full_name,date_of_birth,more\n" + line * 300_000)
    (tmp_path / "area.csv").write_text("mrn,pincode\n" + "000123,1\n" * 10)
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    before = bytes_read(spark)
    src = ExportDirectory(spark, str(tmp_path))
    assert src.accepted == ["area.csv", "reg0.csv", "reg1.csv", "reg2.csv"]
    assert bytes_read(spark) - before < size / 20
    assert src.fetch(dims.PA, ["pincode"]).count() == 10                    # the large files aren't opened for it
    assert bytes_read(spark) - before < size / 20
    assert src.fetch(dims.PA, ["full_name"]).count() == 900_000


def test_heads_may_span_lines_and_start_late(spark, tmp_path):
    d = write(tmp_path, a__csv='\n\n"mrn","full\nname",phone\n1,2,3\n', b__csv="\ufeffmrn,phone\r\n1,2\r\n", c__csv="", d__csv="mrn,phone")
    found = {r.name: r.head for r in heads(spark, d, "*.csv")}
    assert found == {"a.csv": '"mrn","full\nname",phone', "b.csv": "mrn,phone", "d.csv": "mrn,phone"}
    src = ExportDirectory(spark, d)
    assert src.accepted == ["a.csv", "b.csv", "d.csv"] and src.layer(dims.PA).count() == 2


@pytest.mark.parametrize("split", [1 << 30, 4000, 500])
def test_read_order_does_not_depend_on_splits(spark, tmp_path, split):
    rng = random.Random(4)
    names = [f"reg_{i}.csv" for i in range(4)]
    want = []
    for n in names:
        rows = [(f"M{n[4]}{i:04d}", rng.choice(["Asha", "Rao, Meera", 'the "third"']), f"W{rng.randrange(9)}") for i in range(rng.choice([1, 300, 700]))]
        extra = ",sex" if n == "reg_2.csv" else ""
        (tmp_path / n).write_text(f"mrn,full_name,admission_ward{extra}\n" + "".join(
            f'{m},"{f.replace(chr(34), chr(34) * 2)}",{w}{",F" if extra else ""}\n' for m, f, w in rows))
        want += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        layers = ExportDirectory(spark, str(tmp_path)).layers(numbered=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = layers[dims.PA].orderBy("row_ix").collect()
    assert [(r.row_ix, r.mrn, r.full_name, r.admission_ward) for r in got] == [(i, *r) for i, r in enumerate(want)]
    from pullwise.operators import extract
    assert extract.first_subject(layers).first()[0] == want[0][0]


def test_many_values_that_share_frequent_words(spark):
    """10 000 values share two words that every artefact holds: what meets is each value's own rare word with its postings."""
    values = spark.range(10_000).selectExpr("concat('Kumar Singh u', id) as value").unionAll(
        spark.createDataFrame([("Singh Kumar",), ("kumar absent",), ("Kumar north",), ("u1 u2",)], "value string"))
    artefacts = spark.range(4_000).selectExpr("id as artefact_id", "concat('PID|', 'kumar^singh|u', id * 3, if(id = 7, '|north', ''), repeat(concat('|x', id), 20)) as text")
    got = {r.value: r.leaked for r in leaks.find_leaks(values, artefacts).collect()}
    assert {v for v, hit in got.items() if hit} == {f"Kumar Singh u{i}" for i in range(0, 10_000, 3)} | {"Singh Kumar", "Kumar north"} and len(got) == 10_004
    hot = {r.value for r in leaks.find_leaks(values.where("value like 'Singh%' or value like 'Kumar n%'"), artefacts, hot=100).where("leaked").collect()}
    assert hot == {"Singh Kumar", "Kumar north"}


def test_stored_steps_hold_nothing_in_the_clear(spark, tmp_path):
    from pullwise import session
    rows = session.sealed(spark.createDataFrame([("Asha Rao", 1), (None, 2)], "value string, n int"), "sealed-test", "value")
    assert {tuple(r) for r in rows.collect()} == {("Asha Rao", 1), (None, 2)}
    stored = spark.read.parquet(rows.inputFiles()[0].rsplit("/", 1)[0]).collect()
    assert all(b"Asha" not in bytes(r.value) for r in stored if r.value is not None)
