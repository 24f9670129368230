"""Edges that ordinary exports hold: quoting, missing words, zones, blanks, marks left open, chains gone as a whole."""

import json

import pytest
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import dates
from pullwise.operators import audit, extract, privacy
from pullwise.plans import benchmark
from pullwise.sinks.exports import write_layers
from pullwise.sources import pages
from pullwise.sources.exports import ExportDirectory


def test_quoted_cells_and_missing_words(spark, tmp_path):
    (tmp_path / "reg.csv").write_text('mrn,full_name,phone\nM1,"Asha ""Annie"", Rao",12345678\nM2,"line one\nline two",NA\nM3,N/A,"nan"\n')
    rows = {r.mrn: (r.full_name, r.phone) for r in ExportDirectory(spark, str(tmp_path)).layer(dims.PA).collect()}
    assert rows == {"M1": ('Asha "Annie", Rao', "12345678"), "M2": ("line one\nline two", None), "M3": (None, None)}


def test_written_layers_read_back(spark, tmp_path):
    df = spark.createDataFrame([("M1", 'a "b", c\nd'), ("M2", "plain")], "mrn string, full_name string")
    assert write_layers({dims.PA: df}, str(tmp_path)).first().rows == 2
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/{dims.PA}")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_record_lists_are_read_together(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"adm{i}.json").write_text(json.dumps([{"mrn": f"{i}{j}", "admission_ward": "W" * 50_000} for j in range(4)]))
    (tmp_path / "fin.json").write_text(json.dumps([{"mrn": "1", "invoice_id": "I", "billed_amount": 2.5}]))
    source = ExportDirectory(spark, str(tmp_path))
    assert len(source.accepted) == 4 and source.layer(dims.PA).count() == 12 and len(source._groups(dims.PA)) == 1


@pytest.mark.parametrize("written, iso", [
    ("2010-01-23T17:45:28Z", "2010-01-23T17:45:28"), ("2010-01-23 17:45:28+05:30", "2010-01-23T17:45:28"), ("2010-01-23T17:45:28.123-0300", "2010-01-23T17:45:28"),
    ("20100123", "2010-01-23T00:00:00"), ("20100123T174528", "2010-01-23T17:45:28"), ("14 March 1988", "1988-03-14T00:00:00"), ("14-Mar-1988", "1988-03-14T00:00:00"),
    ("March 14, 1988", "1988-03-14T00:00:00"), ("14/03/1988", "1988-03-14T00:00:00"), ("not a date", "not a date")])
def test_date_forms(spark, written, iso):
    assert spark.range(1).select(dates.normalise_date(F.lit(written), True)).first()[0] == iso


def test_blank_quasi_identifiers_are_not_carried(spark):
    df = spark.createDataFrame([(1, "1988", "F", "560"), (1, "1988", "F", "560"), (1, "", " "[:0], ""), (2, None, "", None)],
                               "run int, date_of_birth string, sex string, pincode string")
    got = {r.run: (r.k, r.groups) for r in privacy.k_anonymity(df, "run").collect()}
    assert got == {1: (2, 1), 2: (None, 0)}


def test_requests_without_rows_still_count(spark):
    layers = {dims.PA: spark.createDataFrame([("M1", "Asha", 0)], "mrn string, full_name string, row_ix long").where("mrn is null")}
    costs = benchmark.technique_costs(spark, layers).collect()
    assert len(costs) == len(benchmark.TECHNIQUES) * len(dims.TASKS)
    for r in costs:
        asked = len(dims.LAYERS) if r.technique == dims.BASELINE_TECHNIQUE else len(dims.TASKS[r.task_id][4])
        assert (r.fetches, r.records, r.fields_pulled) == (asked, 0, 0)


def test_chains_removed_as_a_whole_are_missed(spark):
    lines = audit.build_chains(spark.range(1000).select(F.col("id").alias("seq")), F.to_json(F.struct("seq")), length=10)
    anchors = audit.anchor_chains(lines, fan=8)
    assert anchors.where("level = 3").count() == 1 and anchors.agg(F.max("level")).first()[0] == 3
    status = {r.chain: r.status for r in audit.verify_anchors(lines.where("chain <> 7 and seq <> 59"), anchors).collect()}
    assert {k for k, v in status.items() if v != "intact"} == {7, 5} and status[7] == "missing" and status[5] == "changed"


def test_tables_and_links_as_written_by_hand():
    page = ("<table><tr><th>Name<th>Sex<tr><td>M1<td>F<tr><td>M2<td><a href='/p?a=1&amp;b=2'>open</table>"
            "<a href=../x>up</a> <a HREF=\"y\">y<a href='#z'>z")
    p = pages.parse_page("https://h/a/b/c", page)
    assert p["rows"] == [[], ["M1", "F"], ["M2", "open"]]
    links = [(x["text"], x["href"]) for x in p["links"]]
    assert links == [("open", "https://h/p?a=1&b=2"), ("up", "https://h/a/x"), ("y", "https://h/a/b/y"), ("z", "https://h/a/b/c#z")]
    assert pages.links_of("https://h/a/b/c", page) == links
    outside = pages.parse_page("https://h/", "<table><thead><tr><th>A</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table><main><a href=q>q</a></main><a href=r>r</a>")
    assert outside["headers"] == ["A"] and outside["rows"] == [["1"]] and [x["text"] for x in outside["links"]] == ["q"]


def test_marks_left_open_are_read_once():
    import time
    start = time.perf_counter()
    pages.parse_page("https://h/", "<!-- " * 20_000 + "<script " * 20_000)
    assert time.perf_counter() - start < 5
