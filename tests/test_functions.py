"""Expressions against plain Python."""

import hashlib
import hmac
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import crypto, dates, masks, numeric, text


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def run(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_token_is_the_keyed_hash(spark):
    values = ["MRN0000001", "Åsa Ünlü", "x" * 200]
    for key in ("k", "a-much-longer-key-" * 8):
        want = ["PSN-" + hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest()[:12] for v in values]
        assert run(col(spark, values), crypto.token(F.col("v"), key)) == want


def test_uuid5(spark):
    names = [f"run-{i}/{i}" for i in range(40)]
    assert run(col(spark, names), crypto.uuid5_url(F.col("v"))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_is_token(spark):
    assert run(col(spark, ["PSN-1", "MRN1", None]), crypto.is_token(F.col("v"))) == [True, False, False]


@pytest.mark.parametrize("value,want", [("MRN2867825", "MRN*****25"), ("1234", "****"), ("12345", "***45"), ("AB12345", "*****45")])
def test_mask(spark, value, want):
    assert run(col(spark, [value]), text.mask_value(F.col("v"))) == [want]


def test_stem_and_near(spark):
    words = ["registering", "registered", "registers", "allergies", "pass", "bed", "sing", "ed"]
    assert run(col(spark, words), text.stem(F.col("v"))) == ["register", "register", "register", "allergy", "pass", "bed", "sing", "ed"]
    pairs = [("invoice", "invoise", True), ("invoice", "invoces", False), ("bed", "bad", False), ("bed", "bed", True),
             ("charge", "charges", True), ("charge", "hcarge", False), ("ward", "wards", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert run(df, text.near(F.col("a"), F.col("b"))) == [p[2] for p in pairs]


def test_content_tokens(spark):
    assert run(col(spark, ["Please raise the bill for the patient"]), text.content_tokens(F.col("v"))) == [["raise", "bill"]]


def test_digit_fields_never_join_fields(spark):
    msg = 'PID|1||MRN12^x|+91 98765-43210|"a": 12, "b": 34'
    assert run(col(spark, [msg]), text.digit_fields(F.col("v"))) == [["1", "12", "919876543210", "12", "34"]]


def test_short_digit_fields_are_dropped(spark):
    msg = 'PID|1||MRN12^x|+91 98765-43210|"a": 12345, "b": no digits at all'
    assert run(col(spark, [msg]), text.digit_fields(F.col("v"), 5)) == [["919876543210", "12345"]]


def test_dates(spark):
    values = ["14/03/1988", "1988-03-14", "1988-03-14T10:20:30", "not a date", None]
    assert run(col(spark, values), dates.normalise_date(F.col("v"), False)) == ["1988-03-14", "1988-03-14", "1988-03-14", "not a date", None]
    assert run(col(spark, values), dates.unparsed_date(F.col("v"))) == [False, False, False, True, False]
    assert run(col(spark, ["14/03/1988"]), dates.normalise_date(F.col("v"), True)) == ["1988-03-14T00:00:00"]
    assert run(col(spark, ["1988-03-14T10:20:30", ""]), dates.hl7_date(F.col("v"))) == ["19880314102030", None]


def test_age(spark):
    values = ["2008-01-01", "2008-01-02", "2008", "1950-06-30", "x", None, ""]
    assert run(col(spark, values), dates.age_on(F.col("v"), date(2026, 1, 1))) == [18, 17, 18, 75, None, None, None]


def test_due_and_overdue_differ_at_the_moment_itself(spark):
    df = spark.sql("select 0 as i, timestamp'2026-01-31 00:00:00' as v")
    now = F.lit("2026-01-31 00:00:00").cast("timestamp")
    assert run(df, dates.due(F.col("v"), now)) == [True] and run(df, dates.overdue(F.col("v"), now)) == [False]
    none = spark.sql("select 0 as i, cast(null as timestamp) as v")
    assert run(none, dates.due(F.col("v"), now)) == [False]


def test_numbers(spark):
    assert run(col(spark, ["1,250.50", "pending", None]), numeric.parse_number(F.col("v"))) == [1250.5, None, None]
    assert run(col(spark, ["1,250.50", "pending", None]), numeric.unparsed_number(F.col("v"))) == [False, True, False]
    assert run(col(spark, [173665.47, 10000000.0, 12345678.9], "double"), text.number_text(F.col("v"))) == ["173665.47", "10000000.0", "12345678.9"]


def test_wilson(spark):
    df = spark.createDataFrame([(0, 10, 20), (1, 20, 20), (2, 0, 0)], "i int, k int, n int")
    lo, hi = numeric.wilson(F.col("k"), F.col("n"))
    assert run(df, numeric.interval_text(lo, hi)) == ["0.30–0.70", "0.84–1.00", "0.00–1.00"]
    with pytest.raises(Exception, match="not between"):
        spark.createDataFrame([(3, 2)], "k int, n int").select(numeric.wilson(F.col("k"), F.col("n"))[0]).collect()


def test_slots(spark):
    mrn, find = r"[A-Za-z]{0,6}[- ]?\d{4,12}", r"\b[A-Z]{2,6}\d{5,12}\b"
    assert run(col(spark, ["MRN2867825", "hello"]), text.fits(F.col("v"), mrn)) == [True, False]
    assert run(col(spark, ["see mrn2867825 please", "none"]), text.found_in(F.col("v"), find)) == ["mrn2867825", None]
    assert run(col(spark, ["x"]), text.fits(F.col("v"), None)) == [True]


def test_small_text_functions(spark):
    assert run(col(spark, ["Gemini 3.1 Flash_Lite!"]), text.model_slug(F.col("v"))) == ["gemini-3.1-flash-lite"]
    assert run(col(spark, ["compliance-aware (ours)", "a, b"]), text.short_technique(F.col("v"))) == ["compliance-aware", "a"]
    assert run(col(spark, [["None", " research ", "n/a"]], "array<string>"), text.real_uses(F.col("v"))) == [["research"]]
    assert run(col(spark, ["care_coordination", "care"]), text.recognised_purpose(F.col("v"))) == ["care_coordination", None]
    assert run(col(spark, ["payer_name", "lab_result"]), text.humanise(F.col("v"))) == ["payer", "lab result"]
    assert run(col(spark, ["DPO on call", "endpoint", None, "the dpo."]), text.cites(F.col("v"), "DPO")) == [True, False, False, True]
    assert run(col(spark, ["  Patient \n Number "]), text.header_key(F.col("v"))) == ["patient number"]
    assert run(col(spark, [dims.CL, "x_y"]), text.plain_category(F.col("v"))) == ["clinical information", "x y"]


def test_buttons(spark):
    df = spark.createDataFrame([("Check-in",), ("Discharge",), ("Zap",)], "label string")
    got = {r["label"]: r["action"] for r in text.match_controls(df, "label").collect()}
    assert got == {"Check-in": "mark_arrived", "Discharge": "discharge", "Zap": None}
    alias = spark.createDataFrame([("zap", "transfer")], "shown string, action string")
    assert {r["label"]: r["action"] for r in text.match_controls(df, "label", aliases=alias).collect()}["Zap"] == "transfer"


def test_masks(spark):
    df = spark.createDataFrame([(0, dims.PA, "mrn"), (1, dims.EHR, "allergy"), (2, dims.PA, "nope")], "i int, l string, f string")
    assert run(df, masks.field_bit(F.col("l"), F.col("f"))) == [dims.FIELD_BIT[dims.PA, "mrn"], dims.FIELD_BIT[dims.EHR, "allergy"], 0]
    assert run(df, masks.category_names(masks.categories_of_fields(masks.field_bit(F.col("l"), F.col("f"))))) == [[dims.DI], [dims.CL], []]
    assert run(df, masks.field_category(F.col("l"), F.col("f"))) == [dims.DI, dims.CL, "uncatalogued"]
