"""HL7 v2 messages, one per row of four layers, as column expressions.

A segment is a positional list; fields not extracted stay empty, trailing empties go, and a segment with
nothing beyond field 1 is left out unless the message requires it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions.dates import hl7_date
from pullwise.functions.text import number_text

# fixed values: header fields, message types and their structures
SENDER, FACILITY, VERSION = "EXTRACTION", "HIS", "2.5"
STRUCTURE = {"ADT^A04": "ADT_A01", "ORM^O01": "ORM_O01", "ORU^R01": "ORU_R01", "DFT^P03": "DFT_P03"}
MESSAGE_OF = {dims.PA: "ADT^A04", dims.EHR: "ORM^O01", dims.ANC: "ORU^R01", dims.FIN: "DFT^P03"}
_GAP = "\u0001"


def segment(name: str, fields: dict[int, Column], required: bool = False) -> Column:
    cells = [F.coalesce(fields[i], F.lit("")) if i in fields else F.lit("") for i in range(1, max(fields) + 1)]
    body = F.translate(F.rtrim(F.concat_ws(_GAP, *cells), F.lit(_GAP)), _GAP, "|")
    whole = F.when(body == "", F.lit(name)).otherwise(F.concat(F.lit(name + "|"), body))
    beyond = [v.isNotNull() for i, v in fields.items() if i > 1]
    if required:
        return whole
    has_data = beyond[0] if beyond else F.lit(False)
    for b in beyond[1:]:
        has_data = has_data | b
    return F.when(has_data, whole)


def _value(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    c = F.col(name)
    return number_text(c) if dict(df.dtypes)[name] == "double" else F.nullif(c, F.lit(""))


def patient_segment(df: DataFrame) -> Column:
    v = lambda n: _value(df, n)
    blank = lambda n: F.coalesce(v(n), F.lit(""))
    parts = F.split(F.trim(v("full_name")), r"\s+")
    name = F.when(F.size(parts) > 1, F.concat(
        F.element_at(parts, -1), F.lit("^"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " "))
    ).otherwise(F.element_at(parts, 1))
    either = lambda a, b, sep: F.when(v(a).isNotNull() | v(b).isNotNull(),
                                      F.concat(blank(a), F.lit(sep), blank(b)))
    return segment("PID", {
        1: F.lit("1"), 3: F.concat(v("mrn"), F.lit("^^^HIS^MR")), 5: F.when(v("full_name").isNotNull(), name),
        7: hl7_date(v("date_of_birth")), 8: v("sex"), 11: either("street_address", "pincode", "^^^^"),
        13: either("phone", "email", "^^^")}, required=True)


def header(message_type: str, control_id: Column, when: str) -> Column:
    kind = f"{message_type}^{STRUCTURE[message_type]}"
    return F.concat(F.lit(f"MSH|^~\\&|{SENDER}|{FACILITY}|||{when}||{kind}|"), control_id, F.lit(f"|P|{VERSION}"))


def _segments(layer: str, df: DataFrame) -> list[Column]:
    v = lambda n: _value(df, n)
    one, pid = F.lit("1"), patient_segment(df)
    if layer == dims.PA:
        admitted = hl7_date(v("admission_datetime"))
        return [segment("EVN", {1: F.lit("A04"), 2: admitted}), pid,
                segment("PV1", {1: one, 2: F.when(v("admission_ward").isNotNull(), "I"), 3: v("admission_ward"), 44: admitted})]
    if layer == dims.EHR:
        return [pid, segment("PV1", {1: one, 7: v("attending_clinician"), 44: hl7_date(v("encounter_datetime"))}),
                segment("AL1", {1: one, 3: v("allergy")}), segment("DG1", {1: one, 3: v("primary_diagnosis")}),
                # ORC and RXO carry only field 1 and so never hold data of their own
                F.when(v("lab_result").isNotNull(),
                       segment("OBX", {1: one, 2: F.lit("NM"), 3: F.lit("LAB"), 5: v("lab_result")}))]
    if layer == dims.ANC:
        return [pid, segment("OBR", {1: one, 2: v("order_id"), 4: v("imaging_modality"), 15: v("specimen_type")}),
                F.when(v("result_value").isNotNull(),
                       segment("OBX", {1: one, 2: F.lit("NM"), 3: F.lit("RESULT"), 5: v("result_value")})),
                segment("NTE", {1: one, 3: v("report_text")})]
    return [pid, segment("FT1", {1: one, 2: v("invoice_id"), 6: F.lit("CG"), 11: v("billed_amount")}),
            segment("IN1", {1: one, 4: v("payer_name"), 36: v("insurance_policy_no")})]


def message(layer: str, df: DataFrame, control_id: Column, when: str) -> Column:
    """The message of one row. Absent segments are dropped by ``concat_ws``."""
    return F.concat_ws("\r", header(MESSAGE_OF[layer], control_id, when), *_segments(layer, df))


def control_id(layer: str) -> Column:
    return F.concat(F.col("run_id"), F.lit(f"-{layer}-"), F.col("n").cast("string"))


