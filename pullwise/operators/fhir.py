"""FHIR R4 resources of a row: an element only if its field was extracted, mandatory elements say so when not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions.crypto import uuid5_url
from pullwise.functions.masks import choose
from pullwise.operators.ordinals import numbered

# fixed values: code systems and display texts of the exported resources
MRN_SYSTEM = "urn:his:mrn"
ACT_CODE = "http://terminology.hl7.org/CodeSystem/v3-ActCode"
NULL_FLAVOR = "http://terminology.hl7.org/CodeSystem/v3-NullFlavor"
DCM = "http://dicom.nema.org/resources/ontology/DCM"
NOT_IN_EXTRACT = "not in extract"
GENDER = {"F": "female", "M": "male", "O": "other"}
ACTION = {"read": "R", "create": "C", "update": "U", "export": "E"}


def obj(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def text(v: str) -> Column:
    return F.lit(v)


class Row:
    """The columns of a layer row, absent ones as null and blanks as absent."""

    def __init__(self, df: DataFrame) -> None:
        self.types = dict(df.dtypes)

    def __getitem__(self, name: str) -> Column:
        if name not in self.types:
            return F.lit(None).cast("string")
        c = F.col(name)
        return c if self.types[name] == "double" else F.nullif(c, F.lit(""))

    def any(self, *names: str) -> Column:
        return F.coalesce(*[self[n].cast("string") for n in names]).isNotNull()


def if_set(value: Column, made: Column) -> Column:
    return F.when(value.isNotNull(), made)


def reference(row: Row, key: str = "mrn") -> Column:
    v = row[key]
    return obj(identifier=if_set(v, obj(system=text(MRN_SYSTEM), value=v)), display=F.when(v.isNull(), NOT_IN_EXTRACT))


def patient(r: Row) -> Column:
    telecom = F.array_compact(F.array(if_set(r["phone"], obj(system=text("phone"), value=r["phone"])),
                                      if_set(r["email"], obj(system=text("email"), value=r["email"]))))
    return obj(
        resourceType=text("Patient"),
        identifier=if_set(r["mrn"], F.array(obj(system=text(MRN_SYSTEM), value=r["mrn"]))),
        name=if_set(r["full_name"], F.array(obj(text=r["full_name"]))), birthDate=r["date_of_birth"],
        gender=if_set(r["sex"], choose(F.upper(r["sex"]), GENDER, "unknown")),
        telecom=F.when(F.size(telecom) > 0, telecom),
        address=F.when(r.any("street_address", "pincode"), F.array(obj(
            line=if_set(r["street_address"], F.array(r["street_address"])), postalCode=r["pincode"]))))


def encounter(r: Row) -> Column:
    ward, start = r["admission_ward"], F.coalesce(r["admission_datetime"], r["encounter_datetime"])
    kind = F.when(ward.isNotNull(), obj(system=text(ACT_CODE), code=text("IMP"), display=text("inpatient encounter"))).otherwise(
        obj(system=text(NULL_FLAVOR), code=text("UNK"), display=text("unknown")))
    return obj(resourceType=text("Encounter"), status=text("in-progress"), subject=reference(r),
               period=if_set(start, obj(start=start)), **{"class": kind},
               location=if_set(ward, F.array(obj(location=obj(display=ward)))),
               participant=if_set(r["attending_clinician"], F.array(obj(individual=obj(display=r["attending_clinician"])))))


def _coded(kind: str, r: Row, field: str, **more: Column) -> Column:
    return obj(resourceType=text(kind), **more, subject=reference(r), code=obj(text=r[field]))


def _observation(r: Row, what: str, field: str) -> Column:
    return obj(resourceType=text("Observation"), status=text("final"), subject=reference(r), code=obj(text=text(what)),
               valueQuantity=obj(value=r[field]))


def resources(layer: str, df: DataFrame) -> list[tuple[str, Column, Column]]:
    """(type, condition, resource) of every resource a row of the layer may yield, in order."""
    r = Row(df)
    if layer == dims.PA:
        return [("Patient", r.any("mrn", "full_name", "date_of_birth", "sex", "phone", "email", "street_address", "pincode"),
                 patient(r)),
                ("Encounter", r.any("admission_ward", "admission_datetime"), encounter(r))]
    if layer == dims.EHR:
        return [("Encounter", r.any("encounter_datetime", "attending_clinician"), encounter(r)),
                ("Condition", r.any("primary_diagnosis"), _coded("Condition", r, "primary_diagnosis")),
                ("MedicationRequest", r.any("medication"), obj(
                    resourceType=text("MedicationRequest"), status=text("active"), intent=text("order"),
                    subject=reference(r), medicationCodeableConcept=obj(text=r["medication"]))),
                ("AllergyIntolerance", r.any("allergy"), obj(
                    resourceType=text("AllergyIntolerance"), patient=reference(r), code=obj(text=r["allergy"]))),
                ("Observation", r.any("lab_result"), _observation(r, "laboratory result", "lab_result"))]
    if layer == dims.ANC:
        return [("ServiceRequest", r.any("order_id", "specimen_type", "imaging_modality"), obj(
                    resourceType=text("ServiceRequest"), status=text("active"), intent=text("order"), subject=reference(r),
                    identifier=if_set(r["order_id"], F.array(obj(value=r["order_id"]))),
                    code=if_set(r["imaging_modality"], obj(text=r["imaging_modality"])),
                    specimen=if_set(r["specimen_type"], F.array(obj(display=r["specimen_type"]))))),
                ("Observation", r.any("result_value"), _observation(r, "result", "result_value")),
                ("DiagnosticReport", r.any("report_text"), obj(
                    resourceType=text("DiagnosticReport"), status=text("final"), subject=reference(r),
                    conclusion=r["report_text"],
                    code=obj(text=F.coalesce(r["imaging_modality"], text("diagnostic report")))))]
    if layer == dims.FIN:
        return [("Invoice", r.any("invoice_id", "billed_amount"), obj(
                    resourceType=text("Invoice"), status=text("issued"), subject=reference(r),
                    identifier=if_set(r["invoice_id"], F.array(obj(value=r["invoice_id"]))),
                    totalGross=if_set(r["billed_amount"], obj(value=r["billed_amount"], currency=text("INR"))))),
                ("Coverage", r.any("insurance_policy_no", "payer_name"), obj(
                    resourceType=text("Coverage"), status=text("active"), beneficiary=reference(r),
                    payor=F.array(obj(display=F.coalesce(r["payer_name"], text(NOT_IN_EXTRACT)))),
                    subscriberId=r["insurance_policy_no"]))]
    acted = r["action"]
    return [("AuditEvent", r.any("audit_event_id", "event_timestamp", "actor_role", "action", "source_system", "subject_mrn"), obj(
        resourceType=text("AuditEvent"),
        type=obj(system=text(DCM), code=text("110110"), display=text("Patient Record")),
        source=obj(observer=obj(display=F.coalesce(r["source_system"], text(NOT_IN_EXTRACT)))),
        agent=F.array(obj(requestor=F.lit(True), role=if_set(r["actor_role"], F.array(obj(text=r["actor_role"]))),
                          name=r["source_system"])),
        id=r["audit_event_id"], action=if_set(acted, choose(F.lower(acted), ACTION, acted)),
        recorded=r["event_timestamp"],
        entity=if_set(r["subject_mrn"], F.array(obj(what=obj(identifier=obj(system=text(MRN_SYSTEM), value=r["subject_mrn"])))))))]


def count_resources(layer: str, df: DataFrame) -> Column:
    """How many resources a row yields."""
    return sum((cond.cast("int") for _, cond, _ in resources(layer, df)), F.lit(0))


def shape(layer: str, df: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per resource: (keep..., position in the row from zero, resource_type, own_id, resource as JSON)."""
    own = Row(df)["audit_event_id"] if layer == dims.INF else F.lit(None).cast("string")
    cells = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(kind).alias("resource_type"), own.alias("own_id"), F.to_json(made).alias("resource")))
        for kind, cond, made in resources(layer, df)]))
    return df.select(*keep, F.posexplode(cells).alias("position", "_r")).select("*", "_r.*").drop("_r")


def bundle(layer: str, rows: DataFrame, *keep: str) -> DataFrame:
    """Bundle entries of exported rows: rows carry run_id and ``resources_before``, the resources of the run's
    rows before. Ids are stable: UUIDv5 of run/n, n the resource's place in the run. A resource's own id stays."""
    shaped = shape(layer, rows, "run_id", "resources_before", *keep).withColumn("n", F.col("resources_before") + F.col("position"))
    rid = uuid5_url(F.concat(F.col("run_id"), F.lit("/"), F.col("n").cast("string")))
    with_id = F.when(F.col("own_id").isNotNull(), F.col("resource")).otherwise(F.concat(
        F.substring(F.col("resource"), F.lit(1), F.length("resource") - 1), F.lit(',"id":"'), F.col("rid"), F.lit('"}')))
    return shaped.withColumn("rid", rid).select(
        "run_id", *keep, "n", "resource_type", F.concat(F.lit("urn:uuid:"), F.col("rid")).alias("full_url"), with_id.alias("resource"))


def numbered_rows(layer: str, df: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows numbered within their run (``n``, from one), with the resources of the rows before: one pass."""
    return numbered(df, ["run_id"], "row_ix", out="n", ties=ties, totals={"resources_before": count_resources(layer, df)})
