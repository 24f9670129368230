"""Reference tables: the field catalogue, purpose policy, control register, artefacts, roles and tasks.

Everything here is small, bounded configuration (at most a few dozen rows per table). It is used in
three forms: Python values for building expressions, ``values`` lists for SQL, and bitmasks.

Sets of categories and sets of fields are carried through the engine as **integer bitmasks**
(6 category bits, 34 field bits). A mask aggregates with ``bit_or`` inside a plain hash aggregate,
shuffles as one number, and makes every set operation (`allowed`, `excess`, `matched`) an
integer expression inside whole-stage code generation; arrays of names are produced only at the end.
"""

from __future__ import annotations

# --- fixed values: categories ------------------------------------------------------------------
DI = "direct_identifier"
QI = "quasi_identifier"
CL = "clinical"
FI = "financial"
AD = "administrative"
CO = "contact"
CATEGORIES = (DI, QI, CL, FI, AD, CO)

# --- fixed values: layers and the field catalogue ------------------------------------------------
PA = "patient_administration"
EHR = "clinical_ehr"
ANC = "ancillary_departmental"
FIN = "administrative_financial"
INF = "infrastructure_integration"
LAYERS = (PA, EHR, ANC, FIN, INF)

FIELD_CATALOGUE = {
    PA: {
        "mrn": DI, "full_name": DI, "phone": DI, "email": CO, "street_address": CO,
        "date_of_birth": QI, "sex": QI, "pincode": QI,
        "admission_ward": AD, "admission_datetime": AD,
    },
    EHR: {
        "mrn": DI, "primary_diagnosis": CL, "medication": CL, "lab_result": CL, "allergy": CL,
        "encounter_datetime": AD, "attending_clinician": AD,
    },
    ANC: {
        "mrn": DI, "order_id": AD, "specimen_type": CL, "result_value": CL,
        "imaging_modality": CL, "report_text": CL,
    },
    FIN: {
        "mrn": DI, "invoice_id": FI, "billed_amount": FI, "insurance_policy_no": FI, "payer_name": FI,
    },
    INF: {
        "audit_event_id": AD, "event_timestamp": AD, "actor_role": AD, "action": AD,
        "source_system": AD, "subject_mrn": DI,
    },
}
SUBJECT_KEY = {PA: "mrn", EHR: "mrn", ANC: "mrn", FIN: "mrn", INF: "subject_mrn"}
NUMERIC_FIELDS = ("lab_result", "result_value", "billed_amount")
PARSED_NUMBER_FIELDS = ("billed_amount",)
DATE_FIELDS = ("date_of_birth",)
DATETIME_FIELDS = ("admission_datetime", "encounter_datetime", "event_timestamp")
QUASI_IDENTIFIERS = ("date_of_birth", "sex", "pincode")

# --- fixed values: purposes ------------------------------------------------------------------------
CARE = "care_coordination"
BILL = "billing_settlement"
REG = "patient_registration"
PURPOSES = (CARE, BILL, REG)
PURPOSE_POLICY = {
    CARE: {"allowed": (DI, QI, CL, AD), "max_retention_days": 90, "pseudonymise": True},
    BILL: {"allowed": (DI, CO, FI, AD), "max_retention_days": 365, "pseudonymise": False},
    REG: {"allowed": (DI, QI, CO, AD), "max_retention_days": 180, "pseudonymise": False},
}

# --- fixed values: rules -----------------------------------------------------------------------------
RULES = ("DM-01", "LB-01", "SL-01", "SS-01", "PL-01", "NT-01", "AC-01")
RULE_WEIGHTS = dict.fromkeys(RULES, 1.0)
BEHAVIOUR_RULES = ("DM-01", "PL-01")
PAPERWORK_RULES = ("LB-01", "NT-01", "SS-01", "AC-01")
TECHNIQUE_RETENTION_DAYS = 30
LOG_RETENTION_DAYS = 365
REPORT_WINDOW_HOURS = 72
MIN_FILE_CONFIDENCE = 0.5
ADULT_AGE = 18
Z_95 = 1.959964

# --- fixed values: capability register: slot -> (control id, demonstrated by evidence) -------------
REGISTER = {
    "transport_encrypted": ("TLS", True),
    "at_rest_encrypted": ("ENC-REST", False),
    "access_controlled": ("ACL-STORE", False),
    "pseudonymisation": ("PSEUDO-EXPORT", True),
    "deletion_mechanism": ("PURGE-01", True),
    "notice": ("NOTICE-REG-2026", False),
    "accountable_party": ("DPO", False),
    "audit_log": ("AUDIT-LOG", True),
    "processing_record": ("ROPA", True),
}
NOTICE_MACHINE_READABLE = True
ACCESS_AUTHORISATION = ("AUTH-RPA-2026", True)      # on the register, but not a claim a run may make
LAWFUL_BASES = {CARE: ("LU-CARE", False), BILL: ("LU-BILL", False), REG: ("LU-REG", False)}

# --- fixed values: interoperability standards per layer ----------------------------------------------
LAYER_STANDARDS = {
    PA: ("hl7_v2", "fhir"),
    EHR: ("hl7_v2", "fhir"),
    ANC: ("hl7_v2", "fhir", "dicom", "iso_ieee_11073"),
    FIN: ("hl7_v2", "fhir"),
    INF: ("fhir",),
}

# --- fixed values: artefact -> (layer, categories) -----------------------------------------------------
ARTEFACTS = {
    "hl7:ADT": (PA, (DI, QI, CO, AD)),
    "hl7:SIU": (PA, (DI, AD)),
    "hl7:ORM": (EHR, (DI, CL, AD)),
    "hl7:ORU": (ANC, (DI, CL)),
    "hl7:DFT": (FIN, (DI, FI)),
    "hl7:BAR": (FIN, (DI, FI, CO)),
    "fhir:Patient": (PA, (DI, QI, CO)),
    "fhir:Appointment": (PA, (DI, AD)),
    "fhir:Schedule": (PA, (AD,)),
    "fhir:Consent": (PA, (DI, AD)),
    "fhir:Task": (PA, (DI, AD)),
    "fhir:Location": (PA, (AD,)),
    "fhir:Encounter": (EHR, (DI, AD)),
    "fhir:Condition": (EHR, (DI, CL)),
    "fhir:MedicationRequest": (EHR, (DI, CL)),
    "fhir:AllergyIntolerance": (EHR, (DI, CL)),
    "fhir:ServiceRequest": (ANC, (DI, CL, AD)),
    "fhir:Observation": (ANC, (DI, CL)),
    "fhir:DiagnosticReport": (ANC, (DI, CL)),
    "fhir:Coverage": (FIN, (DI, FI)),
    "fhir:Account": (FIN, (DI, FI)),
    "fhir:Invoice": (FIN, (DI, FI, CO)),
    "fhir:ClaimResponse": (FIN, (DI, FI)),
    "fhir:Claim": (FIN, (DI, FI, CL)),
    "fhir:AuditEvent": (INF, (DI, AD)),
    "dicom:Study": (ANC, (DI, CL)),
    "ieee11073:PoCD": (ANC, (CL,)),
}

# --- fixed values: role -> purposes and artefacts --------------------------------------------------------
ROLES = {
    "reception": {
        "purposes": (REG, BILL),
        "artefacts": ("hl7:ADT", "hl7:SIU", "fhir:Patient", "fhir:Appointment", "fhir:Schedule",
                      "fhir:Coverage", "fhir:Consent", "fhir:Task"),
    },
    "nurse": {
        "purposes": (CARE,),
        "artefacts": ("hl7:ORM", "hl7:ORU", "fhir:Patient", "fhir:Encounter", "fhir:Condition",
                      "fhir:MedicationRequest", "fhir:AllergyIntolerance", "fhir:ServiceRequest",
                      "fhir:Observation", "fhir:DiagnosticReport", "ieee11073:PoCD"),
    },
    "administrator": {
        "purposes": (BILL, REG),
        "artefacts": ("hl7:ADT", "hl7:DFT", "hl7:BAR", "fhir:Patient", "fhir:Encounter", "fhir:Location",
                      "fhir:Coverage", "fhir:Account", "fhir:Invoice", "fhir:ClaimResponse",
                      "fhir:Consent", "fhir:Task"),
    },
}

# --- fixed values: tasks: purpose, single subject?, trap?, trap on scope?, needed fields ------------------
TASKS = {
    "patient-summary": (CARE, True, False, False, {PA: ("mrn", "date_of_birth", "sex"),
                        EHR: ("mrn", "primary_diagnosis", "medication", "allergy")}),
    "ward-census": (CARE, False, False, False, {PA: ("mrn", "admission_ward", "admission_datetime"),
                    EHR: ("mrn", "encounter_datetime")}),
    "medication-review": (CARE, True, False, False, {PA: ("mrn", "date_of_birth"),
                          EHR: ("mrn", "primary_diagnosis", "medication", "allergy")}),
    "appointment-reminder": (REG, False, False, False, {PA: ("mrn", "full_name", "phone", "admission_datetime")}),
    "claim-reconciliation": (BILL, True, True, False, {PA: ("mrn", "full_name"),
                             FIN: ("mrn", "invoice_id", "billed_amount", "payer_name")}),
    "desk-registration": (REG, True, True, False, {PA: ("mrn", "full_name", "date_of_birth", "phone")}),
    "ward-summary-registry": (CARE, True, True, False, {PA: ("mrn", "date_of_birth"),
                              EHR: ("mrn", "primary_diagnosis", "medication")}),
    "consultant-file": (CARE, True, True, False, {PA: ("mrn",), EHR: ("mrn", "primary_diagnosis", "allergy")}),
}
INJECTION_TASKS = {
    "injected-billing": (BILL, True, True, False, {PA: ("mrn", "full_name"),
                         FIN: ("mrn", "invoice_id", "billed_amount", "payer_name")}),
    "injected-onward": (CARE, True, True, False, {PA: ("mrn", "date_of_birth"),
                        EHR: ("mrn", "medication", "allergy")}),
    "injected-scope": (REG, True, True, True, {PA: ("mrn", "full_name", "date_of_birth", "phone")}),
}
MATRIX_TASKS = {
    "care-pull": (CARE, False, False, False, {PA: ("mrn", "date_of_birth", "admission_ward"),
                  EHR: ("mrn", "primary_diagnosis", "medication", "allergy")}),
    "billing-pull": (BILL, False, False, False, {PA: ("mrn", "email", "street_address", "admission_ward"),
                     FIN: ("mrn", "invoice_id", "billed_amount", "payer_name")}),
}
ABLATIONS = ("scope", "field_list", "manifest", "retention", "pseudonymise")
REFERENCE_TECHNIQUE = "compliance-aware"
BASELINE_TECHNIQUE = "unconstrained"
HEADLINE_BRIEFING = "policy"

# --- fixed values: words that mean "nothing" in a free-text list ---------------------------------------------
NULL_WORDS = ("", "none", "n/a", "na", "nil", "null", "-", "--", "no", "not applicable")

# --- fixed values: words that carry no meaning in a request ----------------------------------------------------
STOPWORDS = (
    "a", "an", "the", "i", "me", "my", "we", "our", "you", "to", "for", "of", "on", "in",
    "is", "it", "this", "that", "and", "or", "please", "can", "could", "would", "need",
    "want", "how", "do", "does", "up", "show", "get", "help", "with", "patient", "patients",
    "his", "her", "their", "some", "any", "there", "here", "am", "are", "be",
)

# --- fixed values: words shown for a field or a category -----------------------------------------------------------
FIELD_WORDS = {
    "mrn": "MRN", "insurance_policy_no": "policy number", "date_of_birth": "date of birth",
    "billed_amount": "amount", "payer_name": "payer", "admission_ward": "ward",
}
CATEGORY_WORDS = {
    DI: "details that identify you", QI: "details such as date of birth", CO: "contact details",
    CL: "clinical information", FI: "billing information", AD: "visit and admission details",
}

# --- fixed values: button -> names it is shown under ---------------------------------------------------------------
ACTIONS = {
    "create_patient": ("New patient", "Add registration", "Register patient", "Add patient",
                       "New registration", "Create patient"),
    "edit_details": ("Edit details", "Update demographics", "Update details", "Edit patient",
                     "Modify details", "Edit"),
    "mark_arrived": ("Mark arrived", "Check-in", "Check in", "Arrived", "Mark arrival"),
    "book_appointment": ("Book appointment", "New appointment", "Schedule appointment", "Add appointment", "Book"),
    "reschedule": ("Reschedule", "Change appointment", "Move appointment", "Reschedule appointment"),
    "cancel_appointment": ("Cancel appointment", "Cancel booking", "Cancel visit"),
    "allocate_bed": ("Allocate bed", "Assign bed", "Bed allocation", "Admit"),
    "transfer": ("Transfer", "Transfer ward", "Change ward", "Transfer patient", "Move bed"),
    "discharge": ("Discharge", "Discharge patient", "Release bed"),
    "ward_census": ("Ward census", "Occupancy report", "Census", "Bed occupancy", "Census report"),
    "withdraw_consent": ("Record consent withdrawal", "Withdraw consent", "Revoke consent", "Consent withdrawal"),
    "privacy_request": ("Log privacy request", "Data protection request", "Privacy request", "Data request",
                        "Data principal request", "Rights request"),
    "record_dose": ("Record dose given", "Administer", "Record administration", "Give dose", "Chart dose"),
    "add_allergy": ("Add allergy", "New allergy", "Record allergy"),
    "ready_for_discharge": ("Ready for discharge", "Mark fit for discharge", "Fit for discharge", "Discharge ready"),
    "new_lab_request": ("New lab request", "Order test", "Lab order", "Request test", "New order"),
    "record_observation": ("Record observation", "Add vitals", "Record vitals", "New observation", "Enter vitals"),
    "open_account": ("Open account", "New account", "Create account"),
    "check_eligibility": ("Check eligibility", "Verify coverage", "Eligibility check", "Check coverage"),
    "post_charge": ("Post charge", "Add charge", "Enter charge"),
    "generate_invoice": ("Generate invoice", "Create bill", "Generate bill", "Raise bill", "Final bill"),
    "record_settlement": ("Record settlement", "Mark settled", "Record payment", "Settle"),
}

# --- fixed values: staff function -> (group, purpose, artefacts, categories read when narrower) ----------------------
FUNCTIONS = {
    "register_patient": ("Patients and appointments", REG, ("hl7:ADT", "fhir:Patient", "fhir:Consent"), None),
    "find_patient": ("Patients and appointments", REG, ("fhir:Patient",), (DI, QI)),
    "update_details": ("Patients and appointments", REG, ("hl7:ADT", "fhir:Patient", "fhir:Task"), None),
    "book_appointment": ("Patients and appointments", REG, ("fhir:Appointment", "fhir:Schedule", "hl7:SIU"), None),
    "change_appointment": ("Patients and appointments", REG, ("fhir:Appointment", "fhir:Schedule", "hl7:SIU"), None),
    "check_in_arrival": ("Patients and appointments", REG, ("fhir:Appointment", "hl7:ADT", "fhir:Patient"), None),
    "verify_insurance": ("Insurance", BILL, ("fhir:Coverage",), None),
    "share_diagnosis_with_insurer": ("Insurance", BILL, ("fhir:Condition", "fhir:Coverage"), None),
    "access_request": ("Privacy requests", REG, ("fhir:Patient", "fhir:Task"), None),
    "erasure_request": ("Privacy requests", REG, ("fhir:Patient", "fhir:Task"), None),
    "withdraw_consent": ("Privacy requests", REG, ("fhir:Patient", "fhir:Consent", "fhir:Task"), None),
    "privacy_grievance": ("Privacy requests", REG, ("fhir:Task",), None),
    "correction_request": ("Privacy requests", REG, ("fhir:Patient", "fhir:Task"), None),
    "nominate_representative": ("Privacy requests", REG, ("fhir:Patient", "fhir:Task"), None),
    "confirm_identity": ("Ward care", CARE, ("fhir:Patient",), (DI, QI)),
    "record_vitals": ("Ward care", CARE, ("fhir:Observation", "ieee11073:PoCD"), None),
    "view_medications": ("Ward care", CARE, ("fhir:MedicationRequest", "fhir:AllergyIntolerance"), None),
    "record_medication_given": ("Ward care", CARE, ("fhir:MedicationRequest", "fhir:AllergyIntolerance"), None),
    "view_diagnosis": ("Ward care", CARE, ("fhir:Condition",), None),
    "record_allergy": ("Ward care", CARE, ("fhir:AllergyIntolerance",), None),
    "shift_handover": ("Ward care", CARE, ("fhir:Encounter", "fhir:Condition"), None),
    "discharge_checklist": ("Ward care", CARE, ("fhir:Encounter", "fhir:MedicationRequest"), None),
    "request_lab": ("Orders and results", CARE, ("fhir:ServiceRequest", "hl7:ORM"), None),
    "view_lab_results": ("Orders and results", CARE, ("fhir:DiagnosticReport", "hl7:ORU"), None),
    "allocate_bed": ("Beds and wards", REG, ("fhir:Location", "hl7:ADT", "fhir:Encounter"), None),
    "transfer_patient": ("Beds and wards", REG, ("fhir:Location", "hl7:ADT", "fhir:Encounter"), None),
    "release_bed": ("Beds and wards", REG, ("fhir:Location", "hl7:ADT", "fhir:Encounter"), None),
    "ward_census": ("Beds and wards", REG, ("fhir:Encounter", "fhir:Location", "hl7:ADT"), None),
    "open_billing_account": ("Billing", BILL, ("hl7:BAR", "fhir:Account"), None),
    "post_charges": ("Billing", BILL, ("hl7:DFT", "fhir:Account"), None),
    "generate_invoice": ("Billing", BILL, ("fhir:Account", "fhir:Invoice", "hl7:DFT"), None),
    "reconcile_payment": ("Billing", BILL, ("fhir:ClaimResponse", "fhir:Coverage"), None),
}

# --- fixed values: steps of a function that press a button or read a field: (layer, fields, action) -------------------
FUNCTION_STEPS = {
    "register_patient": ((PA, ("full_name", "date_of_birth", "phone"), "create_patient"),),
    "find_patient": ((PA, ("full_name", "date_of_birth", "mrn"), None),),
    "update_details": ((PA, ("phone", "email", "street_address"), "edit_details"), (PA, ("mrn",), "privacy_request")),
    "book_appointment": ((PA, ("admission_datetime",), "book_appointment"),),
    "change_appointment": ((PA, ("admission_datetime",), "reschedule"), (PA, (), "cancel_appointment")),
    "check_in_arrival": ((PA, ("mrn", "admission_datetime"), "mark_arrived"),),
    "verify_insurance": ((FIN, (), "check_eligibility"), (FIN, ("mrn", "insurance_policy_no", "payer_name"), None)),
    "access_request": ((PA, ("mrn",), "privacy_request"),),
    "erasure_request": ((PA, ("mrn",), "privacy_request"),),
    "correction_request": ((PA, ("mrn",), "privacy_request"),),
    "nominate_representative": ((PA, ("mrn",), "privacy_request"),),
    "privacy_grievance": ((PA, ("mrn",), "privacy_request"),),
    "confirm_identity": ((PA, ("mrn", "full_name", "date_of_birth"), None),),
    "shift_handover": ((EHR, ("primary_diagnosis",), None),),
    "withdraw_consent": ((PA, (), "withdraw_consent"), (PA, ("mrn",), "privacy_request")),
    "record_vitals": ((ANC, ("result_value",), "record_observation"),),
    "view_medications": ((EHR, ("allergy", "medication"), None),),
    "record_medication_given": ((EHR, ("allergy", "medication"), "record_dose"),),
    "view_diagnosis": ((EHR, ("primary_diagnosis",), None),),
    "record_allergy": ((EHR, ("allergy",), "add_allergy"),),
    "discharge_checklist": ((EHR, ("mrn", "encounter_datetime", "medication", "allergy"), "ready_for_discharge"),),
    "request_lab": ((ANC, ("mrn", "specimen_type"), "new_lab_request"),),
    "view_lab_results": ((ANC, ("mrn", "order_id", "result_value", "report_text"), None),),
    "allocate_bed": ((PA, ("admission_ward", "admission_datetime"), "allocate_bed"),),
    "transfer_patient": ((PA, ("admission_ward",), "transfer"),),
    "release_bed": ((PA, ("mrn", "admission_ward"), "discharge"),),
    "ward_census": ((PA, ("admission_ward", "mrn"), "ward_census"),),
    "open_billing_account": ((FIN, ("mrn", "payer_name"), "open_account"),),
    "post_charges": ((FIN, ("mrn", "invoice_id", "billed_amount"), "post_charge"),),
    "generate_invoice": ((FIN, ("mrn", "invoice_id", "billed_amount", "payer_name"), "generate_invoice"),),
    "reconcile_payment": ((FIN, ("invoice_id", "billed_amount", "payer_name", "insurance_policy_no"),
                           "record_settlement"),),
}

# ----------------------------------------------------------------------------------------------------------------------
# Derived: bits and lookups
# ----------------------------------------------------------------------------------------------------------------------
CATEGORY_BIT = {c: 1 << i for i, c in enumerate(CATEGORIES)}
ALL_CATEGORIES_MASK = (1 << len(CATEGORIES)) - 1
FIELD_REFS = [(layer, f) for layer, cat in FIELD_CATALOGUE.items() for f in cat]
FIELD_BIT = {ref: 1 << i for i, ref in enumerate(FIELD_REFS)}
SHARED_FIELDS = tuple(sorted(
    {f for _, f in FIELD_REFS if sum(g == f for _, g in FIELD_REFS) > 1}))
ARTEFACT_BIT = {a: 1 << i for i, a in enumerate(ARTEFACTS)}


def category_mask(names) -> int:
    out = 0
    for n in names:
        out |= CATEGORY_BIT[n]
    return out


def field_mask(layer: str, names) -> int:
    out = 0
    for n in names:
        out |= FIELD_BIT.get((layer, n), 0)
    return out


def layer_mask(layer: str) -> int:
    return field_mask(layer, FIELD_CATALOGUE[layer])


def fields_of_category(category: str) -> int:
    """The mask of all catalogue fields of one category."""
    out = 0
    for (layer, f), bit in FIELD_BIT.items():
        if FIELD_CATALOGUE[layer][f] == category:
            out |= bit
    return out


def allowed_mask(purpose: str) -> int:
    return category_mask(PURPOSE_POLICY[purpose]["allowed"])


def task_mask(needed: dict) -> int:
    out = 0
    for layer, names in needed.items():
        out |= field_mask(layer, names)
    return out


def catalogue_rows():
    """(layer_ord, layer, field_ord, field, category) - the 34-row dimension."""
    return [(li, layer, fi, f, cat)
            for li, layer in enumerate(LAYERS)
            for fi, (f, cat) in enumerate(FIELD_CATALOGUE[layer].items())]


def direct_identifiers(layer: str) -> list[str]:
    return [f for f, c in FIELD_CATALOGUE[layer].items() if c == DI]
