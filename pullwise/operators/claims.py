"""Claims a manifest makes, checked against the capability register and what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions.text import cites


def _has_text(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def slots(register: dict | None = None, lawful_bases: dict | None = None,
          machine_readable: bool = dims.NOTICE_MACHINE_READABLE) -> dict[str, tuple[Column, Column, Column, Column]]:
    """control -> (declared?, declared text, substantiated?, demonstrated?), in the order they are listed."""
    reg = dims.REGISTER if register is None else register
    bases = dims.LAWFUL_BASES if lawful_bases is None else lawful_bases

    def control(slot):
        return reg.get(slot, (None, False))

    def flag(col, slot, observed=None):
        ident, shown = control(slot)
        ok = F.lit(ident is not None)
        if observed is not None:
            ok = ok & F.coalesce(F.col(observed), F.lit(True))
        return _flag(col), F.lit("True"), ok, F.lit(shown)

    def text(col, slot):
        ident, shown = control(slot)
        return _has_text(F.col(col)), F.trim(F.col(col)), cites(F.col(col), ident), F.lit(shown)

    basis_ok, basis_shown = F.lit(False), F.lit(False)
    for purpose, (ident, shown) in bases.items():
        here = F.col("purpose") == purpose
        basis_ok = F.when(here, cites(F.col("basis_reference"), ident)).otherwise(basis_ok)
        basis_shown = F.when(here, F.lit(shown)).otherwise(basis_shown)
    notice_id, notice_shown = control("notice")
    return {
        "transport encryption": flag("transport_encrypted", "transport_encrypted", "observed_transport"),
        "encryption at rest": flag("at_rest_encrypted", "at_rest_encrypted"),
        "access control": flag("access_controlled", "access_controlled"),
        "pseudonymisation on export": flag("identifiers_pseudonymised", "pseudonymisation"),
        "deletion mechanism": text("deletion_mechanism", "deletion_mechanism"),
        "privacy notice": text("notice_reference", "notice"),
        "machine-readable notice": (
            F.col("notice_reference").isNotNull() & _flag("notice_machine_readable"), F.lit("True"),
            F.lit(notice_id is not None and machine_readable), F.lit(notice_shown)),
        "audit log": flag("audit_log_enabled", "audit_log"),
        "accountable party": text("accountable_party", "accountable_party"),
        "record of processing": flag("processing_record_kept", "processing_record"),
        "lawful-basis reference": (
            F.col("basis_type").isNotNull() & F.coalesce(F.col("basis_reference") != "", F.lit(False))
            & _has_text(F.col("basis_reference")),
            F.trim(F.col("basis_reference")), basis_ok, basis_shown),
    }


def claim_rows(runs: DataFrame, *keep: str, **register) -> DataFrame:
    """One row per declared control of a run."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("control"), declared.alias("is_declared"), shown.alias("declared"),
                 ok.alias("substantiated"),
                 F.when(ok & demo, "demonstrated").when(ok, "attested").otherwise("").alias("basis"))
        for name, (declared, shown, ok, demo) in slots(**register).items()])
    return runs.select(*keep, F.inline(cells)).where("is_declared").drop("is_declared")


def with_veracity(runs: DataFrame, **register) -> DataFrame:
    """Per run: claims declared, substantiated, demonstrated, attested, and substantiated / declared."""
    declared = backed = shown = F.lit(0)
    for d, _, ok, demo in slots(**register).values():
        declared = declared + d.cast("int")
        backed = backed + (d & ok).cast("int")
        shown = shown + (d & ok & demo).cast("int")
    out = runs.withColumns({"declared": declared, "substantiated": backed, "demonstrated": shown})
    return out.withColumns({
        "attested": F.col("substantiated") - F.col("demonstrated"),
        "veracity": F.round(F.when(F.col("declared") > 0, F.col("substantiated") / F.col("declared")), 3)})


def substantiate(runs: DataFrame, **register) -> DataFrame:
    """The manifest with every claim the register or the observation does not back removed."""
    s = slots(**register)

    def good(name):
        return s[name][2]

    keep_notice = good("privacy notice") | ~_has_text(F.col("notice_reference"))
    return runs.withColumns({
        "transport_encrypted": F.col("transport_encrypted") & good("transport encryption"),
        "at_rest_encrypted": F.col("at_rest_encrypted") & good("encryption at rest"),
        "access_controlled": F.col("access_controlled") & good("access control"),
        "identifiers_pseudonymised": F.col("identifiers_pseudonymised") & good("pseudonymisation on export"),
        "deletion_mechanism": F.when(good("deletion mechanism"), F.col("deletion_mechanism")),
        "notice_reference": F.when(keep_notice, F.col("notice_reference")),
        "notice_machine_readable": _flag("notice_machine_readable") & good("machine-readable notice"),
        "audit_log_enabled": F.col("audit_log_enabled") & good("audit log"),
        "accountable_party": F.when(good("accountable party") | ~_has_text(F.col("accountable_party")), F.col("accountable_party")),
        "processing_record_kept": F.col("processing_record_kept") & good("record of processing"),
        "basis_reference": F.when(good("lawful-basis reference"), F.col("basis_reference")),
    })
