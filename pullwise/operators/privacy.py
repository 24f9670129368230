"""Pseudonymised and generalised exports, and k-anonymity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import crypto, text


def pseudonymise(layer: str, df: DataFrame, key: str, when: Column | None = None) -> DataFrame:
    """Replaces the layer's direct identifiers (non-blank ones) by keyed tokens, where ``when`` holds."""
    on = F.lit(True) if when is None else when
    return df.withColumns({c: F.when(on & text.present(F.col(c)), crypto.token(F.col(c), key)).otherwise(F.col(c))
                           for c in dims.direct_identifiers(layer) if c in df.columns})


def generalise(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Birth date to its year, PIN to its sorting district; sex is kept."""
    on = F.lit(True) if when is None else when
    steps = {"date_of_birth": text.generalise_date, "pincode": text.generalise_pin}
    return df.withColumns({c: F.when(on, f(F.col(c))).otherwise(F.col(c)) for c, f in steps.items() if c in df.columns})


def normalise_rows(layer: str, df: DataFrame, key: str, when: Column | None = None) -> DataFrame:
    """What an export holds: pseudonymised and generalised exactly where the manifest declares it."""
    return generalise(pseudonymise(layer, df, key, when), when)


def skipped_standards(layer: str) -> list[str]:
    return [s for s in dims.LAYER_STANDARDS[layer] if s not in ("hl7_v2", "fhir")]


def k_anonymity(rows: DataFrame, *keys: str) -> DataFrame:
    """Smallest group sharing the quasi-identifiers, per key; rows carrying none (or only blanks)
    count nowhere; k is null where no row carries any.

    Two hash aggregates; the largest combination is one partially aggregated row per task."""
    have = [q for q in dims.QUASI_IDENTIFIERS if q in rows.columns]
    carried = reduce(lambda a, b: a | b, [F.coalesce(F.col(q) != "", F.lit(False)) for q in have], F.lit(False))
    groups = rows.groupBy(*keys, *have).agg(F.count(F.lit(1)).alias("n"))
    carrying = F.when(carried, F.col("n"))
    return groups.groupBy(*keys).agg(F.min(carrying).alias("k"), F.sum(carrying).alias("k_rows"), F.count(carrying).alias("groups"))
