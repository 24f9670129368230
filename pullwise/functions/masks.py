"""Expressions over category and field bitmasks (see ``pullwise.dims``)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pullwise import dims


def choose(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """A literal lookup written as CASE: stays in generated code, needs no join."""
    expr = None
    for k, v in table.items():
        v = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(key == F.lit(k), v) if expr is None else expr.when(key == F.lit(k), v)
    d = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(d)


def allowed_mask(purpose: Column) -> Column:
    """Categories the purpose policy allows; an unknown purpose allows none."""
    return choose(purpose, {p: dims.allowed_mask(p) for p in dims.PURPOSES}, 0)


def retention_ceiling(purpose: Column) -> Column:
    return choose(purpose, {p: v["max_retention_days"] for p, v in dims.PURPOSE_POLICY.items()}, F.lit(None).cast("int"))


def pseudonymise_required(purpose: Column) -> Column:
    return choose(purpose, {p: v["pseudonymise"] for p, v in dims.PURPOSE_POLICY.items()}, False)


def recognised(purpose: Column) -> Column:
    return purpose.isin(*dims.PURPOSES)


def minus(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def has(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits)) != 0


def categories_of_fields(field_mask: Column) -> Column:
    """Field bits -> category bits."""
    out = F.lit(0)
    for c in dims.CATEGORIES:
        bits = dims.fields_of_category(c)
        out = out + F.when(has(field_mask, bits), dims.CATEGORY_BIT[c]).otherwise(0)
    return out


def category_bit(category: Column) -> Column:
    return choose(category, dims.CATEGORY_BIT, 0)


def field_bit(layer: Column, field: Column) -> Column:
    """The bit of a (layer, field) reference; 0 when the catalogue has no such field."""
    return choose(layer, {
        lay: choose(field, {f: dims.FIELD_BIT[lay, f] for f in fields}, 0)
        for lay, fields in dims.FIELD_CATALOGUE.items()}, 0).cast("bigint")


def field_category(layer: Column, field: Column, default: str | None = "uncatalogued") -> Column:
    return choose(layer, {lay: choose(field, fields, default) for lay, fields in dims.FIELD_CATALOGUE.items()}, default)


def category_names(mask: Column) -> Column:
    """Sorted array of the category names in a mask."""
    return F.array_compact(F.array(*[
        F.when(has(mask, dims.CATEGORY_BIT[c]), F.lit(c)) for c in sorted(dims.CATEGORIES)]))


def category_list(mask: Column) -> Column:
    return F.array_join(category_names(mask), ",")


def field_names(mask: Column, layer: str | None = None) -> Column:
    """Sorted array of the ``layer/field`` references in a mask."""
    refs = sorted(r for r in dims.FIELD_REFS if layer is None or r[0] == layer)
    return F.array_compact(F.array(*[
        F.when(has(mask, dims.FIELD_BIT[r]), F.lit(f"{r[0]}/{r[1]}" if layer is None else r[1])) for r in refs]))


def layers_of_fields(mask: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(has(mask, dims.layer_mask(layer)), F.lit(layer)) for layer in dims.LAYERS]))


def artefact_categories(artefacts: Column) -> Column:
    """Union of the category masks of an array of artefact keys."""
    table = {a: dims.category_mask(c) for a, (_, c) in dims.ARTEFACTS.items()}
    return F.aggregate(artefacts, F.lit(0), lambda acc, a: acc.bitwiseOR(choose(a, table, 0)))


def artefact_mask(artefacts: Column) -> Column:
    return F.aggregate(artefacts, F.lit(0), lambda acc, a: acc.bitwiseOR(choose(a, dims.ARTEFACT_BIT, 0)))
