"""A layer kept by two modules: records paired by key, in listing order; and scoped module reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise.operators.ordinals import numbered


def paired_join(left: DataFrame, right: DataFrame, key: str, order: str, wanted: list[str] | None = None) -> DataFrame:
    """The n-th record of a key on the left takes the n-th of the same key on the right, if there is one.

    The join key (key, n) is unique on both sides, so a key with most of the records is spread evenly."""
    a = numbered(left, [key], order, out="_n")
    b = numbered(right, [key], order, out="_n").drop(order)
    out = a.join(b, [key, "_n"], "left").drop("_n")
    return out.select(*[c for c in wanted if c in out.columns]) if wanted else out


def read_module(listing: DataFrame, details: DataFrame | None, wanted: list[str], key: str, where: dict | None = None,
                limit: int | None = None) -> DataFrame:
    """A module's records: the record pages are joined only when something asked for is not on the list."""
    cond = F.lit(True)
    for k, v in (where or {}).items():
        if k in listing.columns:
            cond = cond & (F.col(k).cast("string") == str(v))
    rows = listing.where(cond)
    extra = [f for f in wanted if f not in listing.columns]
    if extra and details is not None:
        have = [f for f in extra if f in details.columns]
        rows = rows.join(details.select(key, *have), key)
        late: Column = F.lit(True)
        for k, v in (where or {}).items():
            if k not in listing.columns and k in rows.columns:
                late = late & (F.col(k).cast("string") == str(v))
        rows = rows.where(late)
    out = rows.select(*[f for f in wanted if f in rows.columns])
    return out if limit is None else out.limit(limit)       # a reader's own limit, none by default
