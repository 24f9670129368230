"""Small expressions and helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pullwise.session import ship

# fixed values: ASCII white space as the contracts spell it
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once a row, however often the body (and its lambdas) name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def array_sum(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def running_totals(lengths: Column, block: int = 256) -> Column:
    """Sum of the elements before each element, by blocks, so that a long array costs about its length times the block."""
    def prefixes(a: Column) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("all"), F.lit(0).cast("long").alias("at"))
        return F.aggregate(a, start, lambda s, x: F.struct(F.concat(s["all"], F.array(s["at"])).alias("all"),
                                                            (s["at"] + x).alias("at")), lambda s: s["all"])

    def by_blocks(a: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(a), F.lit(block))
        return let(F.transform(firsts, lambda i: F.slice(a, i, F.lit(block))), lambda parts: let(
            prefixes(F.transform(parts, lambda p: array_sum(p))),
            lambda before: F.flatten(F.transform(parts, lambda p, i: F.transform(prefixes(p), lambda x: x + F.get(before, i))))))

    return let(lengths.cast("array<long>"), lambda a: F.when(F.size(a) > 0, by_blocks(a)).otherwise(F.array().cast("array<long>")))


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def row_key(*columns: str) -> Column:
    """A digest of the values of a row, equal for equal rows only; nulls count as values."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("\x00", *[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- numpy side: words of a batch of texts as 64-bit hashes ----

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)
    return out


_POWERS = _powers(1 << 12)


def _hash_run(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a run of bytes that ends with a space."""
    global _POWERS
    space = _SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    lengths = ends - starts
    if int(lengths.max()) > len(_POWERS):
        _POWERS = _powers(1 << int(lengths.max()).bit_length())
    inside = np.flatnonzero(~space)
    first = np.cumsum(lengths) - lengths
    offset = np.arange(len(inside), dtype=np.int64) - np.repeat(first, lengths)
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[offset]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _ODD), starts


def word_hashes(texts: list[str | None], lower: bool = False, run: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and the number of words of each text.

    A word is a run of bytes other than ASCII white space; lower folds A-Z only. The hash covers every byte of the word. The bytes
    are worked through in runs of about a megabyte that end at a space, so memory follows the text and its words only."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    ends = np.cumsum([len(x) for x in encoded], dtype=np.int64)
    data = np.frombuffer(b"".join(encoded), dtype=np.uint8)
    del encoded
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(at + run, len(data))
        while not _SPACES[data[to - 1]]:                # the last byte of all is a space
            more = np.flatnonzero(_SPACES[data[to:to + 4096]])
            to = to + int(more[0]) + 1 if len(more) else min(to + 4096, len(data))
        part = data[at:to]
        if lower:
            part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        h, s = _hash_run(part)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    counts = np.diff(np.searchsorted(np.concatenate(starts), np.concatenate(([0], ends))))
    return np.concatenate(hashes), counts.astype(np.int64)


def in_pieces(texts: list, size: int = 2 << 20):
    """Slices of a batch with about so many characters each, so that memory follows the piece and the longest text only."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
