"""Hard negatives by threshold joins over inner products, after L2AP.

Anchors are dealt into groups and all rows into blocks; a tile joins one group with one block. Within a tile dimensions are taken in
runs, heaviest first. A row is indexed only in the dimensions before the point where the norm of its remaining ones, times the
longest anchor's, can't reach the lowest threshold any more. The index is worked through run by run: partial scores accumulate, and a
pair goes as soon as its partial score with the norms of what remains can't get into any of its anchor's windows. The few pairs left
are completed from the rows themselves. Whenever a window has its number of rows, its threshold rises to the last of them.

A window asks for its best k rows between a lowest and a highest score. All windows start with a high threshold; those that don't
fill are joined again with a lower one, and the last threshold is the window's own lowest score, so no row is missed. The positives of
an anchor are one such window over rows of its label, its negatives one for each positive over rows of other labels.

Scores are exact: products below 2^53 are added as doubles, larger ones as 64-bit integers.

Odd cases: rows with a null vec_id, label or vector, or a null or non-finite component take no part, nor do vectors whose squared norm
reaches 2^62, as their scores wouldn't fit 64 bits; missing trailing components of shorter vectors count as zero; repeated rows are
rows of their own; ties go to the smaller vec_id; an empty table, or one without anchors, gives an empty result. Further columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullwise.llm.common import partitions
from pullwise.session import written

ANCHORS, ROWS = 1 << 16, 1 << 16    # anchors and rows of a tile
SIDE, STEP = 256, 16                # anchors scored at a time, dimensions in a run
LEAST, MOST = -(1 << 63), (1 << 63) - 1
POSITIVE_LEVELS = (0.5, 0.25)       # first thresholds, as shares of the largest score an anchor may have
NEGATIVE_LEVELS = (8,)              # first thresholds, as the upper 1/n of a window


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vec, norm): the rows that take part, each component x as floor(scale x)."""
    x = F.transform("embedding", lambda v: v.cast("double") * scale)
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.floor(v).cast("double") * F.floor(v).cast("double"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad).withColumn("norm", F.sqrt(norm2)).filter(
        F.col("norm") < float(1 << 31)).select("vec_id", "label", F.transform("x", lambda v: F.floor(v).cast("int")).alias("vec"), "norm")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _tail_norms(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of what remains of each row from each edge on, a little rounded up."""
    squares = np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    squares = np.concatenate([squares, np.zeros((len(x), 1))], axis=1)
    return np.sqrt(squares[:, edges]) * (1 + 1e-9)


class _Queries:
    """The anchors of a tile with their windows, and the best rows of each so far."""

    def __init__(self, parts: list[tuple], k: int, same: bool, width: int) -> None:
        self.no, self.label, windows, vectors = (list(chain(*x)) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*parts))
        self.x, self.k, self.same, self.width = vectors, k, same, width
        most = max(len(w) for w in windows)
        self.w = np.full((len(windows), most), -1, dtype=np.int64)
        self.low, self.high = np.full((len(windows), most), MOST, dtype=np.int64), np.full((len(windows), most), LEAST, dtype=np.int64)
        for i, ws in enumerate(windows):
            for j, w in enumerate(ws):
                self.w[i, j], self.low[i, j], self.high[i, j] = w["w"], w["low"], w["high"]
        self.best = [np.zeros(0, dtype=np.int64) for _ in range(4)]           # anchor's place, window's place, score, vec_id

    def meet(self, no: np.ndarray, ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> None:
        """Searches a block of rows."""
        order = np.argsort(-(y.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        y, x = y[:, order], self.x[:, order]
        edges = [*range(0, self.width, STEP), self.width]
        ty, tx = _tail_norms(y, edges), _tail_norms(x, edges)
        kind = np.float64 if tx[:, 0].max() * ty[:, 0].max() < 2.0 ** 53 else np.int64
        x, y = x.astype(kind), y.astype(kind)
        for a in range(0, len(x), SIDE):
            b = min(a + SIDE, len(x))
            i, j, score = self._pairs(x[a:b], tx[a:b], self.label[a:b], self.no[a:b], self.low[a:b].min(axis=1), self.high[a:b].max(axis=1),
                                      y, ty, labels, no, edges)
            i = i + a
            hits = [((score >= self.low[i, w]) & (score <= self.high[i, w]), w) for w in range(self.w.shape[1])]
            new = [np.concatenate(c) for c in zip(*[(i[h], np.full(int(h.sum()), w), score[h].astype(np.int64), ids[j[h]]) for h, w in hits])]
            if len(new[0]):
                self._keep(new)

    def _pairs(self, x, tx, label, x_no, low, high, y, ty, labels, y_no, edges):
        """(anchor, row, score) of the pairs that reach the range from low to high."""
        low_f, high_f = low.astype(np.float64), high.astype(np.float64)
        runs = len(edges) - 1
        slack = tx[:, 0].max() * ty[:, 0].max() * 1e-9 + 1
        # the index: a row is in the lists of its first runs, until its tail can't reach the lowest threshold
        indexed = (ty[:, :-1] * tx.max(axis=0)[:-1] + slack >= low_f.min()).sum(axis=1)
        rows = np.argsort(-indexed, kind="stable")
        listed = indexed[rows]
        rows, listed = rows[listed > 0], listed[listed > 0]
        lists = y[rows]
        alive = ((label[:, None] == labels[rows][None, :]) == self.same) & (x_no[:, None] != y_no[rows][None, :])
        partial = np.zeros((len(x), len(rows)), dtype=y.dtype)
        done = 0
        while done < runs:
            n = int(np.searchsorted(-listed, -done, side="left"))             # rows that are listed in this run
            if not n:
                break
            run = slice(edges[done], edges[done + 1])
            partial[:, :n] += x[:, run] @ lists[:n, run].T
            done += 1
            rest = tx[:, done][:, None] * ty[rows[:n], done][None, :] + slack
            alive[:, :n] &= (partial[:, :n] + rest >= low_f[:, None]) & (partial[:, :n] - rest <= high_f[:, None])
            if alive.sum() * 16 < alive.size:
                break
        i, at = np.nonzero(alive)
        score, seen = partial[i, at], np.minimum(done, listed[at])
        # what the index leaves out comes from the rows themselves
        for run in range(int(seen.min()) if len(seen) else runs, runs):
            part, more = slice(edges[run], edges[run + 1]), seen <= run
            score[more] += np.einsum("ij,ij->i", x[i[more], part], lists[at[more], part])
            rest = np.where(more, tx[i, run + 1] * ty[rows[at], run + 1], tx[i, seen] * ty[rows[at], seen]) + slack
            keep = (score + rest >= low_f[i]) & (score - rest <= high_f[i])
            i, at, score, seen = i[keep], at[keep], score[keep], seen[keep]
        return i, rows[at], score

    def _keep(self, new: list[np.ndarray]) -> None:
        """Keeps the best k of each window and raises its threshold to the last of them."""
        i, w, score, ids = (np.concatenate([a, b]) for a, b in zip(self.best, new))
        order = np.lexsort((ids, -score, w, i))
        i, w, score, ids = i[order], w[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (w[1:] != w[:-1]))))
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        full = place == self.k - 1
        self.low[i[full], w[full]] = score[full]
        keep = place < self.k
        self.best = [c[keep] for c in (i, w, score, ids)]

    def found(self) -> pa.RecordBatch:
        i, w, score, ids = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.no[i]), pa.array(self.w[i, w].astype(np.int32)), pa.array(score), pa.array(ids)], ["no", "w", "score", "vec_id"])


def _tiles(k: int, same: bool, width: int):
    """Searches tile by tile: the anchors of a tile come first, then its rows in batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, queries = None, [], None
        for b in batches:
            tile, kind = (b.column(c).to_numpy() for c in (0, 1))
            key = tile * 2 + kind
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if tile[x] != now:
                    if queries:
                        yield queries.found()
                    now, parts, queries = tile[x], [], None
                part = b.slice(x, y - x)
                no, ids, labels = (part.column(c).to_numpy() for c in (2, 3, 4))
                vectors = _matrix(part.column(5), width)
                if kind[x] == 0:
                    parts.append((no, labels, part.column(7).to_pylist(), vectors))
                elif parts or queries:
                    queries = queries or _Queries(parts, k, same, width)
                    parts = []
                    queries.meet(no, ids, labels, vectors)
        if queries:
            yield queries.found()
    return run


def threshold_join(rows: DataFrame, anchors: DataFrame, k: int, same: bool, width: int, n_rows: int, n_anchors: int) -> DataFrame:
    """(no, w, rank, score, vec_id): the best k rows of each window (w, low, high) of each anchor, among rows of its label or of others."""
    n = partitions(rows.sparkSession)
    blocks = max(min(n, -(-n_rows // 64)), -(-n_rows // ROWS))
    groups = max(1, -(-n_anchors // ANCHORS))
    tile = F.col("_group") * blocks + F.col("_block")
    hashed = F.xxhash64("no")
    one = anchors.withColumns({"_group": F.pmod(hashed, F.lit(groups)), "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    two = rows.withColumns({"_block": F.pmod(hashed, F.lit(blocks)), "_group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))),
                            "windows": F.lit(None).cast("array<struct<w:int,low:long,high:long>>")})
    both = [side.select(tile.cast("long").alias("tile"), F.lit(kind).alias("kind"), "no", "vec_id", "label", "vec", "norm", "windows") for kind, side in enumerate((one, two))]
    dealt = both[0].unionByName(both[1]).repartition(n, "tile").sortWithinPartitions("tile", "kind", F.desc("norm"))
    found = dealt.mapInArrow(_tiles(k, same, width), "no long, w int, score long, vec_id long")
    best = Window.partitionBy("no", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _filled(rows: DataFrame, windows: DataFrame, vectors: DataFrame, lows: list[Column], k: int, same: bool, width: int, n_rows: int) -> DataFrame:
    """(no, w, rank, score, vec_id) of the windows (no, w, want, low, high), joined under the thresholds of `lows`, one after another,
    until a window has `want` rows. The last threshold is the window's own low."""
    found = None
    open_ = windows
    for low in lows:
        asked = open_.groupBy("no").agg(F.collect_list(F.struct(F.col("w").cast("int").alias("w"), low.cast("long").alias("low"), "high")).alias("windows"))
        asked = written(vectors.join(asked, "no"), "asked")
        n = asked.count()
        if not n:
            break
        got = written(threshold_join(rows, asked, k, same, width, n_rows, n), "found")
        full = open_.join(got.groupBy("no", "w").agg(F.count(F.lit(1)).alias("n")), ["no", "w"], "left").fillna(0, ["n"])
        done = full.filter(F.col("n") >= F.col("want")) if low is not lows[-1] else full
        some = got.join(done.select("no", "w"), ["no", "w"], "left_semi")
        found = some if found is None else found.unionByName(some)
        if low is not lows[-1]:
            open_ = written(full.filter(F.col("n") < F.col("want")).drop("n"), "open")
    return written(found, "windows") if found is not None else None


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that meets `anchor` and each of its best
    `positives` other rows of its label, the best `negatives` rows of other labels that score `low` to `high` per cent of the positive.

    rows: (vec_id, label, vec, norm), as `quantised` gives them."""
    rows = written(rows.withColumn("no", F.monotonically_increasing_id()), "rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"), F.max("norm").alias("norm")).first()
    width, most = max(size["width"] or 0, 1), float(size["norm"] or 0)
    anchors = written(rows.filter(anchor), "anchors")
    of_label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    first = anchors.join(of_label, "label").filter("of_label > 1").select(
        "no", F.lit(0).alias("w"), F.least(F.lit(positives), F.col("of_label") - 1).alias("want"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"), "norm")
    lows = [*[F.floor(F.col("norm") * most * share) for share in POSITIVE_LEVELS], F.col("low")]
    best = _filled(rows, first, anchors, lows, positives, True, width, size["n"])
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if best is None:
        return rows.sparkSession.createDataFrame([], empty)
    best = best.select("no", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    second = best.filter("positive_score >= 0").select("no", "w", F.lit(negatives).alias("want"),        # no range below 0
        F.expr(f"(positive_score div 100) * {low} + ((positive_score % 100) * {low} + 99) div 100").alias("low"),
        F.expr(f"(positive_score div 100) * {high} + ((positive_score % 100) * {high}) div 100").alias("high")).filter("low <= high")
    lows = [*[F.expr(f"high - (high - low) div {part}") for part in NEGATIVE_LEVELS], F.col("low")]
    found = _filled(rows, second, anchors, lows, negatives, False, width, size["n"])
    if found is None:
        return rows.sparkSession.createDataFrame([], empty)
    return found.select("no", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["no", "w"]).join(
        anchors.select("no", F.col("vec_id").alias("anchor_id")), "no").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
