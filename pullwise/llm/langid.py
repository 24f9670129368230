"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text (spaces and non-letters folded to one mark) are hashed into `BUCKETS`
features. Document frequencies are counted over all training documents on the executors. The regression is trained with
follow-the-regularised-leader (per-coordinate rates, elastic net: l1 makes it sparse, l2 shrinks) on a bounded sample of labelled
rows, at most `per_language` of each language, those with the least digests; a held-back part of the sample calibrates
a temperature by likelihood. Prediction runs over every whole text.

Odd cases: null texts and those without a letter are `und` with score 0; rows with a null language aren't learned from; repeated rows
are predicted alike; a table without labels predicts `und` for all; an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15


def ngram_counts(text: str, chunk: int = 1 << 20) -> np.ndarray:
    """How often each feature occurs in the text. Long texts are read in chunks that overlap by an n-gram."""
    total = np.zeros(BUCKETS, dtype=np.float32)
    text = text.lower()
    for at in range(0, max(len(text), 1), chunk):
        c = np.frombuffer(text[max(at - 2, 0):at + chunk].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        fresh = len(c) - min(at, 2)                       # n-grams that end in this chunk
        c = np.where((c < 128) & ~((c >= 97) & (c <= 122)), np.uint32(32), c)
        x = c.astype(np.uint32)
        for n in (1, 2, 3):
            if n > 1:
                x = x[:-1] * np.uint32(0x01000193) ^ c[n - 1:]
            h = x * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            ends = h[max(len(h) - fresh, 0):]
            total += np.bincount(ends & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return total


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for b in batches:
        for t in b.column(0).to_pylist():
            seen += ngram_counts(t) > 0
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["bucket", "n"])


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's TF-IDF vector of length 1."""
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    v = np.log1p(counts[at]) * idf[at]
    norm = float(np.sqrt((v * v).sum()))
    return at, (v / norm if norm else v).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0,
          l1: float = 0.02, l2: float = 0.5, seed: int = 7) -> np.ndarray:
    """Weights (features x classes) by FTRL-proximal with elastic net."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    rng = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v, y = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return weights(z, n)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the best likelihood on held-back rows."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 5.0, 60)
    loss = []
    for t in grid:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        loss.append(float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]).mean()))
    return float(grid[int(np.argmin(loss))])


def fit(labelled: DataFrame, per_language: int = 400) -> dict | None:
    """A model of (doc_id, text, lang) rows. Frequencies are of all rows; weights of at most per_language rows of each language."""
    spark = labelled.sparkSession
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = known.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()   # a row per feature
    frequency = np.zeros(BUCKETS)
    total = 0
    for r in seen:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            frequency[r["bucket"]] = r["n"]
    names = [r["lang"] for r in known.select("lang").distinct().collect()]        # a row per language
    if not names:
        return None
    names.sort()
    # the least digests of each language: first within shares of the rows, then among the shares' least ones
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = known.filter(F.col("lang").isin(names)).select("lang", digest.alias("d"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("x"))
    share = keyed.withColumn("s", F.spark_partition_id())
    least = lambda rows, *by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("d", "x"))).filter(F.col("r") <= per_language)
    chosen = least(least(share, "lang", "s"), "lang").select(F.col("lang").alias("l"), "i", "x", "d")
    same = known["doc_id"].eqNullSafe(F.col("i")) & (F.xxhash64(known["text"]) == F.col("x")) & (known["lang"] == F.col("l"))
    rows = known.join(F.broadcast(chosen), same).select("text", "lang", "d").dropDuplicates(["d", "text"]).orderBy("d", "text")   # a bounded table
    idf = np.log((1 + total) / (1 + frequency)) + 1
    place = {name: k for k, name in enumerate(names)}
    data = [(*features(r["text"], idf), place[r["lang"]]) for r in rows.toLocalIterator()]      # per_language x languages at most
    held, learned = data[::5], [x for i, x in enumerate(data) if i % 5]
    w = train(learned or data, len(names))
    logits = np.array([v @ w[at] for at, v, _ in held]).reshape(len(held), len(names))
    return {"names": names, "idf": idf.astype(np.float32), "weights": w.astype(np.float32),
            "temperature": temperature(logits, np.array([y for *_, y in held], dtype=int))}


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            names, scores = [], []
            for t in b.column(1).to_pylist():
                if model is None or t is None or not any(c.isalpha() for c in t):
                    names.append("und")
                    scores.append(0.0)
                    continue
                at, v = features(t, model["idf"])
                p = softmax((v @ model["weights"][at]).astype(np.float64) / model["temperature"])
                k = int(np.argmax(p))
                names.append(model["names"][k])
                scores.append(min(float(p[k]), 1.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per row doc_id, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predictor(shared), "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Learns from the documents that aren't held out, and predicts all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"), per_language)
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
