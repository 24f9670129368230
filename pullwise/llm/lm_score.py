"""Cross-entropy difference: a target and a background bigram model of one order, vocabulary and smoothing score each document.

The vocabulary is all words of the background, whatever their number; words of the target that the background lacks are one
unknown word (given `vocabulary`, only so many of the most frequent words are told apart). Both models are interpolated
bigrams, `weight` c(vw) / c(v) + (1 - weight) (c(w) + 0.5) / (N + 0.5 V). A document's score is the mean over its words of the
target's loss minus the background's, in nats: the lower, the more like the target.

Two passes over the texts find what is counted. The first gives N, V and the number of texts with words; only these come to the
driver. In the second each task cuts its texts into blocks and sends every distinct word and pair of a block once, as a
64-bit hash with its count in the block, to the bucket of that hash. There the counts of all blocks and of the target are
added up and both sums return to each block that asked, where its documents are scored. What travels grows with the corpus,
and as a block names a key once, however often it occurs, no word or pair that a large share of the documents hold makes a
bucket large. Buckets are cut to about `keys` keys by N, so memory follows that and the block, not the corpus.

Odd cases: null texts and those without words have 0 words and null losses and score; repeated rows count in the
background and are scored each; an empty target gives the uniform unigram model of the vocabulary; an empty corpus gives an
empty result; further columns are never read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pullwise.llm.common import in_pieces, mix, partitions, word_hashes
from pullwise.session import written

START = np.uint64(0x5BF03635F0A31E21)       # stands before a text's first word
UNKNOWN = np.uint64(0x2545F4914F6CDD1D)     # all words outside a vocabulary that the caller limits
_PAIR = np.uint64(0xA24BAED4963EE407)


def thin(values: np.ndarray) -> bytes:
    """Unsigned integers, compressed byte plane by byte plane, as many planes as the largest needs."""
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return struct.pack("<BQ", planes, len(values)) + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def wide(data: bytes) -> np.ndarray:
    planes, n = struct.unpack_from("<BQ", data)
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, :planes] = np.frombuffer(pa.decompress(memoryview(data)[9:], decompressed_size=planes * n, codec="zstd"), np.uint8).reshape(planes, n).T
    return out.view("<u8").ravel()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each piece with their counts, and as a null word the number of texts that have words."""
    for b in batches:
        texts = b.column(0).to_pylist()
        for i, j in in_pieces(texts):
            hashes, counts = word_hashes(texts[i:j])
            h, n = np.unique(hashes, return_counts=True)
            h = pa.concat_arrays([pa.array(h.view(np.int64)), pa.nulls(1, pa.int64())])
            yield pa.RecordBatch.from_arrays([h, pa.array(np.append(n, (counts > 0).sum()).astype(np.int64))], ["hash", "n"])


def words(texts: list, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each text. known: the sorted hashes of a limited vocabulary."""
    hashes, counts = word_hashes(texts)
    if known is not None and len(hashes):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1) if len(known) else 0
        hashes = np.where(known[at] == hashes, hashes, UNKNOWN) if len(known) else np.full(len(hashes), UNKNOWN)
    return hashes, counts


def pairs(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each word with the word before it (START before a text's first)."""
    before = np.concatenate(([START], hashes[:-1])) if len(hashes) else hashes.copy()
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    return mix(mix(before ^ _PAIR) + hashes)


def edges(buckets: int) -> np.ndarray:
    """Where the buckets' ranges of hashes begin."""
    return np.array([-(-(k << 32) // buckets) << 32 for k in range(buckets)], dtype=np.uint64)


PARTS = "block long, bucket int, a binary, b binary, doc_ids array<long>"
_NAMES, _KINDS = ["block", "bucket", "a", "b", "doc_ids"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)


def _ask(known, buckets: int, asking: bool, flush: int):
    """Distinct words and pairs of each block with their counts, by bucket; asking: with the block's number, to be answered, and
    as bucket -1 what scoring needs: words a text, distinct words, most frequent first, and each word's place among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, block = edges(buckets), TaskContext.get().partitionId() << 32
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in in_pieces(texts, flush):
                hashes, counts = words(texts[i:j], known and known.value)
                rows = []
                if asking:
                    distinct, where, n = np.unique(hashes, return_inverse=True, return_counts=True)
                    order = np.argsort(-n, kind="stable")
                    rank = np.empty(len(order), dtype=np.int64)
                    rank[order] = np.arange(len(order))
                    rows.append((block, -1, thin(rank[where]), counts.astype("<i8").tobytes() + thin(np.diff(distinct[order], prepend=np.uint64(0))), doc_ids[i:j]))
                    del distinct, where, order, rank
                keys, n = np.unique(np.concatenate((hashes, pairs(hashes, counts))), return_counts=True)
                cuts = np.append(np.searchsorted(keys, floor), len(keys))
                for k in np.flatnonzero(np.diff(cuts)):
                    x, y = cuts[k], cuts[k + 1]
                    rows.append((block if asking else -1, int(k), thin(np.diff(keys[x:y], prepend=floor[k])), thin(n[x:y]), None))
                yield _batch(rows)
                block += 1
    return run


def _answer(buckets: int):
    """Adds up a bucket's counts over all blocks and sends each block the sums of its keys: background's, target's."""
    def close(bucket: int, held: list, floor: np.ndarray) -> pa.RecordBatch:
        keys = [floor[bucket] + np.cumsum(wide(a), dtype=np.uint64) for _, a, _ in held]
        lengths = [len(k) for k in keys]
        known, where = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sums = [np.zeros(len(known), dtype=np.uint64) for _ in range(2)]
        at, rows = 0, []
        for (block, _, n), size in zip(held, lengths):
            sums[block < 0][where[at:at + size]] += wide(n)           # a block has each key once
            at += size
        at = 0
        for (block, *_), size in zip(held, lengths):
            if block >= 0:
                k = where[at:at + size]
                rows.append((block, bucket, thin(sums[0][k]), thin(sums[1][k]), None))
            at += size
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, held, now = edges(buckets), [], -1
        for b in batches:
            for i in range(b.num_rows):
                block, bucket, *row = (b.column(k)[i].as_py() for k in range(5))
                if bucket < 0:
                    yield _batch([(block, bucket, *row)])
                    continue
                if bucket != now and held:
                    yield close(now, held, floor)
                    held = []
                now = bucket
                held.append((block, *row[:2]))
        if held:
            yield close(now, held, floor)
    return run


def losses(pair: np.ndarray, context: np.ndarray, single: np.ndarray, total: int, size: int, weight: float) -> np.ndarray:
    """Minus log probability of words that occur `single` times, after words that occur `context` times, in pairs that occur `pair` times."""
    base = (single + 0.5) / (total + 0.5 * size)
    share = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
    return -np.log(np.where(context > 0, weight * share + (1 - weight) * base, base))


def _judge(totals: list[tuple[int, int]], size: int, weight: float):
    """Scores a block's documents. totals: words and texts with words of the background and of the target."""
    def close(parts: list) -> pa.RecordBatch:
        own = next(p for p in parts if p[0] < 0)
        parts = sorted((p for p in parts if p[0] >= 0), key=lambda p: p[0])
        docs = len(own[3])
        counts = np.frombuffer(own[2][:8 * docs], "<i8")
        hashes = np.cumsum(wide(own[2][8 * docs:]), dtype=np.uint64)[wide(own[1]).astype(np.int64)]
        keys, where = np.unique(np.concatenate((hashes, pairs(hashes, counts))), return_inverse=True)
        word, pair = where[:len(hashes)], where[len(hashes):]
        of, first = np.repeat(np.arange(docs), counts), (np.cumsum(counts) - counts)[counts > 0]
        mean = []
        for k in (1, 0):                                              # target, background
            n = np.concatenate([np.zeros(0), *(wide(p[1 + k]) for p in parts)])
            single = n[word]
            context = np.concatenate(([0.0], single[:-1])) if len(single) else single.copy()
            context[first] = totals[k][1]
            loss = np.bincount(of, weights=losses(n[pair], context, single, totals[k][0], size, weight), minlength=docs)
            mean.append(np.divide(loss, counts, out=np.zeros(docs), where=counts > 0))
        return pa.RecordBatch.from_arrays([pa.array(own[3], pa.int64()), pa.array(counts), *(pa.array(m, mask=counts == 0) for m in mean)],
                                          ["doc_id", "n_words", "loss_target", "loss_background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now = [], None
        for batch in batches:
            for block, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if block != now and parts:
                    yield close(parts)
                    parts = []
                now = block
                parts.append(row)
        if parts:
            yield close(parts)
    return run


def score(corpus: DataFrame, target: DataFrame, vocabulary: int | None = None, weight: float = 0.7, flush: int = 8 << 20, keys: int = 8 << 20) -> DataFrame:
    """Per row of the corpus (doc_id, text): doc_id, n_words, loss_target, loss_background, score. target: a text column."""
    spark = corpus.sparkSession
    if vocabulary is not None and vocabulary < 1:
        raise ValueError("a vocabulary has at least one word")
    texts = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    totals, known = [], None
    for of in (texts, wanted):
        counted = of.select("text").mapInArrow(_word_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        word = F.col("hash").isNotNull()
        r = counted.agg(F.count("hash").alias("size"), F.sum(F.when(word, F.col("n"))).alias("words"), F.sum(F.when(~word, F.col("n"))).alias("texts")).first()
        totals.append((r["words"] or 0, r["texts"] or 0))
        if of is texts:
            size = r["size"] + 1
            if vocabulary is not None and vocabulary < r["size"]:
                top = counted.where(word).orderBy(F.desc("n"), "hash").limit(vocabulary).collect()
                size = vocabulary + 1
                known = spark.sparkContext.broadcast(np.sort(np.array([x["hash"] for x in top], dtype=np.int64).view(np.uint64)))
    n = partitions(spark)
    buckets = max(2 * n, -(-2 * sum(t[0] for t in totals) // keys))
    asked = texts.mapInArrow(_ask(known, buckets, True, flush), PARTS).unionByName(wanted.mapInArrow(_ask(known, buckets, False, flush), PARTS))
    dealt = asked.repartition(n, F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    parts = dealt.mapInArrow(_answer(buckets), PARTS)
    done = parts.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_judge(totals, size, weight), "doc_id long, n_words long, loss_target double, loss_background double")
    return written(done, "scores").withColumn("score", F.col("loss_target") - F.col("loss_background"))
