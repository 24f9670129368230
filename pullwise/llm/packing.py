"""Best-fit packing of tokenised documents by a linear grouping scheme.

Only the histogram of piece lengths is needed to plan: at most `capacity` rows whatever the corpus. Lengths above
`capacity / 8` are large. They are put, longest first, into groups of equal cardinality and rounded up to their group's
longest; configurations of these few sizes are chosen to fill a sequence as far as possible (a bounded knapsack over
what is left, its longest size always in), each used as often as the stock allows. Actual documents then take the places
of rounded sizes, which leaves room but never too little, and small documents are put, longest first, where they fit
best. The plan is a table of runs: the pieces of one length with ranks in a range go to consecutive sequences at one
offset. Pieces learn their rank from counts per task and length, so nothing is sorted or gathered by length.

Odd cases: a null or empty text is the end-of-document id alone; documents longer than the capacity are cut into pieces of
exactly the capacity but for the first; repeated rows are packed each; a null id stays null; an empty table gives an empty
result; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pullwise.llm.common import in_pieces
from pullwise.session import written

SPECIAL = "<|endoftext|>"       # fixed value: the one string that the tokenizer file treats apart
_tokenizers: dict[str, "WordCache"] = {}


class WhiteRun(Exception):
    """A space with white space or nothing after it."""


class WordCache(dict):
    """Ids of words as bytes. A space begins a new pre-token unless it stands within a run of white space, no-break and other
    spaces included, or ends one at the end of the text. So where every space has a character after it that isn't white space, the
    words between spaces are encoded alone, and mostly found here; other texts are encoded whole."""

    def __init__(self, name: str, most: int = 300_000):
        super().__init__()
        import base64
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most = most

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise WhiteRun
        ids = np.array(self.fast.encode_ordinary(" " + word), dtype="<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if "  " in text:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        if len(self) > self.most:
            self.clear()
        first, _, rest = text.partition(" ")
        head = np.array(self.fast.encode_ordinary(first), dtype="<u4").tobytes() if first else b""
        try:
            return head + b"".join(map(self.__getitem__, rest.split(" "))) if _ else head
        except WhiteRun:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


def _cutter(name: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tokenizers:
            _tokenizers[name] = WordCache(name)
        encode, task = _tokenizers[name].encode, TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64).tolist()
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in in_pieces(texts):
                rows = []
                for key, text in zip(keys[i:j], texts[i:j]):
                    ids = encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    at, piece = 0, 0
                    length = n % capacity or capacity if n > capacity else n
                    while at < n:
                        rows.append((key, piece, at, length, ids[4 * at:4 * (at + length)], task, ranks[length]))
                        ranks[length] += 1
                        at, piece, length = at + length, piece + 1, capacity
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                                 ["doc_id", "piece", "start", "length", "ids", "task", "rank"])
    return run


PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, rank long"


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their ids (unsigned 32-bit, little-endian), written once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(_cutter(tokenizer, capacity), PIECES), "pieces")


def fill(sizes: list[int], stock: list[int], capacity: int) -> list[int]:
    """How many of each size make the fullest configuration with sizes[0] in it. Sizes descend; stock bounds each."""
    room = capacity - sizes[0]
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    last = np.full(room + 1, -1, dtype=np.int64)                # the size that made a sum reachable first
    uses = np.zeros(room + 1, dtype=np.int64)                   # of that size, how many the sum holds
    for k, size in enumerate(sizes):
        left = stock[k] - (k == 0)
        for c in range(1, min(left, room // size) + 1):
            new = np.zeros_like(reach)
            new[size:] = reach[:-size] & ((last[:-size] != k) | (uses[:-size] == c - 1)) & ~reach[size:]
            if c > 1:
                new[size:] &= last[:-size] == k
            if not new.any():
                break
            reach |= new
            last[new], uses[new] = k, c
    out = [0] * len(sizes)
    out[0] = 1
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k = int(last[at])
        out[k] += int(uses[at])
        at -= int(uses[at]) * sizes[k]
    return out


def plan(counts: dict[int, int], capacity: int = 2048, groups: int = 512) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, how many, first sequence, offset) that pack counts[length] pieces, and the number of sequences."""
    used_up = {n: 0 for n in counts}                            # ranks given out so far
    large = sorted((n for n in counts if n > capacity // 8), reverse=True)
    total = sum(counts[n] for n in large)
    target, queues = -(-total // groups) if total else 1, []
    filling = 0
    for n in large:                                             # groups of equal cardinality, longest first
        left = counts[n]
        while left:
            if not queues or filling == target:
                queues.append([])
                filling = 0
            take = min(left, target - filling)
            queues[-1].append([n, take])
            filling, left = filling + take, left - take
    merged: dict[int, list] = {}
    for q in queues:                                            # a group's size is its longest
        merged.setdefault(q[0][0], []).extend(q)
    sizes = list(merged)
    stock = [sum(c for _, c in merged[s]) for s in sizes]
    runs, free = [], {r: [] for r in range(capacity + 1)}       # free[room]: (first sequence, how many)
    sequences = 0
    while sizes:
        use = fill(sizes, stock, capacity)
        times = min(stock[k] // u for k, u in enumerate(use) if u)
        slots = [(merged[sizes[k]], u) for k, u in enumerate(use) if u]
        done = 0
        while done < times:                                     # in each step a place gets documents of one length
            now = min([times - done] + [max(q[0][1] // u, 1) for q, u in slots])
            offset = 0
            for q, u in slots:
                for _ in range(u):
                    n = q[0][0]
                    runs.append((n, used_up[n], now, sequences + done, offset))
                    used_up[n] += now
                    offset += n
                    q[0][1] -= now
                    if not q[0][1]:
                        q.pop(0)
            free[capacity - offset].append((sequences + done, now))
            done += now
        sequences += times
        stock = [s - u * times for s, u in zip(stock, use)]
        sizes, stock = [s for s, k in zip(sizes, stock) if k], [k for k in stock if k]
    for n in sorted((n for n in counts if n <= capacity // 8), reverse=True):
        left, room = counts[n], n
        while left:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:                                 # nothing has room: new sequences
                opened = -(-left // (capacity // n))
                free[capacity].append((sequences, opened))
                sequences += opened
                room = capacity
            first, many = free[room].pop()
            now = min(many, left)
            if many > now:
                free[room].append((first + now, many - now))
            runs.append((n, used_up[n], now, first, capacity - room))
            used_up[n] += now
            left -= now
            free[room - n].append((first, now))
            room = max(n, room - n)                             # what just got smaller may fit best again
    return np.array(runs, dtype=np.int64).reshape(-1, 5), sequences


def _placer(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 7))
            at = np.searchsorted(table["key"], length * (1 << 44) + rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(7)), pa.array(sequence), pa.array(table["offset"][at])],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "sequence_id", "offset"])
    return run


def placed(cut: DataFrame, capacity: int = 2048, groups: int = 512) -> DataFrame:
    """Per piece its ids' checksum, task and rank there (with the length its key), sequence and offset."""
    spark = cut.sparkSession
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = written(per_task.select("length", "task", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")), "ranks")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # a row per length
    runs, _ = plan(counts, capacity, groups)
    key = runs[:, 0] * (1 << 44) + runs[:, 1]
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast({"key": key[order], "rank": runs[order, 1], "sequence": runs[order, 3], "offset": runs[order, 4]})
    ranked = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"), "task", "rank").join(
        before.drop("n"), ["length", "task"]).select("doc_id", "piece", "start", "length", "crc", "task", "rank", (F.col("rank") + F.col("before")).alias("overall"))
    return ranked.mapInArrow(_placer(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long, "
                             "sequence_id long, offset long")


def place(cut: DataFrame, capacity: int = 2048, groups: int = 512) -> DataFrame:
    """Per piece its ids' checksum, sequence and offset."""
    return placed(cut, capacity, groups).drop("task", "rank")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = 2048, groups: int = 512) -> DataFrame:
    """Pieces with their ids, sequence and offset."""
    cut = pieces(docs, tokenizer, capacity)
    where = placed(cut, capacity, groups).select("length", "task", "rank", "sequence_id", "offset")
    return cut.join(where, ["length", "task", "rank"]).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
