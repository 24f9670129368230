"""Phrases that stand together more often than their parts, counted by vertical partitioning of a suffix tree.

Every word starts a suffix, cut off after `max_words` words or where its piece of text ends. The suffixes are grouped by word
prefixes so that a group fits the memory budget: first words are put into a fixed number of buckets and neighbouring buckets
are packed into groups; a bucket over the budget is extended by the second word, and a pair of words that holds more than a
share of all suffixes by the third. A map task collapses equal suffixes first, so what goes to a group are distinct suffixes with
counts, as codes into a dictionary of the message's words. Each group builds its subtree on its own; a node's count is the total of
the leaves below it, so phrases of every length come from one pass. A group over its memory gives out partial totals, which are
added up like those of split prefixes.

Words are compared by 64-bit hashes. The vocabulary shows whether two words of a language share one; if so, the counts are
made again with another hash, so results are exact.

Odd cases: null texts are empty; a null language is `und`; an empty table gives an empty result; repeated rows count each; very long
texts are read whole, in runs of a megabyte; equal scores and counts are told apart by the phrase's bytes. Further columns are
never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullwise.llm.common import _SPACES, _hash_run, mix, partitions
from pullwise.session import written

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(b".,;:!?" + UPPER, b"\n\n\n\n\n\n" + LOWER)     # what ends a piece becomes a line break
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[10:14] = True
SLICE, RUN = 8 << 20, 1 << 20       # characters collapsed together, bytes hashed together
PREFIXES = 1 << 16                  # buckets of first words
SHARES = 64                         # in which the phrases of a language are ranked first
SHARE = 2048                        # a pair of words with more than one in so many suffixes is a prefix of its own


def _other_hash(data: np.ndarray, starts: np.ndarray, how: int) -> np.ndarray:
    ends = np.flatnonzero(_SPACES[data])
    raw, to = data.tobytes(), ends[np.searchsorted(ends, starts)]
    digests = b"".join(hashlib.blake2b(raw[s:e], digest_size=8, salt=how.to_bytes(8, "little")).digest() for s, e in zip(starts, to))
    return np.frombuffer(digests, dtype=np.uint64)


def tokens(texts: list[str], how: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, hashes, starts, pieces) of all words of the texts; words of one piece share its number."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass").translate(_FOLD), dtype=np.uint8)
    hashes, starts, pieces, at, piece = [], [], [], 0, 0
    while at < len(data):
        to = min(at + RUN, len(data))
        while not _SPACES[data[to - 1]]:                # the last byte of all is a break
            more = np.flatnonzero(_SPACES[data[to:to + 4096]])
            to = to + int(more[0]) + 1 if len(more) else min(to + 4096, len(data))
        part = data[at:to]
        h, s = _hash_run(part)
        breaks = np.cumsum(_BREAKS[part])
        hashes.append(_other_hash(part, s, how) if how else h)
        starts.append(s + at)
        pieces.append(breaks[s] + piece)
        at, piece = to, piece + int(breaks[-1])
    return data, np.concatenate(hashes), np.concatenate(starts), np.concatenate(pieces)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """The texts of a slice, language by language; only a slice of a batch is held as Python strings."""
    for b in batches:
        found: dict[str, list[str]] = {}
        held = 0
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    found.setdefault(lang, []).append(text)
                    held += len(text)
            if held >= SLICE:
                yield from found.items()
                found, held = {}, 0
        yield from found.items()


SEEN = "lang string, first long, second long, word string, n long"


def _vocabulary(how: int):
    """Words with counts, and the pairs that are frequent where they are (with their first and second word's hash)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_language(batches):
            data, hashes, starts, pieces = tokens(texts, how)
            if not len(hashes):
                continue
            known, first, code, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            spaces, raw = np.flatnonzero(_SPACES[data]), data.tobytes()
            ends = spaces[np.searchsorted(spaces, starts[first])]
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first].tolist(), ends.tolist())]
            pair = (code[:-1] * len(known) + code[1:])[pieces[:-1] == pieces[1:]]
            pairs, m = np.unique(pair, return_counts=True)
            pairs, m = pairs[m * (2 * SHARE) > len(hashes)], m[m * (2 * SHARE) > len(hashes)]
            none = np.zeros(len(pairs), dtype=bool)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(known) + len(pairs)), pa.string()),
                pa.array(np.concatenate([known, known[pairs // len(known)]]).view(np.int64)),
                pa.array(np.concatenate([known, known[pairs % len(known)]]).view(np.int64), mask=np.concatenate([~np.zeros(len(known), dtype=bool), none])),
                pa.array(words + [None] * len(pairs), pa.string()),
                pa.array(np.concatenate([n, m]).astype(np.int64))], ["lang", "first", "second", "word", "n"])
    return run


class Groups:
    """Which group a suffix belongs to: tables of a fixed size, whatever the corpus."""

    def __init__(self, totals: dict[int, int], pairs: list[tuple[str, int, int, int]], budget: int) -> None:
        self.first, self.parts = np.zeros(PREFIXES, dtype=np.int64), np.ones(PREFIXES, dtype=np.int64)
        group, held = 0, 0
        for b in range(PREFIXES):
            n = totals.get(b, 0)
            if held and held + n > budget:
                group, held = group + 1, 0
            self.first[b], self.parts[b] = group, max(1, -(-n // budget))
            group, held = (group + int(self.parts[b]), 0) if n > budget else (group, held + n)
        self.pairs: dict[str, list[tuple[int, int, int, int]]] = {}
        group += 1
        for lang, a, b, n in pairs:
            self.pairs.setdefault(lang, []).append((a, b, group, -(-n // budget)))
            group += -(-n // budget)
        self.count = group

    def of(self, lang: str, words: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(group, whether its prefix is split over groups) of each suffix, given as codes from 1 into the words."""
        one, two = words[columns[0] - 1], words[columns[1] - 1]
        bucket = (one >> np.uint64(48)).astype(np.int64)
        group = self.first[bucket] + (mix(two) % self.parts[bucket].astype(np.uint64)).astype(np.int64)
        split = np.zeros(len(one), dtype=bool)
        known = self.pairs.get(lang)
        if known:
            a, b = (np.array([p[k] for p in known], dtype=np.int64).view(np.uint64) for k in (0, 1))
            begin, parts = (np.array([p[k] for p in known], dtype=np.int64) for k in (2, 3))
            ia, ib = (np.minimum(np.searchsorted(words, x), len(words) - 1) for x in (a, b))
            here = (words[ia] == a) & (words[ib] == b)
            key = (ia[here] + 1) * (len(words) + 1) + ib[here] + 1
            order = np.argsort(key)
            key, begin, parts = key[order], begin[here][order], parts[here][order]
            own = columns[0].astype(np.int64) * (len(words) + 1) + columns[1]
            if len(key):
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                split = key[at] == own
                last = mix(np.concatenate([np.zeros(1, dtype=np.uint64), words])[columns[2]]) if len(columns) > 2 else mix(two)
                group = np.where(split, begin[at] + (last % parts[at].astype(np.uint64)).astype(np.int64), group)
        return group, split


def collapse(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows once, in the order of their codes, with the sum of their counts."""
    if not len(counts):
        return columns, counts
    node = columns[0].astype(np.int64)
    for c in columns[1:]:
        node = np.unique(node * (int(c.max()) + 1) + c, return_inverse=True)[1]
    _, first, node = np.unique(node, return_index=True, return_inverse=True)
    return [c[first] for c in columns], np.bincount(node, counts).astype(np.int64)


MESSAGE = "group long, lang string, split boolean, n int, words binary, codes binary, counts binary"


def _code_type(size: int):
    return np.uint16 if size < 1 << 16 else np.uint32


def _dealer(how: int, groups: Groups, max_words: int):
    """Distinct suffixes of two words or more of each slice of texts, a message per group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_language(batches):
            _, hashes, _, pieces = tokens(texts, how)
            if len(hashes) < 2:
                continue
            words, code = np.unique(hashes, return_inverse=True)
            begin = np.flatnonzero(pieces[:-1] == pieces[1:])
            if not len(begin):
                continue
            code, pieces = np.concatenate([code + 1, np.zeros(max_words, dtype=code.dtype)]), np.concatenate([pieces, np.full(max_words, -1)])
            columns = [np.where(pieces[begin + d] == pieces[begin], code[begin + d], 0) for d in range(max_words)]
            columns, counts = collapse(columns, np.ones(len(begin), dtype=np.int64))
            group, split = groups.of(lang, words, columns)
            order = np.argsort(group * 2 + split, kind="stable")
            key = (group * 2 + split)[order]
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            rows = []
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)]):
                at = order[x:y]
                used, local = np.unique(np.concatenate([np.zeros(1, dtype=np.int64), *[c[at] for c in columns]]), return_inverse=True)
                local = local[1:].astype(_code_type(len(used)))              # 0 stays 0: no further word
                rows.append((int(key[x]) >> 1, bool(key[x] & 1), y - x, words[used[1:] - 1].tobytes(), local.tobytes(),
                             counts[at].astype(np.uint32).tobytes()))
            g, s, n, w, c, m = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(g, pa.int64()), pa.array([lang] * len(rows), pa.string()), pa.array(s, pa.bool_()), pa.array(n, pa.int32()),
                pa.array(w, pa.binary()), pa.array(c, pa.binary()), pa.array(m, pa.binary())], [x.split()[0] for x in MESSAGE.split(", ")])
    return run


def _merge(held: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]):
    words, code = np.unique(np.concatenate([w for w, _, _ in held]), return_inverse=True)
    columns, at = [], 0
    for w, cs, _ in held:
        to = np.concatenate([np.zeros(1, dtype=np.int64), code[at:at + len(w)] + 1])
        columns.append([to[c] for c in cs])
        at += len(w)
    return words, *collapse([np.concatenate(c) for c in zip(*columns)], np.concatenate([n for _, _, n in held]))


def _trees(max_words: int, min_count: int, limit: int):
    """Nodes of each group's subtree: phrases of two words or more with the totals of their leaves.

    Nodes below min_count are left out unless others may hold a part of them."""
    def nodes(lang, tree, least):
        words, columns, counts = tree
        for depth in range(2, max_words + 1):
            there = columns[depth - 1] > 0
            above, totals = collapse([c[there] for c in columns[:depth]], counts[there])
            keep = totals >= least
            if keep.any():
                flat = words[np.stack([c[keep] for c in above], axis=1).ravel() - 1].view(np.int64)
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n, pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(0, n * depth + 1, depth), pa.int32()), pa.array(flat)),
                    pa.array(totals[keep])], ["lang", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, parted = [], 0, None, False
        for b in batches:
            for group, lang, split, n, words, codes, counts in zip(*(b.column(k).to_pylist() for k in range(7))):
                if (group, lang, split) != now:
                    if held:
                        yield from nodes(now[1], _merge(held), 1 if parted else min_count)
                    held, size, now, parted = [], 0, (group, lang, split), split
                words = np.frombuffer(words, dtype=np.uint64)
                columns = np.frombuffer(codes, dtype=_code_type(len(words) + 1)).reshape(max_words, n)
                held.append((words, list(columns), np.frombuffer(counts, dtype=np.uint32).astype(np.int64)))
                size += n
                if size >= limit:
                    tree = _merge(held)
                    if 2 * len(tree[2]) > limit:
                        yield from nodes(lang, tree, 1)
                        held, size, parted = [], 0, True
                    else:
                        held, size = [tree], len(tree[2])
        if held:
            yield from nodes(now[1], _merge(held), 1 if parted else min_count)
    return run


def _vocabulary_of(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, first, second, word, n), and the hash under which no two words of a language share a number."""
    how = 0
    while True:
        seen = texts.mapInArrow(_vocabulary(how), SEEN)
        found = written(seen.groupBy("lang", "first", "second").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n")), "vocabulary")
        if not found.filter("second is null and word != other").limit(1).count():
            return found.drop("other"), how
        how += 1


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10, budget: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, phrases): (lang, first, word, n) of all words, and (lang, words, n) of the phrases of two to `max_words` words that
    occur `min_count` times or more, words being the hashes of the vocabulary. budget: suffixes that a group may hold."""
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")
    found, how = _vocabulary_of(texts)
    words, pairs = found.filter("second is null").drop("second"), found.filter("second is not null")
    totals = {r["b"]: r["n"] for r in words.groupBy(F.shiftrightunsigned("first", 48).alias("b")).agg(F.sum("n").alias("n")).collect()}     # PREFIXES rows at most
    hot = pairs.filter(F.col("n") * SHARE > sum(totals.values())).select("lang", "first", "second", "n").collect()                      # SHARE rows at most
    groups = Groups(totals, [tuple(r) for r in hot], budget)
    dealt = texts.mapInArrow(_dealer(how, groups, max_words), MESSAGE).repartition(partitions(spark), "group").sortWithinPartitions("group", "lang", "split")
    nodes = dealt.mapInArrow(_trees(max_words, min_count, budget), "lang string, words array<long>, n long")
    return words, written(nodes.groupBy("lang", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "phrases")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(15,0)")


def collocations(docs: DataFrame, top: int = 2000, max_words: int = 3, min_count: int = 10, covered: int = 50, budget: int = 1 << 21) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language by score.

    a is the phrase's count, l and r those of its two parts at the cut with the lowest score floor(1000000 a a / (l r)). Phrases that
    lie inside a longer one with `covered` per cent of their count or more are left out. top: phrases per language."""
    words, phrases = phrase_counts(docs, max_words, min_count, budget)
    counts = words.filter(F.col("n") >= min_count).select("lang", F.array("first").alias("words"), "n").unionByName(phrases)
    left, right = (counts.select("lang", F.col("words").alias(x), F.col("n").alias(c)) for x, c in (("begin", "l"), ("rest", "r")))
    cuts = phrases.select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"begin": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.size("words"))})
    scored = cuts.join(left, ["lang", "begin"]).join(right, ["lang", "rest"]).withColumns({"_a": _exact("a"), "_l": _exact("l"), "_r": _exact("r")}).select(
        "lang", "words", "a", "k", "l", "r", F.expr("(_a * _a * 1000000bd) div (_l * _r)").alias("score"))
    best = scored.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every shorter phrase inside a longer one
    inside = phrases.filter(F.size("words") > 2).select("lang", "n", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m")).select(
        "lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1), lambda i: F.slice("words", i, F.col("m")))).alias("words"))
    longest = inside.groupBy("lang", "words").agg(F.max("n").alias("longer"))
    kept = best.join(longest, ["lang", "words"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    spelt = kept.select("lang", "words", "a", "cut", F.posexplode("words").alias("at", "first")).join(words.select("lang", "first", "word"), ["lang", "first"]).groupBy(
        "lang", "words", "a", "cut").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))             # the best of each share of a language first, so none is one task's
    ranked = spelt.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
