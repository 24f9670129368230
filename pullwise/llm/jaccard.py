"""Exact Jaccard self-join on word shingles by partitioning the universe.

Two sets of r <= s shingles with Jaccard 0.8 or more differ in at most (r + s) / 9 shingles. Sets are put into size bands;
a band's scheme cuts the universe of shingle hashes into more segments than its pairs can differ in, so some segment of a
pair holds equal subsets (pigeonhole), and a signature of that subset brings the pair together. A set is indexed in the
scheme of its own band and of the next one, where it may be the smaller partner.

Cost-based allocation: what a segment may cost is decided by its subset alone, so both partners decide alike. Subsets of
two or more shingles are rare and cheap: they are always indexed. Empty ones would meet half the table and are never
indexed; single shingles only by sets that have too few larger subsets to be sure of a match; sets that are still short
index one-deletion neighbourhoods too, which also catch subsets that differ by one shingle; the last few (tiny,
lopsided sets) meet under one catch-all signature of their scheme. A pair is found at the lower level of the two.

Equal sets form one class and are compared once. Signatures travel as packed arrays by bucket. Within a map task equal
signatures are pre-aggregated: the least class stands for the others, so a signature that a third of all rows share
arrives once per task. Of the sets that met, each one's shingles that no other of them holds are counted: they are part of
every difference, so sets with too many link with nothing, and pairs with too many together needn't be formed. Nor need
pairs whose parity sketches differ in more bits than the sets may in shingles: each differing bit needs one. Each group
first links its members to the one with the fewest of them; links are verified exactly on the whole sets. Pairs of a group that are
still in different components are verified too, so no link is lost: there shingles count as own that no other component has, and as
both together may have a ninth of their sizes only, one of the two has an eighth of its own at most. So near copies that don't
link, and copies of them, aren't expanded into their pairs. A pair that shares many signatures is formed under the least it shares.

Odd cases: null, empty and blank texts have no shingles and are linked with nothing; fewer words than a shingle make one
shingle of the whole sequence; repeated rows are equal sets; rows without an id are linked to equal sets only, and a component
takes its least id that isn't null; an empty table gives an empty result. Further columns are never read. Sets are compared by 64-bit
hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise.llm.common import free, in_pieces, mix, partitions, word_hashes
from pullwise.llm.graph import components
from pullwise.session import written

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    hashes, counts = word_hashes(texts, lower=True)
    n = len(hashes)
    grams = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        grams += hashes[j:n - width + 1 + j] * (_FACTORS[j % 5] + np.uint64(2 * j)) if n >= width else 0
    grams = mix(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(grams[at:at + c - width + 1]))
        elif c:
            whole = np.array([c], dtype=np.uint64)
            for k in range(at, at + c):
                whole = mix(whole * _FACTORS[0] + hashes[k:k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += c
    return out


def class_of(items: np.ndarray) -> int:
    """An integer that equal sets share."""
    return int(mix(np.array([mix(items).sum(dtype=np.uint64) + np.uint64(len(items))], dtype=np.uint64)).view(np.int64)[0])


def bands(most: int) -> list[int]:
    """Largest size of each band, up to the one that holds `most` and the next."""
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, tops[-1] * 5 // 4))
    tops.append(max(tops[-1] + 1, tops[-1] * 5 // 4))
    return tops


_TOPS = bands(1 << 22)


def scheme(size: int) -> int:
    if size > _TOPS[-2]:
        _TOPS.extend(bands(size)[len(_TOPS):])              # every process extends them alike
    return int(np.searchsorted(_TOPS, size))


def segments(top: int) -> int:
    """Segments of a scheme: one more than its pairs can differ in, and some that sets may leave unindexed."""
    differ = 2 * top // 9
    return 1 if differ == 0 else differ + 1 + -(-15 * (differ + 1) // 100)


def signatures(items: np.ndarray) -> np.ndarray:
    """Signatures of one set in its two schemes."""
    size, band = len(items), scheme(len(items))
    found = [in_scheme(items, band)]
    if 5 * size >= 4 * (_TOPS[band] + 1):
        found.append(in_scheme(items, band + 1))
    return np.concatenate(found)


def in_scheme(items: np.ndarray, band: int) -> np.ndarray:
    size, top = len(items), _TOPS[band]
    m = segments(top)
    mixed = mix(items)
    tag = np.uint64(band) << np.uint64(40)
    if m == 1:
        return mix(mix(np.array([tag], dtype=np.uint64)) + mixed.sum(dtype=np.uint64))
    need = (size + min(top, size * 5 // 4)) // 9 + 1
    place = ((items >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)       # grows with the hash, so segments are runs
    counts = np.bincount(place.astype(np.int64), minlength=m)
    ends = np.cumsum(counts)
    total = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
    sums = total[ends] - total[ends - counts]
    large, single = int((counts >= 2).sum()), int((counts == 1).sum())
    least = 2 if large >= need else 1
    used = np.flatnonzero(counts >= least)
    salt = mix(tag + used.astype(np.uint64) + np.uint64(1))
    out = [mix(salt + sums[used])]
    if large + single < need:                                               # one-deletion neighbourhoods
        deep = counts[place.astype(np.int64)] >= 2
        at = place[deep]
        out.append(mix(mix(tag + at + np.uint64(1)) + sums[at.astype(np.int64)] - mixed[deep]))
        if 2 * large + single < need:
            out.append(mix(np.array([tag + (np.uint64(1) << np.uint64(36))], dtype=np.uint64)))
    return np.unique(np.concatenate(out))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        for i, j in in_pieces(texts):
            sets = shingle_sets(texts[i:j])
            yield pa.RecordBatch.from_arrays([
                b.column(0).slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([class_of(x) if len(x) else None for x in sets], pa.int64())], ["doc_id", "n_shingles", "class"])


def _indexer(buckets: int, flush: int = 1 << 21):
    """Signatures of a map task: packed by bucket for the shuffle, one class per signature; the classes that share one here go
    out as members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []
        n = 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in in_pieces(texts):
                for items in shingle_sets(texts[i:j]):
                    if len(items) and (c := class_of(items)) not in seen:
                        seen.add(c)
                        s = signatures(items)
                        held.append((c, s))
                        n += len(s)
                if n >= flush:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    def pack(held):
        sigs = np.concatenate([s for _, s in held])
        owner = np.repeat(np.array([c for c, _ in held], dtype=np.int64), [len(s) for _, s in held])
        kept, owners, shared = least_of(sigs, owner)
        rows = [(-1, shared[0].tobytes(), shared[1].tobytes(), b"")] if len(shared[0]) else []
        bucket = (kept >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        kept, owners, bucket = kept[order], owners[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for x, y in zip(cuts, np.append(cuts[1:], len(kept))):
            known, where = np.unique(owners[x:y], return_inverse=True)
            rows.append((int(bucket[x]), kept[x:y].tobytes(), known.tobytes(), where.astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [
            pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)], ["bucket", "sigs", "classes", "places"])

    return run


def least_of(sigs: np.ndarray, owner: np.ndarray):
    """Per signature its least class; and, of signatures with several classes, (signature, class) of each member."""
    order = np.lexsort((owner, sigs))
    sigs, owner = sigs[order], owner[order]
    first = np.concatenate(([True], sigs[1:] != sigs[:-1])) if len(sigs) else np.zeros(0, dtype=bool)
    group = np.cumsum(first) - 1
    several = np.bincount(group, minlength=int(first.sum()))[group] > 1 if len(sigs) else first
    return sigs[first], owner[first], (sigs[several].view(np.int64), owner[several])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unpacks the members found in map tasks, and finds those that meet across tasks, bucket by bucket."""
    def out(shared):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in shared], ["sig", "class"])

    def close(held):
        return least_of(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))[2]

    held, now = [], None
    for b in batches:
        for bucket, sigs, classes, places in zip(*(b.column(k).to_pylist() for k in range(4))):
            if bucket < 0:
                yield out([np.frombuffer(x, dtype=np.int64) for x in (sigs, classes)])
                continue
            if bucket != now and held:
                yield out(close(held))
                held = []
            now = bucket
            held.append((np.frombuffer(sigs, dtype=np.uint64), np.frombuffer(classes, dtype=np.int64)[np.frombuffer(places, dtype=np.uint32)]))
    if held:
        yield out(close(held))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        for i, j in in_pieces(texts):
            expected, found = b.column(0).slice(i, j - i).to_pylist(), shingle_sets(texts[i:j])
            rows = [(c, x.tobytes()) for c, x in zip(expected, found) if len(x) and class_of(x) == c]    # an id may stand for several texts
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                             ["class", "items"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        linked = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                linked.append(False)
                continue
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            linked.append(100 * both >= 80 * (len(x) + len(y) - both))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes that link."""
    one = sets.select(F.col("class").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("class").alias("b"), F.col("items").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c, x in zip(b.column(0).to_pylist(), b.column(1)):
            items = np.frombuffer(x.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), c, dtype=np.int64)), pa.array(items)], ["class", "item"])


def own_shingles(sets: DataFrame) -> DataFrame:
    """Per class its size and own: the shingles that no other of these sets has. Items are counted after map-side combine."""
    once = sets.mapInArrow(_hashes, "class long, item long").groupBy("item").agg(F.min("class").alias("class"), F.max("class").alias("other"))
    own = once.filter(F.col("class") == F.col("other")).groupBy("class").agg(F.count(F.lit(1)).alias("own"))
    return sets.mapInArrow(_sketch, "class long, size long, " + ", ".join(f"{x} long" for x in SKETCH)).join(
        own, "class", "left").fillna(0, ["own"])


def _placed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            items = np.frombuffer(x.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), v, dtype=np.int64)) for v in (c, k)] + [pa.array(items)], ["class", "component", "item"])


def own_to_component(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """Per class of (class, component) its own: the shingles that no class of another component has. Copies that link share theirs, so
    this stays as it is however many there are."""
    rows = sets.join(placed, "class").select("class", "component", "items").mapInArrow(_placed_hashes, "class long, component long, item long")
    single = rows.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo = hi").select("item")
    own = rows.join(single, "item").groupBy("class").agg(F.count(F.lit(1)).alias("own"))
    return placed.select("class").join(own, "class", "left").fillna(0, ["own"])


SKETCH = [f"k{i}" for i in range(8)]        # 512 parity bits


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = 64 * len(SKETCH)
    for b in batches:
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in b.column(1)]
        parity = np.array([np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 for x in sets], dtype=np.uint8).reshape(-1, bits)
        words = np.packbits(parity, axis=1).view(np.int64).reshape(-1, len(SKETCH))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(words[:, i]) for i in range(len(SKETCH)))],
                                         ["class", "size", *SKETCH])


def _as(rows: DataFrame, x: str) -> DataFrame:
    """The members' columns named for one side of a pair."""
    return rows.select("sig", F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("own", "size", *SKETCH)],
                       *[F.col(c).alias(f"{c}_{x}") for c in ("component", "light", "first") if c in rows.columns])


def _may_link() -> Column:
    """Whether classes a and b differ little enough by their sizes, own shingles and sketches to link."""
    both = F.col("size_a") + F.col("size_b")
    differ = sum((F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in SKETCH), F.lit(0))
    return (F.col("a") != F.col("b")) & (9 * (F.col("own_a") + F.col("own_b")) <= both) & (
        5 * F.least("size_a", "size_b") >= 4 * F.greatest("size_a", "size_b")) & (9 * differ <= both)


FIRST = 16      # least signatures of a class that ride on its members


def _met_before() -> Column:
    """Whether classes a and b are seen to share a lesser signature than this one, under which they are paired already. They never are
    under the least one they share, so each pair is formed, and most are once."""
    return F.arrays_overlap(F.filter("first_a", lambda s: s < F.col("sig")), F.filter("first_b", lambda s: s < F.col("sig")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, component): equal sets share a class, linked classes a component; both null without shingles."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = written(texts.mapInArrow(_sizes, "doc_id long, n_shingles long, class long"), "sizes")
    n = 4 * partitions(spark)
    packed = texts.select("text").mapInArrow(_indexer(n), "bucket int, sigs binary, classes binary, places binary")
    dealt = packed.repartition(partitions(spark), F.when(F.col("bucket") < 0, F.xxhash64("sigs")).otherwise(F.col("bucket")))
    members = written(dealt.sortWithinPartitions("bucket").mapInArrow(_members, "sig long, class long").distinct(), "members")
    # the sets of the classes that meet another one, from one document of each
    chosen = sizes.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(members.select("class").distinct().join(chosen, "class"), "wanted")
    sets = written(texts.join(wanted.filter("doc_id is not null").hint("merge"), "doc_id").select("class", "text")
                   .mapInArrow(_arrays, "class long, items binary").dropDuplicates(["class"]), "sets")
    able = written(own_shingles(sets).filter("5 * (size - own) >= 4 * size"), "able")
    met = written(members.join(able, "class"), "met")
    centres = met.groupBy("sig").agg(F.min(F.struct("own", "class", "size", *SKETCH)).alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    star = written(_as(met, "b").join(_as(centres.select("sig", "c.*"), "a"), "sig").filter(_may_link()).select("a", "b").distinct(), "star")
    links = written(verified(star, sets), "links")
    found = components(links)
    # signatures whose members aren't in one component yet: every pair across components that may link
    placed = met.join(found.withColumnRenamed("v", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("sig")
    open_ = written(placed.join(mixed, "sig", "left_semi"), "open")
    if open_.limit(1).count():
        own = written(own_to_component(sets, open_.select("class", "component").distinct()), "own")
        first = open_.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST).alias("first"))        # of a set's own signatures
        open_ = open_.drop("own").join(own.join(first, "class"), "class")
        # both together may have few shingles of their own, so one of them has few
        light = 8 * F.col("own") <= F.col("size")
        left, right = _as(open_.filter(light), "a"), _as(open_.withColumn("light", light), "b").withColumnRenamed("sig", "sig_b")
        across = left.join(right, (F.col("sig") == F.col("sig_b")) & (F.col("component_a") != F.col("component_b")) & (
            ~F.col("light_b") | (F.col("a") < F.col("b"))) & ~_met_before() & _may_link()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = written(verified(across.join(tried, ["a", "b"], "left_anti"), sets), "links")
        if more.limit(1).count():
            found = components(links.unionByName(more))
    return sizes.join(found.withColumnRenamed("v", "class"), "class", "left").select(
        "doc_id", "n_shingles", "class", F.coalesce("component", "class").alias("component"))


def component_ids(found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id of the component; a document without shingles is its own."""
    least = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that link, directly or through others, with one of a smaller doc_id; all columns stay.
    Of repeated rows of the kept doc_id all stay, as they are one document."""
    result = component_ids(near_duplicates(docs))
    name = free("_gone", docs.columns)
    gone = written(result.filter("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col(name), "left_anti")
