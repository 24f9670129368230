"""Mixing sources to target weights along a time-varying curriculum.

Targets: the weights share `share` times all words; a source gives at most `most` times its own words, and what it can't
give is shared again by weight (water filling, in closed form over the sources sorted by cap per weight).
Each source has a weight schedule over training time, linear from its start to its end value; its integral gives
the cumulative demand for the source's words, and inverting that demand at the words a copy follows in its source gives the
copy's training position. Sorting by position makes the curriculum.

Within a source documents come in the order of a digest of their id, so reruns agree. Running sums are taken in two levels
(blocks of the digest, then blocks per source), so no window spans a source. Copies are taken whole or not at all: the one that
crosses the target is taken if that is nearer to it, so a source misses its target by half a document at most.

Odd cases: null texts have no words; a null source is a source, last; documents without words take nothing; repeated rows are
mixed each, and as they tie in every key it doesn't matter which is which; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullwise.llm.common import count_words, free, text_of
from pullwise.session import written

WEIGHTS = (5, 2, 1)                                     # by rank of the source, repeating
RAMPS = ((1.4, 0.6), (1.0, 1.0), (0.6, 1.4))            # of each weight, at the start and the end; the mean is 1


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))


def sized(docs: DataFrame, *keep: str, source: str = "source") -> DataFrame:
    """The kept columns with size, source key and digest."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(*keep, count_words(text_of()).alias("_size"), _key(source).alias("_key"), digest.alias("_order"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source key its size, weight class and target. One row per source goes through one task."""
    by_source = sizes.groupBy("_key").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy((F.col("_key") == "-").cast("int"), F.col("_key"))
    kind = (F.row_number().over(order) - 1) % len(weights)
    ranked = by_source.withColumn("kind", kind).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind")))
    ranked = written(ranked.withColumn("cap", (F.col("source_size") * most).cast("double")), "sources")
    before = Window.orderBy(F.col("cap") / F.col("weight"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    total, weight, n = (lambda r: (r[0] or 0, r[1] or 0.0, r[2] or 0))(ranked.agg(F.sum("source_size"), F.sum("weight"), F.sum("n")).first())
    level = ranked.select((F.col("cap") / F.col("weight")).alias("until"), (
        (F.lit(float(share) * total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.lit(weight) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"))
    found = level.filter("level <= until").agg(F.min_by("level", "until")).first()[0]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.col("weight") * F.lit(found))
    return ranked.select("_key", "kind", "source_size", target.alias("target"), F.lit(int(n)).cast("long").alias("n_docs"))


def position(part: Column, start: Column, end: Column) -> Column:
    """The time at which this part of a linear schedule's integral is used up."""
    slope = end - start
    return F.when(F.abs(slope) < 1e-12, part).otherwise(
        (F.sqrt(F.greatest(start * start + (end * end - start * start) * part, F.lit(0.0))) - start) / slope)


def takes(sizes: DataFrame, of: DataFrame, most: int = 2, ramps=RAMPS) -> DataFrame:
    """The rows with source_size, target, and copies: (epoch, words taken, position) of each copy that is taken."""
    row = of.select(F.max("n_docs")).first()
    blocks = max(256, (row[0] or 0) // 5000)
    block = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * blocks / float(1 << 32)).cast("long")
    dealt = sizes.withColumn("_block", block)
    summed = dealt.groupBy("_key", "_block").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(summed.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(of, "_key").select(
        "_key", "_block", "_before", "kind", "source_size", "target"), "offsets")
    within = Window.partitionBy("_key", "_block").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(offsets, ["_key", "_block"]).withColumn("_at", F.col("_before") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
    goal = F.round("target").cast("long")
    start = F.get(F.array(*[F.lit(float(a)) for a, _ in ramps]), F.col("kind"))
    end = F.get(F.array(*[F.lit(float(b)) for _, b in ramps]), F.col("kind"))
    copies = []
    for e in range(most):
        at = F.col("_at") + e * F.col("source_size")
        words = F.when(2 * at + F.col("_size") <= 2 * goal, F.col("_size")).otherwise(F.lit(0)).cast("long")
        part = F.when(F.col("target") > 0, F.least(at / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
        copies.append(F.struct(F.lit(e).alias("epoch"), words.alias("words"), position(part, start, end).alias("position")))
    return placed.withColumn("_copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))


def mix(docs: DataFrame, source: str = "source", share: float = 1.5, most: int = 2) -> DataFrame:
    """The mixed rows in training order: the documents' columns, then position and epoch, named `_position` and `_epoch` or, where the
    documents have these, with further underscores before."""
    names = docs.columns
    row = docs.select("doc_id", "text", source, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_all"))
    sizes = written(sized(docs, "doc_id", source=source), "sizes")
    of = targets(sizes, share=share, most=most)
    chosen = takes(sized(row, "doc_id", "_all", source=source), of, most)
    copies = chosen.select("_all", F.explode("_copies").alias("_copy"))
    position, epoch = free("_position", names), free("_epoch", names)
    return copies.select(*[F.col(f"_all.`{c}`").alias(c) for c in names], F.col("_copy.position").alias(position), F.col("_copy.epoch").alias(epoch)).orderBy(
        position, "doc_id", epoch)


def taken_words(docs: DataFrame, source: str = "source", share: float = 1.5, most: int = 2) -> DataFrame:
    """Per row doc_id, size, source_size, target, taken and the position of its first copy."""
    sizes = written(sized(docs, "doc_id", source=source), "sizes")
    chosen = takes(sizes, targets(sizes, share=share, most=most), most)
    return chosen.select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                         F.aggregate("_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
                         F.get(F.col("_copies"), F.lit(0))["position"].alias("first_position"))
