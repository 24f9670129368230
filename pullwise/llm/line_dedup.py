"""Removal of repeated runs of lines by comparing windows of whole lines.

A window is the fewest consecutive lines that hold `least_words` words; one begins and one ends at every line, and all of them
are kept and compared by a hash of their content: they aren't thinned to selected fingerprints, and no match is extended,
as every line of a repeated run then lies in a repeated window. The least line hash in a window (its mark) only drops windows
whose mark stands at one place before they are grouped by content; equal contents have equal marks, so it changes no result.
The first place where the same lines stand keeps them, and in every later place (a larger doc_id, or further down the same
text) they are deleted.
Matched windows overlap into maximal runs: every line of a repeated run of that many words lies in a window within the run
that begins at it or before and one that ends at it or after, so nothing of the run stays.

Blank lines don't count, and go only if both neighbours go. Runs with fewer words stay, however often they occur.
Nothing gathers the places of a common line: first places are aggregates with map-side combine, and places meet them in joins
that adaptive execution can split.

Odd cases: null and empty texts stay as they are; rows with one doc_id and text are one document and stay alike; a null doc_id
comes last; an empty table gives an empty table; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullwise.llm.common import count_words, partitions
from pullwise.session import written


def _digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def lines_of(docs: DataFrame) -> DataFrame:
    """Non-blank lines: doc, digest of the text, at (place among all lines), hash, n (words)."""
    lines = docs.filter(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), _digest().alias("digest"),
        F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("at", "line"))
    return lines.select("doc", "digest", "at", F.xxhash64("line").alias("hash"), count_words(F.col("line")).alias("n")).filter("n > 0")


def windows(lines: DataFrame, least_words: int) -> DataFrame:
    """Windows that begin (or end) at a line: doc, digest, first and last line, fingerprint and content."""
    place = Window.partitionBy("doc", "digest").orderBy("at")
    lines = lines.repartition(partitions(lines.sparkSession), "doc", "digest").dropDuplicates(["doc", "digest", "at"])
    ends = lines.withColumn("end", F.sum("n").over(place)).withColumn("begin", F.col("end") - F.col("n"))
    ahead = Window.partitionBy("doc", "digest").orderBy("begin").rangeBetween(0, least_words - 1)
    behind = Window.partitionBy("doc", "digest").orderBy("end").rangeBetween(1 - least_words, 0)
    values = {}
    for name, over in (("ahead", ahead), ("behind", behind)):
        for field, value in (("first", F.min("at")), ("last", F.max("at")), ("mark", F.min("hash")), ("n", F.sum("n")), ("lines", F.collect_list("hash"))):
            values[f"{name}_{field}"] = value.over(over)
    both = [F.struct(*[F.col(f"{name}_{f}").alias(f) for f in ("first", "last", "mark", "n", "lines")]) for name in ("ahead", "behind")]
    each = ends.withColumns(values).select("doc", "digest", F.explode(F.array(*both)).alias("w")).filter(F.col("w.n") >= least_words)
    return each.select("doc", "digest", "w.first", "w.last", "w.mark", F.xxhash64("w.lines").alias("content"))


def repeated(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """Per document (doc, digest) with lines to delete: `runs`, sorted and disjoint (first, last)."""
    found = written(windows(lines_of(docs), least_words), "windows")
    marks = found.select("mark", F.struct("doc", "first").alias("p")).groupBy("mark").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    shared = found.join(marks.filter("lo != hi").select("mark"), "mark", "left_semi")
    place = F.struct("doc", "first")
    firsts = shared.groupBy("content").agg(F.min(place).alias("source"), F.max(place).alias("latest"), F.count(F.lit(1)).alias("n")).filter("source != latest")
    later = shared.join(firsts.select("content", "source"), "content").filter(place > F.col("source"))
    spans = later.select("doc", "digest", "first", "last").distinct()
    order = Window.partitionBy("doc", "digest").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("new", (F.coalesce(reach, F.lit(-2)) + 1 < F.col("first")).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(order)).groupBy("doc", "digest", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc", "digest").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs: slices between them, so the work is that of the lines and runs together."""
    opened = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    closed = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    spans = F.zip_with(opened, closed, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    return F.flatten(F.transform(spans, lambda s: F.slice(lines, s["a"] + 1, F.greatest(s["n"], F.lit(0)))))


def dedup_lines(docs: DataFrame, least_words: int = 50, drop_emptied: bool = False) -> DataFrame:
    """The documents without later repeated runs; n_chars, if there, follows. drop_emptied: documents of which no word is left go."""
    names = docs.columns
    runs = written(repeated(docs, least_words), "runs")
    row = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), _digest().alias("_digest"),
                      F.split(F.col("text").cast("string"), "\n", -1).alias("_lines"),
                      F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_all"))
    met = row.join(runs.select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), "runs").hint("merge"), ["_doc", "_digest"], "left")
    kept = met.select("_all", "runs", F.when(F.col("runs").isNull(), F.array_join("_lines", "\n")).otherwise(
        F.array_join(without(F.col("_lines"), F.col("runs")), "\n")).alias("_text"))
    if drop_emptied:
        kept = kept.filter(F.col("runs").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {"text": F.col("_text")}
    if "n_chars" in names:
        columns["n_chars"] = F.when(F.col("runs").isNull(), F.col("_all.n_chars")).otherwise(F.length("_text").cast("long"))
    return kept.select(*[columns[c].alias(c) if c in columns else F.col(f"_all.`{c}`").alias(c) for c in names])
