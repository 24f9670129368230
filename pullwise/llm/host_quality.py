"""Quality rules judged by host: rule failures per domain, rates shrunk by an empirical beta prior, verdicts joined back.

Every document gets its own signals. Per host the failures of each rule are counted, and each failure rate is shrunk
towards the corpus by a beta prior fitted by moments to all hosts, so that a host with few documents isn't condemned
by them. A host whose shrunk rate passes `limit` for any rule is rejected, and its documents with it; a document that
fails a base rule is rejected by itself.

Results in odd cases: a null or empty text has no words and fails; a null host is a host like any other; repeated rows
are judged one by one alike; an empty table gives an empty table; further columns are passed through untouched by
`judge` (those named like a signal are replaced) and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise.llm.common import BLANKS, array_sum, let, text_of, words_of
from pullwise.session import written

SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more, first windows included.

    The windows' 64-bit hashes are sorted with their places, so equal ones are neighbours: n log n, whatever repeats."""
    def covered(at: Column) -> Column:
        return array_sum(F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(at, i + 1) - p), F.lit(3)).cast("long")))

    def of_sorted(s: Column) -> Column:
        return let(F.sort_array(F.transform(F.filter(s, lambda g, i: (F.get(s, i - 1)["h"] == g["h"]) | (F.get(s, i + 1)["h"] == g["h"])),
                                            lambda g: g["p"])), covered)

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), of_sorted))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))

    return of_words(words)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0),
               lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def signals(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row the kept columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.col("_text")
    counted = docs.select(*keep, text_of().alias("_text")).select(
        *keep, F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_lines(t).alias("n_dup_lines"), F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"),
        let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("_w"))
    out = counted.select(*keep, F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_lines",
                         F.col("_w.r").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def failures(of: DataFrame) -> DataFrame:
    """The signals with one 0/1 column f_<rule> per rule."""
    n, c = F.col("n_words"), F.col
    rules = {"short": n < 50, "repeats": 100 * c("n_repeat_words") > 50 * n, "symbols": 10 * c("n_symbols") > n,
             "dup_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
             "word_length": (c("word_chars") < 3 * n) | (c("word_chars") > 12 * n) | (n == 0)}
    return of.select("*", *[v.cast("long").alias(f"f_{k}") for k, v in rules.items()])


def host_verdicts(failed: DataFrame, host: str = "source", limit: float = 0.75) -> DataFrame:
    """Per host its documents, shrunk failure rate of each rule and host_rejected.

    The prior of a rule has the mean of all documents and the precision that matches the spread of the hosts' rates
    (moments, weighted by documents, with the binomial part taken off); hosts that all look alike give a strong prior."""
    hosts = written(failed.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES]), "hosts")
    sums = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"),
                     *[F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES],
                     *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}") for r in RULES]).first()   # one row
    columns = []
    for r in RULES:
        a, b = prior(sums["n"] or 0, sums["hosts"], sums[f"f_{r}"] or 0, sums[f"q_{r}"] or 0.0)
        columns.append(((F.col(f"f_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias(f"rate_{r}"))
    rated = hosts.select("host", "n", *columns)
    return rated.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > limit)


def prior(n: float, hosts: float, failed: float, squares: float, least: float = 2.0, most: float = 1e4) -> tuple[float, float]:
    """alpha and beta of one rule. squares: sum over hosts of failures squared by documents."""
    mean = min(max(failed / n, 1e-6), 1 - 1e-6) if n else 0.5
    spread = squares / n - mean * mean if n else 0.0          # variance of the rates between hosts, weighted by documents
    noise = mean * (1 - mean) * hosts / n if n else 0.0       # of it, what drawing that many documents makes by itself
    true = max(spread - noise, 0.0)
    k = most if true <= 0 else min(max(mean * (1 - mean) / true - 1, least), most)
    return mean * k, (1 - mean) * k


def judge(docs: DataFrame, host: str = "source", limit: float = 0.75, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the kept columns, its signals, host_rejected and kept."""
    stats = written(failures(signals(docs.withColumn("_host", F.col(host)), *keep, "_host")), "signals")
    verdicts = host_verdicts(stats, "_host", limit).select(F.col("host").alias("_h"), "host_rejected")
    joined = stats.join(verdicts, F.col("_host").eqNullSafe(F.col("_h")), "left")
    return joined.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def keep_documents(docs: DataFrame, host: str = "source", limit: float = 0.75) -> DataFrame:
    """The documents that pass, with all their columns. The text isn't shuffled: base rules are worked out in place, and
    hosts' verdicts meet the rows by host."""
    names = docs.columns
    row = docs.withColumns({"_host": F.col(host), "_all": F.struct(*[F.col(f"`{c}`") for c in names])})
    marked = signals(row, "_all", "_host")
    stats = written(failures(signals(row, "_host")), "signals")
    rejected = host_verdicts(stats, "_host", limit).filter("host_rejected").select(F.col("host").alias("_h"))
    held = written(rejected, "rejected")
    passing = marked.filter(~F.col("base_failed"))
    if held.limit(1).count():                                  # no rejected host, nothing to join
        passing = passing.join(held, F.col("_host").eqNullSafe(F.col("_h")), "left_anti")
    return passing.select(*[F.col(f"_all.`{c}`").alias(c) for c in names])
