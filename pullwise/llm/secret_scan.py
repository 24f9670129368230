"""Secrets: fixed patterns, and a battery of randomness tests on encoded tokens under length-aware false-discovery control.

Base kinds are assignments to a secret's name, access key ids and long hexadecimal runs. Elsewhere, tokens of 16 or more encoding
characters of any class are candidates; what is too short or too even to tell is left to the tests and the length classes. From its characters a token's encoding is inferred (hexadecimal, base 32, 36,
62 or 64). In it, a chi-squared test of uniformity over the alphabet, a runs test around the alphabet's middle and a
lag-1 serial correlation test must not reject randomness (Bonferroni, at `alpha`). Then the chi-squared value is held
against what ordinary text of that length would give, whose symbols coincide more often: its lower tail probability is the p-value
of "ordinary text". Short tokens can't have small p-values, long ones can. Within each length class (powers of two) the
Benjamini-Hochberg rule at `rate` decides, from a histogram of p-values in fixed bins, taken at their upper edges.

Odd cases: null and empty texts have no spans; repeated rows are judged each (and counted each by the rule); equal starts
sort by kind; an empty table gives an empty result; further columns are never read. Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise.llm.common import array_sum, let, text_of
from pullwise.llm.spans import matches, replaced
from pullwise.session import written

# fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

SET = "A-Za-z0-9+/_="
TOKEN = rf"(?<![{SET}-])[{SET}-]{{16,}}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# name, what the symbols must match, what is left out first, alphabet, chance that two symbols of ordinary text coincide
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "-", DIGITS + "abcdef", 0.12),
    ("base32", r"^[A-Z2-7]+$", "=", UPPER + "234567", 0.065),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "-_", DIGITS + LOWER, 0.06),
    ("base62", r"^[0-9A-Za-z]+$", "=", DIGITS + UPPER + LOWER, 0.055),
    ("base64", r"^[0-9A-Za-z+/_-]+$", "=", UPPER + LOWER + DIGITS + "+/", 0.055),
)
BINS = 400              # p-values by twentieths of a power of ten; the last bin holds all smaller ones


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a polynomial good to 1e-7, and for large z by its leading term."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(symbols: Column, alphabet: str, coincide: float) -> Column:
    """n, uniform (combined p of the three tests of randomness) and text (p of ordinary text) of a string over the alphabet."""
    k = len(alphabet)
    half = k // 2
    n = F.length(symbols).cast("double")
    counts = F.transform(F.split(F.lit(alphabet), ""), lambda c: (F.length(symbols) - F.length(F.replace(symbols, c, F.lit("")))).cast("double"))
    chi = array_sum(F.transform(counts, lambda c: c * c), "double") * k / n - n
    halves = F.translate(symbols, alphabet, "a" * half + "b" * (k - half))
    runs = F.length(F.regexp_replace(halves, "a+|b+", "x")).cast("double")
    low = F.length(F.translate(halves, "b", "")).cast("double")
    pairs = 2 * low * (n - low)
    runs_sd = F.sqrt(F.greatest(pairs * (pairs - n) / (n * n * (n - 1)), F.lit(1e-9)))
    mean_at = (k - 1) / 2.0
    codes = F.transform(F.split(symbols, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1 - mean_at).cast("double"))

    def serial(x: Column) -> Column:
        products = F.zip_with(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.size(x) - 1), lambda a, b: a * b)
        square = array_sum(F.transform(x, lambda a: a * a), "double")
        return array_sum(products, "double") / F.greatest(square, F.lit(1e-9)) * F.sqrt(n)

    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    z_runs = (runs - (1 + pairs / n)) / runs_sd
    least = F.least(normal_tail(z_chi), 2 * normal_tail(F.abs(z_runs)), 2 * normal_tail(F.abs(let(codes, serial))))
    text_mean = k + k * (n - 1) * coincide - n
    text_sd = F.sqrt(2 * (k - 1) + 4 * n * (k * coincide - 1) * k * coincide)
    return F.struct(n.cast("long").alias("n"), F.least(3 * least, F.lit(1.0)).alias("uniform"), normal_tail((text_mean - chi) / text_sd).alias("text"))


def tested(match: Column) -> Column:
    """The battery in the inferred encoding; null if none fits."""
    def over(alphabet: str, coincide: float):
        return lambda s: battery(s, alphabet, coincide)

    result = None
    for name, shape, out, alphabet, coincide in ENCODINGS:
        symbols = F.translate(match, out, "")
        folded = F.lower(symbols) if name in ("hex", "base36") else F.translate(symbols, "-_", "+/")
        value = let(folded, over(alphabet, coincide))
        fits = symbols.rlike(shape) & (F.length(symbols) >= 16)
        result = F.when(fits, value) if result is None else result.when(fits, value)
    return result


def _bin(p: Column) -> Column:
    return F.least(F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(BINS)).cast("int")


def scanned(docs: DataFrame, *keep: str, alpha: float = 0.001) -> DataFrame:
    """The kept columns, base spans (kind number, start, end) and candidates (start, end, class, bin) that pass as random."""
    t = F.col("_text")
    strong = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    rows = docs.select(*keep, text_of().alias("_text")).select(
        "*", F.filter(matches(t, ASSIGN), lambda s: strong(s["match"])).alias("_assign"), matches(t, ACCESS).alias("_access"), matches(t, HEX).alias("_hex"))
    blank = lambda m: F.repeat(F.lit(" "), F.length(m))
    rest = replaced(replaced(replaced(t, ASSIGN, lambda m: F.when(strong(m), blank(m)).otherwise(m)), ACCESS, blank), HEX, blank)
    some = (F.size("_assign") + F.size("_access") + F.size("_hex")) > 0
    rows = rows.withColumn("_rest", F.when(some, rest).otherwise(t))
    tests = F.transform(matches(F.col("_rest"), TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tested(s["match"]).alias("test")))
    random = F.filter(tests, lambda s: s["test"].isNotNull() & (s["test"]["uniform"] >= alpha))
    spans = lambda k, name: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    return rows.select(
        *keep, *[F.size(c).cast("long").alias(f"n{c}") for c in ("_assign", "_access", "_hex")],
        F.array_sort(F.concat(*[spans(k, c) for k, c in enumerate(("_assign", "_access", "_hex"))])).alias("base"),
        F.transform(random, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"),
                                               F.floor(F.log2(s["test"]["n"].cast("double"))).cast("int").alias("cls"),
                                               _bin(s["test"]["text"]).alias("bin"))).alias("candidates"))


def cut_bins(histogram: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Per length class the first bin that Benjamini-Hochberg rejects, from (class, bin, count)."""
    cuts = {}
    for cls in {c for c, _, _ in histogram}:
        bins = sorted(((b, n) for c, b, n in histogram if c == cls), reverse=True)
        total, above = sum(n for _, n in bins), 0
        for b, n in bins:
            above += n
            if 10 ** (-b / 20) <= rate * above / total:
                cuts[cls] = b
    return cuts


def secrets(docs: DataFrame, rate: float = 0.05, alpha: float = 0.001) -> DataFrame:
    """Per row doc_id, counts, base spans and found: all spans (start, kind number, end), sorted."""
    rows = written(scanned(docs, "doc_id", alpha=alpha), "scanned")
    tokens = rows.select(F.explode("candidates").alias("c")).groupBy("c.cls", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    cuts = cut_bins([tuple(r) for r in tokens.collect()], rate)                # at most a row per class and bin
    limits = F.array(*[F.lit(cuts.get(c, BINS + 1)) for c in range(64)])
    kept = F.transform(F.filter("candidates", lambda s: s["bin"] >= F.get(limits, s["cls"])),
                       lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", kept)).alias("found"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
