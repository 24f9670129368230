"""Text expressions: normalising, masking, tokens, labels, slot patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions.masks import choose

# fixed value: what ends one field of an exported artefact (HL7 delimiters and JSON structure)
FIELD_BREAK = r'[|^~&\\\r\n"{}\[\],:]'


def present(value: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(value.cast("string") != "", F.lit(False))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


# fixed values: letters whose case folding is plain ASCII but which lower-casing leaves alone
FOLDS = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ſ": "s"}


def fold(value: Column) -> Column:
    """Case-folded as far as it matters once everything outside [a-z0-9] is dropped."""
    out = F.lower(value)
    for letter, plain in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def normalise_text(value: Column) -> Column:
    """Case-folded, every run of other characters one space, padded by spaces."""
    return F.concat(F.lit(" "), F.regexp_replace(fold(value), "[^a-z0-9]+", " "), F.lit(" "))


def words(value: Column) -> Column:
    """Distinct words of a normalised text."""
    return F.array_distinct(F.regexp_extract_all(fold(value), F.lit("([a-z0-9]+)"), 1))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def digit_fields(value: Column, least: int = 1) -> Column:
    """The digits of each delimited field of an artefact; fields with fewer than `least` are dropped, too short ones before they are read."""
    long_enough = lambda f: F.length(f) >= least
    return F.filter(F.transform(F.filter(F.split(value, FIELD_BREAK), long_enough), digits), long_enough)


def phone_like(value: Column) -> Column:
    """At least seven digits, and digits make up all but four of the non-space characters."""
    n = F.length(digits(value))
    return (n >= 7) & (n >= F.length(F.replace(value, F.lit(" "), F.lit(""))) - 4)


def number_text(value: Column) -> Column:
    """A double as plain decimal text with at least one decimal, never in exponent form."""
    wide = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), "(\\.[0-9]+?)0+$", "$1")
    return F.when(F.abs(value) < 1e7, value.cast("string")).otherwise(wide)


def mask_value(value: Column) -> Column:
    """Short values all stars; otherwise three leading letters (if letters) and the last two characters stay."""
    n = F.length(value)
    keep = F.when(value.rlike(r"^\p{L}{3}"), 3).otherwise(0)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(value, F.lit(1), keep), F.repeat(F.lit("*"), n - keep - 2), F.right(value, F.lit(2))))


def generalise_date(value: Column) -> Column:
    return F.when(present(value), F.substring(value, 1, 4)).otherwise(value)


def generalise_pin(value: Column) -> Column:
    d = digits(value)
    short = F.when(F.length(d) >= 3, F.concat(F.substring(d, 1, 3), F.lit("XXX"))).otherwise(d)
    return F.when(present(value), short).otherwise(value)


def normalise_label(value: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(value), F.lit("([a-z0-9]+)"), 1), " ")


def _label_key(text: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", text.lower()))


def match_controls(df: DataFrame, label: str, out: str = "action", aliases: DataFrame | None = None) -> DataFrame:
    """Adds the operation a button label means, exact after normalising; aliases(shown, action) win.

    A hash look-up in the broadcast vocabulary (about a hundred names), so a label is normalised once."""
    spark = df.sparkSession
    names = spark.createDataFrame([(_label_key(n), a) for a, ns in dims.ACTIONS.items() for n in ns], "_k string, _known string")
    found = df.withColumn("_k", normalise_label(F.col(label))).join(F.broadcast(names), "_k", "left")
    best = F.col("_known")
    if aliases is not None:
        table = aliases.select(normalise_label(F.col("shown")).alias("_k"), F.col("action").alias("_alias"))
        found, best = found.join(table, "_k", "left"), F.coalesce("_alias", "_known")
    return found.withColumn(out, best).drop("_k", "_known", "_alias")


def humanise(field: Column) -> Column:
    return choose(field, dims.FIELD_WORDS, F.replace(field, F.lit("_"), F.lit(" ")))


def plain_category(category: Column) -> Column:
    return choose(category, dims.CATEGORY_WORDS, F.replace(category, F.lit("_"), F.lit(" ")))


def stem(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (F.when((n > 5) & word.endswith("ing"), cut(3))
            .when((n > 4) & word.endswith("ed"), cut(2))
            .when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
            .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), cut(1))
            .otherwise(word))


def near(a: Column, b: Column) -> Column:
    """Equal, or one letter added, dropped or changed in words of five letters or more."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b) <= 1))


def content_tokens(value: Column) -> Column:
    found = F.regexp_extract_all(F.lower(value), F.lit("([a-z0-9]+)"), 1)
    stop = F.array(*[F.lit(w) for w in dims.STOPWORDS])
    kept = F.filter(found, lambda w: ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, stem))


def fits(answer: Column, pattern: str | None) -> Column:
    """Does an answer have the shape a slot needs (whole, any case)? No pattern takes anything."""
    if pattern is None:
        return F.lit(True)
    return F.trim(answer).rlike(f"(?i)^(?:{pattern})$")


def found_in(text: Column, pattern: str | None) -> Column:
    """The slot's value if the text already carries it."""
    if pattern is None:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(text, f"(?i)({pattern})", 1), F.lit(""))


def real_uses(uses: Column) -> Column:
    null_words = F.array(*[F.lit(w) for w in dims.NULL_WORDS])
    trimmed = F.transform(uses, lambda u: F.trim(u))
    return F.filter(trimmed, lambda u: ~F.array_contains(null_words, F.lower(u)))


def recognised_purpose(name: Column) -> Column:
    return F.when(name.isin(*dims.PURPOSES), name)


def model_slug(model: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(model), "[^a-z0-9.]+", "-"), "^-+|-+$", "")


def short_technique(name: Column) -> Column:
    return F.rtrim(F.substring_index(name, " ", 1), F.lit(","))


def cites(text: Column, control_id: str | None) -> Column:
    """Free text names the control id as a whole token, in any case."""
    if control_id is None:
        return F.lit(False)
    pattern = f"(?i)(?<![A-Za-z0-9]){re.escape(control_id)}(?![A-Za-z0-9])"
    return F.coalesce(text.rlike(pattern), F.lit(False))


def header_key(header: Column) -> Column:
    """Case and white space do not distinguish two headers."""
    return F.lower(F.regexp_replace(F.trim(header), r"\s+", " "))
