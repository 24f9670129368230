"""Which raw identifier values can be found in written artefacts.

A value is found when all its words occur in one artefact, or - for a phone-like value - its digits occur
within one delimited field. Neither test compares every value with every artefact:

* words: artefacts become an inverted index cut down to words that some value contains. Words are ordered by how rare they are there,
  and values with the same words are one set. One-word sets are a semi-join. Others are looked up by their rarest word; a
  bitset of the artefact's wanted words, of a fixed size, rides on each posting and turns most others away; what is left has its other
  words looked up and counted, so nothing that travels grows with an artefact. A set is looked for until one artefact has it, so
  sets whose rarest word is still frequent are first looked up in small shares of the artefacts.
* digits: distinct digit fields are cut into all windows of the lengths that the values have, and a value is looked up by its
  whole digit string: an equi-join on as many keys as there are numbers.

Words and values that are stored between steps are encrypted (``session.sealed``). Wanted words and sets are numbered there once, so what
is stored for an occurrence of a word, of which there are many, is a number and needs no key. Numbers compress well, so what the
planner makes of their files says little about their rows: joins of them sort and merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise.functions import text
from pullwise.session import sealed, written

HOT = 100_000           # artefacts sharing a set's rarest word above which shares of them are tried first, and look-ups are salted
SHARES = (1024, 32)     # one in so many artefacts
SLOTS = 4               # 64-bit words of an artefact's bitset


def _bit(number: Column, slot: int) -> Column:
    """A word's bit in a slot of the bitset, 0 in all slots but its own."""
    h = F.xxhash64(number)
    return F.when(F.pmod(h, F.lit(SLOTS)) == slot, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int"))).otherwise(
        F.lit(0).cast("long"))


def _bits(numbers: Column, slot: int) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda bits, number: bits.bitwiseOR(_bit(number, slot)))


def _word_hits(values: DataFrame, artefacts: DataFrame, keys: list[str], hot: int) -> DataFrame:
    valued = values.withColumn("words", F.array_sort(text.words(F.col("value")))).where(F.size("words") > 0).withColumn("words", F.array_join("words", " "))
    sets = sealed(valued.select(*keys, "words").distinct().withColumn("set", F.monotonically_increasing_id()), "sets", "words")
    in_sets = sets.select(*keys, "set", F.explode(F.split("words", " ")).alias("word"))
    wanted = sealed(in_sets.select(*keys, "word").distinct().withColumn("number", F.monotonically_increasing_id()), "wanted", "word")
    occurs = artefacts.select(*keys, "artefact_id", F.explode(text.words(F.col("text"))).alias("word"))
    index = written(occurs.join(wanted, [*keys, "word"]).select(*keys, "artefact_id", "number"), "postings").hint("merge")
    frequency = index.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    each = in_sets.join(wanted, [*keys, "word"]).join(frequency, "number", "left")
    ranked = each.groupBy(*keys, "set").agg(F.array_sort(F.collect_list(F.struct("df", "number"))).alias("r"), F.every(F.col("df").isNotNull()).alias("occur")).where(
        "occur")                                                    # a set's own words; one with a word no artefact holds is settled here
    others = F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: x["number"])
    looked = written(ranked.select(*keys, "set", F.get("r", F.lit(0))["df"].alias("df"), F.get("r", F.lit(0))["number"].alias("number"), others.alias("others")), "lookups").hint("merge")
    found = looked.where(F.size("others") == 0).select(*keys, "set")
    open_ = looked.where(F.size("others") > 0)
    bits = index.groupBy(*keys, "artefact_id").agg(*[F.bit_or(_bit(F.col("number"), i)).alias(f"bits_{i}") for i in range(SLOTS)])
    for share in (*SHARES, 1) if open_.where(F.col("df") > hot).limit(1).count() else (1,):
        asked = open_.where(F.col("df") > hot) if share > 1 else open_
        got = _sets_found(asked, index, bits, keys, share, hot)
        if share > 1:
            got = written(got, "found").hint("merge")
            open_ = open_.join(got, [*keys, "set"], "left_anti")
        found = found.unionByName(got)
    return valued.join(found.distinct().join(sets, [*keys, "set"]), [*keys, "words"], "left_semi").select(*keys, "value")


def _sets_found(sets: DataFrame, index: DataFrame, bits: DataFrame, keys: list[str], share: int, hot: int) -> DataFrame:
    """The sets that one artefact of the share holds all words of."""
    posts = index if share == 1 else index.where(F.pmod(F.xxhash64("artefact_id"), F.lit(share)) == 0)
    salts = F.ceil(F.col("df") / F.lit(share) / F.lit(hot)).cast("int")
    lookups = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    lookups = lookups.withColumns({f"need_{i}": _bits(F.col("others"), i) for i in range(SLOTS)})
    anchors = sets.groupBy(*keys, "number").agg(F.max(F.greatest(salts, F.lit(1))).alias("salts"))       # a word's sets share its frequency
    posted = posts.join(anchors, [*keys, "number"]).withColumn("salt", F.pmod(F.xxhash64("artefact_id"), F.col("salts")).cast("int")).join(
        bits, [*keys, "artefact_id"])
    may = reduce(Column.__and__, [F.col(f"bits_{i}").bitwiseAND(F.col(f"need_{i}")) == F.col(f"need_{i}") for i in range(SLOTS)])
    met = lookups.join(posted, [*keys, "number", "salt"]).where(may)
    held = met.select(*keys, "artefact_id", "set", F.size("others").alias("n"), F.explode("others").alias("number")).join(posts, [*keys, "artefact_id", "number"])
    return held.groupBy(*keys, "artefact_id", "set", "n").agg(F.count_distinct("number").alias("held")).where("held = n").select(*keys, "set").distinct()


def _window(n: int):
    return lambda i: F.substring(F.col("field"), i, F.lit(n))


def _digit_hits(values: DataFrame, artefacts: DataFrame, keys: list[str]) -> DataFrame:
    v = values.where(text.phone_like(F.col("value"))).withColumn("digits", text.digits(F.col("value"))).select(*keys, "value", "digits")
    lengths = sorted(r[0] for r in v.select(F.length("digits")).distinct().collect())       # the few lengths that numbers have
    if not lengths:
        return v.select(*keys, "value")
    fields = artefacts.select(*keys, F.explode(F.array_distinct(text.digit_fields(F.col("text"), lengths[0]))).alias("field")).distinct()
    windows = F.flatten(F.array(*[
        F.when(F.length("field") >= n, F.transform(F.sequence(F.lit(1), F.length("field") - n + 1), _window(n)))
        .otherwise(F.array().cast("array<string>")) for n in lengths]))
    grams = fields.select(*keys, F.explode(windows).alias("digits")).distinct()
    return v.join(grams, [*keys, "digits"], "left_semi").select(*keys, "value")


def find_leaks(values: DataFrame, artefacts: DataFrame, keys: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """``values(keys..., value)``, ``artefacts(keys..., artefact_id, text)`` -> the distinct values, with ``leaked``.

    ``keys`` scope the search (an export's values are looked for in its own artefacts)."""
    keys = keys or []
    distinct = sealed(values.where(text.present(F.col("value"))).select(*keys, F.col("value").cast("string").alias("value")).distinct(), "values", "value")
    hits = _word_hits(distinct, artefacts, keys, hot).unionByName(_digit_hits(distinct, artefacts, keys)).distinct()
    return distinct.join(hits.withColumn("hit", F.lit(True)), [*keys, "value"], "left").select(
        *keys, "value", F.coalesce("hit", F.lit(False)).alias("leaked"))


def exact_leaks(values: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Verbatim occurrences of identifiers anywhere in the texts: (value, artefact_id).

    Any stretch of 2q-1 characters holds a whole block of q characters of the text's own grid, so a text is indexed at
    every q-th position only and a value by the q windows of its first 2q-1 characters. Values are taken in bands of length
    (q doubles from band to band), so a short value doesn't decide for the long ones. What is shuffled of a text are its
    blocks that some value's window equals, and only candidates meet texts."""
    v = sealed(values.where(text.present(F.col("value"))).select("value").distinct().withColumn("band", F.floor(
        F.log2((F.length("value") + 1) / 2)).cast("int")), "values", "value")
    bands = sorted(r[0] for r in v.select("band").distinct().collect())         # as many as doublings of the longest value
    found = None
    for band in bands:
        q = 1 << band
        lookups = v.where(F.col("band") == band).select("value", F.explode(F.transform(
            F.sequence(F.lit(1), F.lit(q)), lambda i: F.substring(F.col("value"), i, F.lit(q)))).alias("gram")).distinct()
        wanted = lookups.select("gram").distinct()
        blocks = artefacts.select("artefact_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s).{{{q}}}"), F.lit(0)))).alias("gram"))
        pairs = blocks.join(wanted, "gram", "left_semi").join(lookups, "gram").select("value", "artefact_id")
        found = pairs if found is None else found.unionAll(pairs)
    if found is None:
        return artefacts.select(F.lit(None).cast("string").alias("value"), "artefact_id").limit(0)
    return found.distinct().join(artefacts.select("artefact_id", "text"), "artefact_id").where(
        F.col("text").contains(F.col("value"))).select("value", "artefact_id").distinct()
