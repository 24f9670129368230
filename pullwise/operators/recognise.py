"""Requests in plain words -> the staff functions they could mean.

A function scores one per request word it knows - after a light stem, one typo allowed in words of five
letters or more - plus two per multi-word name of it said whole; every function tied with the best is
kept. Copies of a text are classified once. A text's words are taken from the rarest on: the functions that know the rarest one, or are
named whole, give a score that is reached; functions that know only so many of its commonest words that they can't reach it are never
paired with it, and of the others the whole score is looked up. Typos are found by an equi-join on the words with one letter
left out, on distinct words only, so no word is compared with every other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pullwise.functions import text
from pullwise.operators import access
from pullwise.session import written

PHRASE_WEIGHT = 2


def _variants(word: Column) -> Column:
    """The word itself and, for words of five letters or more, the word with each single letter left out."""
    left_out = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.when(F.length(word) >= 5, F.concat(F.array(word), left_out)).otherwise(F.array(word)))


def near_pairs(words: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (word, token) that are equal or one typo apart. ``words(word)``, ``known(token)`` are distinct."""
    a = words.select("word", F.explode(_variants(F.col("word"))).alias("k"))
    b = known.select("token", F.explode(_variants(F.col("token"))).alias("k"))
    return a.join(b, "k").where(text.near(F.col("word"), F.col("token"))).select("word", "token").distinct()


def vocabulary_tokens(vocabulary: DataFrame) -> DataFrame:
    """vocabulary(function_id, name) -> distinct (function_id, token)."""
    return vocabulary.select("function_id", F.explode(text.content_tokens(F.col("name"))).alias("token")).distinct()


def _phrases(vocabulary: DataFrame) -> DataFrame:
    p = vocabulary.select("function_id", text.normalise_label(F.col("name")).alias("phrase")).distinct()
    return p.where(F.col("phrase").contains(" ")).withColumn("start", F.array_join(F.slice(F.split("phrase", " "), 1, 2), " "))


def recognise(utterances: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """utterances(id, text) -> (id, function_id, score): all best-scoring functions; none when nothing overlaps."""
    keyed = utterances.withColumn("text_id", F.sha2("text", 256))
    texts = keyed.groupBy("text_id").agg(F.first("text").alias("text"))
    asked = texts.select("text_id", F.explode(text.content_tokens(F.col("text"))).alias("word"))
    spec = vocabulary_tokens(vocabulary)
    pairs = near_pairs(asked.select("word").distinct(), spec.select("token").distinct())
    knows = written(pairs.join(spec, "token").select("word", "function_id").distinct(), "knows")

    phrases = _phrases(vocabulary)
    said = texts.withColumn("words", F.split(text.normalise_label(F.col("text")), " "))
    bigrams = said.where(F.size("words") > 1).select("text_id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))))).alias("start"))
    maybe = bigrams.join(phrases, "start").select("text_id", "function_id", "phrase").distinct()
    whole = maybe.join(said.select("text_id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("said")), "text_id").where(
        F.col("said").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    bonus = written(whole.groupBy("text_id", "function_id").agg((F.count(F.lit(1)) * PHRASE_WEIGHT).alias("bonus")), "bonus")

    frequency = knows.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    lists = written(asked.join(frequency, "word").groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w")).select(      # a text's own words
        "text_id", F.transform("w", lambda x: x["word"]).alias("words")), "lists")
    first = _scores(_candidates(lists.withColumn("n", F.lit(1)), knows, bonus), lists, knows, bonus)
    reached = first.groupBy("text_id").agg(F.max("score").alias("reached"))
    essential = lists.join(reached, "text_id", "left").withColumn("n", F.greatest(F.size("words") - F.coalesce("reached", F.lit(0)) + 1, F.lit(1)).cast("int"))
    scores = _scores(_candidates(essential, knows, bonus), lists, knows, bonus)
    best = scores.withColumn("r", F.rank().over(Window.partitionBy("text_id").orderBy(F.col("score").desc()))).where("r = 1").drop("r")
    best = best.join(asked.select("text_id").distinct(), "text_id", "left_semi")
    return keyed.select("id", "text_id").join(best, "text_id").select("id", "function_id", "score")


def _candidates(lists: DataFrame, knows: DataFrame, bonus: DataFrame) -> DataFrame:
    """(text_id, function_id) that know one of a text's n rarest words, or are named whole in it."""
    words = lists.select("text_id", F.explode(F.slice("words", F.lit(1), F.col("n"))).alias("word"))
    return words.join(knows, "word").select("text_id", "function_id").unionByName(bonus.select("text_id", "function_id")).distinct()


def _scores(candidates: DataFrame, lists: DataFrame, knows: DataFrame, bonus: DataFrame) -> DataFrame:
    """The whole score of each candidate: its words are looked up, those of other functions aren't."""
    each = candidates.join(lists, "text_id", "left").select("text_id", "function_id", F.explode_outer("words").alias("word"))
    known = each.join(knows.withColumn("point", F.lit(1)), ["word", "function_id"], "left").groupBy("text_id", "function_id").agg(F.count("point").alias("points"))
    return known.join(bonus, ["text_id", "function_id"], "left").select("text_id", "function_id", (F.col("points") + F.coalesce("bonus", F.lit(0))).alias("score"))


def gate(recognised: DataFrame, roles: DataFrame) -> DataFrame:
    """Ties narrowed to functions the asker's role may use, and the decision: roles(id, role).

    ``begin`` one permitted function (or one match) is left and allowed, ``declined`` when the single match is
    not the role's, ``choose`` when several remain: ``options`` are then the permitted ones, or all where none is.
    ``unrecognised`` when the request matched nothing; every row of ``roles`` has one."""
    asked = access.authorise(access.function_requests(recognised.join(roles, "id"), F.col("function_id")))
    per = asked.groupBy("id", "role").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if("allowed").alias("permitted"),
        F.min(F.when(F.col("allowed"), F.col("function_id"))).alias("first_allowed"),
        F.min("function_id").alias("first"), F.min("rule_id").alias("rule_id"),
        F.array_sort(F.collect_set(F.when(F.col("allowed"), F.col("function_id")))).alias("may"), F.array_sort(F.collect_set("function_id")).alias("all"))
    per = roles.select("id", "role").distinct().join(per, ["id", "role"], "left").fillna(0, ["matches", "permitted"])
    begin = F.col("permitted") == 1
    several = F.when(F.col("permitted") > 1, F.array_join("may", ",")).otherwise(F.array_join("all", ","))
    decision = F.when(F.col("matches") == 0, "unrecognised").when(begin, "begin").when((F.col("matches") == 1), "declined").otherwise("choose")
    return per.select("id", "role", "matches", "permitted", decision.alias("decision"),
                      F.when(begin, F.col("first_allowed")).when(F.col("matches") == 1, F.col("first")).alias("function_id"),
                      F.when(~begin & (F.col("matches") == 1), F.col("rule_id")).alias("rule_id"),
                      F.when(~begin & (F.col("matches") > 1), several).alias("options"))
