"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

A text is cut, losslessly, into sections (after a blank line, before a heading), these into paragraphs (lines, with their
line breaks). A paragraph's node is the SHA-256 of its bytes, a section's that of its paragraphs' nodes, the root's that of the
sections' nodes, each kind with its own prefix. Roots are equal just if texts are; where they differ, comparing the
levels leads to the sections and paragraphs that changed. Paragraphs' leaves are pieces of up to three words that end at
sentence ends, kept as a set of 32-bit hashes; the likeness of two fingerprints is the Dice coefficient of these sets (1 only for
equal roots), so an edit costs what it covers, not the whole paragraph.

Odd cases: null text is the empty text, whose fingerprint is that of no sections; two empty texts are alike (1). Rows with the same
doc_id and text are one document in the order and all get its values; a null doc_id comes last, and texts of one doc_id follow by
digest; the only document follows itself; an empty table gives an empty result; very long texts are read whole, in time that grows
with their lines times the logarithm of their number; further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise.llm.common import let, row_key, text_of
from pullwise.llm.ordering import followers

SECTION = r"(?<=\n\n)(?!\n)|(?<=\n)(?=#{1,6} )"
PARAGRAPH = r"(?<=\n)"
PIECE = r"(?:[^\x20\x09-\x0D]++(?<![.!?])[\x20\x09-\x0D]++){0,2}[^\x20\x09-\x0D]++"


def _node(kind: str, parts: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(parts, "")), 256)


def _cut(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern, -1), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Per section the nodes of its paragraphs."""
    return F.transform(_cut(text, SECTION), lambda s: F.transform(_cut(s, PARAGRAPH), lambda p: F.sha2(F.concat(F.lit("p"), p), 256)))


def tree(text: Column) -> Column:
    """root, sections (nodes) and paragraphs (nodes by section)."""
    return let(paragraphs(text), lambda ps: let(F.transform(ps, lambda p: _node("s", p)), lambda ss: F.struct(
        _node("r", ss).alias("root"), ss.alias("sections"), ps.alias("paragraphs"))))


def leaves(text: Column) -> Column:
    """Set of hashes of the text's pieces."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.hash(p)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots; else the share of leaves that both have, below 1."""
    total = (F.size(leaves_a) + F.size(leaves_b)).cast("double")
    both = F.size(F.array_intersect(leaves_a, leaves_b)).cast("double")
    return F.when(root_a == root_b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(F.least(2 * both / total, 1 - 1 / (total + 1)))


def _among(x: Column, ordered: Column) -> Column:
    """Whether x is in a sorted array, by halving it: a step per bit of its size, not per element."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + F.lit(1))).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        above = (s["lo"] < s["hi"]) & (F.get(ordered, middle) < x)
        return F.struct(F.when(above, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(F.least(middle, s["hi"])).alias("hi"))

    place = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), halve, lambda s: s["lo"])
    return F.coalesce(F.get(ordered, place) == x, F.lit(False))


def edits(tree_a: Column, tree_b: Column) -> Column:
    """Places of b's paragraphs that a hasn't, as (section, paragraph), found by going down differing branches only."""
    def changed(ps: Column, i: Column, known: Column) -> Column:
        placed = F.transform(ps, lambda p, j: F.struct(p.alias("node"), j.alias("paragraph")))
        return F.transform(F.filter(placed, lambda x: ~_among(x["node"], known)), lambda x: F.struct(i.alias("section"), x["paragraph"].alias("paragraph")))

    def compared(both: Column) -> Column:
        branches = F.zip_with(both["nodes"], both["below"], lambda node, ps: F.struct(node.alias("node"), ps.alias("ps")))
        return F.flatten(F.transform(branches, lambda x, i: F.when(_among(x["node"], both["sections"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            changed(x["ps"], i, both["known"]))))

    return let(F.struct(F.array_sort(F.array_distinct(F.flatten(tree_a["paragraphs"]))).alias("known"), F.array_sort(tree_a["sections"]).alias("sections"),
                        tree_b["sections"].alias("nodes"), tree_b["paragraphs"].alias("below")), compared)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row doc_id and its tree."""
    return docs.select("doc_id", tree(text_of()).alias("tree"))


def edited(docs: DataFrame) -> DataFrame:
    """Per row the text's and the edited text's fingerprints and likenesses (see the module).

    Only the next text's beginning, as far as it is needed, and its leaves' hashes travel; the text itself moves once, and
    both sides of the last join read the same exchange."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), text_of().alias("text"))
    sizes = keyed.select("doc_id", "key", F.length("text").cast("long").alias("n")).distinct()
    order = followers(sizes, ["key", "doc_id", "n"], "next_", F.col("doc_id").asc_nulls_last(), F.col("key").asc())
    texts = keyed.select("key", "text")
    wanted = order.select(F.col("next_key").alias("key"), F.col("key").alias("of"), "doc_id", "n")
    ahead = texts.join(wanted, "key").dropDuplicates(["key"]).select(
        F.col("of").alias("key"), "doc_id", "n", F.substring("text", F.lit(1), F.floor(F.col("n") / 2).cast("int")).alias("front"),
        let(F.col("text"), lambda t: F.struct(tree(t)["root"].alias("root"), leaves(t).alias("leaves"))).alias("next"))
    joined = texts.join(ahead, "key")
    half = F.floor(F.col("n") / 2)
    both = joined.select("doc_id", "n", "next", "text", F.concat(F.substring("text", F.lit(1), (F.col("n") - half).cast("int")), "front").alias("changed"))
    found = both.select("doc_id", "n", "next", F.sha2("changed", 256).alias("edited_sha256"),
                        tree(F.col("text")).alias("tree_a"), leaves(F.col("text")).alias("leaves_a"),
                        tree(F.col("changed")).alias("tree_b"), leaves(F.col("changed")).alias("leaves_b"))
    root_a, root_b = F.col("tree_a.root"), F.col("tree_b.root")
    return found.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", root_a.alias("fingerprint"), root_b.alias("edited_fingerprint"),
        likeness(root_a, F.col("leaves_a"), root_b, F.col("leaves_b")).alias("near_edited"),
        likeness(root_a, F.col("leaves_a"), F.col("next.root"), F.col("next.leaves")).alias("near_next"),
        F.size(edits(F.col("tree_a"), F.col("tree_b"))).alias("edited_paragraphs"))
