"""The stored log: chained lines, and a seal per append that ties them to every append before.

A seal holds the root of its append's lines, a link to the seal before it, and the peaks of a Merkle mountain range over the roots of
all appends so far: the roots of the largest complete binary trees that tile them, as many as the number has bits. Any two seals can
so be held against each other, and a seal kept elsewhere shows whether what it covered was cut off or rewritten, even if every later
link was forged to fit. Checking takes one job however many appends there are."""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pullwise.operators import audit
from pullwise.session import written

FAN_BITS, LEVELS = 8, 4         # chain hashes are joined 256 at a time, four levels below an append's root
TIER = 10                       # levels of the mountain range that one grouping works out
SEAL = "batch bigint, n bigint, total bigint, root string, link string, peaks array<string>, append string"


class Seal(NamedTuple):
    batch: int
    n: int
    total: int
    root: str
    link: str
    peaks: list[str | None]     # by height; none where the number of appends has no such bit
    append: str                 # marks the lines it covers


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def next_seal(before: Seal | None, n: int, root: str, append: str) -> Seal:
    """The seal of an append after the one before; adding a root carries like adding one to a binary number."""
    peaks, carried, height = list(before.peaks) if before else [], root, 0
    while height < len(peaks) and peaks[height] is not None:
        carried, peaks[height] = _sha(peaks[height] + carried), None
        height += 1
    peaks[height:height + 1] = [carried]
    return Seal(before.batch + 1 if before else 0, n, n + (before.total if before else 0), root, _sha((before.link if before else "") + root), peaks, append)


def exists(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(path)
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def last_seal(spark: SparkSession, path: str) -> Seal | None:
    if not exists(spark, f"{path}/seals"):
        return None
    row = spark.read.schema(SEAL).parquet(f"{path}/seals").agg(F.max_by(F.struct("*"), "batch").alias("s")).first()["s"]
    return Seal(*row) if row else None


def roots(lines: DataFrame) -> DataFrame:
    """(batch, n, root) of lines(batch, chain, seq, line): hashes of the lines, joined chain by chain and then level by level."""
    hashed = lines.groupBy("batch", F.col("chain").alias("node")).agg(F.array_sort(F.collect_list(F.struct("seq", audit.sha256(F.col("line")).alias("hash")))).alias("of"))
    level = hashed.select("batch", "node", audit.sha256(F.array_join(F.transform("of", lambda x: x["hash"]), "")).alias("hash"), F.size("of").cast("bigint").alias("n"))
    for i in range(LEVELS + 1):
        node = F.shiftright("node", FAN_BITS) if i < LEVELS else F.lit(0).cast("bigint")
        level = level.groupBy("batch", node.alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("parts"), F.sum("n").alias("n")).select(
            "batch", F.col("up").alias("node"), audit.sha256(F.array_join(F.transform("parts", lambda p: F.concat(p["node"].cast("string"), F.lit(":"), p["hash"])), "")).alias("hash"), "n")
    return level.select("batch", "n", F.col("hash").alias("root"))


def append_log(events: DataFrame, path: str, part: Column | None = None) -> list[Seal]:
    """Appends events (seq above those in the log) as chained lines, and returns the seals: one, or one for each value of `part`, an
    integer that grows with seq, where an existing log of many appends is taken over.

    Lines are hashed when they are written, so a later edit shows even if nothing was read in between. One append at a time; one
    that fails before its seal leaves lines that no seal covers and no reader takes."""
    spark = events.sparkSession
    before = last_seal(spark, path)
    first = before.batch + 1 if before else 0
    number = F.lit(first).cast("bigint")
    if part is not None:
        known = written(events.select(part.cast("bigint").alias("part")).distinct(), "parts")
        number = F.lit(first) + F.dense_rank().over(Window.orderBy("part")) - 1        # a row an append
        events = events.withColumn("_part", part.cast("bigint")).join(known.select(F.col("part").alias("_part"), number.cast("bigint").alias("batch")), "_part")
    else:
        events = events.withColumn("batch", number)
    chained = audit.build_chains(events, audit.event_body(), scope="batch")
    token = uuid.uuid4().hex
    stored = chained.withColumn("append", F.lit(token))
    stored.write.mode("append").parquet(f"{path}/lines")                                # unsealed so far, so no reader takes them
    lines = spark.read.schema(stored.schema).parquet(f"{path}/lines").where(F.col("append") == token)
    seals, last = [], before
    for r in roots(lines).orderBy("batch").collect():                                   # a row an append
        last = next_seal(last, r["n"], r["root"], token)
        seals.append(last)
    if seals:
        spark.createDataFrame(seals, SEAL).coalesce(1).write.mode("append").parquet(f"{path}/seals")
    return seals


def _tier(nodes: DataFrame, height: int) -> DataFrame:
    """(height, place, hash) of the nodes of TIER more levels above those of one height."""
    size = 1 << TIER
    blocks = nodes.groupBy(F.shiftright("place", TIER).alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("place") % size).cast("int").alias("at"), F.col("hash")))).alias("m"))       # 1 << TIER at most
    start = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("m", i))

    def up(state: Column, _: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(state["now"]), F.lit(2)), lambda i: F.when(
            F.element_at(state["now"], i).isNotNull() & F.element_at(state["now"], i + 1).isNotNull(),
            audit.sha256(F.concat(F.element_at(state["now"], i), F.element_at(state["now"], i + 1)))))
        return F.struct(joined.alias("now"), F.concat(state["all"], F.array(joined)).alias("all"))

    first = F.struct(start.alias("now"), F.array().cast("array<array<string>>").alias("all"))
    levels = blocks.select("block", F.aggregate(F.sequence(F.lit(1), F.lit(TIER)), first, up, lambda s: s["all"]).alias("levels"))
    each = levels.select("block", F.posexplode("levels").alias("h", "level")).select("block", "h", F.posexplode("level").alias("i", "hash")).where("hash is not null")
    return each.select((F.col("h") + height + 1).alias("height"), (F.shiftleft("block", TIER) / F.pow(F.lit(2), F.col("h") + 1) + F.col("i")).cast("bigint").alias("place"), "hash")


def mountain_range(of: DataFrame) -> DataFrame:
    """(height, place, hash) of all complete nodes over (batch, root); three tiers do for a billion appends."""
    level = of.select(F.lit(0).alias("height"), F.col("batch").alias("place"), F.col("root").alias("hash"))
    out = level
    for t in range(3):
        above = _tier(level, t * TIER)
        out = out.unionByName(above)
        level = above.where(F.col("height") == (t + 1) * TIER)
    return out


def _peaks_hold(seals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(batch, consistent) of seals: whether each of their peaks is the node that the range has there, and none is missing."""
    count = F.col("batch") + 1
    peaks = seals.select("batch", "peaks", F.posexplode("peaks").alias("h", "hash")).where("hash is not null")
    placed = peaks.select("batch", F.col("h").alias("height"), (F.call_function("shiftright", count, F.col("h")) - 1).cast("bigint").alias("place"), "hash")
    held = placed.join(nodes.withColumnRenamed("hash", "now"), ["height", "place"], "left").groupBy("batch").agg(
        F.every(F.coalesce(F.col("hash") == F.col("now"), F.lit(False))).alias("same"), F.count(F.lit(1)).alias("n_peaks"))
    return held.select("batch", (F.col("same") & (F.col("n_peaks") == F.bit_count(count))).alias("consistent"))


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(seals, lines) as they are now."""
    seals = spark.read.schema(SEAL).parquet(f"{path}/seals")
    return seals, spark.read.parquet(f"{path}/lines").join(seals.select("batch", "append"), ["batch", "append"], "left_semi")


def verify_log(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n, intact, linked, consistent) per seal: whether its lines still follow from each other and give its root, whether its
    link follows from the seal before, and whether its peaks are those of the roots that the lines give now."""
    seals, lines = _stored(spark, path)
    now = roots(lines).select("batch", F.col("n").alias("n_now"), F.col("root").alias("root_now"))
    order = Window.orderBy("batch")                                                      # a row an append
    linked = seals.withColumn("linked", (F.col("link") == audit.sha256(F.concat(F.coalesce(F.lag("link").over(order), F.lit("")), "root"))) & (
        F.col("batch") == F.row_number().over(order) - 1))
    chains = audit.verify_chains(lines.withColumn("key", F.struct("batch", "chain")), "key").groupBy(F.col("key.batch").alias("batch")).agg(F.every("intact").alias("lines_intact"))
    same = F.coalesce((F.col("root") == F.col("root_now")) & (F.col("n") == F.col("n_now")) & F.col("lines_intact"), F.lit(False))
    held = _peaks_hold(seals, mountain_range(now.select("batch", F.col("root_now").alias("root"))))
    return linked.join(now, "batch", "left").join(chains, "batch", "left").join(held, "batch", "left").select(
        "batch", "n", same.alias("intact"), "linked", F.coalesce("consistent", F.lit(False)).alias("consistent"))


def verify_against(spark: SparkSession, path: str, kept: DataFrame) -> DataFrame:
    """(batch, status) of seals kept elsewhere: `agrees`, `truncated` where the log has fewer appends by now, else `rewritten`."""
    seals, lines = _stored(spark, path)
    last = seals.agg(F.max("batch")).first()[0]
    held = _peaks_hold(kept, mountain_range(roots(lines)))
    status = F.when(F.col("consistent"), "agrees").when(F.col("batch") > F.lit(-1 if last is None else last), "truncated").otherwise("rewritten")
    return held.select("batch", status.alias("status"))
