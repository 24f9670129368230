"""The processing record as a stream: the audit log read as files arrive, counted per day and purpose.

Counting per day is the streaming form of the record of processing activities; checking the hash chain
stays a batch job, since it needs each line's predecessor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pullwise import session


def read_log(spark: SparkSession, directory: str, schema: StructType | str, glob: str = "*.json", fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).format(fmt).load(directory)


def daily_activity(events: DataFrame, late: str = "2 days") -> DataFrame:
    """events(seq, at, purpose, event, records): late or repeated events handled by a watermark on ``at``.

    ``at`` is cast to an instant because watermarks need one."""
    kind = lambda k: F.count_if(F.col("event") == k)
    return (events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
            .dropDuplicatesWithinWatermark(["seq"])
            .groupBy(F.window("at", "1 day").alias("w"), "purpose")
            .agg(F.count(F.lit(1)).alias("events"), kind("extraction").alias("extractions"), kind("export").alias("exports"),
                 kind("purge").alias("purges"), F.sum("records").alias("records"))
            .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "purpose", "events", "extractions", "exports", "purges", "records"))


def run_available(daily: DataFrame, name: str = "daily", base: str | None = None, keys: tuple[str, ...] = ("day", "purpose")) -> DataFrame:
    """Processes what is there, then stops, and returns every day's counts so far, days still open included.

    Each micro-batch writes the days it changed under its number, over what a failed try of it left; the latest batch of
    a day and purpose holds. Output and checkpoint lie in the shared folder. Give the same ``base`` to a later run to resume
    exactly where this one stopped; without one, every run starts afresh."""
    spark = daily.sparkSession
    base = f"{session.shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}" if base is None else base
    columns = daily.columns

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    spark.createDataFrame([], daily.schema).write.mode("overwrite").parquet(f"{base}/out/batch=-1")     # so there is a table without events too
    q = (daily.writeStream.option("checkpointLocation", f"{base}/state").outputMode("update")
         .foreachBatch(keep).trigger(availableNow=True).start())
    q.awaitTermination()
    written = spark.read.schema(StructType([*daily.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    values = [c for c in columns if c not in keys]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in columns])
