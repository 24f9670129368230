"""The first record of every file, and none of the rest.

Files are listed without being opened. A file's head is a scan with a limit, which ends in the executor's reader after a buffer or two
whatever the file's size; many such scans run at a time. Reader settings live in a session of their own: a scan takes a file
as one split, as later splits hold no head."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

WHOLE = 1 << 45         # bytes a split may hold: a file is never split
AT_ONCE = 32            # scans that run at a time
LINES = 16              # that a head is looked for in first


class Head(NamedTuple):
    path: str
    name: str
    bytes: int
    head: str


def listed(spark: SparkSession, directory: str, glob: str) -> list[tuple[str, str, int]]:
    """(path, name, bytes) of the matching files, in the order of their names; one row a file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    rows = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"))
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[1], r[0]))


def record(lines: list[str]) -> str | None:
    """The first record: from the first line that isn't empty to the one that closes its quotes; none if that isn't among them."""
    held: list[str] = []
    for line in lines:
        if held or line.strip("\ufeff\r"):
            held.append(line)
            if sum(x.count('"') for x in held) % 2 == 0:
                return "\n".join(held)
    return None


def heads(spark: SparkSession, directory: str, glob: str, delimiter: str | None = None) -> list[Head]:
    """The head of every matching file that isn't empty: its first record, or what stands before the first `delimiter`."""
    other = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        other.conf.set(key, str(WHOLE))

    def head(file: tuple[str, str, int]) -> Head:
        path, name, size = file
        if delimiter is not None:
            first = other.read.option("lineSep", delimiter).text(path).select(F.substring("value", 1, 64).alias("value")).head(1)
            return Head(path, name, size, first[0]["value"] if first else "")
        n = LINES
        while True:
            lines = [r["value"] for r in other.read.text(path).head(n)]
            found = record(lines)
            if found is not None or len(lines) < n:
                return Head(path, name, size, found if found is not None else "\n".join(lines))
            n *= 16

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(head, [f for f in listed(spark, directory, glob) if f[2]]))
