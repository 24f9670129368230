"""Recognising exported files by their headers, and cleaning their values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pullwise import dims
from pullwise.functions import dates, numeric
from pullwise.session import written

NO_FIELD, ONLY_KEY, LOW_CONFIDENCE = "no catalogue field", "only a shared key", "too few columns understood"


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(dims.catalogue_rows(), "layer_ord int, layer string, field_ord int, field string, category string")


def mapped_headers(headers: DataFrame, column_map: DataFrame) -> DataFrame:
    """headers(file, header_ord, header) under column_map(file or null, header, field): a file's own entry wins,
    an empty field drops the header on purpose, an unmapped header keeps its name."""
    own = column_map.where("file is not null").select("file", "header", F.col("field").alias("own_field"))
    shared = column_map.where("file is null").select("header", F.col("field").alias("shared_field"))
    named = headers.join(own, ["file", "header"], "left").join(shared, "header", "left")
    target = F.coalesce("own_field", "shared_field")
    return named.select("file", "header_ord", "header", F.coalesce(target == "", F.lit(False)).alias("blanked"),
                        F.when(target == "", F.lit(None)).otherwise(F.coalesce(target, F.col("header"))).alias("name"))


def infer_layer(names: DataFrame, key: str = "file") -> DataFrame:
    """Which layer a set of names belongs to: most hits, ties to catalogue order; confidence = hits / names.

    ``names(key, name)``; groups without a hit are returned with a null layer and confidence 0."""
    distinct = names.where(F.coalesce(F.col("name") != "", F.lit(False))).select(key, "name").distinct()
    bits = F.array_compact(F.array(*[
        F.when(F.col("name").isin(*fields), F.lit(i)) for i, fields in enumerate(dims.FIELD_CATALOGUE.values())]))
    per = distinct.withColumn("in_layers", bits).groupBy(key).agg(
        F.count(F.lit(1)).alias("names"),
        *[F.count_if(F.array_contains("in_layers", i)).alias(f"hits_{i}") for i in range(len(dims.LAYERS))])
    best = F.array_max(F.array(*[F.struct(F.col(f"hits_{i}").alias("hits"), F.lit(-i).alias("o"), F.lit(layer).alias("layer"))
                                 for i, layer in enumerate(dims.LAYERS)]))
    picked = per.withColumn("best", best)
    hit = F.col("best.hits") > 0
    return picked.select(key, F.when(hit, F.col("best.layer")).alias("layer"),
                         F.when(hit, F.round(F.col("best.hits") / F.col("names"), 3)).otherwise(0.0).alias("confidence"))


def read_verdicts(headers: DataFrame, column_map: DataFrame, min_confidence: float = dims.MIN_FILE_CONFIDENCE) -> DataFrame:
    """What is made of each file: layer, confidence, recognised, not understood and blanked headers, refusal."""
    mapped = mapped_headers(headers, column_map)
    layer = infer_layer(mapped)
    files = mapped.select("file").distinct().join(layer, "file", "left").fillna(0.0, ["confidence"])
    placed = mapped.join(files, "file")
    known = F.coalesce(reduce(Column.__or__, [
        (F.col("layer") == name) & F.col("name").isin(*fields) for name, fields in dims.FIELD_CATALOGUE.items()]), F.lit(False))
    kept = ~F.col("blanked")

    def listed(cond, what):
        got = F.array_sort(F.collect_list(F.when(cond, F.struct("header_ord", F.col(what).alias("v")))))
        return F.transform(got, lambda s: s["v"])

    per = placed.withColumn("known", known).groupBy("file", "layer", "confidence").agg(
        listed(kept & F.col("known"), "name").alias("recognised"), listed(kept & ~F.col("known"), "name").alias("not_understood"),
        listed(F.col("blanked"), "header").alias("blanked"))
    shared = F.array(*[F.lit(f) for f in dims.SHARED_FIELDS])
    reason = (F.when(F.col("layer").isNull(), NO_FIELD)
              .when(F.size(F.array_except("recognised", shared)) == 0, ONLY_KEY)
              .when(F.col("confidence") < min_confidence, LOW_CONFIDENCE))
    return per.withColumn("reason", reason)


def template_rows(headers: DataFrame, column_map: DataFrame) -> DataFrame:
    """What a person must fill in: headers not understood, and keys of another layer mapped to a file."""
    verdicts = written(read_verdicts(headers, column_map), "verdicts")
    unknown = verdicts.select("file", F.explode("not_understood").alias("header"))
    keys = {v for v in dims.SUBJECT_KEY.values()}
    own = F.coalesce(*[F.when(F.col("layer") == layer, F.lit(k)) for layer, k in dims.SUBJECT_KEY.items()])
    foreign = F.col("header").isin(*keys) & (F.col("header") != own)
    return unknown.join(verdicts.select("file", "layer"), "file").select(
        "file", "header", F.when(foreign, own).otherwise("").alias("field"))


def absent_fields(layer: str, carried: set[str]) -> list[str]:
    return [f for f in dims.FIELD_CATALOGUE[layer] if f not in carried]


def normalise_columns(df: DataFrame, dayfirst: bool = True) -> DataFrame:
    """Dates to ISO text and amounts to plain numbers, value by value; what cannot be parsed stays as written."""
    changes: dict[str, Column] = {}
    for c in df.columns:
        if c in dims.DATE_FIELDS or c in dims.DATETIME_FIELDS:
            changes[c] = dates.normalise_date(F.col(c), c in dims.DATETIME_FIELDS, dayfirst)
        elif c in dims.PARSED_NUMBER_FIELDS:
            changes[c] = F.coalesce(numeric.parse_number(F.col(c)).cast("string"), F.col(c))
    return df.withColumns(changes) if changes else df


def unparsed_counts(df: DataFrame, *keys: str, dayfirst: bool = True) -> DataFrame:
    """Per key: rows, and values of each date or amount column that could not be parsed."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in df.columns:
        if c in dims.DATE_FIELDS or c in dims.DATETIME_FIELDS:
            aggs.append(F.count_if(dates.unparsed_date(F.col(c), dayfirst)).alias(f"unparsed_{c}"))
        elif c in dims.PARSED_NUMBER_FIELDS:
            aggs.append(F.count_if(numeric.unparsed_number(F.col(c))).alias(f"unparsed_{c}"))
    return df.groupBy(*keys).agg(*aggs)


# fixed values: the messages of a row that does not fit its layer
NOT_A_NUMBER = "Input should be a valid number, unable to parse string as a number"
EXTRA_INPUT = "Extra inputs are not permitted"


def validation_errors(layer: str, df: DataFrame, row: str = "row_ix") -> DataFrame:
    """The first problem of each row that does not fit the layer: (row, field, problem)."""
    checks = []
    for f in dims.FIELD_CATALOGUE[layer]:
        if f in dims.NUMERIC_FIELDS and f in df.columns:
            checks.append((f, F.col(f).isNotNull() & F.trim(F.col(f).cast("string")).try_cast("double").isNull(), NOT_A_NUMBER))
    for c in df.columns:
        if c not in dims.FIELD_CATALOGUE[layer] and c != row:
            checks.append((c, F.col(c).isNotNull(), EXTRA_INPUT))
    first = F.coalesce(*[F.when(cond, F.struct(F.lit(f).alias("field"), F.lit(msg).alias("problem"))) for f, cond, msg in checks])
    return df.select(row, first.alias("e")).where("e is not null").select(row, "e.*")


def _fields(df: DataFrame) -> set[str]:
    return set(df.columns) - {"source_file"}


def stack(files: dict[str, DataFrame]) -> DataFrame:
    """Several files of one layer as one table: rows keep their own file's fields, never joined on the key.

    A frame that covers several files of one header names them itself in ``source_file``."""
    parts = [df if "source_file" in df.columns else df.withColumn("source_file", F.lit(name)) for name, df in files.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def is_stacked(files: dict[str, DataFrame]) -> bool:
    return len({frozenset(_fields(df)) for df in files.values()}) > 1


def relevant_names(layer: str, fields_of: dict[str, set[str]], fields: list[str] | None) -> list[str]:
    """The files a fetch has to read: those carrying an asked field other than the key; a key-only ask reads all."""
    asked = set(fields or ()) - {dims.SUBJECT_KEY[layer]}
    if not asked or len({frozenset(fs) for fs in fields_of.values()}) <= 1:
        return list(fields_of)
    return [name for name, fs in fields_of.items() if asked & fs]


def relevant_files(layer: str, files: dict[str, DataFrame], fields: list[str] | None) -> dict[str, DataFrame]:
    return {name: files[name] for name in relevant_names(layer, {n: _fields(df) for n, df in files.items()}, fields)}


def fetch_stacked(layer: str, files: dict[str, DataFrame], fields: list[str] | None = None,
                  where: dict | None = None) -> DataFrame:
    """Fetch from a layer of several files: files that carry nothing asked for are never scanned."""
    every = {c for df in files.values() for c in _fields(df)}
    chosen = relevant_files(layer, files, fields)
    table = stack(chosen) if chosen else stack(files).where(F.lit(False))
    for k, v in (where or {}).items():
        table = table.where(F.col(k).cast("string") == str(v)) if k in table.columns else table.where(F.lit(False))
    wanted = [f for f in (fields or sorted(every)) if f in table.columns]
    return table.select("source_file", *wanted)


def rows_by_file(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
