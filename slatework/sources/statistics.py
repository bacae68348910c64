"""Statistics of a Parquet folder that are kept by file, so that appended data costs a scan of itself only.

Every statistic is a mergeable partial: counts, extremes, a sketch of distinct values, the least values.
Those of a folder are the merged ones of its files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from slatework.operators.profile import plain_fields, profile_rows
from slatework.operators.stats import Least, as_text, col, is_number

#: One row a file and column.
SCHEMA = "file string, modified timestamp, column string, n long, missing long, low double, high double, distinct binary, least array<string>"
#: Least values kept of each column and file.
LEAST = 20


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified): the Parquet files of a folder, by a listing; none is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"))


def _least_by_file(df: DataFrame, names: list[str]) -> DataFrame:
    """(file, i, least): the least values of each column in each file; tasks keep a few of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], Least] = {}
        for batch in batches:
            file = batch.column(0).dictionary_encode()
            codes = file.indices.to_numpy()
            for code in np.unique(codes).tolist():
                mine, name = batch.filter(pa.array(codes == code)), file.dictionary[code].as_py()
                for i in range(len(names)):
                    found.setdefault((name, i), Least(LEAST)).add(mine.column(i + 1))
        for (name, i), f in found.items():
            values = [v for _, v in f.keys]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array([i] * len(values), pa.int32()), pa.array(values, pa.string())], ["file", "i", "value"])

    texts = df.select(F.col("_metadata.file_path").alias("file"), *[as_text(df, c).alias(f"_{i}") for i, c in enumerate(names)])
    kept = texts.mapInArrow(run, "file string, i int, value string")
    return kept.groupBy("file", "i").agg(_least_of(F.collect_set("value")).alias("least"))


def _least_of(values: Column) -> Column:
    keyed = F.array_sort(F.transform(values, lambda v: F.struct(F.lower(v).alias("l"), v.alias("v"))))
    return F.transform(F.slice(keyed, 1, LEAST), lambda k: k["v"])


def file_statistics(df: DataFrame) -> DataFrame:
    """SCHEMA's rows for the files that ``df`` reads: two scans of these files, and a row of partials a
    file and column. Nested columns are left out; NaN is missing; a file without rows has no statistics."""
    fields = plain_fields(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        x = F.when(~F.isnan(col(f.name)), col(f.name)) if f.dataType.typeName() in ("double", "float") else col(f.name)
        number = x.cast("double") if is_number(f.dataType) else F.lit(None).cast("double")
        aggs += [F.count(x).alias(f"k{i}"), F.min(number).alias(f"low{i}"), F.max(number).alias(f"high{i}"), F.theta_sketch_agg(F.when(x.isNotNull(), as_text(df, f.name)), 12).alias(f"distinct{i}")]
    wide = df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).agg(*aggs)
    parts = [F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), (F.col("n") - F.col(f"k{i}")).alias("missing"), *[F.col(f"{c}{i}").alias(c) for c in ("low", "high", "distinct")]) for i, f in enumerate(fields)]
    rows = wide.select("file", "modified", "n", F.inline(F.array(*parts)))
    least = _least_by_file(df, [f.name for f in fields])
    found = rows.join(least, ["file", "i"], "left").withColumn("least", F.coalesce("least", F.array().cast("array<string>")))
    return found.select(*[x.split()[0] for x in SCHEMA.split(", ")])


def refresh(spark: SparkSession, path: str, kept: str) -> tuple[DataFrame, list[str]]:
    """(the current statistics of a folder, the files that were scanned for them). ``kept`` is the table of
    statistics, to which those of new and changed files are added; those of files that are gone do
    not count any more."""
    try:
        known = spark.read.schema(SCHEMA).parquet(kept)
    except AnalysisException:
        known = spark.createDataFrame([], SCHEMA)
    now = files(spark, path)
    here = F.regexp_replace("file", "^file:/+", "file:/")
    seen = known.select(here.alias("_f"), "modified").distinct()
    new = [r["file"] for r in now.withColumn("_f", here).join(seen, ["_f", "modified"], "left_anti").collect()]
    if new:
        file_statistics(spark.read.option("mergeSchema", "true").parquet(*new)).write.mode("append").parquet(kept)
        known = spark.read.schema(SCHEMA).parquet(kept)
    current = now.select(here.alias("_f"), "modified")
    return known.withColumn("_f", here).join(current, ["_f", "modified"], "left_semi").drop("_f"), new


def merged(statistics: DataFrame) -> DataFrame:
    """(column, n, missing, low, high, about, least): the files' partials put together. A column that a
    file lacks is missing in all its rows."""
    whole = statistics.select("file", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    by_column = statistics.groupBy("column").agg(
        F.sum("n").alias("_n"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.theta_sketch_estimate(F.theta_union_agg("distinct", 12)).alias("about"), _least_of(F.array_distinct(F.flatten(F.collect_list("least")))).alias("least"),
    )
    n = whole.first()["whole"]
    return by_column.select("column", F.lit(n).alias("n"), (F.col("missing") + F.lit(n) - F.col("_n")).alias("missing"), "low", "high", "about", "least")


def missing_counts(statistics: DataFrame) -> DataFrame:
    """(column, missing) of the columns with missing values."""
    return merged(statistics).filter("missing > 0").select("column", "missing")


def profile(statistics: DataFrame, like: DataFrame) -> DataFrame:
    """The profile of :func:`column_profile` from statistics alone, for the columns of ``like``; distinct
    counts are exact up to 4,096 values and estimates beyond."""
    found = {r["column"]: r for r in merged(statistics).collect()}
    fields = [f for f in plain_fields(like) if f.name in found]
    rows = next((r["n"] for r in found.values()), 0)
    ranges = {f.name: (found[f.name]["low"], found[f.name]["high"]) for f in fields if is_number(f.dataType)}
    return profile_rows(like, fields, rows, {f.name: int(found[f.name]["about"]) for f in fields}, {f.name: found[f.name]["least"] for f in fields}, ranges)
