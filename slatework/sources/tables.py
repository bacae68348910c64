"""CSV ingestion, named datasets and previews."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Mapping
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.functions.text import NA_TOKENS
from slatework.operators.clean import Cleaned, clean, kinds_from, observing_kinds
from slatework.operators.scratch import delete, scratch
from slatework.operators.stats import nan_to_null
from slatework.sources.records import line_end, lines, records, scanned


_CSV = {"quote": '"', "escape": '"', "columnPruning": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record"}


def _parsed(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(the fields of a CSV file as text under numbered names, with the text of rows that have too many
    as the last column; the names of the header)."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError(f"not a CSV file: {path}")
    head = spark.read.csv(path, header=False, quote='"', escape='"', multiLine=True).limit(1).collect()
    if not head:
        raise ValueError(f"no header in {path}")
    names = [(n.removeprefix("\ufeff") if i == 0 else n) if n is not None else f"column_{i}" for i, n in enumerate(head[0])]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_record", T.StringType())])
    text = lines(spark, path)
    end = line_end(text)
    if end is None:
        df = records(text).select(F.from_csv("record", ", ".join(f"{c} string" for c in schema.names), _CSV).alias("r")).select("r.*")
    else:
        df = spark.read.schema(schema).options(**_CSV, header="true", enforceSchema="true", lineSep=end).csv(path)
    # Spark reads no record text on its own, so a field is looked at too
    odd = F.col("_record").isNotNull() & (F.length(F.coalesce("_c0", F.lit(""))) >= 0)
    over = F.when(odd & (scanned(F.col("_record"))["fields"] > len(names)), F.col("_record"))
    return df.select(*[F.when(~F.trim(c).isin(*NA_TOKENS), F.col(c)).alias(c) for c in df.columns[:-1]], over.alias("_extra")), names


def _refusing_extra(df: DataFrame, n: int) -> DataFrame:
    told = F.concat(F.lit(f"{TOO_MANY} ({n}): "), F.substring("_extra", 1, 200))
    return df.filter(F.coalesce(F.when(F.col("_extra").isNotNull(), F.raise_error(told).cast("boolean")), F.lit(True))).drop("_extra")


def read_csv(spark: SparkSession, path: str, extra: str = "raise") -> DataFrame:
    """A CSV file or folder with a header line in each file, every column as text, under its own names.

    Fields may be quoted, with doubled quotes, commas and line breaks inside. Many tasks read a file:
    if no line leaves a quoted field open, lines are records, and Spark's reader takes them; else :func:`records` finds the true
    records of every split. Names are read as data, so repeated ones stay as they are until they
    are normalised. The usual marks of a missing value are null, and so are fields that a row lacks.

    A row with more fields than the header fails the job that reads it; :func:`ingest` makes it a
    ValueError. With ``extra="keep"`` it stays, and column ``extra_fields`` holds its whole text; the column is there if there are such rows.
    ValueError unless the name ends in .csv, or without rows."""
    df, names = _parsed(spark, path)
    with refusing():
        if df.isEmpty():
            raise ValueError(f"no rows in {path}")
        if extra == "keep" and not df.filter("_extra is not null").isEmpty():
            return df.toDF(*names, "extra_fields")
        return (df.drop("_extra") if extra == "keep" else _refusing_extra(df, len(names))).toDF(*names)


#: What an error says of a row with more fields than the header.
TOO_MANY = "a row has more fields than the header"


@contextlib.contextmanager
def refusing() -> Iterator[None]:
    """Errors of jobs that are due to rows with too many fields become ValueErrors."""
    try:
        yield
    except PySparkException as e:
        if TOO_MANY in str(e):
            raise ValueError(str(e)[str(e).index(TOO_MANY) :].split("\n")[0][:300]) from None
        raise


def ingest(spark: SparkSession, path: str, rename: Mapping[str, str] | None = None, semantic_hints: Mapping[str, str] | None = None, extra: str = "raise") -> Cleaned:
    """A cleaned table from a CSV file, or from Parquet by any other name.

    A CSV file is parsed once: its text goes to Parquet in the shared folder, from which the result is then
    read. What the write observes, the number of rows, rows with too many fields and the kinds of texts of all
    columns, needs no scan of its own. Rows with too many fields raise ValueError or, with
    ``extra="keep"``, are kept in column ``extra_fields`` and logged."""
    if not path.lower().rstrip("/").endswith(".csv"):
        return clean(spark.read.parquet(path), rename, semantic_hints)
    df, names = _parsed(spark, path)
    stored, seen = scratch(spark, "text"), Observation()
    fields = df.columns[:-1]
    counts = F.count(F.lit(1)).alias("_rows"), F.count("_extra").alias("_over"), F.min("_extra").alias("_first")
    observing_kinds(df, fields, seen, *counts).write.parquet(stored)
    found = seen.get
    if not found["_rows"] or found["_over"] and extra != "keep":
        delete(spark, stored)
        raise ValueError(f"{TOO_MANY} ({len(names)}): {found['_first'][:200]}" if found["_rows"] else f"no rows in {path}")
    text = spark.read.parquet(stored)
    kinds = kinds_from({c: found[c] for c in fields})
    if found["_over"]:
        text = text.toDF(*names, "extra_fields")
        # whole records are kept as they are
        kinds = kinds and [*kinds.values(), {(None, False): found["_rows"]}]
    else:
        text, kinds = text.drop("_extra").toDF(*names), kinds and list(kinds.values())
    done = clean(text, rename, semantic_hints, kinds)
    if found["_over"]:
        return replace(done, actions=(("extra_fields", f"Kept {found['_over']} rows with more fields than the header", found["_over"]), *done.actions))
    return done


def load(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with NaN as null."""
    return nan_to_null(spark.read.parquet(path))


def register(df: DataFrame, name: str) -> str:
    """Make a table known by name in the session."""
    df.createOrReplaceTempView(name)
    return name


def dataset(spark: SparkSession, name: str) -> DataFrame:
    """A registered table; KeyError if there is none of the name."""
    if not spark.catalog.tableExists(name):
        raise KeyError(name)
    return spark.table(name)


def preview(df: DataFrame, rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """(the first rows, a one-row table with the total)."""
    return df.limit(rows), df.agg(F.count(F.lit(1)).alias("total"))
