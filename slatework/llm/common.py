"""Helpers that several operators share: scratch tables, whole-group batches, block grids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of the tables that :func:`materialize` wrote in this process and nobody deleted yet.
MADE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves a
    local session, as in tests; on a cluster, where executors could not read it, that is a ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
        base = tempfile.mkdtemp(prefix="slatework-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, and no
    executor's loss can take the rows away."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/slatework-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._slatework_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    _delete(df.sparkSession, df._slatework_path)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what :func:`materialize` wrote since there were ``since`` tables in MADE. Operators'
    results read such tables when they are computed, so only whoever has written a result can tell
    that they are done with."""
    for path in MADE[since:]:
        if keep is None or path != keep._slatework_path:
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if name in MADE:
        MADE.remove(name)


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a text or binary column, 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def slices(batch: pa.RecordBatch, weights: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``most`` total weight (or one row), so that what a task makes of them
    stays small however large the batch is."""
    start, total = 0, 0
    for i, weight in enumerate(weights.tolist()):
        if total and total + weight > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += weight
    if batch.num_rows > start:
        yield batch.slice(start)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front of those that columns of ``df`` have already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys``, yield tables of whole groups with the groups' bounds
    (starts, and the end of the last). A group that spans batches is carried over."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = _bounds(pa.Table.from_batches([batch]), keys)
        if rest:
            edge = pa.Table.from_batches([rest[-1].slice(rest[-1].num_rows - 1), batch.slice(0, 1)])
            if len(_bounds(edge, keys)) == 2 and len(bounds) == 2:
                rest.append(batch)
                continue
            if len(_bounds(edge, keys)) == 2:
                rest.append(batch.slice(0, int(bounds[1])))
                batch, bounds = batch.slice(int(bounds[1])), bounds[1:] - bounds[1]
            yield pa.Table.from_batches(rest).combine_chunks(), np.array([0, sum(b.num_rows for b in rest)])
            rest = []
        last = int(bounds[-2])
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)]), bounds[:-1]
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks(), np.array([0, sum(b.num_rows for b in rest)])


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group starts, and the number of rows."""
    n, new = table.num_rows, np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), n)


def fixed_matrix(column: pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def rekeyed(counts: DataFrame, n: str, *keys: str) -> DataFrame:
    """The keys of a grouped table with positive counts ``n``, as columns that Spark takes as new: a
    join on them shuffles both sides anew, so that Spark may split a crowded key's rows."""
    return counts.select(*[F.when(F.col(n) > 0, F.col(k)).alias(k) for k in keys], *[c for c in counts.columns if c not in (n, *keys)])


def block_grid(df: DataFrame, keys: list[str], member: str, weight: str, limit: int) -> DataFrame:
    """Cut the groups of ``keys`` into chunks of about ``limit`` total ``weight`` and lay every
    pair of chunks on a cell of its own, so that all pairs of a group meet in some cell while no
    task ever holds a whole large group.

    Adds ``cell_i <= cell_j`` and ``chunk`` (the row's own chunk, one of the two). A group within
    the limit is the single cell (0, 0). A row of a group of g chunks is copied g times. Groups
    are sized by a partial aggregate; only oversized ones enter the join, whose strategy is left
    to Spark, which splits its skewed side."""
    big = df.groupBy(*keys).agg(F.sum(F.col(weight).cast("long")).alias("_w"), F.count(F.lit(1)).alias("_n"))
    big = big.filter((F.col("_w") > limit) & (F.col("_n") > 1)).withColumn("_g", F.ceil(F.col("_w") / limit).cast("int"))
    big = rekeyed(big.drop("_w"), "_n", *keys)
    out = df.join(big, keys, "left").withColumn("chunk", F.pmod(F.xxhash64(member), F.coalesce("_g", F.lit(1))).cast("int"))
    other = F.sequence(F.lit(0), F.coalesce("_g", F.lit(1)) - 1)
    out = out.withColumn("_o", F.explode(other))
    return out.withColumns({"cell_i": F.least("chunk", "_o"), "cell_j": F.greatest("chunk", "_o")}).drop("_g", "_o")


def by_cell(df: DataFrame, keys: list[str], *within: str) -> DataFrame:
    """Deal cells of :func:`block_grid` to tasks, sorted for :func:`whole_groups`, and ``within`` cells."""
    cols = [*keys, "cell_i", "cell_j"]
    return df.repartition(*cols).sortWithinPartitions(*cols, *within)


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, each row's smallest connected row."""
    n = len(linked)
    label = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new
