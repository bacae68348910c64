"""Near-duplicate vectors: rotated binary codes bound inner products, exact cosines decide."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.llm.common import block_grid, by_cell, fixed_matrix, forest, materialize, rekeyed, whole_groups
from slatework.llm.components import components

#: Rotations whose signs are a vector's stored code, and the standard errors that bounds allow.
CODES, BOUND = 4, 6.0
CLASS = "cls binary, dim int, n long, unit binary, code binary, factor binary"


@functools.cache
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random orthogonal matrices side by side, (dim x count * dim)."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)], axis=1)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign bits, correction factors) of unit vectors: for each rotation, the factor is the inner
    product of the rotated vector with its own sign vector of length one."""
    n, dim = unit.shape
    turned = unit @ rotations(dim, CODES, 1)
    factor = np.abs(turned).reshape(n, CODES, dim).sum(axis=2) / math.sqrt(dim)
    return np.packbits(turned > 0, axis=1), factor.astype("<f4")


def estimator(code: np.ndarray, factor: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors whose inner product with a unit vector is an unbiased estimate of the coded
    vector's, the standard error of that estimate)."""
    signs = np.unpackbits(code, axis=1, count=CODES * dim).astype(np.float64) * 2 - 1
    scaled = signs.reshape(-1, CODES, dim) / (CODES * math.sqrt(dim) * factor[:, :, None])
    error = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(1, dim - 1))
    return scaled.reshape(-1, CODES * dim) @ rotations(dim, CODES, 1).T, np.sqrt((error**2).sum(axis=1)) / CODES


def links_within(unit: np.ndarray, code: np.ndarray, factor: np.ndarray, least: float) -> np.ndarray:
    """Symmetric matrix of pairs with cosine >= least. Pairs whose upper confidence bound is below
    it are done with; the others' cosines are computed in double precision."""
    n, dim = unit.shape
    vectors, error = estimator(code, factor, dim)
    maybe = vectors @ unit.T + BOUND * error[:, None] >= least
    i, j = np.nonzero(np.triu(maybe & maybe.T, 1))
    linked = np.zeros((n, n), bool)
    for s in range(0, len(i), 50_000):
        a, b = i[s : s + 50_000], j[s : s + 50_000]
        yes = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
        linked[a[yes], b[yes]] = True
    return linked | linked.T


def _matrices(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dim = rows["dim"][0].as_py()
    return fixed_matrix(rows["unit"], "<f8", dim), fixed_matrix(rows["code"], "u1", -(-CODES * dim // 8)), fixed_matrix(rows["factor"], "<f4", CODES)


def class_key(v: Column) -> Column:
    """96 bits that tell vectors apart."""
    return F.unhex(F.concat(F.lpad(F.hex(F.xxhash64(v)), 16, "0"), F.lpad(F.hex(F.hash(v)), 16, "0").substr(9, 8)))


def classes_of(table: DataFrame, vector: str) -> DataFrame:
    """A row per distinct valid vector: cls, dim, n (rows that have it), unit, code, factor."""
    x = F.col(vector)
    valid = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    distinct = table.filter(valid).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                mine = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(mine)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
                code, factor = encode(unit)
                blobs = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (unit.astype("<f8"), code, factor)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(v), dim), pa.int32()), part.column(2), *blobs], ["cls", "dim", "n", "unit", "code", "factor"])

    return distinct.select(class_key(F.col("v")).alias("cls"), "v", "n").mapInArrow(run, CLASS)


def bands(n: int, least: float, miss: float) -> tuple[int, int]:
    """(bits of a band, bands) so that a random pair of n vectors seldom shares a band and a pair
    with cosine ``least`` shares none with probability ``miss`` at most."""
    width = min(48, max(8, math.ceil(math.log2(max(n, 2))) + 6))
    agree = (1 - math.acos(least) / math.pi) ** width
    return width, math.ceil(math.log(miss) / math.log1p(-agree))


def candidate_keys(classes: DataFrame, width: int, count: int) -> DataFrame:
    """(dim, key, cls): the band keys of every class, signs of further rotations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.uint64(1) << np.arange(width, dtype=np.uint64)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for start in range(0, part.num_rows, 512):
                    some = part.slice(start, 512)
                    unit = fixed_matrix(pa.chunked_array([some.column(2)]), "<f8", dim)
                    bits = unit @ rotations(dim, -(-count * width // dim), 2)[:, : count * width] > 0
                    keys = (bits.reshape(len(unit), count, width) * place).sum(axis=2, dtype=np.uint64)
                    keys += np.arange(count, dtype=np.uint64) << np.uint64(48)
                    cls = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), count)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), dim), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)), cls], ["dim", "key", "cls"])

    return classes.select("cls", "dim", "unit").mapInArrow(run, "dim int, key long, cls binary")


def _forests(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(a, b): forests of exact links within the cells of a grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [*keys, "cell_i", "cell_j"]):
            cls, sizes = table["cls"].combine_chunks(), np.diff(bounds)
            left, right = [], []
            two = bounds[:-1][sizes == 2]
            for dim in np.unique(table["dim"].to_numpy()[two]).tolist():
                a = two[table["dim"].to_numpy()[two] == dim]
                (u, c, f), (v, _, _) = (_matrices(table.take(pa.array(a + k))) for k in (0, 1))
                vectors, error = estimator(c, f, dim)
                a, u, v = (x[np.einsum("ij,ij->i", vectors, v) + BOUND * error >= least] for x in (a, u, v))
                a = a[np.einsum("ij,ij->i", u, v) >= least]
                left.append(a), right.append(a + 1)
            for g in np.flatnonzero(sizes > 2).tolist():
                s = int(bounds[g])
                root = forest(links_within(*_matrices(table.slice(s, int(sizes[g]))), least))
                moved = np.flatnonzero(root != np.arange(len(root)))
                left.append(s + moved), right.append(s + root[moved])
            if left:
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(np.concatenate(x).astype(np.int64))) for x in (left, right)], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _link_counts(rows: DataFrame, least: float) -> DataFrame:
    """(cls, links): for each class the rows of other classes linked with it, by cells that cover
    every pair of a component once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["component", "cell_i", "cell_j"]):
            cls = table["cls"].combine_chunks()
            n, chunk = (table[c].to_numpy() for c in ("n", "chunk"))
            i, j = table["cell_i"].to_numpy(), table["cell_j"].to_numpy()
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                linked = links_within(*_matrices(table.slice(s, e - s)), least)
                if i[s] != j[s]:
                    linked &= chunk[s:e, None] != chunk[None, s:e]
                yield pa.RecordBatch.from_arrays([cls.slice(s, e - s), pa.array(linked @ n[s:e], pa.int64())], ["cls", "links"])

    return rows.mapInArrow(run, "cls binary, links long")


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, miss: float = 1e-5, cell_rows: int = 1024) -> DataFrame:
    """(key, n_links, component_id, kept), a row per row of ``table``.

    Two vectors are linked if their cosine, in double precision, is at least ``least``.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest key that
    links reach, ``kept`` says whether it is the row's own.

    Method: equal vectors are one class. Sign bits of random rotations, in bands, bring classes
    together; a band's width follows the number of classes, so that by chance they seldom meet, and
    the number of bands follows from ``miss``, the chance not to find a pair just at ``least``.
    Within a band, estimates from the stored codes and factors and their confidence bounds leave
    the pairs whose cosines are computed exactly. Found links make components; all pairs of a
    component are then compared the same way, once, to count links. Crowded bands and large
    components are cut into pairs of chunks of about ``cell_rows``; tasks return forests and
    counts, never pairs.

    The bands' signs are those of the vectors as they are. Vectors that all lean to one side agree in
    most of them: then more candidates are estimated, up to all pairs, and no link is lost.

    Null, empty and zero vectors and those with null or non-finite components link with nothing;
    vectors of different lengths are not compared. Rows that repeat a key count as rows. A null key
    is never smallest; such a row is kept only if its component has no key. An empty table gives
    an empty table; other columns are ignored."""
    rows = table.select(F.col(key).cast("long").alias(key), F.col(vector).alias("v"))
    rows = rows.withColumn("cls", class_key(F.col("v")))
    classes = materialize(classes_of(rows, "v"), "vectors")
    width, count = bands(classes.count(), least, miss)
    keys = materialize(candidate_keys(classes, width, count), "bands")
    shared = keys.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    shared = rekeyed(shared, "_c", "dim", "key")
    met = keys.join(shared, ["dim", "key"]).select("key", "cls").join(classes.drop("n"), "cls").withColumn("one", F.lit(1))
    cells = by_cell(block_grid(met, ["dim", "key"], "cls", "one", cell_rows), ["dim", "key"])
    found = components(_forests(cells.select("dim", "key", "cell_i", "cell_j", "cls", "unit", "code", "factor"), ["dim", "key"], least), "a", "b")
    found = found.withColumnsRenamed({"node": "cls", "root": "component"})
    members = classes.join(found, "cls").withColumn("one", F.lit(1))
    cells = by_cell(block_grid(members, ["component"], "cls", "one", cell_rows), ["component"])
    links = _link_counts(cells.select("component", "cell_i", "cell_j", "chunk", "cls", "n", "dim", "unit", "code", "factor"), least)
    links = links.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.select("cls", "n").join(found, "cls", "left").join(links, "cls", "left")
    named = named.select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    out = rows.select(key, "cls").join(named, "cls", "left")
    least_id = out.filter("component is not null").groupBy("component").agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("_c"))
    out = out.join(rekeyed(least_id, "_c", "component"), "component", "left")
    component = F.when(F.col("component").isNull(), F.col(key)).otherwise(F.col("_least"))
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col(key)).alias("kept"))
