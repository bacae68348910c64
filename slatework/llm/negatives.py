"""Hard negatives for anchors among vectors: the best rows of other labels that score a little below a
positive, found with bounds from summaries of the vectors' segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatework.llm.common import materialize, rekeyed, whole_groups

#: Components of the smallest segments.
SEGMENT = 2
#: Anchors and rows whose pairs are bounded at once.
ANCHORS, ROWS = 256, 4096
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def summarize(table: DataFrame, key: str, vector: str, label: str, anchor: Column, scale: float) -> DataFrame:
    """(id, label, anchor, v, mean, dev): the scaled vectors and, of each of their segments of two
    components, the mean and the deviation (the root of the summed squares about the mean).

    Rows take part if they have an id, a label and a vector of finite components, one at least. Of rows
    that share an id one takes part, the least by label and vector."""
    x = F.col("vector")
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & finite)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.label", "r.anchor", "r.vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            dims = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                v = np.floor(part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * scale)
                parts = np.pad(v, ((0, 0), (0, -dim % SEGMENT))).reshape(len(v), -1, SEGMENT)
                mean = parts.mean(axis=2)
                blobs = [pa.array([r.tobytes() for r in m.astype("<f8")], pa.binary()) for m in (v, mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *blobs], ["id", "label", "anchor", "v", "mean", "dev"])

    return rows.mapInArrow(run, "id long, label long, anchor boolean, v binary, mean binary, dev binary")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as a matrix; shorter ones end in zeros."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(b.ljust(8 * width, b"\0") for b in blobs), "<f8").reshape(len(blobs), width)


class Side:
    """Vectors with the summaries of their segments, from one segment down to the smallest ones."""

    def __init__(self, table: pa.Table, width: int):
        count = 1 << max(0, (-(-width // SEGMENT) - 1).bit_length())
        self.id, self.label = table["id"].to_numpy(), table["label"].to_numpy()
        self.v = _matrix(table["v"], width)
        total, dev, size = _matrix(table["mean"], count) * SEGMENT, _matrix(table["dev"], count), SEGMENT
        self.levels = [(total, dev, size)]
        while total.shape[1] > 1:
            square = dev * dev + total * total / size
            total, square, size = total[:, ::2] + total[:, 1::2], square[:, ::2] + square[:, 1::2], 2 * size
            dev = np.sqrt(np.maximum(square - total * total / size, 0))
            self.levels.insert(0, (total, dev, size))
        self.norm = np.sqrt((self.v * self.v).sum(axis=1))


def _exact(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows ``p`` of a and ``q`` of b, as exact integers; those beyond 64 bits are the
    nearest that fit. Doubles hold them exactly unless the vectors are very large."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        many = 8 * len(p) >= len(a) * len(b)
        return ((a @ b.T)[p, q] if many else np.einsum("ij,ij->i", a[p], b[q])).astype(np.int64)
    rows = [sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True)) for i, j in zip(p, q, strict=True)]
    return np.array([min(max(r, _LEAST), _MOST) for r in rows], np.int64)


def _left(a: Side, b: Side, i: slice, j: slice, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``alive`` whose bounds meet the anchors' ranges, (anchors, rows): all pairs at once
    while many are left, then one by one, at ever smaller segments."""
    slack = 1e-9 * a.norm[i].max() * b.norm[j].max() + 1e-6
    pairs = None
    for (ta, da, size), (tb, db, _) in zip(a.levels, b.levels, strict=True):
        if pairs is None:
            middle, off = ta[i] @ tb[j].T / size, da[i] @ db[j].T + slack
            alive = alive & (middle + off >= low[:, None]) & (middle - off <= high[:, None])
            if np.count_nonzero(alive) * 8 < alive.size:
                pairs = np.nonzero(alive)
        else:
            p, q = pairs
            middle, off = np.einsum("ij,ij->i", ta[i][p], tb[j][q]) / size, np.einsum("ij,ij->i", da[i][p], db[j][q]) + slack
            keep = (middle + off >= low[p]) & (middle - off <= high[p])
            pairs = p[keep], q[keep]
    return np.nonzero(alive) if pairs is None else pairs


def _best(a: Side, b: Side, lows: np.ndarray, highs: np.ndarray, same: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, slot, id, score): for each slot, a range of scores, of each anchor the ``most`` best rows of
    the same or of other labels. What is found raises the bar for what comes later."""
    out: list[list[np.ndarray]] = []
    for s in range(0, len(a.id), ANCHORS):
        i = slice(s, s + ANCHORS)
        low, high = lows[i].copy(), highs[i]
        held = [np.empty(0, np.int64) for _ in range(4)]
        for t in range(0, len(b.id), ROWS):
            j = slice(t, t + ROWS)
            alive = (a.label[i, None] == b.label[None, j]) == same
            alive &= a.id[i, None] != b.id[None, j]
            open_ = low <= high
            least = np.where(open_, low, _MOST).min(axis=1).astype(np.float64)
            alive &= open_.any(axis=1)[:, None]
            p, q = _left(a, b, i, j, alive, least, np.where(open_, high, _LEAST).max(axis=1).astype(np.float64))
            score = _exact(a.v[i], b.v[j], p, q)
            fits = (score[:, None] >= low[p]) & (score[:, None] <= high[p])
            which, slot = np.nonzero(fits)
            found = p[which], slot, b.id[j][q[which]], score[which]
            held = [np.concatenate(x) for x in zip(held, found, strict=True)]
            order = np.lexsort((held[2], ~held[3], held[1], held[0]))
            held = [x[order] for x in held]
            new = np.ones(len(order), bool)
            new[1:] = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])
            starts = np.flatnonzero(new)
            place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            last = place == most - 1
            low[held[0][last], held[1][last]] = np.maximum(low[held[0][last], held[1][last]], held[3][last])
            held = [x[place < most] for x in held]
        held[0] = held[0] + s
        out.append(held)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(4))


def _cells(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Anchors, with ``n_rows`` chunks of rows, and rows, with ``n_anchors`` chunks of anchors, of the same
    group: every pair of chunks is a cell. An anchor is copied for each chunk of rows, a row for each of
    anchors."""
    chunk = F.pmod(F.xxhash64("id"), F.greatest(F.col("n_anchors"), F.lit(1))).cast("int"), F.pmod(F.xxhash64("id"), F.greatest(F.col("n_rows"), F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)), F.explode(F.sequence(F.lit(0), F.col("n_anchors") - 1))
    left = anchors.withColumn("i", chunk[0]).withColumn("j", every[0]).withColumn("row", F.lit(False))
    right = rows.withColumn("j", chunk[1]).withColumn("i", every[1]).withColumn("row", F.lit(True))
    both = left.drop("n_rows", "n_anchors").unionByName(right.drop("n_rows", "n_anchors"), allowMissingColumns=True)
    keys = ["group", "i", "j"]
    return both.repartition(*keys).sortWithinPartitions(*keys, "row")


def _searched(cells: DataFrame, width: int, same: bool, most: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score): the best rows within each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["group", "i", "j"]):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                cell = table.slice(s, e - s)
                n = cell.num_rows - pc.sum(cell["row"]).as_py()
                if not 0 < n < cell.num_rows:
                    continue
                a, b = Side(cell.slice(0, n), width), Side(cell.slice(n), width)
                slots = [x if x is not None else [{"id": -1, "score": 0}] for x in cell["positives"].slice(0, n).to_pylist()]
                ids, scores = (np.zeros((n, max(map(len, slots))), np.int64) for _ in range(2))
                lows, highs = np.full(ids.shape, _MOST), np.full(ids.shape, _LEAST)
                for k, found in enumerate(slots):
                    for at, x in enumerate(found):
                        ids[k, at], scores[k, at] = x["id"], x["score"]
                        lows[k, at], highs[k, at] = (_LEAST, _MOST) if same else (max(-(-low * x["score"] // 100), _LEAST), min(high * x["score"] // 100, _MOST))
                who, slot, got, score = _best(a, b, lows, highs, same, most)
                columns = [a.id[who], ids[who, slot], scores[who, slot], got, score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score", "id", "score"])

    return cells.select("group", "i", "j", "row", "id", "label", "v", "mean", "dev", "positives").mapInArrow(run, "anchor_id long, positive_id long, positive_score long, id long, score long")


def mine(
    table: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: float = 256.0, chunk_rows: int | None = None, chunk_anchors: int = 16_384,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each
    of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose
    scores are from ``low`` to ``high`` per cent of the positive's.

    A component x counts as floor(scale x); a score is the inner product of two rows, an exact integer.
    Ties go to the smaller key. Anchors are the rows where ``anchor`` holds.

    Method: with each vector stand the mean and deviation of its segments of two components; larger
    segments' follow from them. The inner product of two segments is their length times the product of
    the means, plus or minus the product of the deviations at most. Pairs are bounded so from one
    segment down to the smallest ones; those that can neither come into an anchor's range nor pass
    what it has already are out, and only the rest is scored exactly. Anchors, as a query set, meet
    all rows in cells of a chunk of anchors and a chunk of rows: first the rows of their label, for the
    positives, then all rows. Cells return their best rows only, and a window takes the best of those.
    A large label has many cells. A table of n rows has chunks of n / 64 rows, but from 1,024 to
    131,072, so that the copies stay few.

    Rows without key or label, and with a vector that is null, empty or has null or non-finite
    components, take no part. Of rows with the same key one takes part, the least by label and
    vector; a row is no positive or negative of itself. A shorter vector counts as ending in
    zeros. A score beyond 64 bits is the nearest number that fits. A positive with a negative score has no
    negatives, as its range is empty. No anchors, and an empty table, give an empty table; other columns are ignored."""
    rows = materialize(summarize(table, key, vector, label, anchor, scale), "segments")
    total, n_anchors, width = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max(F.length("v")), F.lit(8))).first()
    width //= 8
    size = chunk_rows or min(131_072, max(1024, -(-total // 64)))

    def chunks(n: Column | int, of: int) -> Column:
        return F.ceil((F.lit(n) if isinstance(n, int) else n) / of).cast("int")

    counted = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).filter("a > 0")
    counted = rekeyed(counted.select("label", "n", chunks(F.col("a"), chunk_anchors).alias("n_anchors"), chunks(F.col("n"), size).alias("n_rows")), "n", "label")
    known = rows.join(counted, "label").withColumn("group", F.col("label"))
    slots = "array<struct<id: long, score: long>>"
    first = _cells(known.filter("anchor").withColumn("positives", F.lit(None).cast(slots)), known)
    found = _searched(first, width, True, positives, low, high)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    found = materialize(found.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).cast(slots).alias("positives")), "positives")
    grid = {"group": F.lit(0).cast("long"), "n_anchors": chunks(n_anchors, chunk_anchors), "n_rows": chunks(total, size)}
    asking = rows.filter("anchor").join(found.withColumnRenamed("anchor_id", "id"), "id")
    best = _searched(_cells(asking.withColumns(grid), rows.withColumns(grid)), width, False, negatives, low, high)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
