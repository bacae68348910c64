"""Near-duplicate documents: bottom-k sketches find candidates, exact Jaccard on full sets decides."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.llm.common import by_cell, materialize, rekeyed, unused, whole_groups
from slatework.llm.components import components

#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Values of a sketch that the inverted lists hold; two sets with Jaccard J share none of them
#: with a probability of (1 - J) ** LISTED.
LISTED = 8
#: Values of the sketches that estimates use, as 32-bit prefixes.
SKETCH = 48
#: Standard errors by which an estimate may be too low: of pairs just at the threshold, one in 10**8 or so is lost.
SLACK = 6.5
#: Fills up shorter sketches.
FILL = np.uint32(0xFFFFFFFF)
REMEMBERED = 500_000


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of a text's words; one hash function for all."""

    def __init__(self, width: int):
        self.width, self.at = width, {}
        self.scale = np.array([xxhash.xxh64_intdigest(b"place", i) | 1 for i in range(width)], dtype=np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(LOWER).split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.at) > REMEMBERED:
            self.at.clear()
        at = self.at
        try:
            codes = [at[w] for w in words]
        except KeyError:
            for w in words:
                if w not in at:
                    at[w] = xxhash.xxh3_64_intdigest(w)
            codes = [at[w] for w in words]
        codes = np.array(codes, dtype=np.uint64)
        width = min(self.width, len(codes))
        n = len(codes) - width + 1
        mixed = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            x = codes[i : i + n] * self.scale[i]
            mixed = (mixed ^ (x ^ (x >> np.uint64(31)))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed * np.uint64(0xD6E8FEB86659FD93))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, listed, sketch): text_key is a hash of the text, set_key is
    a 128-bit hash of the whole set,
    null if it is empty; listed and sketch are its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [shingler.of(t.as_py()) for t in batch.column(1)]
            low = [(s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            arrays = [batch.column(0), batch.column(2), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array([s[:LISTED].astype(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_shingles", "set_key", "listed", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, listed array<long>, sketch binary")


def close_pairs(blobs: list[bytes], dtype: str, sizes: np.ndarray, chunk: np.ndarray, ratio: Fraction, need, rows: int = 256, strip: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) of pairs of sets whose sizes allow ``ratio`` and whose overlap is at least
    ``need(i, j)``. If two chunks are given, only pairs between them.

    Sets are taken in order of size, so that a block of rows meets only the run of larger sets
    that can fit. Overlaps are products of membership matrices over the values of the block."""
    order = np.lexsort((chunk, sizes))
    sizes, across = sizes[order], len(np.unique(chunk)) > 1
    chunk = chunk[order]
    blobs = [blobs[k] for k in order.tolist()]
    values = np.frombuffer(b"".join(blobs), dtype=dtype)
    lengths = np.array([len(x) // np.dtype(dtype).itemsize for x in blobs])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(blobs)), lengths)
    for r0 in range(0, len(blobs), rows):
        r1 = min(r0 + rows, len(blobs))
        top = int(np.searchsorted(sizes, int(sizes[r1 - 1]) * ratio.denominator // ratio.numerator, "right"))
        base = int(ends[r0] - lengths[r0])
        inside, whose = values[base : ends[top - 1]], owner[base : ends[top - 1]] - r0
        known = np.unique(values[base : ends[r1 - 1]])
        place = np.minimum(np.searchsorted(known, inside), len(known) - 1)
        held = known[place] == inside
        place, whose = place[held], whose[held]
        both = np.zeros((r1 - r0, top - r0), dtype=np.float32)
        by = np.argsort(place, kind="stable")
        place, whose = place[by], whose[by]
        for start in range(0, len(known), strip):
            lo, hi = np.searchsorted(place, [start, start + strip])
            x = np.zeros((top - r0, min(strip, len(known) - start)), dtype=np.float32)
            x[whose[lo:hi], place[lo:hi] - start] = 1
            both += x[: r1 - r0] @ x.T
        i, j = np.nonzero(both)
        keep = (j > i) & (chunk[i + r0] != chunk[j + r0] if across else True)
        i, j = i[keep], j[keep]
        overlap = np.rint(both[i, j]).astype(np.int64)
        i, j = order[i + r0], order[j + r0]
        keep = overlap >= need(i, j)
        yield i[keep], j[keep], overlap[keep]


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after links i-j: each row's smallest connected row."""
    root = root.copy()
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]


def union_estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches (rows, sorted, filled up with the largest value):
    the share of the SKETCH smallest values of the union that both hold. A union with fewer
    values is judged by all of them, exactly."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != FILL
    twin = np.zeros(both.shape, bool)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twin, axis=1)
    shared = (twin & (rank <= SKETCH)).sum(axis=1)
    return shared / np.clip(rank[:, -1], 1, SKETCH)


def _candidate_roots(rows: pa.Table, ratio: Fraction, slack: float) -> np.ndarray:
    """Roots of one list's cell by sketches. Overlaps that cannot reach the estimate wanted go
    first; the rest is estimated from the union's sketch, the best first, unless the pair is
    connected already."""
    low, n = float(ratio) - slack, rows.num_rows
    blobs, sizes = rows["sketch"].to_pylist(), rows["n_shingles"].to_numpy()
    held = np.minimum(sizes, SKETCH)
    table = np.full((n, SKETCH), FILL, dtype="<u4")
    for k, x in enumerate(blobs):
        table[k, : len(x) // 4] = np.frombuffer(x, dtype="<u4")
    if n == 2:
        i, j, both = np.array([0]), np.array([1]), np.array([0])
        if min(sizes) * ratio.denominator < max(sizes) * ratio.numerator:
            return np.arange(2)
    else:
        chunk = rows["chunk"].to_numpy() if rows["cell_i"][0] != rows["cell_j"][0] else np.zeros(n)
        found = list(close_pairs(blobs, "<u4", sizes, chunk, ratio, lambda i, j: low * np.maximum(held[i], held[j])))
        i, j, both = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(-both, kind="stable")
    i, j, root = i[by], j[by], np.arange(n)
    while len(i):
        some = slice(0, 20_000)
        yes = union_estimates(table[i[some]], table[j[some]]) >= low
        root = merge(root, i[some][yes], j[some][yes])
        i, j = i[20_000:], j[20_000:]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def banded_grid(df: DataFrame, key: str, member: str, size: str, weight: str, limit: int, ratio: Fraction) -> DataFrame:
    """Lay the sets of each ``key`` out in cells so that all pairs whose sizes allow ``ratio`` meet in
    some cell, and no cell has much more than twice ``limit`` total ``weight``. Rows that are alone
    with their key meet nothing and go.

    Adds ``band``, ``cell_i <= cell_j`` and ``chunk`` (the row's own chunk, one of the two). A key within
    the limit is the single cell (0, 0, 0). The sets of another are told by bands of sizes, so wide that
    sets that can be linked are in the same or in neighbouring bands; every two neighbours are a group,
    and a group over the limit is cut into chunks, of which each pair is a cell. Bands are weighed by a
    partial aggregate, and a key's few bands are a map in its row; in the join Spark splits skewed sides."""
    # a little narrower steps than the ratio, so that rounding never puts linked sets two bands apart
    band = F.floor(F.log(F.col(size)) / float(np.log(float(1 / ratio)) * 1.0001)).cast("int")
    df = df.withColumn("_band", band)
    sums = df.groupBy(key, "_band").agg(F.sum(F.col(weight).cast("long")).alias("_w"), F.count(F.lit(1)).alias("_n"))
    keys = sums.groupBy(key).agg(F.sum("_w").alias("_all"), F.sum("_n").alias("_k"), F.map_from_entries(F.collect_list(F.struct("_band", "_w"))).alias("_in")).filter("_k > 1")

    def group(at: Column) -> Column:
        total = sum((F.coalesce(F.try_element_at("_in", x), F.lit(0)) for x in (at, at - 1)), F.lit(0))
        return F.struct(at.alias("band"), F.greatest(F.ceil(total / limit), F.lit(1)).cast("int").alias("_g"))

    plan = keys.select("*", F.explode(F.map_keys("_in")).alias("_band"))
    to = F.when(F.col("_all") > limit, F.array(group(F.col("_band")), group(F.col("_band") + 1))).otherwise(F.array(F.struct(F.lit(0).alias("band"), F.lit(1).alias("_g"))))
    out = df.join(rekeyed(plan.select(key, "_band", "_k", to.alias("_to")), "_k", key, "_band"), [key, "_band"])
    out = out.withColumn("_to", F.explode("_to"))
    out = out.select("*", F.col("_to.band").alias("band"), F.col("_to._g").alias("_g")).withColumn("chunk", F.pmod(F.xxhash64(member), F.col("_g")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return out.withColumns({"cell_i": F.least("chunk", "_o"), "cell_j": F.greatest("chunk", "_o")}).drop("_g", "_o", "_to", "_band")


def sketch_values(rows: DataFrame, least: float) -> DataFrame:
    """(set_key, value, n_values, n_rarest), a row for each value of the sketches of ``rows``. Two sketches of
    which the share ``least`` of the larger is in both have a value in common among each one's
    ``n_rarest`` first values, in whatever order, if it is the same one for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(x, dtype="<u4")) for x in batch.column(1).to_pylist()]
            n, held = np.array([len(x) for x in found], dtype=np.int64), np.minimum(batch.column(2).to_numpy(), SKETCH)
            rarest = n - np.ceil(least * held - 1e-9).astype(np.int64) + 1
            values = np.concatenate([*found, np.empty(0, dtype="<u4")]).astype(np.int64)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(values), pa.array(np.repeat(n, n)), pa.array(np.repeat(rarest, n))], ["set_key", "value", "n_values", "n_rarest"])

    return rows.select("set_key", "sketch", "n_shingles").mapInArrow(run, "set_key binary, value long, n_values long, n_rarest long")


def shortened(classes: DataFrame, least: float, most_rows: int) -> DataFrame:
    """``classes`` with the lists that each set is to be on as ``listed``: those longer than ``most_rows`` are
    left, where that loses nothing, for lists of values that are rare among the sets on them.

    Of the sets on long lists all values of the sketches are counted. Two of them whose sketches share
    enough to pass the estimate share one of the values that are each one's rarest (:func:`sketch_values`),
    so each goes on the lists of those: values that no other set has need none. A set leaves the long
    lists if no list of its rarest values is long, as such a set meets all others on these; sets whose
    rarest values are common too (near copies in thousands) stay on both."""
    long_lists = classes.select(F.explode("listed").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    long_lists = materialize(long_lists.filter(F.col("n") > most_rows), "long_lists")
    if long_lists.isEmpty():
        return classes
    on = classes.select("set_key", F.explode("listed").alias("value")).join(rekeyed(long_lists, "n", "value"), "value")
    on = on.groupBy("set_key").agg(F.collect_set("value").alias("long"))
    values = sketch_values(classes.join(on.select("set_key"), "set_key"), least)
    known = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).withColumn("m", F.col("n"))
    near = values.join(rekeyed(known, "n", "value"), "value").groupBy("set_key", "n_values", "n_rarest")
    near = near.agg(F.sort_array(F.collect_list(F.struct("m", "value"))).alias("near"))
    # values of this set alone come first in the order
    first = F.slice("near", 1, F.greatest(F.col("n_rarest") - F.col("n_values") + F.size("near"), F.lit(0)).cast("int"))
    near = near.select("set_key", first.alias("first")).select("set_key", F.forall("first", lambda x: x.m <= most_rows).alias("free"), F.filter("first", lambda x: x.m <= most_rows).alias("rare"))
    lists = on.join(near, "set_key", "left").select("set_key", F.when(F.coalesce("free", F.lit(True)), F.col("long")).alias("left"), F.transform("rare", lambda x: -1 - x.value).alias("rare"))
    none = F.array().cast("array<long>")
    listed = F.concat(F.array_except("listed", F.coalesce("left", none)), F.coalesce("rare", none))
    # written, as laying them out reads them several times
    return materialize(classes.join(lists, "set_key", "left").select("set_key", "n_shingles", "sketch", listed.alias("listed")), "lists")


def candidate_cells(classes: DataFrame, ratio: Fraction, slack: float, list_rows: int, most_rows: int) -> DataFrame:
    """The sets of each list, once for each cell in which they are compared. Lists longer than
    ``list_rows`` are laid out by :func:`banded_grid`, after those longer than ``most_rows`` are
    :func:`shortened`: at eight chunks, copies cost about what counting a sketch's values does. Most
    values are on one set's list only, so sketches join after the layout."""
    classes = shortened(classes, float(ratio) - slack, most_rows)
    lists = classes.select("set_key", "n_shingles", F.explode("listed").alias("value"), F.lit(1).alias("one"))
    cells = banded_grid(lists, "value", "set_key", "n_shingles", "one", list_rows, ratio)
    return cells.join(classes.select("set_key", "sketch"), "set_key")


def candidates(classes: DataFrame, ratio: Fraction, list_rows: int = 1024, most_rows: int = 8192) -> DataFrame:
    """(a, b): a forest of candidate links between set_keys, from the inverted lists of the
    listed hashes, as :func:`candidate_cells` lays them out. Rows of a cell are in order of set_key, so
    that the trees of a cluster in different cells mostly have one root: fewer rounds find the components."""
    slack = SLACK * float(np.sqrt(float(ratio) * (1 - float(ratio)) / SKETCH))
    cells = by_cell(candidate_cells(classes, ratio, slack, list_rows, most_rows), ["value", "band"], "set_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["value", "band", "cell_i", "cell_j"]):
            sizes, keys = np.diff(bounds), table["set_key"].combine_chunks()
            left, right = [], []
            for g in np.flatnonzero(sizes > 1).tolist():
                root = _candidate_roots(table.slice(int(bounds[g]), int(sizes[g])), ratio, slack)
                moved = np.flatnonzero(root != np.arange(len(root)))
                left.append(moved + bounds[g]), right.append(root[moved] + bounds[g])
            if left:
                ends = [keys.take(pa.array(np.concatenate(x))) for x in (left, right)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    cols = cells.select("value", "band", "cell_i", "cell_j", "chunk", "set_key", "n_shingles", "sketch")
    return cols.mapInArrow(run, "a binary, b binary")


def _exact_roots(rows: pa.Table, ratio: Fraction) -> np.ndarray:
    """Roots of one cluster's cell by exact Jaccard on full sets."""
    blobs, n = rows["full"].to_pylist(), rows.num_rows
    sizes = np.array([len(x) // 8 for x in blobs], dtype=np.int64)
    p, q = ratio.numerator, ratio.denominator
    if n == 2:
        a, b = (np.frombuffer(x, dtype="<u8") for x in blobs)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return np.array([0, 0]) if both * q >= (len(a) + len(b) - both) * p else np.arange(2)
    chunk = rows["chunk"].to_numpy() if rows["cell_i"][0] != rows["cell_j"][0] else np.zeros(n)
    root = np.arange(n)
    # both / (a + b - both) >= p / q, in whole numbers
    for i, j, _ in close_pairs(blobs, "<u8", sizes, chunk, ratio, lambda i, j: -(-(sizes[i] + sizes[j]) * p // (p + q))):
        root = merge(root, i, j)
    return root


def keyed(docs: DataFrame, own: str = "own_id", key: str = "text_key") -> DataFrame:
    """Adds what tells rows apart: the doc_id (the largest number for null) and a hash of the text."""
    return docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), key: F.xxhash64("text")})


def verified(docs: DataFrame, clusters: DataFrame, width: int, ratio: Fraction, cell_weight: int = 1_500_000) -> DataFrame:
    """(a, b): a forest of exact links. ``clusters`` has (own_id, text_key, set_key, cluster) of one
    document of each set. Full sets are made again from whole texts, of these documents only; a
    cluster of more than ``cell_weight`` values (each set counts 1,000 more) is laid out by
    :func:`banded_grid`."""
    texts = keyed(docs.select("doc_id", "text")).join(clusters, ["own_id", "text_key"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, done = Shingler(width), set()
        for batch in batches:
            found = []
            for text, key, cluster in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key in done:  # a row that repeats
                    continue
                s = shingler.of(text).astype("<u8").tobytes()
                if xxhash.xxh3_128_digest(s) == key:
                    done.add(key)
                    found.append((key, cluster, s, len(s) // 8, 1000 + len(s) // 8))
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            columns = zip(*found, strict=True) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["set_key", "cluster", "full", "size", "weight"])

    sets = materialize(texts.select("text", "set_key", "cluster").mapInArrow(full, "set_key binary, cluster binary, full binary, size long, weight long"), "sets")
    cells = by_cell(banded_grid(sets, "cluster", "set_key", "size", "weight", cell_weight, ratio), ["cluster", "band"], "set_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["cluster", "band", "cell_i", "cell_j"]):
            keys = table["set_key"].combine_chunks()
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s > 1:
                    root = _exact_roots(table.slice(s, e - s), ratio)
                    moved = np.flatnonzero(root != np.arange(len(root)))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(moved + s)), keys.take(pa.array(root[moved] + s))], ["a", "b"])

    return cells.select("cluster", "band", "cell_i", "cell_j", "chunk", "set_key", "full").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key), a row per document.

    Words are runs of characters other than blank and control white space, with A-Z lower-cased. A
    document's set holds its distinct shingles of ``width`` words, or all its words as one
    shingle if they are fewer. Documents are linked if 100 x intersection >= ``percent`` x union.
    component_id is the smallest doc_id that links reach, and kept is whether it is the
    document's own.

    Method: equal sets are one class. Each class's bottom-k sketch comes from one hash function;
    inverted lists of its smallest values bring classes together, overlaps and union-sketch
    estimates filter them, and clusters of what is left are compared by exact Jaccard on full
    sets (of 64-bit shingle hashes). Sets on very long lists go to lists of their rarest sketch values instead.
    Long lists and large clusters are cut by bands of sizes and then into pairs of chunks; tasks
    return forests of links, never all pairs.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat a doc_id
    are compared each by its own text. A row with a null doc_id takes part as all others; it is
    never the smallest and takes its component's smallest id; if there is none, the rows with one of
    its texts are kept. An empty table gives an empty table; other columns are ignored."""
    ratio = Fraction(percent, 100)
    rows = materialize(sketches(docs, width), "sketches")
    place = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("own_id"), "text_key")).alias("place")
    classes = rows.filter("set_key is not null").groupBy("set_key").agg(place, F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("listed").alias("listed"))
    classes = materialize(classes, "classes")
    near = components(candidates(classes, ratio), "a", "b").withColumnsRenamed({"node": "set_key", "root": "cluster"})
    clusters = classes.select("set_key", "place.own_id", "place.text_key").join(near, "set_key")
    links = components(verified(docs, clusters, width, ratio), "a", "b").withColumnsRenamed({"node": "set_key", "root": "component"})
    named = classes.select("set_key", "place").join(links, "set_key")
    least = named.groupBy("component").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    named = named.join(rekeyed(least, "n", "component"), "component").select("set_key", "least")
    own = classes.select("set_key", "place", "n_shingles").join(named, "set_key", "left").select("set_key", F.coalesce("least", "place").alias("least"), "n_shingles")
    own = rekeyed(own, "n_shingles", "set_key")
    out = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(own, "set_key", "left")
    reached = F.when(F.col("least.own_id") < 2**63 - 1, F.col("least.own_id"))
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(reached)
    nameless = F.col("set_key").isNull() | reached.isNull() & (F.col("text_key") == F.col("least.text_key"))
    kept = F.when(F.col("doc_id").isNull(), nameless).otherwise(component.eqNullSafe(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_key")


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, one of each group: rows are told by
    doc_id and text, so of equal rows one stays. All columns pass through."""
    own, key, kept_id, kept_key = unused(docs, "own_id", "text_key", "kept_id", "kept_key")
    keys = groups.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key)).distinct()
    rows = docs.withColumns({own: F.col("doc_id").cast("long"), key: F.xxhash64("text")})
    found = rows.join(keys, rows[own].eqNullSafe(keys[kept_id]) & rows[key].eqNullSafe(keys[kept_key]), "left_semi")
    return found.dropDuplicates([own, key]).drop(own, key)
