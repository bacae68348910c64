"""How far the sources of a language differ in their words: exact integer divergences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatework.llm.common import materialize, sizes, slices, whole_groups

#: Fixed value: what stands between terms, as bytes below 128 that are no letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are split at once, and of counts that a task holds before it passes them on.
PART, HELD = 4 << 20, 48 << 20
#: Counts of a term and a source that a shard holds, and that are compared at once.
SHARD, BLOCK = 1 << 20, 1 << 20
UNIT = 1_000_000_000

COUNT = "lang string, source string, term string, n long, docs long"


def _counted(part: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents (text, lang, source); a null term stands for the
    documents themselves."""
    text, lang, source = (pc.fill_null(c, "") for c in part.columns)
    groups = pa.table({"lang": lang, "source": source, "doc": pa.array(np.arange(part.num_rows))})
    every = groups.group_by(["lang", "source"]).aggregate([("doc", "count")])
    whole = [every["lang"], every["source"], pa.nulls(every.num_rows, pa.string()), pa.array(np.zeros(every.num_rows, np.int64)), every["doc_count"].cast(pa.int64())]
    split = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    terms, doc = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(terms, "")
    coded, doc = pc.dictionary_encode(terms.filter(real)), doc.filter(real)
    here = pa.table({"doc": doc, "code": coded.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")])
    pair = pc.binary_join_element_wise(pc.cast(pc.binary_length(lang), pa.string()), ":", lang, source, "").dictionary_encode()
    of_group = pa.table({"group": pair.indices.take(here["doc"].combine_chunks()), "code": here["code"], "n": here["count_all"]})
    found = of_group.group_by(["group", "code"]).aggregate([("n", "sum"), ("n", "count")])
    first = pa.table({"group": pair.indices, "doc": groups["doc"]}).group_by("group").aggregate([("doc", "min")]).sort_by("group")
    at = first["doc_min"].combine_chunks().take(found["group"].combine_chunks())
    columns = [lang.take(at), source.take(at), coded.dictionary.take(found["code"].combine_chunks()), found["n_sum"].cast(pa.int64()), found["n_count"].cast(pa.int64())]
    names = ["lang", "source", "term", "n", "docs"]
    return pa.concat_tables([pa.Table.from_arrays(x, names) for x in (whole, columns)])


def _merged(tables: list[pa.Table]) -> pa.Table:
    done = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return done.rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often, and in how many documents, a term occurs in some of a
    source's documents. With a null term: how many documents there are, whether they have terms or not.

    Tasks lower, split, encode and group by Arrow's functions and merge what they have as they go; one
    that holds too many different terms passes on its counts. Rows of the same key are to be added up.
    Null text, lang and source are ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, sizes(batch.column(0)), PART):
                held.append(_counted(part))
                if sum(t.nbytes for t in held) > HELD:
                    held = [_merged(held)]
                    if held[0].nbytes > HELD // 2:
                        yield from held.pop().to_batches(65_536)
        if held:
            yield from _merged(held).to_batches(65_536)

    return docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]).mapInArrow(run, COUNT)


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), by long division in steps of three digits, so that
    no product leaves 64 bits."""
    rest, below = count + 2, total + 2 * kept
    out = np.zeros_like(rest)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))"""
    return (p - q) ** 2 // (p + q)


def _compared(table: pa.Table, most: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, part, item, value): what the terms of one language in one shard add to each pair of
    sources, and the terms that each source has most too often. The sources' rows come first."""
    names = ["lang", "source", "part", "item", "value"]
    n_sources = table["term"].null_count
    heads, rows = table.slice(0, n_sources), table.slice(n_sources)
    source = heads["source"].combine_chunks()
    total, kept, whole = (heads[c].to_numpy() for c in ("total", "kept", "whole"))
    lang, kept, whole = heads["lang"][0], int(kept[0]), int(whole[0])
    counts = rows["counts"].combine_chunks()
    starts = counts.offsets.to_numpy() if len(counts) else np.zeros(1, np.int64)
    flat = counts.values
    place = pc.index_in(flat.field("source"), value_set=source).to_numpy(zero_copy_only=False)
    n, terms = flat.field("n").to_numpy(zero_copy_only=False), rows["term"].combine_chunks()

    def batch(part: str, a: np.ndarray, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        same = [pa.array([x] * len(a), pa.string()) for x in (lang.as_py(), part)]
        return pa.RecordBatch.from_arrays([same[0], source.take(pa.array(a)), same[1], item, pa.array(value, pa.int64())], names)

    step = max(1, BLOCK // n_sources)
    for first in range(0, max(len(terms), 1), step):
        last = min(first + step, len(terms))
        low, high = int(starts[first]), int(starts[last])
        seen = np.zeros((n_sources, last - first), np.int64)
        seen[place[low:high], np.repeat(np.arange(last - first), np.diff(starts[first : last + 1]))] = n[low:high]
        p = shares(seen, total[:, None], kept) if last > first else seen
        q = shares(seen.sum(axis=0), np.int64(whole), kept) if last > first else seen[0]
        for a in range(n_sources):
            other = np.arange(a + 1, n_sources)
            added = gap(p[a], p[other]).sum(axis=1)
            if len(other):
                this = np.full(len(other), a)
                yield batch("pair", this, source.take(pa.array(other)), added)
                yield batch("pair", other, source.take(pa.array(this)), added)
            over = np.flatnonzero((seen[a] > 0) & (p[a] > q))
            value = gap(p[a, over], q[over])
            best = over[np.lexsort((over, -value))[:most]]
            yield batch("term", np.full(len(best), a), terms.take(pa.array(first + best)), gap(p[a, best], q[best]))


def audit(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one,
    and the terms that it has most too often beside the whole language.

    A term is a run of letters; all characters beyond ASCII are letters, and only A to Z are lowered. A
    language keeps the terms of at least ``least_docs`` of its documents. A source's share of a kept term,
    in billionths, is smoothed by two: p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Part ``pair`` has
    the sum over all kept terms of floor((p - q)^2 / (p + q)) for each other source; part ``term`` has
    that value for the ``most_terms`` terms with the largest ones, of those that the source has and has
    more often than the language. Ranks go down by value, then up by the bytes of the item.

    Method: tasks count by Arrow (:func:`partial_counts`), Spark adds the counts up and gathers those
    of a term, a row with one count per source. These rows are dealt by hash to shards of about a million counts;
    every shard gets the sources' totals too, compares all pairs of sources over its terms and
    returns one sum for each pair and the best terms of each source, which are merged again. So no task
    ever holds a language; a source with most of the documents has one count a term as any other has.

    Null lang, source and text count as ''. A source without terms has pairs too; their value is 0 where
    the language keeps no term. A language of one source has no pairs. Rows that repeat count as often
    as they stand there; an empty table gives an empty table; other columns are ignored."""
    spark = docs.sparkSession
    added = partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = added.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    terms = materialize(by_term.filter((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs"), "terms")
    count = F.col("term").isNotNull().cast("long")
    totals = terms.select("lang", count.alias("kept"), F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    langs = terms.select("lang", count.alias("kept"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("n")).groupBy("lang").agg(F.sum("kept").alias("kept"), F.sum("n").alias("whole"))
    heads = totals.join(langs, "lang")
    shards = max(16, -(-(terms.agg(F.sum(F.size("counts"))).first()[0] or 0) // SHARD))
    heads = heads.select("lang", F.lit(None).cast("string").alias("term"), F.lit(None).cast(terms.schema["counts"].dataType).alias("counts"), "source", "total", "kept", "whole", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    rows = terms.filter("term is not null").withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    both = rows.unionByName(heads, allowMissingColumns=True).repartitionById(shards, F.col("shard")).sortWithinPartitions("lang", F.asc_nulls_first("term"), "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["lang"]):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield from _compared(table.slice(s, e - s), most_terms)

    found = materialize(both.drop("shard").mapInArrow(run, "lang string, source string, part string, item string, value long"), "gaps")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
