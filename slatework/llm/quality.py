"""Importance resampling of documents: the ratio of two hashed n-gram models, and Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.llm.common import sizes, slices
from slatework.operators.stats import kth_largest

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: The most distinct tokens that a worker remembers.
REMEMBERED = 300_000
#: Bytes of text that are taken at once.
PART = 2 << 20
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Grams:
    """Hashed n-grams of texts: lower-cased words and word pairs, and pairs of word shapes
    (lower, Title, UPPER, digits, or the punctuation itself). A word followed by itself is one
    gram whatever the word is, so that repetition is a feature too."""

    def __init__(self, buckets: int):
        self.buckets, self.at = np.uint64(buckets), {}
        self.word: list[int] = []
        self.shape: list[int] = []

    def _add(self, token: str) -> int:
        if not token[0].isalnum() and token[0] != "_":
            shape = token
        elif token.isdigit():
            shape = "digits"
        else:
            shape = "upper" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "lower"
        self.word.append(xxhash.xxh3_64_intdigest(token.lower()))
        self.shape.append(xxhash.xxh3_64_intdigest(shape, 1))
        self.at[token] = at = len(self.at)
        return at

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all grams, the number of each text's grams)."""
        if len(self.at) > REMEMBERED:
            self.__init__(int(self.buckets))
        ids, ends = [], []
        for text in texts:
            tokens = TOKEN.findall(text or "")
            try:
                ids += [self.at[t] for t in tokens]
            except KeyError:
                ids += [self.at[t] if t in self.at else self._add(t) for t in tokens]
            ends.append(len(ids))
        ids, ends = np.array(ids, dtype=np.int64), np.array(ends, dtype=np.int64)
        word, shape = np.array(self.word, dtype=np.uint64)[ids], np.array(self.shape, dtype=np.uint64)[ids]
        counts = np.diff(ends, prepend=0)
        whose = np.repeat(np.arange(len(texts)), counts)
        near = np.flatnonzero(whose[1:] == whose[:-1])
        pair = np.where(ids[near] == ids[near + 1], _ODD, (word[near] * _MIX) ^ (word[near + 1] + _ODD))
        shapes = (shape[near] * _ODD) ^ (shape[near + 1] + _MIX)
        grams = np.concatenate([word, pair, shapes])
        owner = np.concatenate([whose, whose[near], whose[near]])
        grams = ((grams ^ (grams >> np.uint64(29))) * _MIX >> np.uint64(20)) % self.buckets
        return grams.astype(np.int64), owner


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, most_labelled: int = 20_000, prior: float = 100.0) -> np.ndarray:
    """The log ratio of target to raw probability of each gram bucket.

    The raw model counts the grams of all documents. The target model counts those of documents
    labelled quality 1: of at most ``most_labelled`` of them, those with the smallest hashed ids,
    so that their ids may be broadcast; it is smoothed by ``prior`` grams of the raw model. Each task
    sums its counts before the shuffle, and the driver gets one row per bucket. Buckets without grams
    have ratio 0, and without labelled documents all have; so it is with empty tables. Rows that repeat
    count as often as they stand there; null and empty texts have no grams."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).withColumn("_good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("_good", F.lit(False)).alias("_good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(buckets), np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, sizes(batch.column(0)), PART):
                found, owner = grams.of(part.column(0).to_pylist())
                counts[0] += np.bincount(found, minlength=buckets)
                flags = part.column(1).to_numpy(zero_copy_only=False)
                counts[1] += np.bincount(found[flags[owner]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    counts = np.zeros((2, buckets))
    for bucket, raw, target in sums:
        counts[:, bucket] = raw, target
    if not counts[1].any():
        return np.zeros(buckets)
    raw = counts[0] / counts[0].sum()
    target = (counts[1] + prior * raw) / (counts[1].sum() + prior)
    return np.where(raw > 0, np.log(np.where(raw > 0, target / np.where(raw > 0, raw, 1), 1)), 0.0)


def score(docs: DataFrame, ratio: np.ndarray, most_grams: int | None = 32) -> DataFrame:
    """``docs`` with ``log_weight`` and ``n_grams``; columns of these names are replaced, all others
    pass through.

    The log weight is log target - log raw probability: the mean log ratio of the text's grams times
    their number, of which ``most_grams`` count at most. A text's grams depend on each other, so that
    their plain sum would make any long text's weight boundless, and the noise of the sample nothing.
    With ``most_grams=None`` it is that plain sum, the models' exact ratio, for which :func:`perturb`
    wants a temperature of the size of the weights' spread (:func:`spread`).
    Null and empty texts have no grams and weight 0. Equal rows get equal results, an empty table an
    empty one. The model is one array of a fixed size."""
    docs = docs.drop("log_weight", "n_grams")
    text = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = held.value
        grams = Grams(len(ratio))
        for batch in batches:
            for part in slices(batch, sizes(batch.column(text)), PART):
                found, owner = grams.of(part.column(text).to_pylist())
                n = np.bincount(owner, minlength=part.num_rows)
                weight = np.bincount(owner, ratio[found], minlength=part.num_rows)
                if most_grams is not None:
                    weight = weight * np.minimum(most_grams / np.maximum(n, 1), 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weight, pa.float64()), pa.array(n, pa.int64())], [*batch.schema.names, "log_weight", "n_grams"])

    schema = T.StructType([*docs.schema.fields, T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType())])
    return docs.mapInArrow(run, schema)


def perturb(scored: DataFrame, temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """Adds ``gumbel_key``: the log weight plus Gumbel noise of the given temperature, from a hash
    of the doc_id, the text and the seed, so that a rerun draws the same noise; equal rows have the
    same. A column of this name is replaced, all others pass through; an empty table stays empty."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return scored.withColumn("gumbel_key", F.col("log_weight") - F.lit(temperature) * F.log(-F.log(u)))


def spread(scored: DataFrame) -> float:
    """The standard deviation of the log weights, 1 where there is none: a temperature for weights that
    have no bound. At this one the noise and the weights have a say of the same size."""
    return scored.agg(F.stddev_samp("log_weight")).first()[0] or 1.0


def accepted(scored: DataFrame, sure: float = -6.0) -> int:
    """How many documents rejection sampling by the weights is expected to keep, if those with a log
    weight of ``sure`` or more are always kept, and others in proportion to their weights."""
    return round(scored.agg(F.coalesce(F.sum(F.exp(F.least(F.col("log_weight") - sure, F.lit(0.0)))), F.lit(0.0))).first()[0])


def threshold(keyed: DataFrame, k: int) -> float:
    """The smallest ``gumbel_key`` that top-k keeps; ties with it are kept too. Minus infinity if
    there are fewer than k documents, infinity if k is 0."""
    found = kth_largest(keyed, "gumbel_key", k)
    return found if found is not None else float("inf") if k < 1 else float("-inf")
