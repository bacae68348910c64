"""Repeated passages: runs of sentences that occurred before, in any document, are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.llm.common import materialize, rekeyed, sizes, slices, unused

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+[\"')\]]*\s*|$)")
WORD = re.compile(r"\s*\S+\s*")
#: Sentences of more words are cut where their words say.
MOST_WORDS = 16
REMEMBERED = 500_000
#: Bytes of text that are taken at once.
PART = 2 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Units:
    """Sentences of many texts, long ones in pieces: the words' hashes and, of each unit with words,
    its first word, the word after its last, and its text."""

    parts: list[list[str]]
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def of_docs(self) -> np.ndarray:
        """Bounds of the texts' units."""
        return np.searchsorted(self.doc, np.arange(len(self.parts) + 1))


def places_to_cut(hashes: np.ndarray, sentence: np.ndarray, window: int) -> np.ndarray:
    """Which words are of least hash in some ``window`` consecutive words of their sentence (all of
    equals). They are at most ``window`` apart. Between the first and the last that follow from a
    passage's own words, which are among its first and last ``window`` words, they are the same
    wherever the passage is."""
    view = np.lib.stride_tricks.sliding_window_view
    least = np.zeros(len(hashes) + window - 1, dtype=np.uint64)
    least[window - 1 : len(hashes)] = np.where(sentence[: 1 - window] == sentence[window - 1 :], view(hashes, window).min(axis=1), 0)
    return hashes == view(least, window).max(axis=1)


class Reader:
    """Splits texts into units, and remembers words' hashes."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}

    def of(self, texts: list[str | None]) -> Units:
        if len(self.at) > REMEMBERED:
            self.at.clear()
        at, words, counts, doc = self.at, [], [], []
        parts = [[s for s in SENTENCE.findall(t) if s] if t else [] for t in texts]
        for d, found in enumerate(parts):
            for s in found:
                w = s.split()
                if w:
                    words += w
                    counts.append(len(w))
                    doc.append(d)
        try:
            codes = [at[w] for w in words]
        except KeyError:
            for w in words:
                if w not in at:
                    at[w] = xxhash.xxh3_64_intdigest(w)
            codes = [at[w] for w in words]
        hashes, counts = np.array(codes, dtype=np.uint64), np.array(counts, dtype=np.int64)
        last = np.zeros(len(words), bool)
        last[np.cumsum(counts) - 1] = True
        if counts.max(initial=0) > MOST_WORDS:
            sentence = np.repeat(np.arange(len(counts)), counts)
            last |= places_to_cut(hashes, sentence, MOST_WORDS) & (counts > MOST_WORDS)[sentence]
        end = np.flatnonzero(last) + 1
        begin = np.append(0, end)[: len(end)]
        of = np.searchsorted(np.cumsum(counts), begin, "right")
        return Units(parts, hashes, begin, end, np.array(doc, dtype=np.int64)[of])


def runs(units: Units, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first units, lengths), each once and in order: from every unit the shortest run of at least
    ``run`` units and ``least_words`` words, and the shortest such run up to every unit; a text of at
    least ``run`` units, but fewer words, as a whole. Runs lie within one text."""
    n, bounds = len(units.doc), units.of_docs()
    at = np.arange(n)
    ahead = np.maximum(np.searchsorted(units.end, units.begin + least_words) + 1 - at, run)
    back = np.maximum(at + 2 - np.searchsorted(units.begin, units.end - least_words, "right"), run)
    first, last = bounds[:-1][np.diff(bounds) >= run], bounds[1:][np.diff(bounds) >= run]
    few = units.end[last - 1] - units.begin[first] < least_words
    ok, back_ok = at + ahead <= bounds[units.doc + 1], at + 1 - back >= bounds[units.doc]
    starts = np.concatenate([at[ok], (at + 1 - back)[back_ok], first[few]])
    found = np.unique(starts * (n + 2) + np.concatenate([ahead[ok], back[back_ok], (last - first)[few]]))
    return found // (n + 2), found % (n + 2)


def hashes_of(units: Units, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of each run's words, by two polynomials over the words' hashes."""
    n, out = len(units.hashes), []
    begin, end = units.begin[first], units.end[first + lengths - 1]
    for base in _BASES:
        inverse = np.uint64(pow(base, -1, 1 << 64))
        power = np.cumprod(np.append(np.uint64(1), np.full(n, base, dtype=np.uint64)))
        back = np.cumprod(np.append(np.uint64(1), np.full(n, inverse, dtype=np.uint64)))
        values = (units.hashes ^ (units.hashes >> np.uint64(32))) * np.uint64(base)
        prefix = np.append(np.uint64(0), np.cumsum(values * power[:-1]))
        x = (prefix[end] - prefix[begin]) * back[begin]
        x = (x ^ (x >> np.uint64(31))) * _MIX * ((end - begin).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        out.append(x ^ (x >> np.uint64(29)))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def spans(units: Units, run: int, least_words: int) -> tuple[np.ndarray, ...]:
    """(text, first unit in it, length, hash, check, whether the text has the same words before) of
    each run."""
    first, lengths = runs(units, run, least_words)
    doc = units.doc[first]
    span, check = hashes_of(units, first, lengths)
    order = np.lexsort((first, check, span, doc))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (np.diff(doc[order]) == 0) & (np.diff(span[order]) == 0) & (np.diff(check[order]) == 0)
    return doc, first - units.of_docs()[doc], lengths, span, check, again


def without(units: Units, doc: int, go: list[dict]) -> tuple[str, int]:
    """(a text without the units that the runs cover, the number of those units)."""
    a, b = units.of_docs()[[doc, doc + 1]].tolist()
    change = np.zeros(b - a + 1, dtype=np.int64)
    np.add.at(change, [x["at"] for x in go], 1)
    np.add.at(change, [x["at"] + x["length"] for x in go], -1)
    gone, words = np.cumsum(change)[:-1] > 0, (units.end - units.begin)[a:b]
    out, at = [], 0
    for part in units.parts[doc]:
        left = len(part.split())
        if not left:
            out.append(part)
        elif words[at] == left:
            out.append("" if gone[at] else part)
            at += 1
        else:
            found, k = WORD.findall(part), 0
            while k < left:
                n = int(words[at])
                out.append("" if gone[at] else "".join(found[k : k + n]))
                at, k = at + 1, k + n
    return "".join(out), int(gone.sum())


def remove_repeats(docs: DataFrame, run: int = 2, least_words: int = 0) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and the columns ``n_sentences``,
    ``n_removed`` (sentences) and ``removed_spans`` (their first sentences, by number); columns of
    these names are replaced, all others pass through unchanged.

    By default every run of ``run`` consecutive sentences is hashed. With ``least_words`` a run has so
    many words too: the shortest runs from and up to each sentence are hashed, and a text with fewer
    words as a whole. The first occurrence of a hash
    is that with the smallest (doc_id, position); sentences in any other occurrence go, whether it
    is in the same document or another. White space is not compared.

    Sentences of over 16 words count as several, cut where their words say. So a passage may begin
    and end inside sentences: of every one of 50 words or more, all but at most 16 words at either end
    are sentences that other texts with it cut alike, so with 15 ``least_words`` none is missed, and
    what stays of it is at most those ends.

    What a document repeats of itself is known without the others: only the first place of each hash
    in a document takes part in the join. Hashes are counted by a global aggregate, summed before the
    shuffle, and joined with the places; those that repeat, now by 96 bits, get their first place by a
    second aggregate. A passage that very many documents share is a skewed join key, which Spark splits.
    Texts are read twice for this, as keeping all places would take more disk than they do. Whole texts
    cross one shuffle, and only texts that lose something are split again.

    Null and empty texts stay. A null doc_id is after all others. Documents that are equal in doc_id
    and text are one document: equal rows get equal results. An empty table gives an empty table."""
    docs = docs.drop("n_sentences", "n_removed", "removed_spans")
    own, key, mine, told_by, go_by = unused(docs, "own_id", "text_key", "_id", "_text", "_go")
    # half a hash, which shuffles less, tells texts of one doc_id apart; those without an id are many
    told = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.shiftrightunsigned(F.xxhash64("text"), 32))
    keyed = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), key: told})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for part in slices(batch, sizes(batch.column(0)), PART):
                *_, span, _, again = spans(reader.of(part.column(0).to_pylist()), run, least_words)
                yield pa.RecordBatch.from_arrays([pa.array(span[~again])], ["span"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for part in slices(batch, sizes(batch.column(2)), PART):
                units = reader.of(part.column(2).to_pylist())
                doc, at, length, span, check, again = spans(units, run, least_words)
                # a text's own repeats have negative lengths, and its number of units is a row of length
                # 0; what stands for their hashes is spread evenly
                every, none = np.arange(part.num_rows), np.zeros(part.num_rows, dtype=np.int64)
                other = (part.column(0).to_numpy() ^ part.column(1).to_numpy()) * np.int64(_BASES[0] >> 1)
                take = pa.array(np.append(doc, every))
                span = np.append(np.where(again, other[doc] + at, span), other)
                arrays = [pa.array(span), pa.array(np.append(check, none).astype(np.int32)), part.column(0).take(take), part.column(1).take(take)]
                arrays += [pa.array(np.append(at, np.diff(units.of_docs())), pa.int32()), pa.array(np.append(np.where(again, -length, length), none), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["span", "check", "_id", "_text", "at", "length"])

    texts = keyed.select(F.col(own).alias("_id"), F.col(key).alias("_text"), "text")
    twice = texts.select("text").mapInArrow(counted, "span long").groupBy("span").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = materialize(twice, "repeated")
    found = texts.mapInArrow(placed, "span long, check int, _id long, _text long, at int, length int")
    found = materialize(found.join(twice, "span", "left").filter("n is not null or length <= 0").drop("n"), "places")
    place, here = F.struct("_id", "at", "_text"), found.filter("length > 0")
    first = here.groupBy("span", "check").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    again = here.join(rekeyed(first, "n", "span", "check"), ["span", "check"]).filter(~(place == F.col("first"))).select("_id", "_text", "at", "length")
    known = again.union(found.filter("length <= 0").select("_id", "_text", "at", "length"))
    starts = known.groupBy("_id", "_text").agg(F.max(F.when(F.col("length") == 0, F.col("at"))).cast("long").alias("n_sentences"), F.collect_set(F.when(F.col("length") != 0, F.struct("at", F.abs("length").alias("length")))).alias("_go"))
    starts = starts.withColumnsRenamed({"_id": mine, "_text": told_by, "_go": go_by})
    joined = keyed.join(starts, (F.col(own) == F.col(mine)) & (F.col(key) == F.col(told_by)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "n_sentences", go_by)
    text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.IntegerType()))])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for part in slices(batch, sizes(batch.column(text)), PART):
                texts, go = part.column(text).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                hit = [k for k, x in enumerate(go) if x]
                units, removed = reader.of([texts[k] for k in hit]), np.zeros(len(go), dtype=np.int64)
                for d, k in enumerate(hit):
                    texts[k], removed[k] = without(units, d, go[k])
                starts = [sorted({x["at"] for x in row or []}) for row in go]
                arrays = list(part.columns[:-1])
                arrays[text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed), pa.array(starts, pa.list_(pa.int32()))], [f.name for f in schema.fields])

    return joined.mapInArrow(rewrite, schema)
