"""Language labels of words in code-switched text: a linear-chain conditional random field."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.llm.common import sizes, slices

WORD = re.compile(r"[^\W\d_]+")
#: Features are hashed into so many rows of weights.
ROWS = 1 << 15
REMEMBERED = 300_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed affixes of up to 3 letters and all letter trigrams with word ends, then length and
    lexicon entry."""
    w = f"^{word}$"
    found = [f"p{w[1:k]}" for k in (2, 3, 4)] + [f"s{w[-k:-1]}" for k in (2, 3, 4)]
    found += [w[i : i + 3] for i in range(len(w) - 2)]
    out = [zlib.crc32(f.encode()) % (ROWS - 1000) for f in found]
    return [*out, ROWS - 1000 + min(len(word), 20), ROWS - 900 + lexicon.get(word, 0)]


def table_of(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words, where each word's begin)."""
    found = [features(w, lexicon) for w in words]
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    return np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum())), np.cumsum(sizes) - sizes


@dataclass
class Model:
    """Weights of features x languages, of transitions and of a text's first word; which features
    the training texts have."""

    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    seen: np.ndarray


def forward_backward(emit: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, forward) label probabilities of the words of many texts, each (words x labels).

    ``starts`` marks each text's first word. Texts go side by side, the longest first: a step takes the
    next word of all texts that have one, so it costs labels squared a word."""
    n, k = emit.shape
    if n == 0:
        return emit.copy(), emit.copy()
    begin = np.flatnonzero(starts)
    lengths = np.diff(np.append(begin, n))
    begin, lengths = begin[by := np.argsort(-lengths, kind="stable")], lengths[by]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left").tolist()
    psi = np.exp(emit - emit.max(axis=1, keepdims=True))
    a, pi = np.exp(moves - moves.max()), np.exp(first - first.max())
    alpha, out = np.empty((n, k)), np.empty((n, k))
    x = np.broadcast_to(pi, (len(begin), k))
    for s, m in enumerate(active):
        at = begin[:m] + s
        x = (x[:m] @ a if s else x) * psi[at]
        x /= x.sum(axis=1, keepdims=True)
        alpha[at] = x
    behind = np.ones((len(begin), k))
    for s in range(len(active) - 1, -1, -1):
        m = active[s]
        at, x = begin[:m] + s, behind[:m]
        out[at] = alpha[at] * x
        if s:
            x = (x * psi[at]) @ a.T
            behind[:m] = x / x.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True), alpha


def sample(docs: DataFrame, per_lang: int, most_bytes: int = 64 << 20, most_langs: int | None = 200) -> list[tuple[str, str]]:
    """(text, lang) of at most ``per_lang`` different documents of each of the ``most_langs``
    commonest languages (all for None), and of at most ``most_bytes`` of text in all, to which each
    language may add the same part.

    Taken are those with the smallest hashes of (doc_id, text). A share of rows that is wanted twice
    over goes on to the ranking, which sees hashes and lengths only, so neither a language's rows nor
    many texts ever meet in a task; the texts that are taken are fetched afterwards. Equal rows are
    one. Texts that are null, or longer than a language's part, are left out. An empty table gives none."""
    rows = docs.filter("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = (counts if most_langs is None else counts.limit(most_langs)).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2 * per_lang + 50) / r["count"]))])
    drawn = rows.select("lang", F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(7), "doc_id", "text").alias("_draw"))
    drawn = drawn.filter(F.pmod("_draw", F.lit(1_000_000)) / 1_000_000.0 < F.element_at(share, F.col("lang")))
    keys = drawn.groupBy("lang", "_draw").agg(F.min(F.octet_length("text")).alias("_bytes")).filter(F.col("_bytes") <= most_bytes // len(counts))
    order = Window.partitionBy("lang").orderBy(F.pmod("_draw", F.lit(1_000_000)), "_draw")
    ranked = keys.withColumns({"_at": F.row_number().over(order), "_all": F.sum("_bytes").over(order)})
    picked = ranked.filter((F.col("_at") <= per_lang) & (F.col("_all") <= most_bytes // len(counts))).select("lang", "_draw")
    texts = drawn.join(picked, ["lang", "_draw"]).dropDuplicates(["lang", "_draw"]).select("text", "lang")
    return [(r["text"], r["lang"]) for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["text"]))]


def train(pairs: list[tuple[str, str]], steps: int = 400, sequences: int = 64, length: int = 32, rate: float = 0.3, seed: int = 1) -> Model:
    """Fit by gradient ascent on the conditional likelihood of made-up code-switched sequences:
    each is a stretch of a document, or two stretches of two documents. Gradients are posterior
    minus gold counts, from forward-backward; steps are scaled by the gradients so far. Without
    texts the only language is ``und``."""
    rng, langs = np.random.default_rng(seed), sorted({lang for _, lang in pairs})
    texts = [(words_of(text), langs.index(lang)) for text, lang in pairs]
    texts = [(w, y) for w, y in texts if w]
    if not texts:
        k = max(1, len(langs))
        return Model(langs or ["und"], {}, np.zeros((ROWS, k)), np.zeros((k, k)), np.zeros(k), np.ones(ROWS, bool))
    k = len(langs)
    seen: dict[str, Counter] = {}
    for w, y in texts:
        for word in w:
            seen.setdefault(word, Counter())[y] += 1
    lexicon = {w: 1 + c.most_common(1)[0][0] for w, c in seen.items() if c.total() >= 20 and c.most_common(1)[0][1] >= 0.9 * c.total()}
    at = {w: i for i, w in enumerate(seen)}
    table, begin = table_of(list(seen), lexicon)
    sizes = np.diff(np.append(begin, len(table)))
    coded = [(np.array([at[x] for x in w]), y) for w, y in texts]
    by_lang = [[i for i, (_, y) in enumerate(coded) if y == lang] for lang in range(k)]
    by_lang = [x for x in by_lang if x]
    weights, moves, first = np.zeros((ROWS, k)), np.eye(k) * 2, np.zeros(k)
    squares = [np.full(x.shape, 1e-2) for x in (weights, moves, first)]

    def stretch(most: int) -> tuple[np.ndarray, int]:
        group = by_lang[rng.integers(len(by_lang))]
        w, y = coded[group[rng.integers(len(group))]]
        n = min(len(w), most)
        s = rng.integers(len(w) - n + 1)
        return w[s : s + n], y

    for _ in range(steps):
        words, gold, starts = [], [], []
        for _ in range(sequences):
            switch = rng.integers(2, length) if rng.random() < 0.5 else length
            parts = [stretch(switch)] + ([stretch(length - switch)] if switch < length - 1 else [])
            starts += [True] + [False] * (sum(len(w) for w, _ in parts) - 1)
            words += [w for w, _ in parts]
            gold += [np.full(len(w), y) for w, y in parts]
        ids, y, new = np.concatenate(words), np.concatenate(gold), np.array(starts)
        n = sizes[ids]
        rows = table[np.arange(int(n.sum())) + np.repeat(begin[ids] - (np.cumsum(n) - n), n)]
        emit = np.add.reduceat(weights[rows], np.cumsum(n) - n)
        gamma, alpha = forward_backward(emit, new, moves, first)
        delta = np.eye(k)[y] - gamma
        spread = np.repeat(delta, n, axis=0)
        grad = np.stack([np.bincount(rows, spread[:, j], minlength=ROWS) for j in range(k)], axis=1)
        inner = np.flatnonzero(~new)
        # a pair's posterior: the later label's, shared among earlier ones by forward and transition
        left, right = alpha[inner - 1], gamma[inner]
        pair = np.exp(moves) * (left.T @ (right / (left @ np.exp(moves))))
        moved = np.zeros((k, k))
        np.add.at(moved, (y[inner - 1], y[inner]), 1)
        steps_of = (grad / sequences - 1e-4 * weights, (moved - pair) / sequences, delta[new].sum(axis=0) / sequences)
        for x, g, sq in zip((weights, moves, first), steps_of, squares, strict=True):
            sq += g * g
            x += rate * g / np.sqrt(sq)
    known = np.zeros(ROWS, bool)
    known[table] = True
    return Model(langs, lexicon, weights, moves, first, known)


class _Emitter:
    """Emission scores of words, and which share of their features is known, remembered by a worker."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.scores, self.known = np.zeros((0, len(self.model.langs))), np.zeros(0)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emission scores of all words, known shares, the number of each text's words)."""
        if len(self.at) > REMEMBERED:
            self._forget()
        ids, new, ends = [], [], []
        for text in texts:
            w = words_of(text)
            try:
                ids += [self.at[x] for x in w]
            except KeyError:
                for x in w:
                    if x not in self.at and any(map(str.isalpha, x)):
                        self.at[x] = len(self.scores) + len(new)
                        new.append(x)
                    else:
                        self.at.setdefault(x, -1)  # numerals that are not decimal digits
                ids += [self.at[x] for x in w]
            ends.append(len(ids))
        for start in range(0, len(new), 20_000):
            table, begin = table_of(new[start : start + 20_000], self.model.lexicon)
            weights, held = self.model.weights[table], self.model.seen[table].astype(np.float64)
            self.scores = np.concatenate([self.scores, np.add.reduceat(weights, begin)])
            self.known = np.append(self.known, np.add.reduceat(held, begin) / np.diff(np.append(begin, len(table))))
        ids = np.array(ids, dtype=np.int64)
        before = np.append(0, np.cumsum(ids >= 0))[np.append(0, ends)]
        ids = ids[ids >= 0]
        return self.scores[ids], self.known[ids], np.diff(before)


def predict(docs: DataFrame, model: Model, spans: bool = False, part_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the language of most words by expectation, and the
    mean posterior of that language; with ``n_words``, and ``known``: the mean share of its words'
    features that the training texts have, low in text of no language that was learned. Columns of
    these names are replaced; others pass through.

    With ``spans``, also ``lang_spans``: (first_word, words, lang) of each run of equally labelled
    words. Whole words of whole texts are used. A text that is null or has no letter is ``und`` with
    score 0. Ties take the first language in order. Equal rows get equal results, an empty table an
    empty one. The model is broadcast; its size is fixed."""
    docs = docs.drop("lang_pred", "score", "n_words", "known", "lang_spans")
    text = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("lang", T.StringType())]))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("known", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *added, *[T.StructField("lang_spans", kind)] * spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        emitter, k = _Emitter(model), len(model.langs)
        for batch in batches:
            for part in slices(batch, sizes(batch.column(text)), part_bytes):
                emit, known, counts = emitter.of(part.column(text).to_pylist())
                ends = np.cumsum(counts)
                new = np.zeros(len(emit), bool)
                new[(ends - counts)[counts > 0]] = True
                gamma, _ = forward_backward(emit, new, model.moves, model.first)
                owner, some = np.repeat(np.arange(part.num_rows), counts), np.maximum(counts, 1)
                mean = np.stack([np.bincount(owner, gamma[:, j], minlength=part.num_rows) for j in range(k)], axis=1) / some[:, None]
                best = mean.argmax(axis=1)
                pred = [model.langs[b] if c else "und" for b, c in zip(best.tolist(), counts.tolist(), strict=True)]
                arrays = [pa.array(pred), pa.array(np.clip(np.where(counts > 0, mean.max(axis=1), 0.0), 0, 1))]
                arrays += [pa.array(counts, pa.int64()), pa.array(np.bincount(owner, known, minlength=part.num_rows) / some)]
                if spans:
                    label, rows = gamma.argmax(axis=1), []
                    for s, e in zip(ends - counts, ends, strict=True):
                        cuts = np.r_[s, s + 1 + np.flatnonzero(np.diff(label[s:e])), e] if e > s else []
                        rows.append([{"first_word": int(x - s), "words": int(y - x), "lang": model.langs[label[x]]} for x, y in zip(cuts[:-1], cuts[1:], strict=True)] if e > s else [])
                    arrays.append(pa.array(rows, pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
