"""SentencePiece-style BPE encoding with seeded merge-dropout, and its lossless decoding."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.llm.common import sizes, slices, unused

#: The mark that stands for a blank in pieces.
BLANK = "▁"
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Longer segments go through a heap, the others through arrays together.
ARRAYS = 48
REMEMBERED = 400_000
NONE = np.int32(2**31 - 1)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def skipped(seed: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate merge of two pieces at a place in a segment is skipped: a hash keyed
    by the seed (which holds the segment) falls below the dropout rate."""
    x = seed ^ (start.astype(np.uint64) * _K[1]) ^ (left.astype(np.uint64) * _K[2]) ^ (right.astype(np.uint64) * _K[3])
    x = (x ^ (x >> np.uint64(32))) * _K[0]
    x = (x ^ (x >> np.uint64(29))) * _K[1]
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 < dropout


class Pieces:
    """A BPE model file: ids of pieces, ranks of merges, bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte_ids = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(BLANK in names[i].lstrip(BLANK) for i in plain) or len(byte_ids) != 256:
            raise ValueError("a model is wanted whose pieces have blanks only in front, with byte fallback")
        self.at = {names[i]: i for i in plain}
        self.byte_ids = byte_ids
        order = sorted(plain, key=lambda i: -model.get_score(i))
        rank = {i: k for k, i in enumerate(order)}
        pairs = sorted((self.at[p[:k]] * n + self.at[p[k:]], rank[i], i) for p, i in self.at.items() for k in range(1, len(p)) if p[:k] in self.at and p[k:] in self.at)
        self.pair, self.rank, self.merged = (np.array(x, dtype=t) for x, t in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True))
        self.n = n
        # pairs by a hash; slots of several pairs are -2 and those pairs are searched for
        self.slot = np.full(1 << 21, -1, dtype=np.int32)
        at = self._slot(self.pair)
        self.slot[at] = np.arange(len(at))
        crowded, times = np.unique(at, return_counts=True)
        self.slot[crowded[times > 1]] = -2
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.at.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        out = [b""] * n
        for p, i in self.at.items():
            out[i] = p.replace(BLANK, " ").encode()
        for b, i in byte_ids.items():
            out[i] = bytes([b])
        self.size = np.array([len(x) for x in out], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(out), dtype=np.uint8)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _K[0] >> np.uint64(43)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of the merges of pairs of pieces; rank NONE where there is none."""
        key = left.astype(np.int64) * self.n + right
        at = self.slot[self._slot(key)]
        crowded = np.flatnonzero(at == -2)
        at[crowded] = np.searchsorted(self.pair, key[crowded])
        np.clip(at, 0, len(self.pair) - 1, out=at)
        ok = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.rank[at], NONE), self.merged[at]

    def _finish(self, segment: str, ids: list[int], starts: list[int]) -> bytes:
        """Ids as bytes; a character without a piece becomes its UTF-8 bytes' pieces."""
        out: list[int] = []
        for i, s in zip(ids, starts, strict=True):
            out += [i] if i >= 0 else [self.byte_ids[b] for b in segment[s].encode()]
        return np.array(out, dtype="<i4").tobytes()

    def one(self, segment: str, seed: int, dropout: float) -> bytes:
        """A segment's ids by an agenda: the best merge first, the leftmost of equals."""
        ids = [self.at.get(c, -1) for c in segment]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        key, agenda = np.uint64(seed ^ xxhash.xxh3_64_intdigest(segment)), []

        def offer(a: np.ndarray, b: np.ndarray) -> None:
            left, right = (np.array([ids[x] for x in y], dtype=np.int64) for y in (a, b))
            rank, new = self.look(left, right)
            ok = rank != NONE
            if dropout:
                ok &= ~skipped(np.full(len(left), key), np.array(a, dtype=np.int64), left, right, dropout)
            for k in np.flatnonzero(ok).tolist():
                heapq.heappush(agenda, (int(rank[k]), a[k], b[k], ids[a[k]], ids[b[k]], int(new[k])))

        offer(list(range(len(ids) - 1)), list(range(1, len(ids))))
        while agenda:
            _, a, b, x, y, new = heapq.heappop(agenda)
            if ids[a] != x or ids[b] != y or after[a] != b:
                continue
            ids[a], ids[b] = new, -2
            after[a] = after[b]
            if after[a] < len(ids):
                before[after[a]] = a
                offer([a], [after[a]])
            if before[a] >= 0:
                offer([before[a]], [a])
        kept = [k for k in range(len(ids)) if ids[k] != -2]
        return self._finish(segment, [ids[k] for k in kept], kept)

    def many(self, codes: np.ndarray, lengths: np.ndarray, keys: np.ndarray, dropout: float, tested: list[tuple[np.ndarray, ...]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short segments at once, the best merge of each in every round: (all
        their ids, the number of each one's). ``codes`` has their characters one after the other,
        ``keys`` each one's seed with its hash; ``tested`` gets the candidate merges: (segments,
        places, left pieces, right pieces).

        Columns are segments and rows places; pieces are linked to their neighbours, dead places are
        -2 and those behind a segment's end -3. A candidate's order is its rank and then its place."""
        n, size = len(lengths), int(lengths.max())
        inside = np.arange(size + 1)[None, :] < lengths[:, None]
        grid = np.full((n, size + 1), -3, dtype=np.int32)
        grid[inside] = self.of_char[codes]
        ids = np.ascontiguousarray(grid.T).reshape(-1)
        after = np.repeat(np.arange(1, size + 2, dtype=np.int32), n)
        before = np.repeat(np.arange(-1, size, dtype=np.int32), n)
        order, new = np.full((size + 1) * n, NONE, dtype=np.int32), np.zeros((size + 1) * n, dtype=np.int32)

        def offer(r: np.ndarray, p: np.ndarray) -> None:
            """Set the candidate merge of each place with the piece after it."""
            at = p * n + r
            left, right = ids[at], ids[np.minimum(after[at], size) * n + r]
            found, made = self.look(left, right)
            hit = np.flatnonzero(found != NONE)
            if tested is not None:
                tested.append((r[hit], p[hit], left[hit], right[hit]))
            if dropout:
                hit = hit[~skipped(keys[r[hit]], p[hit], left[hit], right[hit], dropout)]
            order[at] = NONE
            at = at[hit]
            order[at], new[at] = found[hit] * np.int32(64) + p[hit].astype(np.int32), made[hit]

        p, r = np.nonzero(inside[:, 1:].T)
        offer(r, p)
        while True:
            best = order.reshape(size + 1, n).min(axis=0)
            rows = np.flatnonzero(best != NONE)
            if not len(rows):
                break
            p = (best[rows] & 63).astype(np.int64)
            at = p * n + rows
            gone = after[at] * np.int64(n) + rows
            ids[at], ids[gone], order[gone] = new[at], -2, NONE
            end = after[gone]
            after[at] = end
            before[np.minimum(end, size) * np.int64(n) + rows] = p
            back = before[at]
            ok = back >= 0
            offer(np.append(rows, rows[ok]), np.append(p, back[ok]))
        grid = ids.reshape(size + 1, n)[:size].T
        alive = grid > -2
        flat, counts = grid[alive], alive.sum(axis=1)
        unknown = np.flatnonzero(flat == -1)
        if len(unknown):
            # a character without a piece becomes its UTF-8 bytes' pieces
            whose, place = np.nonzero(alive)
            at = (np.cumsum(lengths) - lengths)[whose[unknown]] + place[unknown]
            spelled = [[self.byte_ids[b] for b in chr(c).encode()] for c in codes[at].tolist()]
            times = np.ones(len(flat), dtype=np.int64)
            times[unknown] = [len(x) for x in spelled]
            np.add.at(counts, whose[unknown], times[unknown] - 1)
            flat = np.repeat(flat, times)
            flat[flat == -1] = [b for x in spelled for b in x]
        return flat, counts

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Texts' bytes from all their ids and the ends of each text's."""
        size = self.size[ids]
        stop = np.cumsum(size)
        at = np.repeat(self.begin[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        flat = self.bytes[at].tobytes()
        cuts = np.append(0, stop)[np.append(0, ends)].tolist()
        return [flat[a + 1 : b] if b > a else b"" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pick(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` values from ``begin``, one after the other."""
    return values[np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)]


class Remembered:
    """Short segments' ids without a skip, and the candidate merges that lead to them: where none of
    those is skipped, these are the ids."""

    def __init__(self, bpe: Pieces):
        self.bpe, self.at = bpe, {"": 0}
        self.hash, self.lengths, self.count = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.codes = np.zeros(0, dtype=np.uint32)
        #: A literal mark, as its bytes; the segment "" stands for it.
        self.ids = np.array([bpe.byte_ids[b] for b in BLANK.encode()], dtype=np.int32)
        self.n_ids = np.array([len(self.ids)])
        self.tested = [np.zeros(0, dtype=t) for t in (np.uint8, np.int32, np.int32)]
        self._place()

    def _place(self) -> None:
        self.of_codes, self.of_ids, self.of_tested = (np.cumsum(n) - n for n in (self.lengths, self.n_ids, self.count))

    def learn(self, segments: list[str]) -> None:
        """Adds segments that are not there yet."""
        segments.sort(key=len)
        for start in range(0, len(segments), 20_000):
            some, tested = segments[start : start + 20_000], []
            self.at.update(zip(some, range(len(self.at), len(self.at) + len(some)), strict=True))
            codes, lengths = _codes(some)
            ids, n = self.bpe.many(codes, lengths, np.zeros(len(some), dtype=np.uint64), 0.0, tested)
            rows, *found = (np.concatenate(x) for x in zip(*tested, strict=True))
            by = np.argsort(rows, kind="stable")
            self.tested = [np.append(old, new[by].astype(old.dtype)) for old, new in zip(self.tested, found, strict=True)]
            hashes = np.array([xxhash.xxh3_64_intdigest(s) for s in some], dtype=np.uint64)
            news = (hashes, lengths, np.bincount(rows, minlength=len(some)), codes, ids, n)
            self.hash, self.lengths, self.count, self.codes, self.ids, self.n_ids = (np.append(old, new) for old, new in zip((self.hash, self.lengths, self.count, self.codes, self.ids, self.n_ids), news, strict=True))
        if segments:
            self._place()

    def encode(self, segments: list[str], seeds: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of each segment's) by each segment's own seed. Merged anew are only
        segments with a skip; what :meth:`Pieces.one` gives is the same."""
        at = self.at
        try:
            which = np.array([at[s] for s in segments], dtype=np.int64)
        except KeyError:
            self.learn(list({s for s in segments if s not in at and len(s) <= ARRAYS}))
            which = np.array([at.get(s, -1) for s in segments], dtype=np.int64)
        known, long = np.flatnonzero(which >= 0), np.flatnonzero(which < 0)
        keys = seeds.astype(np.uint64)
        keys[known] ^= self.hash[which[known]]
        anew = np.zeros(len(segments), bool)
        if dropout:
            n = self.count[which[known]]
            whose = np.repeat(known, n)
            start, left, right = (pick(x, self.of_tested[which[known]], n) for x in self.tested)
            anew[whose[skipped(keys[whose], start, left, right, dropout)]] = True
        n_ids = np.zeros(len(segments), dtype=np.int64)
        n_ids[known], begin = self.n_ids[which[known]], np.zeros(len(segments), dtype=np.int64)
        begin[known] = self.of_ids[which[known]]
        found, end = [self.ids], len(self.ids)
        again = np.flatnonzero(anew)
        again = again[np.argsort(self.lengths[which[again]], kind="stable")]
        for start in range(0, len(again), 20_000):
            some = again[start : start + 20_000]
            lengths = self.lengths[which[some]]
            ids, n = self.bpe.many(pick(self.codes, self.of_codes[which[some]], lengths), lengths, keys[some], dropout)
            found.append(ids)
            n_ids[some], begin[some] = n, end + np.cumsum(n) - n
            end += len(ids)
        for k in long.tolist():
            found.append(np.frombuffer(self.bpe.one(segments[k], int(seeds[k]), dropout), dtype="<i4"))
            n_ids[k], begin[k] = len(found[-1]), end
            end += len(found[-1])
        return pick(np.concatenate(found), begin, n_ids), n_ids


def _codes(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all segments, the number of each one's)."""
    return np.frombuffer("".join(segments).encode("utf-32-le"), dtype="<u4"), np.array([len(s) for s in segments], dtype=np.int64)


def occurrence_seeds(doc_seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A seed for each of the ``counts`` segments of each document: a hash of its seed and their place."""
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    x = np.repeat(doc_seeds.astype(np.uint64), counts) ^ ((place.astype(np.uint64) + np.uint64(1)) * _K[1])
    x = (x ^ (x >> np.uint64(32))) * _K[0]
    return x ^ (x >> np.uint64(29))


@functools.cache
def pieces(path: str) -> Pieces:
    """One model for each file in a worker process."""
    return Pieces(path)


def _segments(text: str) -> list[str]:
    """A blank goes in front and blanks become marks. A mark in the text itself is not a blank: it
    is spelled in bytes, as the segment "" tells."""
    if not text:
        return []
    parts = f" {text}".split(BLANK)
    out = SEGMENT.findall(parts[0].replace(" ", BLANK))
    for p in parts[1:]:
        out.append("")
        out += SEGMENT.findall(p.replace(" ", BLANK))
    return out


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 42) -> DataFrame:
    """``docs`` with ``ids``: the pieces of whole texts under merge-dropout.

    Each candidate merge is skipped if a hash of (seed, doc_id, the segment's place in the document,
    segment, place, pieces) falls below ``dropout``; the others are made best first. So equal words
    differ within a document and between documents, and a rerun or a retried task gives the same
    ids. Documents without a doc_id are told apart by their text. With dropout 0 the ids are the
    model's own. A null text gives null ids, an empty one none. A column named ids is replaced;
    others pass through. Equal rows get equal ids, an empty table gives an empty one."""
    docs = docs.drop("ids")
    text = docs.columns.index("text")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    rows = docs.withColumn(*unused(docs, "doc_seed"), key)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pieces(model)
        known = Remembered(bpe)
        for batch in batches:
            for part in slices(batch, sizes(batch.column(text)), 1 << 20):
                texts, doc_seeds = part.column(text).to_pylist(), part.column(part.num_columns - 1).to_numpy()
                split = [_segments(t or "") for t in texts]
                if len(known.at) > REMEMBERED:
                    known = Remembered(bpe)
                counts = np.array([len(x) for x in split], dtype=np.int64)
                ids, n = known.encode([s for x in split for s in x], occurrence_seeds(doc_seeds, counts), dropout)
                offsets = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))].astype(np.int32)
                null = pa.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()), mask=null)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` with ``decoded``: the text of its ``ids`` (null for null). Decoding what
    :func:`encode` made gives the text back whole. A column named decoded is replaced. Rows are decoded each for itself,
    so equal ones stay equal; an empty table gives an empty one."""
    coded = coded.drop("decoded")
    at = coded.columns.index("ids")
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pieces(model)
        for batch in batches:
            column = batch.column(at)
            counts = np.array([len(x.values) if x.is_valid else 0 for x in column], dtype=np.int64)
            for part in slices(batch, counts, 1 << 20):
                some = part.column(at)
                n = np.array([len(x.values) if x.is_valid else 0 for x in some], dtype=np.int64)
                out = bpe.decode(some.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n))
                texts = [x.decode("utf-8", "replace") if ok else None for x, ok in zip(out, some.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [f.name for f in schema.fields])

    return coded.mapInArrow(run, schema)
