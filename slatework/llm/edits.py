"""Token counts that follow edits: a segment tree of pre-token leaves for each document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from slatework.llm.common import sizes, slices
from slatework.llm.tokenize import encoder

#: A blank or line end after other text always starts a new pre-token, whatever follows.
SAFE = re.compile(r"\S(?=[ \n])")

EDITS = "array<struct<start:bigint,length:bigint,replacement:string>>"


def leaves(text: str, least: int = 128) -> list[str]:
    """Consecutive parts of at least ``least`` characters, cut only between pre-tokens."""
    out, start = [], 0
    while len(text) - start > least and (m := SAFE.search(text, start + least - 1)):
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return [x for x in out if x]


class Tree:
    """Sums of characters and tokens over the leaves; node 1 is the root, leaves fill the second half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def build(cls, text: str, count: Callable[[str], int]) -> Tree:
        parts = leaves(text)
        tree = cls(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        tree._plant([len(x) for x in parts], [count(x) for x in parts])
        return tree

    def _plant(self, chars: list[int], tokens: list[int]) -> None:
        """All nodes from those of the leaves."""
        half = 1 << max(0, len(chars) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * half, dtype=np.int64), np.zeros(2 * half, dtype=np.int64)
        self.chars[half : half + len(chars)], self.tokens[half : half + len(chars)] = chars, tokens
        while half > 1:
            half //= 2
            for sums in (self.chars, self.tokens):
                sums[half : 2 * half] = sums[2 * half : 4 * half].reshape(-1, 2).sum(axis=1)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf node, characters before it) of the leaf that holds character ``at``."""
        node, before, half = 1, 0, len(self.chars) // 2
        while node < half:
            node *= 2
            if at - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node, before

    def edit(self, text: str, start: int, length: int, new: str, count: Callable[[str], int]) -> tuple[str, int]:
        """(the edited text, characters encoded anew). Only the leaves that hold the characters from
        the one before the edit to the one after it are encoded again; then the sums above them."""
        start = min(max(start, 0), len(text))
        end = min(start + max(length, 0), len(text))
        first, from_ = self.find(max(start - 1, 0)) if text else (len(self.chars) // 2, 0)
        last, before = self.find(min(end, len(text) - 1)) if text else (first, 0)
        to = before + int(self.chars[last])
        region = text[from_:start] + new + text[end:to]
        slots, parts, half = last - first + 1, leaves(region), len(self.chars) // 2
        if len(parts) > slots:
            # leaves keep their size: the others move on, with the counts that they have
            old = list(zip(self.chars[half:].tolist(), self.tokens[half:].tolist(), strict=True))
            grown = old[: first - half] + [(len(x), count(x)) for x in parts] + old[last - half + 1 :]
            self._plant(*zip(*[x for x in grown if x[0]], strict=True))
            return text[:start] + new + text[end:], len(region)
        for k in range(slots):
            part = parts[k] if k < len(parts) else ""
            self.chars[first + k], self.tokens[first + k] = len(part), count(part) if part else 0
        low, high = first // 2, last // 2
        while low:
            for sums in (self.chars, self.tokens):
                sums[low : high + 1] = sums[2 * low : 2 * high + 2].reshape(-1, 2).sum(axis=1)
            low, high = low // 2, high // 2
        return text[:start] + new + text[end:], len(region)


_TREE = [T.StructField("tree_chars", T.ArrayType(T.LongType())), T.StructField("tree_tokens", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.LongType())]
_LISTS = pa.list_(pa.int64())


def build_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` with ``tree_chars``, ``tree_tokens`` (sums at every node) and ``n_tokens`` of whole
    texts; columns of these names are replaced, others pass through. Null texts count as empty.
    Rows stay where they are: nothing is shuffled. Equal rows get equal trees, an empty table gives an
    empty one."""
    docs = docs.drop(*[f.name for f in _TREE])
    text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *_TREE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, sizes(batch.column(text)), 4 << 20):
                trees = [Tree.build(t or "", lambda x: len(enc.ids(x))) for t in part.column(text).to_pylist()]
                arrays = [pa.array([t.chars for t in trees], _LISTS), pa.array([t.tokens for t in trees], _LISTS), pa.array([int(t.tokens[1]) for t in trees], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, tokenizer: str, edits: str = "edits") -> DataFrame:
    """The rows of :func:`build_trees` with their ``edits`` (start, length, replacement) applied in
    order, each to the text as it then is: text, trees and n_tokens are the edited ones, and
    ``chars_reencoded`` says how much was encoded anew.

    Starts and lengths count characters; what lies outside a text is cut off, null starts and
    lengths are 0, null replacements empty, null edits nothing. A null text with edits is an empty
    one. Edits of a document are one array in its row, so a document's edits are local to it. Rows that
    repeat are edited each for itself; an empty table gives an empty one."""
    trees = trees.drop("chars_reencoded")
    names = trees.columns
    text, chars, tokens, total, how = (names.index(x) for x in ("text", "tree_chars", "tree_tokens", "n_tokens", edits))
    schema = T.StructType([*trees.schema.fields, T.StructField("chars_reencoded", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, sizes(batch.column(text)), 4 << 20):
                out: list[list] = [[], [], [], [], []]
                cols = [part.column(k) for k in (chars, tokens)]
                for k, (old, todo) in enumerate(zip(part.column(text).to_pylist(), part.column(how).to_pylist(), strict=True)):
                    tree = Tree(*(np.array(c[k].values) for c in cols))
                    new, done = old, 0
                    for x in filter(None, todo or []):
                        new, n = tree.edit(new or "", x["start"] or 0, x["length"] or 0, x["replacement"] or "", lambda s: len(enc.ids(s)))
                        done += n
                    for column, value in zip(out, (new, tree.chars, tree.tokens, int(tree.tokens[1]), done), strict=True):
                        column.append(value)
                arrays = list(part.columns)
                for at, column, kind in zip((text, chars, tokens, total), out, (pa.string(), _LISTS, _LISTS, pa.int64()), strict=False):
                    arrays[at] = pa.array(column, kind)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[4], pa.int64())], [f.name for f in schema.fields])

    return trees.mapInArrow(run, schema)
