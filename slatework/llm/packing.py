"""Cost-balanced packing of token ids into fixed-length training sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from slatework.llm.tokenize import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def balance(lengths: np.ndarray, capacity: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Assign whole items of at most ``capacity`` tokens to as few sequences as can hold them.

    In descending order each goes to the sequence of lowest cost (tokens + ``quadratic`` x the
    sum of squared piece lengths) among those with room. What fits nowhere whole is cut over the
    cheapest gaps. Returns (item, start, length, sequence, offset)."""
    n = -(-int(lengths.sum()) // capacity)
    room, cost, out, cut = np.full(n, capacity), np.zeros(n), [], []

    def put(item: int, start: int, size: int, seq: int) -> None:
        out.append((item, start, size, seq, capacity - int(room[seq])))
        room[seq] -= size
        cost[seq] += size + quadratic * size * size

    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        seq = int(np.where(room >= size, cost, np.inf).argmin()) if size else -1
        if size and room[seq] >= size:
            put(item, 0, size, seq)
        elif size:
            cut.append(item)
    for item in cut:
        start, left = 0, int(lengths[item])
        while left:
            seq = int(np.where(room > 0, cost, np.inf).argmin())
            size = min(left, int(room[seq]))
            put(item, start, size, seq)
            start, left = start + size, left - size
    return out


def _pack_block(docs: list[tuple[int | None, np.ndarray]], capacity: int, quadratic: float, first: int) -> pa.RecordBatch:
    """Pack one block's documents. Full stretches of a long document are sequences of their own."""
    rows: list[tuple] = []
    tails = np.array([len(ids) % capacity for _, ids in docs], dtype=np.int64)
    seq = first
    for doc_id, ids in docs:
        for start in range(0, len(ids) - capacity + 1, capacity):
            rows.append((doc_id, start, capacity, ids[start : start + capacity].tobytes(), len(ids), seq, 0))
            seq += 1
    for item, start, size, at, offset in balance(tails, capacity, quadratic):
        doc_id, ids = docs[item]
        start += len(ids) - int(tails[item])
        rows.append((doc_id, start, size, ids[start : start + size].tobytes(), len(ids), seq + at, offset))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, quadratic: float | None = None, block_tokens: int = 2_000_000) -> DataFrame:
    """Tokenize ``text``, append ``end_id`` and pack all ids into sequences of ``capacity``.

    One row per piece: doc_id, start and length (ids of the document before and in it), ids
    (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset in the sequence (gapless
    from 0). Each id is in exactly one piece. A task packs its rows in blocks of about
    ``block_tokens`` ids, so nothing is shuffled, no source or group of copies can be hot, memory
    is bounded by a block and the longest document, and a block pads less than one sequence.
    Sequence ids come from the partition, so a rerun of a lost task gives the same ones.

    A null or empty text is its end id alone. Null and repeated doc_ids are kept as they are;
    repeated rows are packed each. An empty table gives an empty table. Other columns are ignored."""
    weight = 1 / capacity if quadratic is None else quadratic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, size = encoder(tokenizer), [], 0
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                block.append((doc_id, ids))
                size += len(ids)
                if size >= block_tokens:
                    yield (out := _pack_block(block, capacity, weight, first))
                    first, block, size = max(out.column(5).to_pylist()) + 1, [], 0
        if block:
            yield _pack_block(block, capacity, weight, first)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, PIECES)
