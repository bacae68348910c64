"""Records of CSV text whose quoted fields may hold line breaks, read by many tasks a file.

A split of a file does not show whether it begins inside a quoted field. So each split is read for both
cases, which gives two flags; from the first split on, the flags of a file say how every split begins.
Then all splits are read side by side, each from its first true record on. A record that runs on into
the next splits is put together from its pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places in a line: within an unquoted field, at the start of a field, in a quoted one, and after a
#: quote in a quoted one, which ends it unless another quote follows.
PLAIN, FRESH, QUOTED, CLOSING = range(4)
#: Where a quote leads to from each place.
_QUOTE = {PLAIN: PLAIN, FRESH: QUOTED, QUOTED: CLOSING, CLOSING: QUOTED}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines of files, and the split that each begins in. Lines of a split come
    in order."""
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def scanned(line: Column) -> Column:
    """(place, fields): where a text that begins outside of quotes ends, and how many fields it has."""

    def step(acc: Column, part: Column) -> Column:
        place = F.when(acc["place"].isNull(), FRESH)
        for before, after in _QUOTE.items():
            place = place.when(acc["place"] == before, after)
        moved = F.when((part == "") | (place == QUOTED), place).when(part.endswith(","), FRESH).otherwise(PLAIN)
        commas = F.when(place == QUOTED, 0).otherwise(F.length(part) - F.length(F.replace(part, F.lit(","), F.lit(""))))
        return F.struct(moved.cast("int").alias("place"), (acc["fields"] + commas).cast("int").alias("fields"))

    first = F.struct(F.lit(None).cast("int").alias("place"), F.lit(1).alias("fields"))
    return F.aggregate(F.split(line, '"', -1), first, step)


def line_end(text: DataFrame) -> str | None:
    """The line end by which a reader of lines may cut a file into records; None if a line that begins
    outside of quotes ends inside, or if line ends are mixed. One small aggregate."""
    opens = F.when(F.col("value").contains('"'), scanned(F.col("value"))["place"] == QUOTED).otherwise(False)
    opening, n, returns = text.agg(F.count_if(opens), F.count(F.lit(1)), F.count_if(F.col("value").endswith("\r"))).first()
    return None if opening or 0 < returns < n else "\r\n" if returns else "\n"


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a line ends inside of quotes."""
    first, *parts = line.split('"')
    place = QUOTED if quoted else FRESH if not first or first[-1] == "," else PLAIN
    for part in parts:
        place = _QUOTE[place]
        if part and place != QUOTED:
            place = FRESH if part[-1] == "," else PLAIN
    return place == QUOTED


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of each split in a batch."""
    file, start = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
    codes = file.indices.to_numpy()
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (start[1:] != start[:-1])) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if high > low:
            yield (file.dictionary[int(codes[low])].as_py(), int(start[low])), batch.column(0).slice(low, high - low)


def _quoting(values: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))


def split_ends(text: DataFrame) -> list[tuple[str, int, bool, bool]]:
    """(file, start, end if it begins outside, end if it begins inside): whether each split ends inside
    of quotes; a row per split, of each of which the driver holds a description anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends = None, (False, True)
        for batch in batches:
            for split, values in _runs(batch):
                if split != now:
                    if now:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, *ends), strict=True))])
                    now, ends = split, (False, True)
                for line in values.take(pa.array(_quoting(values))).to_pylist():
                    ends = tuple(ends_quoted(line, e) for e in ends) if ends[0] != ends[1] else (ends_quoted(line, ends[0]),) * 2
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, *ends), strict=True))])

    names = ["file", "start", "outside", "inside"]
    return sorted(tuple(r) for r in text.mapInArrow(run, "file string, start long, outside boolean, inside boolean").collect())


def begins(ends: list[tuple[str, int, bool, bool]]) -> dict[tuple[str, int], tuple[bool, bool]]:
    """Whether each split begins, and ends, inside of quotes."""
    out, file, state = {}, None, False
    for name, start, outside, inside in ends:
        state = state if name == file else False
        out[name, start] = state, (state := inside if state else outside)
        file = name
    return out


class _Split:
    """The records of one split, from lines that come in batches."""

    def __init__(self, key: tuple[str, int], quoted: bool):
        self.key, self.quoted = key, quoted
        self.lead, self.held, self.before = quoted, [], None
        self.first = key[1] == 0

    def take(self, values: pa.Array) -> pa.Array:
        """The records that are known to be whole by these lines."""
        inside, at, here = np.zeros(len(values), bool), 0, _quoting(values)
        for i, line in zip(here.tolist(), values.take(pa.array(here)).to_pylist(), strict=True):
            inside[at : i + 1] = self.quoted
            self.quoted, at = ends_quoted(line, self.quoted), i + 1
        inside[at:] = self.quoted
        starts = np.flatnonzero(~inside)
        self.held += values.slice(0, int(starts[0]) if len(starts) else len(values)).to_pylist()
        if not len(starts):
            return values.slice(0, 0)
        earlier = self._close()
        ends = np.append(starts[1:], len(values))
        if self.quoted:
            self.held = values.slice(int(starts[-1])).to_pylist()
            starts, ends = starts[:-1], ends[:-1]
        found, many = values.take(pa.array(starts)), ends - starts > 1
        joined = ["\n".join(values.slice(s, e - s).to_pylist()) for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True)]
        found = pc.replace_with_mask(found, pa.array(many), pa.array(joined, pa.string())) if joined else found
        return self._without_first(pa.concat_arrays([earlier, found]))

    def _close(self) -> pa.Array:
        """What is held: the end of a record that began before the split, or a record."""
        text, held = "\n".join(self.held), bool(self.held)
        self.held = []
        if self.lead:
            self.before, self.lead, held = text, False, False
        return pa.array([text] if held else [], pa.string())

    def _without_first(self, found: pa.Array) -> pa.Array:
        if self.first and len(found):
            found, self.first = found.slice(1), False
        return found

    def last(self) -> pa.Array:
        """The record that ends with the split, if it is held still."""
        return self._without_first(self._close()) if self.held and not self.lead and not self.quoted else pa.array([], pa.string())

    def pieces(self) -> list[tuple[str | None, bool]]:
        """(text, whether it begins a record): what the split has of records that pass its ends. A
        file's first record has no text."""
        open_ = "\n".join(self.held)
        if self.lead:
            return [(open_, False)]
        begun = [(None if self.first else open_, True)] if self.quoted else []
        return [*([(self.before, False)] if self.before is not None else []), *begun]


def _records(text: DataFrame, inside: frozenset[tuple[str, int]], pieces: bool) -> DataFrame:
    """(record, file, start, whole): the whole records of every split, without a file's first; or the
    pieces at the splits' ends, where ``whole`` says that a piece begins a record."""

    def rows(split: _Split, found: pa.Array | list[tuple[str | None, bool]]) -> pa.RecordBatch:
        if pieces:
            texts, whole = [f[0] for f in found], [f[1] for f in found]
        else:
            found = pc.utf8_rtrim(found, "\r")
            texts = found.filter(pc.not_equal(pc.utf8_trim_whitespace(found), ""))
            whole = [True] * len(texts)
        of_split = [pa.array([x] * len(texts), kind) for x, kind in zip(split.key, (pa.string(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *of_split, pa.array(whole, pa.bool_())], ["record", "file", "start", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            for key, values in _runs(batch):
                if split is None or key != split.key:
                    if split:
                        yield rows(split, split.pieces() if pieces else split.last())
                    split = _Split(key, key in inside)
                found = split.take(values)
                if not pieces:
                    yield rows(split, found)
        if split:
            yield rows(split, split.pieces() if pieces else split.last())

    return text.mapInArrow(run, "record string, file string, start long, whole boolean")


def records(text: DataFrame) -> DataFrame:
    """(record): the records of files with a first one each, which is left out. Blank lines are no
    records. A quoted field that never ends takes the rest of its file."""
    states = begins(split_ends(text))
    inside = frozenset(k for k, (start, _) in states.items() if start)
    whole = _records(text, inside, False).select("record")
    cut = [k for k, state in states.items() if any(state)]
    if not cut:
        return whole
    few = text.join(F.broadcast(text.sparkSession.createDataFrame(cut, "file string, start long")), ["file", "start"]).select("value", "file", "start")
    parts = _records(few, inside, True)
    parts = parts.withColumn("number", F.sum(F.col("whole").cast("int")).over(Window.partitionBy("file").orderBy("start", "whole")))
    parts = parts.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", "whole", "record"))).alias("parts"))
    parts = parts.filter(~F.exists("parts", lambda p: p["record"].isNull()))
    return whole.unionByName(parts.select(F.rtrim(F.array_join(F.transform("parts", lambda p: p["record"]), "\n"), F.lit("\r")).alias("record")))
