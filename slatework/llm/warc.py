"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic numbers of a Zstandard frame and of the dictionary's skippable frame.
FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A5D
#: Fixed value: the profile of a revisit whose payload is the same, from the WARC 1.1 standard.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "archive string, offset long, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def resolve(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to): which record each row gets.

    Among equal payloads of at least ``least_bytes``, rows with the smallest page_id are
    responses and all others revisits of it; smaller payloads are all responses. Null html is an
    empty payload. Rows that repeat the smallest page_id are responses too; a null page_id is
    never the smallest, and payloads that only null page_ids have are all responses. The join is on
    the digest; a digest that many rows share is split by Spark's skew handling."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.filter(F.length("payload") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1 and refers_to is not null").select("payload_digest", "refers_to")
    again = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id"))
    out = rows.join(first, "payload_digest", "left")
    return out.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("refers_to")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record's bytes: WARC head, HTTP head and, in a response, the payload. A url that no head
    line can hold as it is, is also given as JSON."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body += payload if kind == "response" else b""
    target = re.sub(r"[\x00-\x20\x7f-\xa0\s<>]", lambda m: quote(m[0], safe=""), url or "") or "urn:none"
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Page-URL": None if target == url else json.dumps(url),
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": len(payload),
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(body).hexdigest()}",
        "WARC-Profile": SAME_PAYLOAD if kind == "revisit" else None,
        "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(body),
    }
    lines = [f"{k}: {v}" for k, v in head.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + body + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on a few records, or their beginnings where training needs more."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(s[: max(64, size // len(samples))] for s in samples)[:size]


def write_archives(records: DataFrame, archive_bytes: int = 4 << 20, samples: int = 200, dictionary_bytes: int = 16 << 10, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(path, content): archives of about ``archive_bytes`` with the rows of :func:`resolve`.

    Each task trains a dictionary on its first ``samples`` records and holds those and one
    archive. The result has the columns of Spark's binaryFile source; write it as a table, or
    its contents as files. An empty table gives no archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, waiting, out, held, squeeze, head = TaskContext.get().partitionId(), 0, [], [], 0, None, b""

        def archive() -> pa.RecordBatch:
            name = f"part-{part:05d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], ["path", "content"])

        def start() -> None:
            nonlocal squeeze, head
            content = _dictionary(waiting, dictionary_bytes)
            squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True).compress
            packed = zstandard.ZstdCompressor(level=9).compress(content)
            head = struct.pack("<II", DICTIONARY, len(packed)) + packed

        def drain() -> Iterator[pa.RecordBatch]:
            nonlocal number, out, held
            if squeeze is None:
                start()
            for record in waiting:
                out = out or [head]
                out.append(squeeze(record))
                held += len(out[-1])
                if held >= archive_bytes:
                    yield archive()
                    number, out, held = number + 1, [], 0
            waiting.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(_record(*row, date))
                if squeeze or len(waiting) >= samples:
                    yield from drain()
        if waiting:
            yield from drain()
        if out:
            yield archive()

    cols = records.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    return cols.mapInArrow(run, "path string, content binary")


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and its blocks' heads."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    here = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if here + 3 > len(data):
            raise ValueError(f"the frame at {at} is cut short")
        block = int.from_bytes(data[here : here + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise ValueError(f"a block of the frame at {at} has a reserved type")
        here += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            break
    here += 4 * (flags >> 2 & 1)
    if here > len(data):
        raise ValueError(f"the frame at {at} is cut short")
    return here


def head_fields(head: bytes) -> tuple[str, dict[str, str]]:
    """(first line, fields by lower-case name) of a WARC or HTTP head. Blanks after the colon are
    optional, and a line that begins with one goes on with the field before; of a field that repeats
    the first counts."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name is not None:
            fields[name] += f" {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError(f"no field: {line[:80]!r}")
        fields.setdefault(name, value.strip())
    return first, fields


def digest_fits(digest: str, data: bytes) -> bool:
    """Whether a digest field, as algorithm:value in hexadecimal or base 32, is that of the data. One of
    an unknown algorithm says nothing, so it fits."""
    algorithm, _, value = digest.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return True
    found = hashlib.new(algorithm, data)
    return value.strip().lower() in (found.hexdigest(), base64.b32encode(found.digest()).decode().lower(), base64.b32encode(found.digest()).decode().lower().rstrip("="))


def parse_record(record: bytes) -> dict:
    """The fields of a WARC record of any version and type; ValueError where the head, a length or a
    digest is wrong.

    The payload is what follows the HTTP head in a block of type application/http, and the whole block
    otherwise; in a revisit it is null, and its length and digest are those that the head names, if any.
    A chunked payload is left as it is, and its digest is not judged. ``page_id`` and ``refers_to`` are
    null in records that other programs wrote."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    first, fields = head_fields(head)
    if not gap or not re.fullmatch(r"WARC/\d+\.\d+", first) or not {"warc-type", "warc-record-id", "content-length"} <= fields.keys():
        raise ValueError("not a WARC head")
    body = rest[:-4]
    if rest[-4:] != b"\r\n\r\n" or not fields["content-length"].isdigit() or len(body) != int(fields["content-length"]):
        raise ValueError("Content-Length is not the block's length")
    if not digest_fits(fields.get("warc-block-digest", ""), body):
        raise ValueError("the block's digest is wrong")
    kind, digest = fields["warc-type"].lower(), fields.get("warc-payload-digest", "")
    size, payload, chunked = fields.get("warc-payload-length"), body, False
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = body.partition(b"\r\n\r\n")
        chunked = "transfer-encoding" in head_fields(http)[1]
    if kind == "revisit":
        if fields.get("warc-profile") == SAME_PAYLOAD and payload and payload is not body:
            raise ValueError("a revisit of an identical payload has one of its own")
        sha = re.fullmatch(r"sha-?256:([0-9a-fA-F]{64})", digest)
        payload_digest = sha[1].lower() if sha else digest or None
        payload_bytes, payload = int(size) if size else None, None
    else:
        if not chunked and (not digest_fits(digest, payload) or size is not None and int(size) != len(payload)):
            raise ValueError("the payload is not the one that its length or digest names")
        payload_bytes, payload_digest = len(payload), hashlib.sha256(payload).hexdigest()
    number = lambda k: int(fields[k]) if k in fields else None
    target = fields.get("warc-target-uri", "")
    url = json.loads(fields["warc-page-url"]) if "warc-page-url" in fields else target.removeprefix("<").removesuffix(">") or None
    return {"page_id": number("warc-page-id"), "url": url, "record_type": kind, "payload": payload, "payload_bytes": payload_bytes, "payload_digest": payload_digest, "refers_to": number("warc-refers-to-page-id")}


def inflate(unpack: zstandard.ZstdDecompressor, frame: memoryview, most_bytes: int) -> bytes:
    """A frame's content; ValueError if it has more than ``most_bytes``, before it is in memory."""
    size = zstandard.frame_content_size(frame)
    if 0 <= size <= most_bytes:
        return unpack.decompressobj().decompress(frame)
    out, held = [], 0
    with unpack.stream_reader(frame) as source:
        while size < 0 and held <= most_bytes and (piece := source.read(1 << 20)):
            out.append(piece)
            held += len(piece)
    if max(held, size) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes")
    return b"".join(out)


def records_of(content: bytes, most_bytes: int = 1 << 30) -> Iterator[tuple[int, dict]]:
    """(offset, fields) of every record of an archive, a frame each. ValueError, with the offset, where
    the archive is broken or a record is of more than ``most_bytes``."""
    data, at, unpack = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("bytes are left after the last frame")
        magic, size = struct.unpack("<II", data[at : at + 8])
        if magic >> 4 == DICTIONARY >> 4:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut short")
            if at == 0 and magic == DICTIONARY:
                held = bytes(data[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME):
                    held = inflate(unpack, memoryview(held), most_bytes)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no Zstandard frame at {at}")
        end = frame_end(data, at)
        try:
            fields = parse_record(inflate(unpack, data[at:end], most_bytes))
        except (ValueError, zstandard.ZstdError) as e:
            raise ValueError(f"the record at {at}: {e}") from e
        yield at, fields
        at = end


def save_archives(archives: DataFrame, folder: str) -> int:
    """Write the archives of (path, content) as files of these names in a folder that all executors
    share, given as a URI, and return how many rows were written. A file is moved into its place when it is
    whole, so that a task may run again. Spark's binaryFile source reads them back for :func:`read_archives`.

    A null content is an empty file; a row without a path is not written. Of rows with equal paths
    one stays, whichever is moved last. An empty table writes nothing and gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting = f"{base}/_{uuid.uuid4().hex}"
                with store.open_output_stream(waiting) as out:
                    out.write(content or b"")
                store.move(waiting, f"{base}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return archives.filter("path is not null").select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives in (path, content), as from the binaryFile source:
    archive, offset, page_id, url, record_type, payload (null in a revisit), payload_bytes,
    payload_digest (both of the full payload) and refers_to. Heads, lengths, checksums and
    digests are validated; a broken archive raises ValueError with its offset. Archives of other
    programs are read too, with records of all types. Null and empty contents have no records, equal
    archives have theirs each, and an empty table gives an empty one."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for offset, x in records_of(content.as_py() or b""):
                    rows.append((path, offset, *(x[n] for n in names[2:])))
                    held += len(x["payload"] or b"")
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("path", "content").mapInArrow(run, RECORDS)
