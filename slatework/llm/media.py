"""Telephony audio columns: WAVE containers of mu-law, A-law and IMA ADPCM, and their PCM."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.llm.common import sizes, slices

#: WAVE format tags; bytes of samples in an ADPCM block, and of its head.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
BLOCK, HEAD = 192, 4
#: The IMA ADPCM index steps of the eight code magnitudes.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
#: The IMA ADPCM quantizer steps.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


@functools.cache
def law_table(codec: str) -> np.ndarray:
    """The 256 linear values of a companded byte, by the rule of the telephony standard."""
    code = np.arange(256, dtype=np.int32)
    if codec == "mulaw":
        code = ~code & 255
        value = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
        return np.where(code & 128, -value, value).astype(np.int16)
    code ^= 85
    step, low = (code >> 4) & 7, (code & 15) << 4
    value = np.where(step == 0, low + 8, (low + 264) << np.maximum(step - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of many blocks at once: a row of ``blocks`` is a block's bytes, the loop runs over the
    positions in a block. The head's predictor is the first sample; the low nibble comes first."""
    heads = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    data = blocks[:, HEAD:].T
    out = np.empty((1 + 2 * len(data), len(blocks)), dtype=np.int16)
    out[0], value = heads, heads
    for at, column in enumerate(data):
        for half, code in enumerate((column & 15, column >> 4)):
            size, step = (code & 7).astype(np.int32), STEPS[index]
            change = step >> 3
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                change = change + np.where(size & bit, step >> shift, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_STEPS[size], 0, len(STEPS) - 1)
            out[1 + 2 * at + half] = value
    return np.ascontiguousarray(out.T)


def to_container(payload: bytes, codec: str, rate: int = 8000) -> bytes:
    """A WAVE file whose samples (ADPCM: whose blocks' code bytes) are the payload."""
    data, align, extra = payload, 1, b""
    if codec == "adpcm":
        body = np.zeros((len(payload) // BLOCK, HEAD + BLOCK), dtype=np.uint8)
        body[:, HEAD:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, BLOCK)
        data, align, extra = body.tobytes(), HEAD + BLOCK, struct.pack("<HH", 2, 1 + 2 * BLOCK)
    bits = 4 if codec == "adpcm" else 8
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * bits // 8, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_container(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, data bytes) of a WAVE file; ValueError where it is broken."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack("<I", media[4:8])[0] != len(media) - 8:
        raise ValueError("not a whole WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        found[name] = media[at + 8 : at + 8 + size]
        if len(found[name]) != size:
            raise ValueError("a chunk is cut short")
        at += 8 + size + size % 2
    tag, channels, rate = struct.unpack("<HHI", found[b"fmt "][:8])
    codec = {v: k for k, v in TAGS.items()}.get(tag)
    if codec is None or channels != 1:
        raise ValueError(f"format {tag} with {channels} channels")
    return codec, rate, found[b"data"]


@functools.cache
def _filters(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc weights around each of ``up`` positions between two samples, of ``taps`` zero
    crossings; the cut-off is half of the lower of both rates."""
    cut = min(1.0, up / down)
    reach = int(np.ceil(taps / 2 / cut))
    at = np.arange(1 - reach, reach + 1)[None, :] - np.arange(up)[:, None] / up
    w = np.where(np.abs(at) <= reach, np.sinc(at * cut) * np.cos(np.pi * at / (2 * reach + 2)) ** 2, 0)
    return (w / w.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, up: int, down: int = 1, taps: int = 8) -> np.ndarray:
    """PCM at up/down times the rate, by a polyphase low-pass filter. Only the samples that stay are
    computed: those at multiples of ``down`` of the positions, ``up`` for each sample."""
    weights = _filters(up, down, taps)
    reach = weights.shape[1] // 2
    x = np.pad(pcm.astype(np.float32), (reach - 1, reach))
    out = np.empty(-(-len(pcm) * up // down), dtype=np.int16)
    turns = up // np.gcd(up, down)  # after so many samples the phases come again
    for first in range(min(turns, len(out))):
        start, phase = divmod(first * down, up)
        count = len(out[first::turns])
        step = turns * down // up
        total = sum(w * x[start + k : start + k + (count - 1) * step + 1 : step] for k, w in enumerate(weights[phase].tolist()) if abs(w) > 1e-7)
        out[first::turns] = np.clip(np.rint(total), -32768, 32767)
    return out


def describe(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, root mean square and sign changes of PCM."""
    x = pcm.astype(np.int32)
    power = float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec};samples={len(x)};peak={int(np.abs(x).max(initial=0))};rms={power:.3f};crossings={crossings}"


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text", codecs: tuple[str, ...] = ("mulaw", "alaw", "adpcm"), slice_bytes: int = 2 << 20) -> DataFrame:
    """(key, n_bytes, media): each whole text's UTF-8 bytes, padded with blanks to a positive
    multiple of 192, as the samples of a WAVE file.

    The codec is chosen by the payload's CRC-32, so equal texts give equal files. A null text is
    an empty one: 192 blanks. Keys may be null or repeat; other columns are left out; an empty
    table gives an empty table."""
    import zlib

    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, sizes(batch.column(1)), slice_bytes):
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                payloads = [b + b" " * (max(1, -(-len(b) // BLOCK)) * BLOCK - len(b)) for b in raw]
                media = [to_container(p, codecs[zlib.crc32(p) % len(codecs)]) for p in payloads]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame, key: str = "doc_id", rate: int = 16000, slice_bytes: int = 2 << 20) -> DataFrame:
    """(key, n_bytes, media, payload, feature, pcm): what :func:`encode_media` stored, read back.

    ``payload`` is the code bytes, ``feature`` describes the decoded samples and ``pcm`` is 16-bit
    PCM resampled to ``rate``. ADPCM blocks of all files of a slice are decoded together. A null
    file gives nulls; a broken one raises ValueError. Equal files give equal rows, an empty table an
    empty one; columns besides are left out."""
    kind = media.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, sizes(batch.column(2)), slice_bytes):
                files = [m and from_container(m) for m in part.column(2).to_pylist()]
                blocks = [np.frombuffer(f[2], dtype=np.uint8).reshape(-1, HEAD + BLOCK) for f in files if f and f[0] == "adpcm"]
                decoded = iter(np.split(decode_adpcm(np.concatenate(blocks)), np.cumsum([len(b) for b in blocks])[:-1]) if blocks else [])
                payloads, features, pcms = [], [], []
                for f in files:
                    if not f:
                        payloads.append(None), features.append(None), pcms.append(None)
                        continue
                    codec, own_rate, data = f
                    codes = np.frombuffer(data, dtype=np.uint8)
                    if codec == "adpcm":
                        payloads.append(codes.reshape(-1, HEAD + BLOCK)[:, HEAD:].tobytes())
                        pcm = next(decoded).reshape(-1)
                    else:
                        payloads.append(data)
                        pcm = law_table(codec)[codes]
                    features.append(describe(codec, pcm))
                    step = np.gcd(rate, own_rate)
                    pcms.append(resample(pcm, int(rate // step), int(own_rate // step)).astype("<i2").tobytes())
                arrays = [part.column(0), part.column(1), part.column(2), pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(pcms, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [key, "n_bytes", "media", "payload", "feature", "pcm"])

    return media.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary, payload binary, feature string, pcm binary")


def store_pcm(media: DataFrame, path: str, key: str = "doc_id", rate: int = 16000) -> DataFrame:
    """Write the resampled PCM of what :func:`encode_media` stored as Parquet, (key, rate, pcm), and
    read it back. The path is on storage that all executors share. Null files have null PCM."""
    decode_media(media, key, rate).select(key, F.lit(rate).alias("rate"), "pcm").write.parquet(path)
    return media.sparkSession.read.parquet(path)


def digest(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lengths and checksums of what :func:`decode_media` read back."""
    return decoded.select(
        key, F.col("n_bytes"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("feature"),
        F.length("pcm").cast("long").alias("pcm_bytes"), F.crc32("pcm").alias("pcm_crc32"),
    )
