"""Secrets in text: what looks like one by its spelling, and encoded keys and signed tokens whose
structure was parsed."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.llm.common import sizes, slices

#: Kinds of spans in the order in which spans with one start are listed; the first three are
#: the patterns below, with the group and the length that it must have.
KINDS = ("assign", "access", "hex", "key", "jwt")
SPELLED = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]{24,}"), 0, 24),
)

#: Where base64 of a DER sequence, of an OpenSSH key or of an armour's first line may begin, and hex of a DER sequence.
_START = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nr]))(?:M[A-P][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)")
_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])e(?:y[JA]|w[ok0])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_BREAK, _LINE = re.compile(r"(?:\\[nr]|[ \t\r\n])*"), re.compile(r"(?:(?:\\[nr]|[\r\n])+[ \t]*)?")
_ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:\\[nr]|\s)*$")
_END = re.compile(r"(?:\\[nr]|\s)*-----END [A-Z0-9 ]*PRIVATE KEY-----")
_OPENSSH = b"openssh-key-v1\0"

#: Bytes of a signature by algorithm; RSA's are those of the key.
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64, "EdDSA": 64}
_RSA = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 2, 3, 4, 6, 0x30


def element(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(tag, first content byte, end) of the DER element at ``at``; ValueError if its length is no DER
    or passes ``end``."""
    if at + 2 > end:
        raise ValueError("cut off")
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or at + more > end or data[at] == 0:
            raise ValueError("no length")
        n, at = int.from_bytes(data[at : at + more]), at + more
        if n < 0x80:
            raise ValueError("a long form of a short length")
    if at + n > end:
        raise ValueError("longer than what holds it")
    return tag, at, at + n


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """The DER elements that fill a range exactly."""
    out = []
    while at < end:
        out.append(element(data, at, end))
        at = out[-1][2]
    return out


def _algorithm(data: bytes, x: tuple[int, int, int]) -> bool:
    inner = elements(data, x[1], x[2])
    return x[0] == _SEQUENCE and bool(inner) and inner[0][0] == _OID and inner[0][2] > inner[0][1]


def der_key(data: bytes) -> str | None:
    """The form of a private key that ``data`` is, from the first byte to the last; None if it is none."""
    try:
        tag, at, end = element(data, 0, len(data))
        if tag != _SEQUENCE or end != len(data):
            return None
        parts = elements(data, at, end)
        tags = [p[0] for p in parts]
        version = int.from_bytes(data[parts[0][1] : parts[0][2]]) if tags[:1] == [_INTEGER] else None
        numbers = [p[2] - p[1] for p in parts[1:]]
        if tags == [_INTEGER] * 9 and version == 0 and numbers[0] >= 32 and numbers[0] - 3 <= numbers[3] + numbers[4] <= numbers[0] + 3:
            return "rsa"
        if tags == [_INTEGER] * 6 and version == 0 and numbers[0] >= 64 and numbers[1] >= 16:
            return "dsa"
        if tags[:2] == [_INTEGER, _OCTETS] and version == 1 and numbers[0] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:]):
            inner = [elements(data, *p[1:]) for p in parts[2:]]
            return "ec" if all([x[0] for x in i] in ([_OID], [_BITS]) for i in inner) else None
        if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and version in (0, 1) and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]) and _algorithm(data, parts[1]):
            inside = data[parts[2][1] : parts[2][2]]
            held = element(inside, 0, len(inside))
            return "pkcs8" if held[2] == len(inside) and held[0] in (_SEQUENCE, _OCTETS, _INTEGER) else None
        if tags == [_SEQUENCE, _OCTETS] and numbers[0] >= 32 and _algorithm(data, parts[0]) and len(elements(data, *parts[0][1:])) == 2:
            return "pkcs8 encrypted"
    except (ValueError, IndexError):
        pass
    return None


def openssh_size(data: bytes) -> int | None:
    """The bytes of the OpenSSH private key that ``data`` begins with, by its counted strings; None if it is none."""
    at, end = len(_OPENSSH), len(data)

    def text() -> bytes:
        nonlocal at
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > end:
            raise ValueError("cut off")
        at += 4 + n
        return data[at - n : at]

    try:
        if not data.startswith(_OPENSSH):
            return None
        cipher, kdf, _ = text(), text(), text()
        keys, at = int.from_bytes(data[at : at + 4]), at + 4
        public = [text() for _ in range(min(keys, 64))]
        secret = text()
    except ValueError:
        return None
    right = cipher and kdf and public and len(secret) % 8 == 0 and len(secret) >= 16 and all(p[4 : 4 + int.from_bytes(p[:4])].isascii() for p in public)
    return at if right else None


def _decoded(run: str) -> bytes:
    run = run.translate({0x2D: "+", 0x5F: "/"})
    return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)


def _gathered(text: str, at: int, wanted: int | None) -> tuple[str, int]:
    """(base64 letters, end): from ``at`` over blanks and line breaks until there are as many as wanted or,
    without a number, over line breaks until something else stands there."""
    found, n, between = [], 0, _LINE if wanted is None else _BREAK
    while (run := _RUN.match(text, at)) and (wanted is None or n < wanted):
        part = run[0] if wanted is None else run[0][: wanted - n]
        found.append(part)
        n, end = n + len(part), run.start() + len(part)
        at = between.match(text, end).end() if end == run.end() else end
        if wanted is not None and n == wanted or at == end:
            break
    return "".join(found), end


def _fitting(head: bytes) -> int | None:
    """The bytes of the DER sequence that begins with ``head``, if its first element can be a key's."""
    n, at = head[1], 2
    if n in (0x81, 0x82):
        n, at = int.from_bytes(head[2 : 2 + (n & 3)]), 2 + (n & 3)
    elif n >= 0x80:
        return None
    inner = head[at : at + 4]
    starts = inner[:2] == b"\x02\x01" and inner[2] in (0, 1) and inner[3] in (_INTEGER, _SEQUENCE, _OCTETS) or inner[0] == _SEQUENCE and inner[2] == _OID
    return at + n if starts else None


def _padded(text: str, end: int, letters: int) -> int | None:
    """The end with padding; None if more base64 follows."""
    pad = -letters % 4
    while pad and text.startswith("=", end):
        end, pad = end + 1, pad - 1
    return None if re.compile(r"[A-Za-z0-9+/=]").match(text, end) else end


def _confirmed(text: str, at: int, inside: bool) -> tuple[int, str] | None:
    """(end, form) of the key whose base64 begins at ``at``. Its own lengths say where it ends; more
    base64 may not follow."""
    if text[at] == "M":
        size = _fitting(_decoded(text[at : at + 16]))
    else:
        letters = _gathered(text, at, None)[0]
        data = _decoded(letters[: len(letters) - (len(letters) % 4 == 1)])
        size = openssh_size(data)
        if text[at] == "L" and not inside and (inner := next(_keys(armour := data.decode("latin-1"), True), None)):
            size = len(armour) - len(armour[inner[1] :].lstrip("\r\n"))
    if size is None or size < 24:
        return None
    letters, end = _gathered(text, at, -(-size * 4 // 3))
    end, data = _padded(text, end, len(letters)), _decoded(letters)
    form = der_key(data) if text[at] == "M" else "openssh" if text[at] == "b" else f"base64 of {inner[2]}"
    return (end, form) if end is not None and form and len(data) == size else None


def _keys(text: str, inside: bool = False) -> Iterator[tuple[int, int, str]]:
    after = 0
    for found in _START.finditer(text):
        at = found.start()
        if at < after:
            continue
        try:
            key = _confirmed(text, at, inside)
        except ValueError:
            continue
        if key:
            armour, closed = _ARMOUR.search(text, max(0, at - 64), at), _END.match(text, key[0])
            whole = armour and closed
            after = closed.end() if whole else key[0]
            yield armour.start() if whole else at, after, key[1]
    for found in _HEX.finditer(text):
        if len(found[0]) % 2 == 0 and _fitting(bytes.fromhex(found[0][:24])) == len(found[0]) // 2 and (kind := der_key(bytes.fromhex(found[0]))):
            yield found.start(), found.end(), f"hex of {kind}"


def _object(part: str) -> dict | None:
    try:
        found = json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def token_kind(token: str) -> str | None:
    """What a compact token is: its header names an algorithm, its payload is an object, and its
    signature has the length that the algorithm gives; or five parts of which the header says how they
    are encrypted."""
    parts = token.split(".")
    head = _object(parts[0])
    if head is None or not isinstance(head.get("alg"), str):
        return None
    try:
        last = len(_decoded(parts[-1]))
        if len(parts) == 5:
            return f"jwe {head['alg']}" if isinstance(head.get("enc"), str) and last >= 12 and _decoded(parts[3]) else None
    except ValueError:
        return None
    right = last == _SIGNATURE.get(head["alg"], -1) or head["alg"] in _RSA and last >= 128 and last % 64 == 0
    return f"jws {head['alg']}" if len(parts) == 3 and right and _object(parts[1]) is not None else None


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, detail) of all secrets, by start and then by kind; ends are exclusive, places are those of code points."""
    found = [(kind, m.start(), m.end(), "") for kind, (pattern, group, least) in zip(KINDS[:3], SPELLED, strict=True) for m in pattern.finditer(text) if len(m[group]) >= least]
    found += [("key", *k) for k in _keys(text)]
    for m in _JWT.finditer(text):
        token = m[0].rstrip(".") if m[0].count(".") > 2 and m[0].endswith(".") else m[0]
        if kind := token_kind(token):
            found.append(("jwt", m.start(), m.start() + len(token), kind))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("detail", T.StringType())]))
#: Bytes of text that are taken at once.
PART = 4 << 20


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``findings``, the secrets in each whole text; a column of this name is replaced, all
    others pass through.

    ``assign``, ``access`` and ``hex`` are spelled so, and reported as they are. ``key`` and ``jwt`` are
    reported only once their structure is confirmed: base64 (either alphabet, over line breaks, also
    written as \\n) or hex that decodes to a private key as DER (PKCS 1, PKCS 8, SEC 1, DSA; every
    nested length must fit, up to the last byte) or OpenSSH's counted strings, base64 of such a key's
    armour, and tokens with a header, payload and signature that agree. An armour around a key belongs to
    it. The detail names the form. Public keys and certificates are no secrets.

    Every row is scanned for itself, without a shuffle. A null or empty text has no findings, equal
    texts have equal ones, and an empty table gives an empty table."""
    docs = docs.drop("findings")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))
        for batch in batches:
            for part in slices(batch, sizes(batch.column(place)), PART):
                found = [[dict(zip(("kind", "start", "end", "detail"), f, strict=True)) for f in find(t or "")] for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*batch.schema.names, "findings"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("findings", FINDINGS)]))


def spelled(findings: str = "findings", kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of some kinds as kind:start:end, joined by commas in the order of the findings."""
    of_kind = F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(of_kind, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def count_of(kind: str, findings: str = "findings") -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")
