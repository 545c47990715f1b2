"""Secret scans: patterns find assignments, access keys and hex runs; decoded base64 and hex confirm keys and tokens by structure.

The method's own kinds: `jwt`, a signed token whose header decodes to a JSON object that names an algorithm; `pem`, a private
key block whose body decodes to a key, or base64 of such a block; `der` and `openssh`, base64 whose bytes are such a key, in
one run or wrapped into lines; `hexkey`, hex that is, with 0x before it or not. Bytes are a key if nested lengths agree to the
last byte: DER tags from an outer sequence that starts with a version number, or with an algorithm and the octets that it
encrypted, or OpenSSH's magic followed by length-prefixed fields. A block whose own headers say that it is encrypted holds
whole cipher blocks instead. Random text fails these tests.

Edge cases. A null text counts as empty. Texts are scanned whole. Spans are in code points, end exclusive; equal starts are
ordered by kind as in KINDS. Repeated rows give repeated results; extra columns are left out by `scan` and kept by `redact`.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import documents, sliced

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh", "hexkey")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A JSON object's base64 starts with e and one of these.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s*[A-Za-z0-9-]+: [^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: Lines of equal length and what is left.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}(?:\r?\n[A-Za-z0-9+/]+)+={0,2}")
ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?([0-9A-Fa-f]{32,})(?![0-9A-Za-z])")
MAGIC = b"openssh-key-v1\0"
SPANS = "array<struct<kind:string,start:int,end:int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _classes(characters: bytes) -> bytes:
    return bytes(ord("x") if b in characters else ord(" ") for b in range(256))


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(48, 58))
_HEX, _BASE64 = _classes(b"0123456789abcdefABCDEF"), _classes(_LETTERS + b"+/_-")
_RUN16, _RUN24 = b"x" * 16, b"x" * 24
_WORDS = (b"passw", b"secret", b"token", b"api")


def unpacked(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """DER tags and contents of data if their lengths fill it to the last byte."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        found.append((tag, data[at : at + n]))
        at += n
    return found


def is_der_key(data: bytes) -> bool:
    """A sequence of a version and more, constructed fields well-formed down to four levels."""
    if data[:1] != b"\x30" or not (outer := fields(data)) or len(outer) != 1:
        return False
    inner = fields(outer[0][1])
    if inner and [t for t, _ in inner] == [0x30, 0x04]:  # encrypted
        how = fields(inner[0][1])
        return bool(how) and how[0][0] == 0x06 and len(inner[1][1]) >= 16 and not len(inner[1][1]) % 8
    if not inner or len(inner) < 3 or inner[0] not in ((2, b"\0"), (2, b"\1")):
        return False
    level = [x for t, x in inner if t & 0x20]
    for _ in range(4):
        below = [fields(x) for x in level]
        if None in below:
            return False
        level = [x for f in below for t, x in f if t & 0x20]
    return inner[1][0] in (0x02, 0x04, 0x30)


def is_openssh_key(data: bytes) -> bool:
    """The magic, three strings, a count, and as many public keys and one private part, all lengths exact."""
    if not data.startswith(MAGIC):
        return False
    at, strings = len(MAGIC), 3

    def skip(at: int) -> int:
        return at + 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data) + 1

    for _ in range(strings):
        at = skip(at)
    if at + 4 > len(data) or not 1 <= (keys := int.from_bytes(data[at : at + 4], "big")) <= 16:
        return False
    at += 4
    for _ in range(keys + 1):
        at = skip(at)
    return at == len(data)


def key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def is_block(m: re.Match) -> bool:
    """Whether a PEM block holds a key, or says that it is encrypted and holds whole cipher blocks."""
    data = unpacked("".join(m[3].split()))
    if "ENCRYPTED" in m[2] and "DEK-Info:" in m[2]:
        return bool(data) and not len(data) % 8
    return key_kind(data) is not None


def base64_kind(text: str) -> str | None:
    """What a run of base64 holds: a key, or the text of a PEM block."""
    if (kind := key_kind(data := unpacked(text))) or not data or b"-----BEGIN " not in data:
        return kind
    return "pem" if any(map(is_block, PEM.finditer(data.decode("latin-1")))) else None


def is_token(header: str, payload: str) -> bool:
    try:
        head, body = json.loads(unpacked(header) or b""), json.loads(unpacked(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text. Byte searches, far cheaper than patterns, tell which patterns can match at all."""
    raw = text.encode("utf-8", "surrogatepass")
    lower, found = raw.lower(), []
    if any(w in lower for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _RUN16 in raw.translate(_HEX):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        found += [("hexkey", *m.span()) for m in ANY_HEX.finditer(text) if not len(m[1]) % 2 and key_kind(bytes.fromhex(m[1]))]
    blocks = []
    if b"-----BEGIN " in raw:
        blocks = [m.span() for m in PEM.finditer(text) if is_block(m)]
        found += [("pem", *s) for s in blocks]
    if _RUN16 in (runs := raw.translate(_BASE64)):
        if b"." in raw:
            found += [("jwt", *m.span()) for m in JWT.finditer(text) if is_token(m[1], m[2])]
        if _RUN24 in runs:
            for m in BASE64.finditer(text):
                if m[0][0] in "MbL" and (kind := base64_kind(m[0])) and not any(a <= m.start() < b for a, b in blocks):
                    found.append((kind, *m.span()))
                    blocks.append(m.span())
            for m in WRAPPED.finditer(text) if b"\n" in raw else ():
                if m[0][0] in "MbL" and not any(a <= m.start() < b for a, b in blocks):
                    lines = m[0].split()
                    for n in range(len(lines), 1, -1):  # words of the next lines may follow
                        if len({*map(len, lines[: n - 1])}) == 1 and (kind := base64_kind("".join(lines[:n]))):
                            found.append((kind, m.start(), m.start() + (m.end() - m.start() if n == len(lines) else re.match(r"\s*".join(map(re.escape, lines[:n])), m[0]).end())))
                            break
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and spans, an array of kind, start and end, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, ARROW_SPANS)], [id_column, "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string").alias(text_column)).mapInArrow(run, f"`{id_column}` {kind}, spans {SPANS}")


def redacted(text: str) -> str:
    """The text with each maximal union of spans replaced by the kind that starts it."""
    out, at = [], 0
    for kind, a, b in spans(text):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the same columns; secrets in the text are replaced, a null text stays null."""
    names = docs.columns
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t and redacted(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long")))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in BASE]
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
