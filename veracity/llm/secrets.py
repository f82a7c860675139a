"""Secret scans with structural confirmation.

Plain patterns find assignments, access keys and long hex runs. Base64 and hex candidates, those wrapped over lines and those
behind ``0x`` included, are decoded and reported only if they parse: DER key encodings whose nested lengths fit to the byte,
OpenSSH key blobs, PEM blocks around either (with the headers of traditional encryption, or themselves in base64), and signed
tokens whose header and payload are JSON objects with an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ANY_HEX = re.compile(r"(?:(?<![0-9A-Za-z+/_-])|(?<![0-9A-Za-z+/_-]0[xX])(?<=0[xX]))[0-9A-Fa-f]{32,}(?![0-9A-Za-z+/_-])")
#: Lines of at least 32 characters each but for the last, or a part of one line.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/_-]{32,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]+|[A-Za-z0-9+/_-]{16,})={0,2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[A-Za-z0-9_-]{7,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:(?:\s|\\[nr])*(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]+)*)([A-Za-z0-9+/=\s\\]+?)-----END \1PRIVATE KEY-----")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill ``data[start:end]`` exactly, else None."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, n = data[start], data[start + 1]
        start += 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or start + k > end:
                return None
            n = int.from_bytes(data[start : start + k])
            start += k
            if n < 0x80:
                return None  # DER takes the short form
        if start + n > end:
            return None
        out.append((tag, start, start + n))
        start += n
    return out


def is_der_key(data: bytes) -> bool:
    """A private key in DER: PKCS#1, PKCS#8 (plain or encrypted), SEC 1, or the six numbers of DSA."""
    top = elements(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30 or not (own := elements(data, *top[0][1:])):
        return False
    tags = [x[0] for x in own]
    if tags[0] == 0x02 and own[0][2] - own[0][1] == 1:
        if len(own) >= 9 and set(tags[:9]) == {0x02}:
            return True
        if len(own) == 6 and set(tags) == {0x02}:
            return own[1][2] - own[1][1] >= 64 and 20 <= own[2][2] - own[2][1] <= 65 and own[5][2] - own[5][1] <= own[2][2] - own[2][1] + 1
        if tags[1:3] == [0x30, 0x04]:
            return _names_algorithm(data, own[1])
        return tags[1] == 0x04 and own[1][2] - own[1][1] >= 16 if len(tags) > 1 else False
    return tags == [0x30, 0x04] and _names_algorithm(data, own[0]) and own[1][2] - own[1][1] >= 16


def _names_algorithm(data: bytes, element: tuple[int, int, int]) -> bool:
    inner = elements(data, *element[1:])
    return bool(inner) and inner[0][0] == 0x06


def is_openssh_key(data: bytes) -> bool:
    """An openssh-key-v1 blob whose nested lengths fit."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at, k, keys = len(magic), 0, 1
    while k < 3 + keys + 1:
        if k == 3 and keys == 1 and at + 4 <= len(data):
            keys = int.from_bytes(data[at : at + 4])
            at += 4
            if not 1 <= keys <= 64:
                return False
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4])
        k += 1
    return at == len(data)


def decode64(text: str) -> bytes | None:
    """Base64 of either alphabet, padded or not."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token(header: str, payload: str, signature: str) -> bool:
    """A signed token: JSON header with an algorithm, JSON payload, a signature unless the algorithm is none."""
    try:
        head, body = json.loads(decode64(header) or b""), json.loads(decode64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return head["alg"].lower() == "none" or bool(decode64(signature))


def key_kind(data: bytes | None) -> str | None:
    """What the bytes are: der, openssh, pem, or None."""
    if not data:
        return None
    if data[0] == 0x30 and is_der_key(data):
        return "der"
    if data[0] == 0x6F and is_openssh_key(data):
        return "openssh"
    return "pem" if data.lstrip()[:11] == b"-----BEGIN " and pem_spans(data.decode("latin-1")) else None


def pem_spans(text: str) -> list[tuple[int, str, int]]:
    """PEM blocks whose body is a key, or, under a traditional encryption header, whole cipher blocks."""
    found = []
    for m in PEM.finditer(text):
        data = decode64(re.sub(r"\\n|\\r|\s", "", m[3]))
        if data and (len(data) % 8 == 0 if "DEK-Info" in m[2] and "ENCRYPTED" in m[2] else key_kind(data)):
            found.append((m.start(), "pem", m.end()))
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of assignments, access keys and hex runs; leftmost, not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


#: How base64 of a DER sequence, of an OpenSSH blob and of a PEM block begins.
FIRST = frozenset("MbL")
LINE = re.compile(r"\S+")


def _key_end(body: str, at: list[tuple[int, int]], k: int) -> tuple[str, int] | None:
    """(kind, end) of the key that starts with line k. ``body``: the lines of base64 joined; ``at``: where each is in the text.
    What a DER key says of its length tells the lines it takes; others take all lines up to padding, or all but one or two."""
    first = sum(y - x for x, y in at[:k])
    head = decode64(body[first : first + 32].rstrip("="))
    if not head or not (head[0] == 0x30 or head[:11] in (b"openssh-key", b"-----BEGIN ")):
        return None
    want = 0
    if head[0] == 0x30 and head[1] != 0x80 and head[1] <= 0x84:
        n = head[1] & 0x7F if head[1] > 0x80 else 0
        want = 2 + n + (int.from_bytes(head[2 : 2 + n]) if n else head[1])
    if head[0] == 0x30 and not 0 < want <= len(body) - first:
        return None
    size, ends = 0, []
    for x, y in at[k:]:
        size += y - x
        ends.append((size, y))
        if body[first + size - 1] == "=" or want and 3 * size // 4 >= want:
            break
    for size, y in reversed(ends[-1:] if want else ends[-3:]):
        if kind := key_kind(decode64(body[first : first + size])):
            return kind, y
    return None


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what decodes and parses as a key or signed token."""
    found = pem_spans(text) if "-----BEGIN " in text else []
    inside = lambda a, b: any(s <= a and b <= e for s, _, e in found)
    for m in BASE64.finditer(text):
        # lines that don't belong may stand before or after a key's, so a key may start at any line and end at any
        at = [(m.start() + x.start(), m.start() + x.end()) for x in LINE.finditer(m[0])]
        body, stop = "", 0
        for k, (a, _) in enumerate(at):
            if a >= stop and text[a] in FIRST:
                body = body or "".join(text[x:y] for x, y in at)
                if (end := _key_end(body, at, k)) and not inside(a, end[1]):
                    found.append((a, end[0], end[1]))
                    stop = end[1]
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and m[0][:2] in ("30", "6f", "6F", "2d", "2D") and (kind := key_kind(bytes.fromhex(m[0]))):
            found.append((m.start(), kind, m.end()))
    if "." in text:
        found += [(m.start(), "jwt", m.end()) for m in TOKEN.finditer(text) if is_token(*m.groups())]
    return found


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of the base kinds and of confirmed spans, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, comma-joined. A null text is
    an empty one and has none. Rows are independent, so repeated rows give repeated results; other columns
    are not read. One pass, no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = [base_spans(t or "") for t in b["_text"].to_pylist()]
            more = [confirmed_spans(t or "") for t in b["_text"].to_pylist()]
            n = lambda kind: pa.array([sum(x[1] == kind for x in s) for s in base], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict({
                id_col: b["_id"], "n_assign": n("assign"), "n_access": n("access"), "n_hex": n("hex"),
                "base_sha256": pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()),
                "spans": pa.array([joined(s + m) for s, m in zip(base, more, strict=True)], pa.string()),
                "n_confirmed": pa.array(map(len, more), pa.int64()),
            })

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return own.mapInArrow(scan, f"`{id_col}` {own.schema['_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def mask(text: str, marker: str) -> str:
    """The text with every run of overlapping spans replaced by the marker."""
    out, last = [], 0
    spans = sorted((s, e) for s, _, e in base_spans(text) + confirmed_spans(text))
    for k, (s, e) in enumerate(spans):
        if k and s < last:
            last = max(last, e)
            continue
        out += [text[last:s], marker] if k or s else [marker]
        last = e
    return "".join(out) + text[last:]


def masked(text_col: str = "text", marker: str = "[SECRET]") -> Column:
    """A text column with its secrets replaced; null stays null, texts without secrets stay as they are."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else mask(t, marker))

    return udf(F.col(text_col))
