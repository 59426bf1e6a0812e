"""Secrets in texts: patterns, and candidates confirmed by their structure.

Method: structural confirmation. Runs of base64 or hex characters are decoded
and parsed before they are reported: DER key encodings with their nested
lengths, length-prefixed SSH keys, and signed tokens whose header is a JSON
object that names an algorithm. Base64 lines of one width, over real or escaped
line breaks, are decoded as a whole too. Random-looking text that decodes to
nothing is left alone. The base patterns are reported as they are.

Spans count code points, the end exclusive. Kinds in the order of listing:
assign, access, hex, then the confirmed ones: jwt, der, ssh, pem.

Defined cases: NULL texts count as empty and have no spans; texts are scanned
whole, in time that grows with their length; matches of one kind never overlap, and rows are independent, so repeats
and ties need no rule; an empty table gives an empty result; further columns
are not read (``redacted`` keeps them).
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import map_batches

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
BASE = KINDS[:3]
#: Fixed values of the query.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
MASK = "[SECRET]"

_ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of at least this many is the whole run, so shorter ones need not be matched and dropped.
_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
#: A signed token is three parts with dots between them; the last may be empty.
_PART = re.compile(r"[A-Za-z0-9_-]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{44,}={0,2}")
_BREAK = r"[ \t]*(?:\r\n?|\n|(?:\\+r)?\\+n)[ \t]*"
_LINE_BREAK = re.compile(_BREAK)
#: Lines of base64; the first is of LEAST_WIDTH at least.
LEAST_WIDTH = 40
_LINES = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_WIDTH},}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,]|-(?!----)|\\+[nr])*)-----END \1-----"
)
_KEY_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")
_SSH_FILE = b"openssh-key-v1\x00"
#: No key structure has as many items on one level; reading stops there, however long the data are.
MOST_ITEMS = 64


def decoded64(text: str) -> bytes | None:
    """``text`` as base64 in either alphabet, padded as needed; None if it isn't."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes | memoryview, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the DER item at ``at``, if its length fits."""
    if at + 2 > len(data):
        return None
    tag, first = data[at], data[at + 1]
    start, size = at + 2, first
    if first & 0x80:
        width = first & 0x7F
        if not 1 <= width <= 4 or start + width > len(data):
            return None
        size = int.from_bytes(data[start : start + width], "big")
        if size < 0x80 or width > 1 and not data[start]:
            return None  # DER uses the shortest form
        start += width
    return (tag, start, start + size) if start + size <= len(data) else None


def is_der_key(data: bytes | memoryview | None) -> bool:
    """A SEQUENCE that fills ``data``, whose items nest exactly, with a key's first items."""
    if not data or data[0] != 0x30:
        return False
    outer = der_item(data)
    if not outer or outer[2] != len(data) or outer[2] - outer[1] < 16:
        return False
    items, at = [], outer[1]
    while at < outer[2]:
        item = der_item(data, at)
        if not item or item[2] > outer[2] or len(items) == MOST_ITEMS:
            return False
        items.append(item)
        at = item[2]
    tags = [x[0] for x in items]
    if tags[:2] == [0x02, 0x02] and len(items) >= 6:  # RSA or DSA private key: version and integers
        return set(tags) == {0x02}
    if tags[:2] == [0x02, 0x04]:  # EC private key
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS 8: version, algorithm, key
        return _names_algorithm(data, items[1])
    if tags == [0x30, 0x04]:  # encrypted PKCS 8
        return _names_algorithm(data, items[0])
    return False


def _names_algorithm(data: bytes | memoryview, item: tuple[int, int, int]) -> bool:
    inner = der_item(data, item[1])
    return bool(inner and inner[0] == 0x06 and inner[2] <= item[2])


def is_ssh_key(data: bytes | memoryview | None) -> bool:
    """Length-prefixed fields that fill ``data``, the first a key type; or an OpenSSH private key file."""
    if not data:
        return False
    if bytes(data[: len(_SSH_FILE)]) == _SSH_FILE:
        return _fields(data, len(_SSH_FILE), 3) is not None
    if not bytes(data[4:20]).startswith(_KEY_TYPES):
        return False
    return (_fields(data, 0, None) or 0) >= 2


def _fields(data: bytes | memoryview, at: int, count: int | None) -> int | None:
    """The number of fields from ``at`` on, ``count`` of them or as many as fill ``data``; None if they don't fit."""
    found = 0
    while at < len(data) if count is None else found < count:
        if at + 4 > len(data) or found == MOST_ITEMS:
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return None
        found += 1
    return found


def is_signed_token(text: str) -> bool:
    """header.payload.signature with a JSON header that names an algorithm and a JSON payload."""
    header, payload, signature = text.split(".")
    try:
        head, body = (json.loads(decoded64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or not isinstance(body, dict):
        return False
    return head["alg"].lower() == "none" or len(decoded64(signature) or b"") >= 16


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """Signed tokens. Each part is read a bounded number of times."""
    found, at = [], 0
    while (at := text.find("eyJ", at)) >= 0:
        header = _PART.match(text, at + 3).end()
        payload = _PART.match(text, header + 1).end() if text.startswith(".", header) else header
        if header == at + 3 or payload <= header + 1 or not text.startswith(".", payload):
            at = header  # no other start in this part goes on differently
            continue
        end = _PART.match(text, payload + 1).end()
        if is_signed_token(text[at:end]):
            found.append(("jwt", at, end))
        at = end
    return found


def wrapped_spans(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64 that goes over several lines of one width and a last one that isn't wider."""
    found = []
    for m in _LINES.finditer(text):
        start = m.start() + (text[max(m.start() - 1, 0) : m.start() + 1] == "\\n")  # the n of an escaped break
        breaks = [b.span() for b in _LINE_BREAK.finditer(text, start, m.end())]
        lines = list(zip([start, *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()]))
        at = end = 0
        while at < len(lines) - 1:
            if at >= end:
                block = _Block(text, lines, at)
                end = block.end
            kind, last = block.key(at)
            if kind:
                found.append((kind, lines[at][0], lines[last - 1][1]))
            at = last
    return found


class _Block:
    """Lines of one width from ``first`` to ``end``, and the next line if a key may end in it.

    The characters are decoded once for each remainder that a line's place leaves
    modulo 4, so a line that looks like a key's first costs no more than its own length.
    """

    def __init__(self, text: str, lines: list[tuple[int, int]], first: int):
        self.text, self.lines, self.first = text, lines, first
        a, b = lines[first]
        self.width = b - a
        self.end = first + 1
        while self.end < len(lines) and lines[self.end][1] - lines[self.end][0] == self.width:
            self.end += 1
        self.last_width = 0  # of the line after the block, without padding
        if self.end < len(lines):
            x, y = lines[self.end]
            if y - x <= self.width + 2 * text.endswith("=", x, y):
                self.last_width = len(text[x:y].rstrip("="))
        self.chars: str | None = None
        self.decoded: dict[int, memoryview] = {}

    def data(self, at: int, size: int) -> memoryview | None:
        """The bytes of ``size`` characters from line ``at`` on."""
        if size % 4 == 1:
            return None
        offset = (at - self.first) * self.width
        phase = offset % 4
        if phase not in self.decoded:
            if self.chars is None:
                cut = self.lines[self.first : self.end + bool(self.last_width)]
                self.chars = "".join(self.text[x:y] for x, y in cut).rstrip("=")
            part = self.chars[phase:]
            self.decoded[phase] = memoryview(decoded64(part[: len(part) - (len(part) % 4 == 1)]) or b"")
        begin = (offset - phase) // 4 * 3
        return self.decoded[phase][begin : begin + size * 3 // 4]

    def key(self, at: int) -> tuple[str | None, int]:
        """The kind of the key that begins with line ``at``, if one does, and the line to go on with."""
        a, b = self.lines[at]
        head = decoded64(self.text[a : a + LEAST_WIDTH]) if self.width >= LEAST_WIDTH else None
        if not head or head[0] != 0x30 and not head.startswith(_SSH_FILE) and not head[4:].startswith(_KEY_TYPES):
            return None, at + 1
        chars, end = None, self.end
        if head[0] == 0x30:  # its length tells where it ends
            width = head[1] & 0x7F if head[1] & 0x80 else 0
            size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
            chars = -(-size * 4 // 3)
            end = min(end, at + max(1, -(-chars // self.width)))
        for last in (end + 1, end):
            inside = last <= self.end
            if at + 1 >= last or not inside and not self.last_width:
                continue
            x, y = self.lines[last - 1]
            if self.text.startswith("-----", x):
                continue
            if not inside:
                size = (end - at) * self.width + self.last_width
            else:
                size = (last - 1 - at) * self.width + len(self.text[x:y].rstrip("="))
            if chars is not None and size != chars:
                continue
            data = self.data(at, size)
            if is_der_key(data):
                return "der", last
            if is_ssh_key(data):
                return "ssh", last
        return None, at + 1


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "eyJ" in text:
        found += token_spans(text)
    for m in _BASE64.finditer(text):
        data = decoded64(m[0])
        if is_der_key(data):
            found.append(("der", *m.span()))
        elif is_ssh_key(data):
            found.append(("ssh", *m.span()))
    if "\n" in text or "\r" in text or "\\n" in text:
        found += wrapped_spans(text)
    for m in _ANY_HEX.finditer(text):
        data = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else None
        if is_der_key(data):
            found.append(("der", *m.span()))
        elif is_ssh_key(data):
            found.append(("ssh", *m.span()))
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            body = "".join(x for x in re.split(r"(?:\s|\\+[nr])+", m[2]) if x and ":" not in x and "," not in x)
            data = decoded64(body)
            if is_der_key(data) or is_ssh_key(data):
                found.append(("pem", *m.span()))
    return found


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in in_order(spans))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): kind, start, end and base of each span in each row's text, in order."""

    def make():
        def work(batch: pa.RecordBatch):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = in_order(base_spans(text) + confirmed_spans(text))
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            return {"doc_id": batch.column(0), "spans": rows}

        return work

    kind = docs.select(id_col).dtypes[0][1]
    return map_batches(
        docs.select(id_col, text_col), make, f"doc_id {kind}, spans array<struct<kind:string,start:int,`end`:int>>"
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans, one row per document."""

    def text_of(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(number(kind) for kind in BASE),
        F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )


def mask(text: str | None) -> str | None:
    """``text`` with each secret, and what overlaps it, replaced by ``MASK``."""
    spans = sorted((a, b) for _, a, b in base_spans(text or "") + confirmed_spans(text or ""))
    if not spans:
        return text
    parts, at = [], 0
    for start, end in spans:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked; the column of text lengths, if there is one, follows the texts that changed."""

    def make():
        def work(batch: pa.RecordBatch):
            columns = dict(zip(batch.schema.names, batch.columns))
            old = columns[text_col].to_pylist()
            new = [mask(x) for x in old]
            columns[text_col] = pa.array(new, pa.string())
            if size_col in columns:
                sizes = columns[size_col].to_pylist()
                columns[size_col] = [n if a == b else len(b) for n, a, b in zip(sizes, old, new)]
            return columns

        return work

    return map_batches(docs, make, docs.schema)
