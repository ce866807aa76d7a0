"""Secret scan: patterns find candidates, their decoded structure confirms them.

Plain kinds (password-like assignments, access key ids, long hex) are matches of
fixed patterns.  For the structural kinds, candidates are runs of base64 or hex
digits, also wrapped over lines or with escaped line ends, found by alphabet alone;
a key may begin anywhere in a run.  It is reported only if its bytes parse: DER whose
nested lengths fit and whose content is laid out as a private key (RSA, DSA, EC, the
wrapped general form and its encrypted one), OpenSSH key containers and wire-format
keys whose length fields add up, and dotted tokens whose first part decodes to a
JSON header that names an algorithm.  A span ends where the declared length ends.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

#: ASCII: no letter outside A-Z counts as another case of one inside
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: a header begins with a brace or with JSON's white space: "e", "I", "C" or "D" in base64
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[eICD][A-Za-z0-9_-]{7,}={0,2}\.[A-Za-z0-9_-]*={0,2}\.[A-Za-z0-9_-]*")
#: what may stand between the lines of a wrapped key: line ends, also as the two characters of an escape
_BREAK = r"(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*)"
PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
PEM_LINE_END = re.compile(r"\r?\n|\\r\\n|\\n|\\r")
PEM_HEADER = re.compile(r"[A-Za-z-]+: ")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]*")
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]{{4,}})*={{0,2}}")
#: where a key may begin: 0x30 with a length, or the magic word of OpenSSH
BASE64_KEY = re.compile(r"M[A-P][A-Za-z0-9+/_-]{2}|b3BlbnNzaC1rZXkt")
HEX_RUN = re.compile(rf"[0-9A-Fa-f]{{16,}}(?:{_BREAK}[0-9A-Fa-f]{{4,}})*")
HEX_KEY = re.compile(r"30(?:8[1-3]|[2-7][0-9A-Fa-f])|6[Ff]70656[Ee]7373682[Dd]")
#: bytes of a key at least and at most (an RSA key of 16384 bits has 9.3 kB)
KEY_BYTES = (32, 1 << 16)
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem_key", "der_key", "ssh_key", "signed_token")


#: object identifiers of password-based encryption begin so (fixed values)
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at ``at``, if its length fits below ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or at + width > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + width]), at + width
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill the range exactly."""
    out = []
    while at < end:
        got = _element(data, at, end)
        if got is None:
            return None
        out.append(got)
        at = got[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A DER private key: RSA (nine integers), DSA (six), EC (version 1 and an octet string), the wrapped general form or its encrypted one."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags == [0x30, 0x04]:  # the algorithm is one of password-based encryption
        algorithm = _children(data, parts[0][1], parts[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(PASSWORD_BASED)
    if parts[0][0] != 0x02 or len(parts) < 3:
        return False
    version = int.from_bytes(data[parts[0][1] : parts[0][2]])
    if tags[:9] == [0x02] * 9 and version in (0, 1):
        return True
    if tags == [0x02] * 6 and version == 0:
        return True
    if tags[1] == 0x04 and version == 1 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return all(_children(data, p[1], p[2]) is not None for p in parts[2:])
    if tags[1] == 0x30 and tags[2] == 0x04 and version in (0, 1):
        algorithm = _children(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def _fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill the data exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4])
        at += 4 + n
        if at > len(data):
            return None
        out.append(data[at - n : at])
    return out


MAGIC = b"openssh-key-v1\x00"


def ssh_spans(read: Callable[[int, int], bytes]) -> list[tuple[int, int]]:
    """Ranges of an OpenSSH private-key container's fields, from its length fields alone; none if they can't be.

    The fields are cipher, key derivation, its options, the public keys and the
    private part.  ``read(a, b)`` gives the bytes of a range (fewer at the data's
    end); nothing but magic word and lengths is read.
    """
    at, spans, wanted = len(MAGIC), [], 3
    if read(0, at) != MAGIC:
        return []
    while len(spans) < wanted:
        head = read(at, at + 4)
        end = at + 4 + int.from_bytes(head)
        if len(head) < 4 or end > KEY_BYTES[1]:
            return []
        spans.append((at + 4, end))
        at = end
        if len(spans) == 3:
            keys = int.from_bytes(read(at, at + 4))
            if not 1 <= keys <= 64:
                return []
            at, wanted = at + 4, 3 + keys + 1
    return spans


def ssh_key_length(data: bytes) -> int:
    """Bytes of the OpenSSH private-key container that ``data`` begins with; 0 if its nested lengths don't fit."""
    spans = ssh_spans(lambda a, b: data[a:b])
    if not spans or spans[-1][1] > len(data) or spans[-1][0] == spans[-1][1]:
        return 0
    for a, b in spans[3:-1]:
        inner = _fields(data[a:b])
        if not inner or inner[0][:4] not in (b"ssh-", b"ecds", b"sk-s", b"sk-e"):
            return 0
    return spans[-1][1]


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private-key container whose nested lengths add up."""
    return bool(data) and ssh_key_length(data) == len(data)


def der_length(data: bytes) -> int:
    """Bytes that the DER element at the start of ``data`` declares, its header included; 0 if there is none."""
    if len(data) < 2 or data[0] != 0x30:
        return 0
    n = data[1]
    if n < 0x80:
        return 2 + n
    width = n & 0x7F
    return 2 + width + int.from_bytes(data[2 : 2 + width]) if 1 <= width <= 3 and len(data) >= 2 + width else 0


def _decoded(text: str) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """The first of the dotted parts is a JSON header that names an algorithm."""
    raw = _decoded(text.split(".")[0])
    if raw is None:
        return False
    try:
        header = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _keys_in(run: str, starts: re.Pattern, digits: str, per: tuple[int, int], decode) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys in a run; ``per``: so many digits make so many bytes."""
    places = [i for i, c in enumerate(run) if c in digits]
    plain = "".join(run[i] for i in places)
    many, few = per
    at = 0
    while m := starts.search(plain, at):
        at = m.start() + 1
        head = decode(plain[m.start() : m.start() + 16])
        if head is None or len(head) < 6:
            continue
        kind, n = ("der_key", der_length(head)) if head[:1] == b"0" else ("ssh_key", 0)
        if kind == "der_key" and (not KEY_BYTES[0] <= n <= KEY_BYTES[1] or head[2 + (head[1] & 0x7F) * (head[1] >= 0x80)] not in (0x02, 0x30)):
            continue
        if kind == "ssh_key":

            def read(a: int, b: int, first: int = m.start()) -> bytes:
                a0 = a - a % few  # where a group of digits begins
                raw = decode(plain[first + a0 // few * many : first + -(-b // few) * many]) or b""
                return raw[a - a0 : b - a0]

            spans = ssh_spans(read)
            n = spans[-1][1] if spans else 0
        size = -(-n * many // few)
        data = decode(plain[m.start() : m.start() + size]) if n and m.start() + size <= len(plain) else None
        if data is not None and (is_ssh_key(data[:n]) if kind == "ssh_key" else is_der_key(data[:n])):
            end = m.start() + size
            last = places[end - 1] + 1
            while last < len(run) and run[last] == "=":
                last += 1
            yield kind, places[m.start()], last
            at = end


_B64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
_HEX = frozenset("0123456789abcdefABCDEF")


def _from_base64(text: str) -> bytes | None:
    return _decoded(text[: len(text) - (len(text) % 4 == 1)])


def _from_hex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) & ~1])


def _unescaped(run: str) -> str:
    """Escaped line ends as blanks, so that their letters are no digits; places stay."""
    return run.replace("\\r", "  ").replace("\\n", "  ") if "\\" in run else run


def pem_blocks(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, label, base64 digits, header lines) of each BEGIN marker that the next marker closes.

    Every stretch of text belongs to one pair of markers at most, and is split into lines once.
    """
    open_ = None
    for mark in PEM_MARK.finditer(text):
        if mark[1] == "BEGIN":
            open_ = mark
            continue
        if open_ is not None and open_[2] == mark[2]:
            lines = [line.strip() for line in PEM_LINE_END.split(text[open_.end() : mark.start()])]
            heads = [bool(PEM_HEADER.match(line)) for line in lines]
            body = "".join(line for line, head in zip(lines, heads) if not head)
            if body and PEM_BODY.fullmatch(body):
                yield open_.start(), mark.end(), mark[2], "".join(body.split()), "\n".join(line for line, head in zip(lines, heads) if head)
        open_ = None


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in a text, by start and then by kind; places count code points."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += [("signed_token", m.start(), m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    taken = []
    if "PRIVATE KEY-----" in text:
        for start, end, label, body, headers in pem_blocks(text):
            data = _decoded(body)
            if data is None:
                continue
            whole = (top := _element(data, 0, len(data))) is not None and top[2] == len(data)
            locked = "DEK-Info:" in headers and "ENCRYPTED" in headers and len(data) >= 16 and len(data) % 8 == 0
            if is_der_key(data) or is_ssh_key(data) or locked or label.startswith("ENCRYPTED ") and whole:
                found.append(("pem_key", start, end))
                taken.append((start, end))
    for pattern, starts, digits, per, decode in ((BASE64, BASE64_KEY, _B64, (4, 3), _from_base64), (HEX_RUN, HEX_KEY, _HEX, (2, 1), _from_hex)):
        for m in pattern.finditer(text) if starts.search(text) else ():
            if len(m[0]) >= 40 and starts.search(m[0]) or "\n" in m[0] or "\\" in m[0]:
                for kind, a, b in _keys_in(_unescaped(m[0]), starts, digits, per, decode):
                    if not any(x <= m.start() + a < y for x, y in taken):
                        found.append((kind, m.start() + a, m.start() + b))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every whole text: doc_id, spans (kind, start, end), in order.

    Null texts are empty; null doc_ids stay; repeated rows are scanned each; an
    empty table gives none; other columns are ignored.  One pass, no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textvec.keep_freed_memory()
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t)] if t else [] for t in map(lambda x: x.as_py(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str:
    """The text with each span (overlapping ones as one) replaced."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_secrets``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
