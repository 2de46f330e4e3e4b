r"""Secret scan with structural confirmation.

Lexical kinds (kept as found): assignments, access-key ids and long hex runs. Confirmed kinds are added only when
the decoded bytes are a private key or a signed token: DER whose nested lengths fill the value exactly and whose fields
are those of a private key (PKCS#1, PKCS#8 plain or encrypted, SEC1, DSA), OpenSSH private blobs read field by field,
PEM blocks of these (or of the older encrypted form, by its cipher and block length), and tokens whose header is JSON that
names an algorithm. A key may be wrapped: base64 on one line or on lines of one length (line breaks also as the two characters \n), hex in either
case with separators between bytes, PEM with escaped line breaks, and any of these inside another, DEPTH times. Each wrapping is
decoded and the same parsers run on what comes out; the span is that of the outermost form in the text. Encrypted tokens (five parts)
and tokens whose payload is not JSON are not confirmed. Certificates and public keys are no secrets: DER ones are not reported, and a length-prefixed
public SSH key is reported as not confirmed, which redaction and the query's spans leave out.

Spans are code points, end exclusive, sorted by start and then by the order of KINDS. Null or empty texts have no
spans; repeated rows repeat their result; an empty table gives an empty result; other columns are never read, whatever
their names. A text of any length is scanned whole in time linear in its length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("pem", "der", "ssh", "jwt", "hexkey", "nested")
KINDS = BASE_KINDS + ADDED_KINDS
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The same matches as [0-9a-f]+ with at least 32 characters.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: How a line of wrapped base64 or hex goes on; hex of 32 bytes or more in either case, and with one separator between all bytes.
_BREAK = r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*"
_NEXT_64 = re.compile(_BREAK + r"([A-Za-z0-9+/_-]+={0,2})")
_NEXT_HEX = re.compile(_BREAK + r"([0-9A-Fa-f]+)")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}")
_PAIRS = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{2}}([:\x20-])[0-9A-Fa-f]{{2}}(?:(?:\1(?:{_BREAK})?|{_BREAK})[0-9A-Fa-f]{{2}}(?![0-9A-Fa-f])){{30,}}+")
#: How many wrappings around a key are taken off.
DEPTH = 4
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM_HEAD = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")

OUTPUT = "doc_id long, secrets array<struct<kind:string,start:int,end:int,confirmed:boolean>>"


def decode64(s: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padding optional; None where it isn't valid."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: Universal tags of DER values that are not constructed.
_PLAIN_TAGS = frozenset((0, 1, 2, 3, 4, 5, 6, 9, 10, 12, 19, 20, 22, 23, 24))
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
EXPLICIT = frozenset(range(0xA0, 0xC0))


def der_fields(b: bytes) -> list[tuple[int, bytes, list]] | None:
    """The one DER value of b as [(tag, content, fields)], or None where a length, nested to any depth, doesn't fit."""
    top: list = []
    todo = [(0, len(b), top)]
    while todo:
        at, end, out = todo.pop()
        while at < end:
            if end - at < 2:
                return None
            tag, n, at = b[at], b[at + 1], at + 2
            if n >= 0x80:
                k = n & 0x7F
                if not 1 <= k <= 4 or at + k > end:
                    return None
                n, at = int.from_bytes(b[at : at + k], "big"), at + k
                if n < 0x80:
                    return None
            if at + n > end or not tag & 0x20 and not tag & 0xC0 and tag & 0x1F not in _PLAIN_TAGS:
                return None
            fields: list = []
            out.append((tag, b[at : at + n] if not tag & 0x20 else b"", fields))
            if tag & 0x20:
                todo.append((at, at + n, fields))
            at += n
    return top if len(top) == 1 else None


def der_fits(b: bytes) -> bool:
    """Whether b is one DER value whose length, and all nested lengths, fill it exactly."""
    return bool(b) and der_fields(b) is not None


def der_key(b: bytes) -> bool:
    """A DER private key of at least 32 bytes."""
    value = der_fields(b) if len(b) >= 32 and b[0] == SEQUENCE else None
    if not value:
        return False
    fields = value[0][2]
    tags = [t for t, *_ in fields]
    version = fields[0][1] if tags[:1] == [INTEGER] else None
    named = lambda f: f[0] == SEQUENCE and [t for t, *_ in f[2]][:1] == [OID]
    optional = set(tags[3:]) <= EXPLICIT | {0x81}
    if version in (b"\0", b"\1") and len(fields) >= 3 and named(fields[1]) and tags[2] == OCTETS and optional:
        return True  # PKCS#8
    if version in (b"\0", b"\1") and len(tags) >= 9 and set(tags[:9]) == {INTEGER} and set(tags[9:]) <= {SEQUENCE}:
        return True  # PKCS#1
    if version == b"\0" and tags == [INTEGER] * 6:
        return True  # DSA
    if version == b"\1" and tags[1:2] == [OCTETS] and set(tags[2:]) <= EXPLICIT:
        return True  # SEC1
    return tags == [SEQUENCE, OCTETS] and named(fields[0]) and len(fields[1][1]) >= 16  # PKCS#8, encrypted


def _prefixed(b: bytes, at: int) -> tuple[bytes, int] | None:
    """The length-prefixed field at `at` and its end."""
    n = int.from_bytes(b[at : at + 4], "big")
    return (b[at + 4 : at + 4 + n], at + 4 + n) if at + 4 <= len(b) and at + 4 + n <= len(b) else None


def ssh_private(b: bytes) -> bool:
    """An OpenSSH private blob: cipher, key derivation, its options, the number of keys, public keys, private part."""
    if not b.startswith(b"openssh-key-v1\0"):
        return False
    at, head = 15, []
    for _ in range(3):
        field = _prefixed(b, at)
        if field is None:
            return False
        head.append(field[0])
        at = field[1]
    n, at = int.from_bytes(b[at : at + 4], "big"), at + 4
    if not 1 <= n <= len(b) // 4:
        return False
    for k in range(n + 1):
        field = _prefixed(b, at)
        if field is None or k < n and not ssh_public(field[0]):
            return False
        body, at = field
    plain = head[0] == b"none"
    # the private part is whole cipher blocks and, unencrypted, begins with the same check number twice
    return at == len(b) and len(body) >= 16 and len(body) % 8 == 0 and plain == (head[1] == b"none") and (not plain or body[:4] == body[4:8])


def ssh_public(b: bytes) -> bool:
    """Length-prefixed fields that fill the value and begin with a key type."""
    at, fields = 0, 0
    while at < len(b):
        field = _prefixed(b, at)
        if field is None or fields == 0 and not re.match(rb"(ssh|ecdsa|sk)-", field[0]):
            return False
        at, fields = field[1], fields + 1
    return fields >= 2


def pem_key(kind: str, block: str) -> bool:
    """Whether the lines between the marks of a PEM block hold the private key that `kind` announces."""
    lines = block.split()
    head = " ".join(x for x in block.splitlines() if ":" in x)
    cipher = re.search(r"DEK-Info:\s*([A-Za-z0-9-]+),([0-9A-Fa-f]+)", head)
    named = {w for line in block.splitlines() if ":" in line for w in line.split()}
    raw = decode64("".join(x for x in lines if x not in named))
    if not raw:
        return False
    if "ENCRYPTED" in head and cipher:
        return len(cipher[2]) in (16, 32) and len(raw) >= 32 and len(raw) % (len(cipher[2]) // 2) == 0
    if kind.startswith("ENCRYPTED"):
        return der_key(raw) and raw[der_start(raw)] == SEQUENCE
    return der_key(raw) or ssh_private(raw)


def der_start(b: bytes) -> int:
    """Where the content of the DER value begins."""
    return 2 + (b[1] & 0x7F if b[1] & 0x80 else 0)


def signed_header(token: str) -> bool:
    head, body, _ = token.split(".", 2)
    for part, need in ((head, "alg"), (body, None)):
        raw = decode64(part)
        try:
            value = json.loads(raw.decode("utf-8")) if raw is not None else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or need and not isinstance(value.get(need), str):
            return False
    return True


def _held(raw: bytes | None, depth: int) -> str | None:
    """The kind of private key that bytes are, or hold in text: "nested"."""
    if not raw:
        return None
    if der_key(raw):
        return "der"
    if ssh_private(raw):
        return "ssh"
    # text is ASCII here: every wrapping is
    return "nested" if depth and len(raw) >= 40 and raw.isascii() and any(yes for *_, yes in wrapped_keys(raw.decode("ascii"), depth - 1)) else None


def _lines(text: str, start: int, end: int, following: re.Pattern) -> list[int]:
    """Ends of the lines that go on from the run [start, end): lines of its length, and a shorter last one."""
    ends, length = [end], end - start
    while text[ends[-1] - 1] != "=" and (m := following.match(text, ends[-1])) and m.end(1) - m.start(1) <= length:
        ends.append(m.end())
        if m.end(1) - m.start(1) < length:
            break
    return ends


def _spans(text: str, first: re.Pattern, following: re.Pattern) -> Iterator[tuple[int, list[int]]]:
    """(start, ends to try) of the runs of a form and their lines, disjoint: one line alone, all lines, all but a shorter last
    one, which may be a word that follows."""
    done = 0
    for m in first.finditer(text):
        if m.start() >= done:
            ends = _lines(text, *m.span(), following)
            done = ends[-1]
            yield m.start(), list(dict.fromkeys((ends[0], ends[-1], ends[-2] if len(ends) > 1 else ends[-1])))


def _unbroken(run: str) -> str:
    return re.sub(r"\\r|\\n|\s", "", run)


def _whole_der(b: bytes) -> bytes:
    """Bytes up to where the DER value that they begin with says it ends."""
    if len(b) < 4 or b[0] != SEQUENCE or b[1] & 0x7F > 4 and b[1] & 0x80:
        return b
    at = der_start(b)
    return b[: at + (int.from_bytes(b[2:at], "big") if b[1] & 0x80 else b[1])]


def wrapped_keys(text: str, depth: int = DEPTH) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, confirmed) of keys and tokens in a text, plain or wrapped; public SSH keys are not confirmed.

    Each form's candidates are disjoint and a decoding is shorter than what it decodes, so the time is linear in the text.
    """
    out = []
    heads = list(_PEM_HEAD.finditer(text))
    for k, m in enumerate(heads):
        tail = f"-----END {m.group(1)}-----"
        end = text.find(tail, m.end(), heads[k + 1].start() if k + 1 < len(heads) else len(text))
        if end >= 0 and pem_key(m.group(1), text[m.end() : end].replace("\\r", "").replace("\\n", "\n")):
            out.append(("pem", m.start(), end + len(tail), True))
    out += [("jwt", *m.span(), True) for m in _TOKEN.finditer(text) if signed_header(m.group())]
    for start, ends in _spans(text, _ANY_HEX, _NEXT_HEX):
        for end in ends:
            digits = _unbroken(text[start:end])
            kind = _held(bytes.fromhex(digits), depth) if len(digits) % 2 == 0 else None
            if kind:
                out.append(("nested" if kind == "nested" else "hexkey", start, end, True))
                break
    for m in _PAIRS.finditer(text):
        raw = bytes.fromhex(re.sub(r"\\r|\\n|[^0-9A-Fa-f]", "", m.group()))
        key = _whole_der(raw)  # a word of two hex letters may follow
        kind = _held(key, depth)
        if kind:
            pairs = re.compile(r"[0-9A-Fa-f]{2}(?![0-9A-Fa-f])").finditer(text, m.start(), m.end())
            end = next(x.end() for i, x in enumerate(pairs, 1) if i == len(key))
            out.append(("nested" if kind == "nested" else "hexkey", m.start(), end, True))
    for start, ends in _spans(text, _BASE64, _NEXT_64):
        for end in ends:
            raw = decode64(_unbroken(text[start:end]))
            kind = _held(raw, depth)
            if kind:
                out.append((kind, start, end, True))
                break
            if raw and end == ends[0] and ssh_public(raw):
                out.append(("ssh", start, end, False))
                break
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, confirmed) of a text."""
    if not text:
        return []
    out = [("assign", *m.span(), False) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", *m.span(), False) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    keys = wrapped_keys(text)
    sure = {(a, b) for kind, a, b, yes in keys if yes and kind in ("hexkey", "nested")}
    out += [("hex", *m.span(), m.span() in sure) for m in _HEX.finditer(text)]
    out += keys
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans).encode()).hexdigest()


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confirmed", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[dict(zip(("kind", "start", "end", "confirmed"), s, strict=True)) for s in find_secrets(t.as_py())] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _TYPE)], names=["doc_id", "secrets"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, secrets): one row per input row, with every span and whether its structure was confirmed."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, OUTPUT)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with each lexical or confirmed span of the text replaced by `mark`; overlaps merge."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema

    def clean(text: str | None) -> str | None:
        spans = [s for s in find_secrets(text) if s[0] in BASE_KINDS or s[3]]
        if not spans:
            return text
        out, end = [], 0
        for _, a, b, _ in spans:
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([clean(t.as_py()) for t in c], pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(rows, schema)
