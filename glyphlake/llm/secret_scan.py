"""Secret scans with structural confirmation.

Base patterns are reported as they match. Beyond them, base64 and hex candidates are decoded and reported only if what
they decode to has the structure of a secret: a private key in DER (nested lengths have to add up), an OpenSSH private
key (length-prefixed fields), a signed token whose header and payload are JSON objects. A run of characters that isn't
a secret as a whole is looked through for the beginnings of keys and tokens, whose own lengths say where they end."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import freeing, id_and_text, sliced

#: Fixed patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "pem", "key", "jwt")

LONG_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{32,}+")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
BASE64_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
#: How base64 of DER sequences and of OpenSSH keys, hex of DER sequences and base64 of JSON objects begin.
KEY_START, HEX_START, TOKEN_START = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA"), re.compile(r"30[0-9A-Fa-f]{2}"), re.compile(r"e[wy]")
#: Lines of base64 without armour, of any width and number; and what parts them.
LINE_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/]++)++={0,2}")
LINE_END = re.compile(r"\r?\n[ \t]*")
DEK_INFO = re.compile(r"DEK-Info:\s*([A-Z0-9-]+),((?:[0-9A-F]{16}){1,2})\b")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----((?:(?!-----)[^\x00])*+)-----END \1PRIVATE KEY-----")
OPENSSH = b"openssh-key-v1\0"

Span = tuple[str, int, int]


def from_base64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER elements that fill data exactly; None if the lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + count], "big")
            at += count
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8: one sequence, its nested lengths followed to the fields of a key."""
    top = der_fields(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    fields = der_fields(top[0][1])
    if not fields:
        return False
    tags = [t for t, _ in fields]
    if tags[0] == 0x30 and tags[1:] == [0x04]:  # encrypted: algorithm, octets
        inner = der_fields(fields[0][1])
        return bool(inner) and inner[0][0] == 0x06 and len(fields[1][1]) >= 32 and len(fields[1][1]) % 8 == 0
    if tags[0] != 0x02 or fields[0][1] not in (b"\0", b"\1"):
        return False
    if len(tags) in (6, 9) and set(tags) == {0x02}:  # DSA, RSA
        return max(len(x) for _, x in fields) >= 32
    if tags[1:2] == [0x04]:  # elliptic curve
        return fields[0][1] == b"\1" and 16 <= len(fields[1][1]) <= 66 and set(tags[2:]) <= {0xA0, 0xA1}
    if tags[1:3] == [0x30, 0x04]:  # PKCS#8
        inner = der_fields(fields[1][1])
        return bool(inner) and inner[0][0] == 0x06 and len(fields[2][1]) >= 16
    return False


def is_openssh_key(data: bytes) -> bool:
    """The magic, then cipher, derivation, options, a count of keys, public and private parts, each with its length."""
    if not data.startswith(OPENSSH):
        return False
    at, parts = len(OPENSSH), 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if parts == 3:  # the count of keys stands alone
            if not 1 <= size <= 16:
                return False
        elif at + size > len(data):
            return False
        else:
            at += size
        parts += 1
    return parts >= 6 and at == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def is_encrypted_pem(head: str, body: bytes | None) -> bool:
    """The older form: a header that names a cipher and its start vector, and whole blocks of that vector's size (or of 8
    bytes, at least 48)."""
    m = DEK_INFO.search(head)
    return bool(m) and "ENCRYPTED" in head and body is not None and len(body) >= 48 and len(body) % (len(m[2]) // 2) == 0


def der_length(data: bytes) -> int | None:
    """How many bytes a DER sequence takes that begins here, from its first six; None if nothing says so."""
    if len(data) < 6 or data[0] != 0x30:
        return None
    count = data[1] & 0x7F
    if data[1] < 0x80:
        return 2 + data[1]
    return 2 + count + int.from_bytes(data[2 : 2 + count], "big") if 1 <= count <= 4 and data[2] else None


def adds_up(read: Callable[[int, int], bytes], size: int) -> bool:
    """Whether the lengths of a sequence's fields, read where they stand, come to its own, as a key's do: from a version or an
    algorithm on, and of few fields."""
    first = read(1, 1)[0]
    at, fields = 2 if first < 0x80 else 2 + (first & 0x7F), 0
    while at < size and fields < 10:
        head = read(at, 6)
        if len(head) < 2 or not fields and not (head[0] == 0x02 and head[1] == 1 or head[0] == 0x30):
            return False
        count = head[1] & 0x7F
        if head[1] >= 0x80 and not (1 <= count <= 4 and len(head) >= 2 + count):
            return False
        at += 2 + (head[1] if head[1] < 0x80 else count + int.from_bytes(head[2 : 2 + count], "big"))
        fields += 1
    return at == size


def openssh_length(read: Callable[[int, int], bytes]) -> int | None:
    """The same for an OpenSSH key, each part's length read where it stands."""
    at = len(OPENSSH)
    for part in range(6):
        size = read(at, 4)
        if len(size) < 4:
            return None
        at += 4 + (0 if part == 3 else int.from_bytes(size, "big"))
    return at


def key_ranges(text: str, start: int, end: int, hexed: bool) -> Iterator[tuple[int, int]]:
    """Places of keys in a run that is none as a whole: from any beginning as far as the key's own lengths say. A beginning
    is looked at in a few characters; all of it is decoded only where its length fits into the run and those of its fields
    add up to it."""
    m = (HEX_START if hexed else KEY_START).search(text, start, end)
    while m is not None:
        at, stop, size = m.start(), m.start() + 1, None
        read = lambda a, n, at=at: bytes.fromhex(text[at + 2 * a : min(at + 2 * (a + n), end - (end - at) % 2)]) if hexed else _decoded(text, at, end, a, n)
        if hexed or m[0].startswith("M"):
            size = der_length(read(0, 6))
            fits = size is not None and at + (2 * size if hexed else -(-4 * size // 3)) <= end and adds_up(read, size)
        else:
            size = openssh_length(read)
            fits = size is not None and at - (-4 * size // 3) <= end
        if fits:
            high = at + (2 * size if hexed else -(-4 * size // 3))
            if is_key(bytes.fromhex(text[at:high]) if hexed else from_base64(text[at:high])):
                stop = high
                while not hexed and stop < min(len(text), at + 4 * -(-size // 3)) and text[stop] == "=":
                    stop += 1
                yield at, stop
        m = m.re.search(text, stop, end)


def _decoded(text: str, start: int, end: int, at: int, n: int) -> bytes:
    """Bytes at:at + n of base64 that begins at start, decoded by themselves."""
    a, b = start + at // 3 * 4, min(end, start + -(-(at + n) // 3) * 4)
    return from_base64_start(text[a : b - (b - a) % 4])[at % 3 : at % 3 + n]


def wrapped_ranges(text: str) -> Iterator[tuple[int, int]]:
    """Places of keys over several lines: the lines of a run are joined, keys are looked for in what that gives, and their
    ends are counted back. The last line may be of the text behind."""
    for m in LINE_RUN.finditer(text) if "\n" in text else ():
        joined, kept, at = [], [], m.start()
        for gap in [*LINE_END.finditer(text, m.start(), m.end()), None]:
            line = text[at : gap.start() if gap else m.end()].rstrip("=")
            kept.append((sum(map(len, joined[-1:])) + (kept[-1][0] if kept else 0), at))
            joined.append(line)
            at = gap.end() if gap else at
        whole = "".join(joined)
        starts = [k for k, _ in kept]
        place = lambda k: (lambda i: kept[i][1] + k - kept[i][0])(bisect_right(starts, k) - 1)  # noqa: B023, E731
        for a, b in key_ranges(whole, 0, len(whole), False):
            low, high = place(a), place(b - 1) + 1
            if "\n" in text[low:high]:
                while high < len(text) and text[high] == "=" and (len("".join(text[low:high].split())) % 4):
                    high += 1
                yield low, high


def from_base64_start(text: str) -> bytes:
    return from_base64(text) or b""


def is_signed_token(text: str) -> bool:
    """Header and payload decode to JSON objects and the header names an algorithm; a payload's bytes may be opaque
    only for encrypted tokens, which this doesn't report."""
    head, payload, signature = text.split(".")
    try:
        header = json.loads(from_base64(head) or b"")
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        body = json.loads(from_base64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(body, dict) and (from_base64(signature) is not None if signature else header["alg"].lower() == "none")


def token_ranges(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Places of signed tokens in a dotted run: each three segments in order, the first from its beginning or, if that
    fails, from a later place where a JSON object begins that its end closes."""
    segments, at = [], start
    for part in text[start:end].split("."):
        segments.append((at, at + len(part)))
        at += len(part) + 1
    k = 0
    while k + 2 < len(segments):
        (low, high), (_, stop) = segments[k], segments[k + 2]
        found = None
        if high - low >= 10 and segments[k + 1][1] - segments[k + 1][0] >= 2 and is_json_object(text[segments[k + 1][0] : segments[k + 1][1]]):
            found = next((s for s in header_starts(text, low, high) if is_signed_token(text[s:stop])), None)
        if found is None:
            k += 1
        else:
            yield found, stop
            k += 3


def is_json_object(segment: str) -> bool:
    try:
        return isinstance(json.loads(from_base64(segment) or b""), dict)
    except (ValueError, RecursionError):
        return False


def header_starts(text: str, low: int, high: int) -> Iterator[int]:
    """Where a token's header may begin in a segment, first to last. It ends with the segment, so its length tells how its
    characters fall into groups of four, and for each of four ways the whole segment is decoded once: a header begins
    where braces opened from there on are closed at the end, and no earlier."""
    found = [low] if text[low] == "e" else []
    for turn in range(4):
        first = low + turn
        if (high - first) % 4 == 1 or high - first < 10:
            continue
        data = from_base64(text[first:high])
        if data:
            found += [s for at in object_starts(data) if at % 3 == 0 and (s := first + at // 3 * 4) > low and high - s >= 10 and text[s] == "e"]
    yield from sorted(set(found))


def object_starts(data: bytes) -> list[int]:
    """Places of braces whose objects close with the last byte that isn't white space: each has its own depth, counted from
    the end over what isn't in a string, so there are as many as objects lie in each other there."""
    end = len(data.rstrip())
    if not end or data[end - 1 : end] != b"}":
        return []
    depth, quoted, at, out = 0, False, end - 1, []
    while at >= 0:
        c = data[at]
        if c == 34:
            k = at
            while k and data[k - 1] == 92:
                k -= 1
            if (at - k) % 2 == 0:
                quoted = not quoted
            at = k if k < at else at
        elif not quoted and c == 125:
            depth += 1
        elif not quoted and c == 123:
            depth -= 1
            if depth == 0:
                out.append(at)
                break
        at -= 1
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind; too short ones are dropped after matching."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if LONG_RUN.search(text):
        out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[Span]:
    """What the structure of decoded candidates confirms: PEM blocks, base64 or hex keys on one line or several, signed
    tokens."""
    out: list[Span] = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            lines = [x for x in m[2].replace("\\n", "\n").split("\n") if ":" not in x]
            body = from_base64("".join("".join(lines).split()))
            if is_key(body) or is_encrypted_pem(m[2], body):
                out.append(("pem", *m.span()))
    inside = Taken(out)
    out += [("key", *x) for x in wrapped_ranges(text) if not inside(*x)]
    if not LONG_RUN.search(text):
        return out
    inside = Taken(out)
    for m in BASE64_KEY.finditer(text):
        found = [m.span()] if is_key(from_base64(m[0])) else key_ranges(text, *m.span(), False)
        out += [("key", *x) for x in found if not inside(*x)]
    for m in HEX_KEY.finditer(text):
        even = (m.end() - m.start()) % 2 == 0
        out += [("key", *x) for x in ([m.span()] if even and is_key(bytes.fromhex(m[0])) else key_ranges(text, *m.span(), True))]
    if "." in text:
        out += [("jwt", *x) for m in DOTTED.finditer(text) for x in token_ranges(text, *m.span())]
    return out


class Taken:
    """Whether a stretch touches any of the spans, by their order: spans of one kind don't overlap, so the last that begins
    before the stretch's end tells, with the furthest end up to it."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((s, e) for _, s, e in spans)
        self.starts, self.ends = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))

    def __call__(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def find_spans(text: str) -> list[Span]:
    """All spans by start, then kind as in KINDS."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; spans are in code points, their end exclusive, ordered by start, then kind.

    Null and empty texts have no spans; null ids, ties and repeated rows keep their rows; empty tables give an empty
    result; other columns are ignored. A text is scanned whole, in time linear in its length."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(freeing(found), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, spans {SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame, base: tuple[str, ...], others: tuple[str, ...] = (), id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as one string."""
    spans = F.col("spans")
    of = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(id_col, *counts, F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), joined(spans).alias("spans"))
