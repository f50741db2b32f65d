"""Operator 7: secrets in texts, with structural confirmation.

Plain patterns find assignments, access key ids and long hex strings. Candidates for keys and
tokens (runs of base64 or hex, armoured blocks, three dotted parts) are decoded and reported only
if their structure holds: DER with nested lengths that fill each other exactly and the fields of a
private key, also an encrypted one, the length-prefixed fields of an OpenSSH key, a signed token's JSON header with an
algorithm and its JSON payload. Lines of a key may be parted by line ends, by escapes such as a
written-out backslash n, and by the quotes and signs that join strings in source code; without
armour the key's own lengths say where it ends. An armoured block with the headers of an encrypted
key is confirmed by these and by whole cipher blocks.

A pass over the bytes finds the texts that have any long run or dotted parts at all, so that most
texts never meet an expression. Offsets are code points, ends exclusive. Spans are sorted by start, then by kind in
the order of ``KINDS``.

Limits of what counts as a key: ``MOST_PARTS`` direct parts, ``MOST_ITEMS`` items nested in them on ``DEEPEST`` levels,
``MOST_KEYS`` keys in one OpenSSH file. A text is worked on in time that grows with its length: lines that belong together are joined once, and a
line that only looks like the start of a key costs a few header reads.

Defined results: a null or empty text has no spans; repeated rows are scanned each; an empty table
gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

# The patterns and lengths that the base kinds are defined by.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = ("assign", "access", "hex", "signed_token", "key", "armoured_key")
BASE_KINDS = KINDS[:3]
#: Characters of the shortest run that base kinds but assignments, and keys without armour, need.
SHORTEST_RUN = 20
#: Characters of the shortest encoded key.
SHORTEST_KEY = 40
#: Direct parts of a private key (nine numbers and a list of further primes), items and levels nested in them, keys in
#: one OpenSSH file.
MOST_PARTS, MOST_ITEMS, DEEPEST, MOST_KEYS = 10, 256, 16, 64

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST_KEY)
_HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: Between the lines of a key: line ends, written out or not, and the ends of joined strings.
_GAP = r"(?:\s|\\+(?:[nrt]|u000[aAdD9]|(?=[\r\n\"']))|[\"'][ \t]*(?:[+.,;&\\][ \t]*)?(?=\s|\\|[\"'])|(?:(?<=\s)[+.&][ \t]*)?[\"'](?=[A-Za-z0-9+/=-]))"
_HEADER = r"[A-Za-z][A-Za-z0-9-]*+:(?:[^\r\n\\\"'-]|-(?!----))*+"
_ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----(?:%s)*+((?:%s(?:%s)++)*+)((?:%s|[A-Za-z0-9+=]|\\*/)*+)"
                     r"-----END \1PRIVATE KEY-----" % (_GAP, _HEADER, _GAP, _GAP))
_GAPS = re.compile(_GAP + "|\\\\+(?=/)|[\"']$")
_DEK = re.compile(r"^DEK-Info: *[A-Z0-9-]+-CBC, *([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s*$", re.M)
#: The first line of a key wrapped over lines: base64 of a sequence's tag, or of the magic of OpenSSH.
_FIRST_LINE = re.compile(r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nrt]))(?:M[A-P]|b3BlbnNz)(?=[A-Za-z0-9+/_-]{%d})" % (SHORTEST_RUN - 8))
_LINE = re.compile(r"(?:[A-Za-z0-9+_-]|\\*/)+")
_BETWEEN = re.compile(f"(?:{_GAP})+")
_PADDING = re.compile("={0,2}")
#: Characters of the shortest header of a signed token.
_DOTTED = 10
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_SPANS = ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long"))

_INTEGER, _OCTETS, _OBJECT, _SEQUENCE = 0x02, 0x04, 0x06, 0x30

#: Bytes ``start`` to ``end`` of what is looked at, fewer where it ends.
Read = Callable[[int, int], bytes]
#: An item: its tag, and where its content starts and ends.
Item = tuple[int, int, int]


def der_header(read: Read, at: int, end: int) -> Item | None:
    """The item at a place, if it ends by ``end``."""
    head = read(at, min(at + 6, end))
    n = head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0
    if len(head) < 2 + n or n > 4 or head[1] == 0x80:
        return None
    start = at + 2 + n
    stop = start + (int.from_bytes(head[2 : 2 + n]) if n else head[1])
    return (head[0], start, stop) if stop <= end else None


def der_parts(read: Read, item: Item, most: int) -> list[Item] | None:
    """The items that fill another exactly, by their headers only; None if they don't or are more than ``most``."""
    parts, (_, at, end) = [], item
    while at < end:
        part = der_header(read, at, end)
        if part is None or len(parts) == most:
            return None
        parts.append(part)
        at = part[2]
    return parts


def der_holds(read: Read, items: list[Item]) -> bool:
    """Whether all that is nested in items fills its place exactly."""
    n, depth = 0, 0
    while items:
        below = []
        for item in items:
            if item[0] & 0x20:
                parts = der_parts(read, item, MOST_ITEMS - n)
                if parts is None or depth == DEEPEST:
                    return False
                n += len(parts)
                below += parts
        items, depth = below, depth + 1
    return True


def is_der_key(read: Read, size: int) -> bool:
    """A private key: a version with numbers (RSA), with an algorithm and octets, or with octets (EC)."""
    outer = der_header(read, 0, size)
    if not outer or outer[0] != _SEQUENCE or outer[2] != size:
        return False
    items = der_parts(read, outer, MOST_PARTS)
    if not items:
        return False
    tags, algorithm = [tag for tag, *_ in items], None
    if tags == [_SEQUENCE, _OCTETS]:  # encrypted: an algorithm with parameters, then whole octets
        if items[1][2] - items[1][1] < 16:
            return False
        algorithm = [_OBJECT, _SEQUENCE]
    elif tags[0] != _INTEGER or items[0][2] - items[0][1] != 1 or read(*items[0][1:])[0] > 1:
        return False
    elif tags[1:3] == [_SEQUENCE, _OCTETS]:
        algorithm = [_OBJECT]
    elif not (len(tags) >= 6 and set(tags) == {_INTEGER} or tags[1:2] == [_OCTETS] and items[1][2] - items[1][1] >= 16):
        return False
    if algorithm:
        own = der_parts(read, items[tags.index(_SEQUENCE)], MOST_PARTS)
        if not own or [tag for tag, *_ in own][: None if len(algorithm) == 2 else 1] != algorithm:
            return False
    return der_holds(read, items)


def openssh_size(read: Read) -> int | None:
    """Bytes of the key at the start of what ``read(start, end)`` gives.

    The magic, cipher, derivation and its options, the number of keys, that many public parts and a private one.
    """
    magic = b"openssh-key-v1\0"
    if read(0, len(magic)) != magic:
        return None
    at, fields, keys = len(magic), 0, None
    while keys is None or fields < 3 + keys + 1:
        head = read(at, at + 4)
        if len(head) < 4:
            return None
        number, at = int.from_bytes(head), at + 4
        if fields == 3 and keys is None:
            if not 1 <= number <= MOST_KEYS:
                return None
            keys = number
        else:
            at, fields = at + number, fields + 1
    return at


def key_size(read: Read, size: int | None) -> int | None:
    """Bytes of the key at the start, ``size`` of them if known; None if there is none."""
    own = openssh_size(read)
    if own is None:
        outer = der_header(read, 0, size or 1 << 33)
        own = outer[2] if outer and is_der_key(read, outer[2]) else None
    return own if size in (None, own) else None


def is_key(data: bytes) -> bool:
    return key_size(lambda start, end: data[start:end], len(data)) == len(data)


def _decoded(run: str) -> Iterator[bytes]:
    """What a run stands for as hex and as either base64 alphabet."""
    body = run.rstrip("=")
    if len(body) % 2 == 0 and _HEX_RUN.fullmatch(body):
        yield bytes.fromhex(body)
    if len(body) % 4 != 1:
        try:
            yield base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
        except binascii.Error:
            return


def is_armoured_key(headers: str, body: str) -> bool:
    run = _GAPS.sub("", body)
    if any(map(is_key, _decoded(run))):
        return True
    lines = re.sub(r"\\+[nr]|\\+u000[aAdD]|[\"']", "\n", headers)
    iv = _DEK.search(lines)
    if not iv or not re.search(r"^Proc-Type: *4, *ENCRYPTED\s*$", lines, re.M) or len(run) % 4:
        return False
    try:
        data = base64.b64decode(run, validate=True)
    except binascii.Error:
        return False
    return len(data) >= 16 and len(data) % (len(iv[1]) // 2) == 0


class _Run:
    """Lines of base64 in a text that only gaps part: one string, with the places where each line starts and ends."""

    def __init__(self, text: str, start: int):
        parts, self.starts, self.ends, self.until = [], [], [], [0]
        line = _LINE.match(text, start)
        while line:
            parts.append(line[0].replace("\\", ""))
            self.starts.append(line.start())
            self.ends.append(line.end())
            self.until.append(self.until[-1] + len(parts[-1]))
            gap = _BETWEEN.match(text, line.end())
            line = gap and _LINE.match(text, gap.end())
        self.chars = "".join(parts).replace("-", "+").replace("_", "/")

    def read(self, line: int, start: int, end: int) -> bytes:
        """Bytes ``start`` to ``end`` of what is encoded from a line on, fewer where the run ends."""
        first = self.until[line] + start // 3 * 4
        chars = self.chars[first : self.until[line] + (end + 2) // 3 * 4]
        chars = chars[: len(chars) - (len(chars) % 4 == 1)]
        return base64.b64decode(chars + "=" * (-len(chars) % 4))[start % 3 : start % 3 + end - start]


def wrapped_keys(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of keys in base64 over lines, from the first line to where the key's lengths end.

    Lines that belong together are joined once. Each line that looks like a key's first one is tried by its place in
    the joined run: only the headers of its items are decoded, and a line must end where the key does.
    """
    done, run = 0, None
    for first in _FIRST_LINE.finditer(text):
        start = first.start()
        if start < done:
            continue
        if run is None or start > run.starts[-1]:
            run = _Run(text, start)
        line = bisect_left(run.starts, start)
        read = partial(run.read, line)
        size = key_size(read, None)
        if size is None:
            continue
        need = run.until[line] + (size * 4 + 2) // 3
        last = bisect_left(run.until, need)
        if last < len(run.until) and run.until[last] == need:
            done = run.ends[last - 1] + len(_PADDING.match(text, run.ends[last - 1])[0])
            yield start, done


def apart_from(spans: Iterable[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that overlap none of ``taken``."""
    taken = sorted(taken)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))
    for a, b in spans:
        n = bisect_left(starts, b)
        if n == 0 or reach[n - 1] <= a:
            yield a, b


def _json_object(part: str) -> dict | None:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(payload) is None:
        return False
    return bool(signature) or head["alg"].lower() == "none"


def spans_of(text: str, has_run: bool = True) -> list[tuple[str, int, int]]:
    """All spans of a text; ``has_run``: whether it may have a long run or dotted parts (``texts_with_runs``)."""
    found = []
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    armoured = []
    if "PRIVATE KEY-----" in text:
        armoured = [m.span() for m in _ARMOUR.finditer(text) if is_armoured_key(m[2], m[3])]
        found += [("armoured_key", *span) for span in armoured]
    if has_run:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        found += [("signed_token", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())]
        keys = [m.span() for m in _RUN.finditer(text) if any(map(is_key, _decoded(m[0])))]
        taken = armoured + keys
        keys += apart_from(wrapped_keys(text), taken)
        found += [("key", *span) for span in keys]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def texts_with_runs(texts: pa.Array) -> np.ndarray:
    """Whether each text may have a run of at least ``SHORTEST_RUN`` characters of base64, or the dotted parts of a token."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out = np.zeros(len(texts), bool)
    if bounds[-1] == bounds[0]:
        return out
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    inside = _IN_RUN[data]
    outside = np.flatnonzero(~inside)
    ends = np.append(outside, len(inside))
    starts = np.concatenate(([0], outside + 1))
    long = ends - starts >= SHORTEST_RUN
    dot = np.append(data[outside] == ord("."), False)
    long[:-1] |= (ends - starts >= _DOTTED)[:-1] & dot[:-1] & dot[1:]  # the next run ends at a dot as well
    first = np.searchsorted(bounds - bounds[0], starts[long], side="right") - 1
    last = np.searchsorted(bounds - bounds[0], ends[long] - 1, side="right") - 1
    change = np.zeros(len(texts) + 1, np.int64)  # a run may go on over several short texts
    np.add.at(change, first, 1)
    np.add.at(change, last + 1, -1)
    return np.cumsum(change[:-1]) > 0


def find_secrets(docs: DataFrame, *, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and ``spans``: array<struct<kind, start, end>>. One scan, no shuffle."""
    schema = docs.select(*(docs[k] for k in keys)).schema.add("spans", _SPANS)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(len(keys))
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t or "", r)]
                     for t, r in zip(texts.to_pylist(), texts_with_runs(texts).tolist())]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(spans, kind)], names=schema.names)

    return docs.select(*(docs[k] for k in keys), docs[text].alias("__text")).mapInArrow(run, schema)
