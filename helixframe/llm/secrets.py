"""Secrets with source offsets: base patterns, and the same patterns in every layer that a worklist of decoders unwraps.

Base kinds, leftmost and non-overlapping per kind: assign (a key word, a sign and a value of 12 or more characters), access (18 or more)
and hex (16 or more). Failing matches are dropped without a retry.

The method adds spans. The worklist starts with the text. Of each layer, escapes of URLs (``%41``, with its own per cent signs escaped any number of times) and
of Unicode (``\\u0041``, ``\\u{41}``, ``\\x41``, ``&#65;``, ``&#x41;``, with escaped backslashes and ampersands) are replaced, each in a layer of the whole; runs of base64
(of either alphabet, over line ends, from any of the four alignments) become layers of their printable stretches, and compressed
data inside them (gzip, zlib, bzip2, xz) becomes layers of its own. New layers are decoded again until nothing is left to decode. A layer
that an ancestor of the same place already had is a cycle and is left. Every layer's characters keep the source span they stand for, so a match is
mapped back; one that lies in a base span of its kind is left out, wider ones stay beside it.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows repeat as given. Escapes shorten a layer and base64 its
region, so work is about linear in a text's length times the depth of its nesting. Compressed data of over ``UNPACKED`` bytes is read up to there: the guard against
archives made to fill memory.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

KINDS = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,depth:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("depth", pa.int32())]))
UNPACKED = 1 << 24

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: No pattern matches fewer characters than this, so no shorter stretch is a layer.
LEAST = 16

_URL = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_UNICODE = re.compile(r"\\+(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))|&(?:amp;)*#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}(?:\r?\n[A-Za-z0-9+/_-]{4,})*")
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % LEAST)
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY|\xfd7zXZ\x00")
_FOLD = str.maketrans("-_", "+/", "\r\n")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind and start."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


class Layer:
    """A decoded text, the source span of each of its characters, and the contents of its ancestors."""

    __slots__ = ("text", "starts", "ends", "depth", "above")

    def __init__(self, text, starts, ends, depth, above):
        self.text, self.starts, self.ends, self.depth = text, starts, ends, depth
        self.above = above

    def key(self) -> bytes:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def child(self, text: str, starts, ends) -> Layer:
        return Layer(text, starts, ends, self.depth + 1, self.above | {self.key()})


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match replaced by the characters that ``decode`` gives for it; None if nothing changes.

    Neighbouring matches are decoded together, as they may spell one character.
    """
    text, out, starts, ends, at = layer.text, [], [], [], 0
    run: list[re.Match] = []

    def flush():
        nonlocal at
        chars = decode(run)
        if chars is not None:
            a = run[0].start()
            out.append(text[at:a])
            starts.append(layer.starts[at:a])
            ends.append(layer.ends[at:a])
            for c, x, y in chars:
                out.append(c)
                starts.append(layer.starts[x:x + 1])
                ends.append(layer.ends[y - 1:y])
            at = run[-1].end()
        run.clear()

    for m in pattern.finditer(text):
        if run and run[-1].end() != m.start():
            flush()
        run.append(m)
    if run:
        flush()
    if not at:
        return None
    out.append(text[at:])
    starts.append(layer.starts[at:])
    ends.append(layer.ends[at:])
    return layer.child("".join(out), np.concatenate(starts), np.concatenate(ends))


def _url(run: list[re.Match]):
    """UTF-8 characters of a run of escaped bytes; bytes that are none stand for themselves."""
    raw = bytes(int(m.group(1), 16) for m in run)
    at = 0
    out = []
    while at < len(raw):
        size = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            c = raw[at:at + size].decode()
        except UnicodeDecodeError:
            size, c = 1, chr(raw[at])
        out.append((c, run[at].start(), run[at + size - 1].end()))
        at += size
    return out


def _unicode(run: list[re.Match]):
    out = []
    for m in run:
        code = int(m.group(5)) if m.group(5) else int(next(g for g in m.groups() if g), 16)
        if code > 0x10FFFF:
            out += [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m.group())]
        elif 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, a, _ = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), a, m.end()))
        else:
            out.append((chr(code), m.start(), m.end()))
    return out


def _unpacked(data: bytes) -> Iterator[bytes]:
    """Everything that decompressing gives, decompressed again until nothing new comes out."""
    todo, seen = [data], set()
    while todo:
        for out in _unpack(todo.pop()):
            key = hashlib.blake2b(out, digest_size=16).digest()
            if key not in seen:
                seen.add(key)
                todo.append(out)
                yield out


def _unpack(data: bytes) -> Iterator[bytes]:
    """Compressed data that starts in ``data`` (zlib's short mark only at its start), decompressed as far as it goes."""
    tries = [(m.start(), m.group()) for m in _PACKED.finditer(data)]
    if len(data) > 6 and data[0] & 0x0F == 8 and data[0] >> 4 <= 7 and int.from_bytes(data[:2]) % 31 == 0:
        tries.append((0, b"zlib"))
    for at, mark in tries:
        try:
            if mark == b"zlib" or mark[:1] == b"\x1f":
                out = zlib.decompressobj(47).decompress(data[at:], UNPACKED)
            elif mark[:1] == b"B":
                out = bz2.BZ2Decompressor().decompress(data[at:], UNPACKED)
            else:
                out = lzma.LZMADecompressor().decompress(data[at:], UNPACKED)
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
            continue
        if out:
            yield out


def _printable(data: bytes) -> Iterator[tuple[str, int]]:
    for m in _STRETCH.finditer(data):
        yield m.group().decode("ascii"), m.start()


def _base64(layer: Layer) -> Iterator[Layer]:
    """Layers of the printable and the compressed stretches of every run of base64, from each alignment."""
    for m in _B64.finditer(layer.text):
        run = m.group()
        place = np.arange(m.start(), m.end())
        if "\n" in run:
            place = place[[c not in "\r\n" for c in run]]
        letters = run.translate(_FOLD)
        for shift in range(4):
            whole = letters[shift:]
            # the last group may be short; a single letter over holds no byte
            whole = whole[:len(whole) - (len(whole) % 4 == 1)]
            if len(whole) < 22:
                continue
            data = binascii.a2b_base64(whole + "=" * (-len(whole) % 4))
            for text, at in _printable(data):
                # byte k comes from letters 8k / 6 to (8k + 7) / 6
                k = np.arange(at, at + len(text))
                yield layer.child(text, layer.starts[place[shift + 8 * k // 6]], layer.ends[place[shift + (8 * k + 7) // 6]])
            for inner in _unpacked(data):
                a, b = layer.starts[place[shift]], layer.ends[place[shift + len(whole) - 1]]
                for text, _ in _printable(inner):
                    yield layer.child(text, np.full(len(text), a), np.full(len(text), b))


def layers(text: str) -> Iterator[Layer]:
    """All layers below the text, each once per place."""
    todo = [Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1), 0, frozenset())]
    seen = set()
    while todo:
        layer = todo.pop()
        if layer.depth:
            key = layer.key()
            mark = (key, int(layer.starts[0]), int(layer.ends[-1]))
            if key in layer.above or mark in seen:
                continue
            seen.add(mark)
            yield layer
        if "%" in layer.text:
            new = _replaced(layer, _URL, _url)
            todo += [new] if new else []
        if "\\" in layer.text or "&" in layer.text:
            new = _replaced(layer, _UNICODE, _unicode)
            todo += [new] if new else []
        todo.extend(_base64(layer))


def encoded(text: str) -> bool:
    """Whether any decoder can find something in the text."""
    return ("%" in text and _URL.search(text) is not None) or (("\\" in text or "&" in text) and _UNICODE.search(text) is not None) or _B64.search(text) is not None


def all_spans(text: str) -> list[tuple[str, int, int, bool, int]]:
    """Base and added spans with the depth at which they were first found, by start, then kind as listed, then end."""
    base = base_spans(text)
    out = [(k, a, b, True, 0) for k, a, b in base]
    if encoded(text):
        own = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
        added: dict[tuple[str, int, int], int] = {}
        for layer in layers(text):
            for k, a, b in base_spans(layer.text):
                span = (k, int(layer.starts[a:b].min()), int(layer.ends[a:b].max()))
                if not _covered(own[k], *span[1:]):
                    added[span] = min(layer.depth, added.get(span, layer.depth))
        out += [(*span, False, depth) for span, depth in added.items()]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def _covered(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the sorted, disjoint spans holds a to b."""
    i = bisect_right(spans, a, key=lambda s: s[0])
    return i > 0 and spans[i - 1][1] >= b


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b, "base": o, "depth": d} for k, a, b, o, d in all_spans(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every text; ``base`` tells base spans from added ones, ``depth`` the layers above a match."""
    return rows_of(docs, id_col, text_col).mapInArrow(_find, f"doc_id long, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the hash of the base spans and all spans as text."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", name), ",").alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
