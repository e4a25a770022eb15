"""Personal data with source offsets: base patterns, and the same patterns over a deobfuscated text mapped back.

Base kinds, leftmost and non-overlapping per kind: email, ip (parts up to 255), card (16 to 19 digits, Luhn) and
phone (8 to 15 digits). Failing matches are dropped without a retry.

The method adds spans. A first transducer rewrites characters (look-alike letters, full-width, circled and other
scripts' digits, invisible characters), a second one phrases (bracketed or spelled ``at`` and ``dot``, runs of spelled
digits). Both keep, for every character written, the source span it stands for. Identifiers found in the rewritten
text are mapped back through these spans; those that lie in a base span of their kind are left out. A wider one stays beside
the base span, which is then a fragment of it.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows repeat as given. Work and memory
are linear in a text's length, whatever it holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a run of digits that fails from its first digit fails from all, so only first digits are tried
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = m.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind and start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


# Look-alike letters of other scripts, by the Latin letter they stand for (fixed values).
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ѵ": "v", "ԛ": "q", "ԝ": "w", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "ρ": "p", "α": "a", "ι": "i", "κ": "k", "τ": "t",
}
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_ODD = re.compile("[­Ͱ-ԯ٠-۹०-൯​-₟①-⓿❶-➓　-〿﹐-￯"
                  "\U0001d400-\U0001d7ff]")
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
               "eight": "8", "nine": "9"}
_W = "(?:" + "|".join(DIGIT_WORDS) + ")"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT_MARK = rf"\s{{0,3}}{_OPEN}\s{{0,3}}(?:at|@)\s{{0,3}}{_SHUT}\s{{0,3}}"
_DOT_MARK = rf"\s{{0,3}}{_OPEN}\s{{0,3}}(?:dot|punkt|punto|point|\.)\s{{0,3}}{_SHUT}\s{{0,3}}"
_DOT_WORD = r"\s{1,3}dot\s{1,3}"
_HOST = r"[a-z0-9-]{1,63}"
_ENDS = r"(?:com|org|net|edu|gov|info|biz|io|co|eu|uk|de|fr|es)(?![a-z0-9])"
_PHRASE = re.compile(
    rf"(?P<at>{_AT_MARK}|(?<=[a-z0-9])\s{{1,3}}at\s{{1,3}}(?={_HOST}(?:{_DOT_MARK}|(?:{_DOT_WORD}{_HOST}){{0,3}}{_DOT_WORD}{_ENDS})))"
    rf"|(?P<dot>{_DOT_MARK}|(?<=[a-z0-9])\s{{1,3}}dot\s{{1,3}}(?=[a-z0-9]))"
    rf"|(?P<spelled>(?<![a-z0-9])(?:plus[\s-]{{1,3}})?{_W}(?:(?:[\s,-]{{1,3}}dot)?[\s,-]{{1,3}}{_W}){{3,}}(?![a-z]))", re.I)
_MARK = re.compile(rf"{_OPEN}\s{{0,3}}(?:at|dot|punkt|punto|point|@|\.)\s{{0,3}}{_SHUT}")
_DOT = re.compile(r"dot(?<=\sdot)\s")
_TWO = re.compile(rf"{_W}[\s,-]{{1,3}}{_W}")
_TOKEN = re.compile(rf"plus|dot|{_W}", re.I)


@lru_cache(maxsize=65536)
def plain_char(c: str) -> str:
    """What a character stands for: one ASCII character, nothing if it is invisible, else itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if _HIDDEN.match(c):
        return ""
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() else c


def disguised(text: str) -> bool:
    """Whether a phrase of the second transducer can be in the text; a cheap test that misses none."""
    low = text.lower()
    return (any(c in low for c in "[({<") and _MARK.search(low) is not None) or _DOT.search(low) is not None or _TWO.search(low) is not None


def deobfuscated(text: str) -> tuple[str, list[int], list[int]] | None:
    """The rewritten text with the source start and end of each of its characters; None if nothing changes."""
    odd = not text.isascii() and _ODD.search(text) is not None
    if not odd and not disguised(text):
        return None
    if odd:
        chars, starts, ends = [], [], []
        for i, c in enumerate(text):
            p = c if c.isascii() else plain_char(c)
            if p:
                chars.append(p)
                starts.append(i)
                ends.append(i + 1)
        text1 = "".join(chars)
    else:
        text1, starts, ends = text, range(len(text)), range(1, len(text) + 1)
    out, s, e, at = [], [], [], 0
    for m in _PHRASE.finditer(text1):
        a, b = m.span()
        out.append(text1[at:a])
        s.extend(starts[at:a])
        e.extend(ends[at:a])
        if m.lastgroup == "spelled":
            for t in _TOKEN.finditer(text1, a, b):
                word = t.group().lower()
                out.append("+" if word == "plus" else "." if word == "dot" else DIGIT_WORDS[word])
                s.append(starts[t.start()])
                e.append(ends[t.end() - 1])
        else:
            out.append("@" if m.lastgroup == "at" else ".")
            s.append(starts[a])
            e.append(ends[b - 1])
        at = b
    if not odd and not out:
        return None
    out.append(text1[at:])
    s.extend(starts[at:])
    e.extend(ends[at:])
    return "".join(out), s, e


def all_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """Base and added spans, by kind as listed, then start."""
    base = base_spans(text)
    out = [(k, a, b, True) for k, a, b in base]
    plain = deobfuscated(text)
    if plain:
        new, starts, ends = plain
        own = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
        for k, a, b in base_spans(new):
            x, y = starts[a], ends[b - 1]
            if not _covered(own[k], x, y):
                out.append((k, x, y, False))
    out.sort(key=lambda t: (KINDS.index(t[0]), t[1], t[2]))
    return out


def _covered(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the sorted, disjoint spans holds a to b."""
    from bisect import bisect_right

    i = bisect_right(spans, a, key=lambda s: s[0])
    return i > 0 and spans[i - 1][1] >= b


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b, "base": o} for k, a, b, o in all_spans(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], ["doc_id", "spans"])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every text; ``base`` tells base spans from added ones."""
    return rows_of(docs, id_col, text_col).mapInArrow(_find, f"doc_id long, spans {SPANS}")


def redacted(text: str | None) -> str | None:
    """The text with each span, overlapping ones as one, replaced by the kind in brackets."""
    spans = sorted((a, b, k) for k, a, b, _ in all_spans(text or ""))
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, k = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at:a], f"[{k.upper()}]"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, personal data in ``text_col`` replaced by its kind in brackets."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            clean = pa.array([redacted(t.as_py()) for t in column], column.type)
            yield pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the hash of the base spans and all spans as text."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", name), ",").alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
