"""XHTML as paragraphs: a quote-aware scanner that keeps where each piece of text stands in the file.

Offsets are code points throughout; file text is decoded before and encoded after.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import BLOCK_TAGS, ENTITIES, FORMAT_TAGS, SKIPPED_TAGS

#: An entity's `;` stands at most this many bytes behind its `&`.
ENTITY_BYTES = 10

_ENTITY = re.compile(r"&([^;]*?);")
_SPECIAL = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<!", ">"))
_NAME = re.compile(r"[A-Za-z0-9:]*")
_BLOCK, _SKIP, _FORMAT = frozenset(BLOCK_TAGS), frozenset(SKIPPED_TAGS), frozenset(FORMAT_TAGS)


class Fragment(NamedTuple):
    """[p_start, p_end) of the paragraph is [f_start, f_end) of the file; `at` maps offsets where entities shrink text."""

    p_start: int
    p_end: int
    f_start: int
    f_end: int
    at: tuple[int, ...] | None

    def file_offset(self, p: int) -> int:
        return self.f_start + (self.at[p - self.p_start] if self.at else p - self.p_start)


class Paragraph(NamedTuple):
    text: str
    fragments: list[Fragment]


def _entity(name: str) -> str | None:
    if name in ENTITIES:
        return ENTITIES[name]
    if not name.startswith("#"):
        return None
    try:
        number = int(name[2:], 16) if name[1:2] in ("x", "X") else int(name[1:])
        valid = "_" not in name and 0 <= number <= 0x10FFFF and not 0xD800 <= number <= 0xDFFF
        return chr(number) if valid else None
    except ValueError:
        return None


def decode_entities(s: str) -> tuple[str, tuple[int, ...] | None]:
    """The text with known entities decoded once, and each character's offset in `s` (None where nothing changed)."""
    if "&" not in s:
        return s, None
    out, at, i = [], [], 0
    while i < len(s):
        c, step = s[i], 1
        if c == "&" and (end := s.find(";", i, i + ENTITY_BYTES)) >= 0 and len(s[i:end].encode()) <= ENTITY_BYTES and (known := _entity(s[i + 1 : end])) is not None:
            c, step = known, end + 1 - i
        out.append(c)
        at.append(i)
        i += step
    return "".join(out), (*at, len(s))


def encode_entities(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def encode_entities_col(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_named_col(c: Column) -> Column:
    """The six named entities, JVM-side; `&amp;` last, so that nothing is decoded twice. Numeric ones stay."""
    for name in ("lt", "gt", "quot", "apos", "nbsp", "amp"):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    return c


def _tag_end(s: str, at: int) -> int:
    """Behind the tag that begins at `at`; a `>` in quotes does not end it."""
    quote = ""
    for i in range(at + 1, len(s)):
        c = s[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i + 1
    return len(s)


def tag_name(tag: str) -> tuple[str, bool]:
    """A tag's name in lower case without its prefix, and whether it closes."""
    body = tag.lstrip("<").rstrip(">")
    closes = body.startswith("/")
    return _NAME.match(body[closes:]).group().rsplit(":", 1)[-1].lower(), closes


def scan(file: str) -> list[Paragraph]:
    """Paragraphs in order: text between block tags, joined over other tags; blank ones are dropped.

    Comments, CDATA, processing instructions and doctypes hold no text, and neither do script, style, code and pre.
    """
    found: list[Paragraph] = []
    text, fragments, length, depth, i = [], [], 0, 0, 0

    def close() -> None:
        nonlocal text, fragments, length
        if "".join(text).strip():
            found.append(Paragraph("".join(text), fragments))
        text, fragments, length = [], [], 0

    while i < len(file):
        if file[i] != "<":
            end = file.find("<", i)
            end = len(file) if end < 0 else end
            if not depth:
                plain, at = decode_entities(file[i:end])
                fragments.append(Fragment(length, length + len(plain), i, end, at))
                text.append(plain)
                length += len(plain)
            i = end
            continue
        special = next((stop for start, stop in _SPECIAL if file.startswith(start, i)), None)
        if special:
            end = file.find(special, i)
            i = len(file) if end < 0 else end + len(special)
            continue
        end = _tag_end(file, i)
        name, closes = tag_name(file[i:end])
        if name in _SKIP and not file.endswith("/>", 0, end):
            depth = max(0, depth - 1) if closes else depth + 1
        if name in _BLOCK:
            close()
        i = end
    close()
    return found


def only_formatting(between: str) -> bool:
    """Whether a stretch of the file holds only white space and formatting tags."""
    i = 0
    while i < len(between):
        if between[i] in " \t\n\r\f":
            i += 1
        elif between[i] == "<":
            end = _tag_end(between, i)
            if tag_name(between[i:end])[0] not in _FORMAT:
                return False
            i = end
        else:
            return False
    return True


def file_ranges(file: str, p: Paragraph, start: int, end: int) -> list[tuple[int, int]] | None:
    """File ranges of [start, end) of a paragraph: one per fragment that it touches; None over other than formatting."""
    inside = next((f for f in p.fragments if start >= f.p_start and end <= f.p_end), None)
    if inside:
        return [(inside.file_offset(start), inside.file_offset(end))]
    touched = [f for f in p.fragments if f.p_start < end and f.p_end > start]
    if len(touched) < 2 or not all(only_formatting(file[a.f_end : b.f_start]) for a, b in zip(touched, touched[1:], strict=False)):
        return None
    return [(f.file_offset(max(start, f.p_start)), f.file_offset(min(end, f.p_end))) for f in touched]


def patch(file: str, changes: list[tuple[Paragraph, str]]) -> tuple[str, int]:
    """The file with each paragraph's new text spliced in, and how many hunks could not be: tag conflicts.

    Only differing pieces are replaced. Where one spans formatting tags, the first range takes the text.
    """
    from ..functions.editing import diff

    hunks: list[tuple[int, int, str]] = []
    conflicts = 0
    for p, new in changes:
        for h in diff(p.text, new):
            ranges = file_ranges(file, p, h.start, h.end)
            if ranges is None:
                conflicts += 1
            else:
                hunks += [(a, b, h.text if k == 0 else "") for k, (a, b) in enumerate(ranges)]
    out, at = [], 0
    for a, b, new in sorted(hunks, key=lambda h: h[:2]):
        if a < at:
            conflicts += 1
            continue
        out += (file[at:a], encode_entities(new))
        at = b
    return "".join([*out, file[at:]]), conflicts


_FRAGMENT = "struct<p_start:int,p_end:int,f_start:int,f_end:int,at:array<int>>"


def paragraphs(files: DataFrame, keys: list[str], content: str = "html") -> DataFrame:
    """keys, para_ix, text, fragments of the paragraphs of each file; null files have none."""
    types = dict(files.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", para_ix int, text string, fragments array<{_FRAGMENT}>"
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("p_start", "p_end", "f_start", "f_end")] + [("at", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, ix, texts, frags = [], [], [], []
            for row, file in enumerate(batch.column(content).to_pylist()):
                for i, p in enumerate(scan(file)):
                    which.append(row)
                    ix.append(i)
                    texts.append(p.text)
                    frags.append([f._asdict() for f in p.fragments])
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in keys), pa.array(ix, pa.int32()), pa.array(texts, pa.string()), pa.array(frags, kind)],
                [*keys, "para_ix", "text", "fragments"],
            )

    return files.filter(F.col(content).isNotNull()).select(*keys, content).mapInArrow(run, schema)


def block_texts_col(html: Column) -> Column:
    """Array of the block texts of simple pages, JVM-side: without offsets, quotes or numeric entities."""
    gone = F.regexp_replace(html, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>", "")
    gone = F.regexp_replace(gone, r"(?is)<(script|style|code|pre)\b[^>]*>.*?</\1\s*>", "")
    cut = F.split(F.regexp_replace(gone, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?![a-zA-Z0-9:])[^>]*>", "\x1e"), "\x1e")
    plain = F.transform(cut, lambda x: decode_named_col(F.regexp_replace(x, "<[^>]*>", "")))
    return F.filter(plain, lambda x: F.regexp_replace(x, r"[\s\x{A0}]", "") != "")
