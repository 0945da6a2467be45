"""The rule layers over one paragraph, as column functions and as kernels that also log their edits.

Layers run in a fixed order, each on the text that the one before it left: Unicode, composition, punctuation, spacing,
tone marks, confusable phrases. Offsets of an edit are code points of its layer's input text.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.lexicon import Options
from .charset import INVISIBLE, ODD_SPACES, TWO_STYLES, char_ranges, letter_class, token_class
from .editing import apply_edits, diff, nearest
from .syllables import frames, parse, spell

#: Rule patterns shared by the column functions (Java) and the kernels (Python): each matches what its edit replaces.
SPACE_BEFORE_CLOSING = r" (?=[,;:!?…)\]}]|\.(?!\.))"
SPACE_AFTER_OPENING = r"(?<=[(\[{]) "
MISSING_SPACE = r"(?s)(?<=.)(?<![0-9](?=[,;:][0-9]))([,;:])(?=[^ ,.;:!?…)\]}])"
MANY_DOTS = r"\.{4,}"
THREE_DOTS = r"(?<!\.)\.{3}(?!\.)"
MANY_SPACES = r" {2,}"


class Edit(NamedTuple):
    start: int
    end: int
    before: str
    after: str
    kind: str
    certainty: str
    reason: str


# --- Column functions: the text only, all JVM-side but for composition. ---


def clean_unicode(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, f"[{INVISIBLE}]", ""), ODD_SPACES, " " * len(ODD_SPACES))


def _compose_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@functools.cache
def uncomposed() -> str:
    """Regex class of all that composition can change: marks, what is the later part of a composed character, and single characters with another NFC."""
    alone, later = [], set()
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        if unicodedata.normalize("NFC", c) != c:
            alone.append(c)
        elif len(parts := unicodedata.normalize("NFD", c)) > 1:
            later.update(parts[1:])
    # The long class is asked only about what is neither Latin, nor Vietnamese, nor common punctuation.
    return rf"(?=[^\x00-\x{{2FF}}\x{{1EA0}}-\x{{1EF9}}\x{{2010}}-\x{{2027}}])[\p{{M}}{char_ranges([*alone, *later])}]"


def compose(c: Column) -> Column:
    """Canonical composition (NFC); Spark has no function for it. Python sees only texts that it may change, and nulls for the others."""
    return F.coalesce(F.pandas_udf(_compose_batch, "string")(F.when(c.rlike(uncomposed()), c)), c)


def space_before_closing(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_BEFORE_CLOSING, "")


def space_after_opening(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_AFTER_OPENING, "")


def missing_space(c: Column) -> Column:
    return F.regexp_replace(c, MISSING_SPACE, "$1 ")


def missing_sentence_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\p{IsLowercase})([.!?])(?=\p{IsUppercase})", "$1 ")


def merge_dots(c: Column) -> Column:
    return F.regexp_replace(c, MANY_DOTS, "...")


def ellipsis_char(c: Column) -> Column:
    return F.regexp_replace(c, THREE_DOTS, "…")


def punctuation(c: Column, options: Options) -> Column:
    """All punctuation rules, as if each were found on the same text.

    Rules that add come before those that take away, whose deletions would make new places for them; a made
    ellipsis is hidden from the rule on spaces, which leaves the dots that it was alone.
    """
    c = missing_sentence_space(missing_space(c))
    if options.ellipsis_char:
        c = F.regexp_replace(c, THREE_DOTS, "\ue000")
    if options.merge_dots:
        c = merge_dots(c)
    c = space_after_opening(space_before_closing(c))
    return F.translate(c, "\ue000", "…") if options.ellipsis_char else c


def collapse_spaces(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, MANY_SPACES, " "), F.lit(" "))


# --- Kernels with edit logs. ---


def _subs(text: str, pattern: str, after: str | Callable, kind: str, certainty: str, reason: str) -> list[Edit]:
    out = []
    for m in regex.finditer(pattern, text):
        new = after(m) if callable(after) else after
        out.append(Edit(m.start(), m.end(), m.group(), new, kind, certainty, reason))
    return out


_ODD = re.compile(f"[{INVISIBLE}{ODD_SPACES}]")


def unicode_edits(text: str) -> list[Edit]:
    """One edit for each invisible character or odd space, with its code point as the reason."""
    out = []
    for m in _ODD.finditer(text):
        c = m.group()
        what = "invisible character" if c in INVISIBLE else "space of another kind"
        out.append(Edit(m.start(), m.end(), c, "" if c in INVISIBLE else " ", "unicode", "sure", f"{what} U+{ord(c):04X}"))
    return out


def compose_edits(text: str) -> tuple[str, list[Edit]]:
    new = unicodedata.normalize("NFC", text)
    return new, [Edit(h.start, h.end, text[h.start : h.end], h.text, "unicode", "sure", "composed Unicode (NFC)") for h in diff(text, new)]


#: A text without a match of this has no punctuation edit.
_MAY_PUNCTUATE = re.compile(r" [,;:!?…)\]}.]|[(\[{] |[,;:][^ ]|[.!?]\S").search


def punctuation_edits(text: str, options: Options) -> list[Edit]:
    """Edits of all punctuation rules, found on the same text."""
    if not _MAY_PUNCTUATE(text):
        return []
    p = ("punctuation", "sure")
    out = _subs(text, SPACE_BEFORE_CLOSING, "", *p, "space before a closing mark")
    out += _subs(text, SPACE_AFTER_OPENING, "", *p, "space after an opening mark")
    out += [Edit(m.end(), m.end(), "", " ", *p, f"no space after `{m.group(1)}`") for m in regex.finditer(MISSING_SPACE, text)]
    gaps = regex.finditer(r"(?<=\p{Lowercase})[.!?](?=\p{Uppercase})", text)
    out += [Edit(m.end(), m.end(), "", " ", "punctuation", "likely", "no space between sentences") for m in gaps]
    if options.merge_dots:
        out += _subs(text, MANY_DOTS, "...", *p, "more than three dots")
    if options.ellipsis_char:
        out += _subs(text, THREE_DOTS, "…", *p, "three dots as one character")
    return out


def spacing_edits(text: str) -> list[Edit]:
    """Trimmed ends and collapsed runs of spaces; runs inside the trimmed ends are no edits of their own."""
    s = ("spacing", "sure")
    lead, tail = len(text) - len(text.lstrip(" ")), len(text.rstrip(" "))
    if lead == len(text):
        return [Edit(0, lead, text, "", *s, "space at the end")] if lead else []
    out = [Edit(0, lead, text[:lead], "", *s, "space at the start")] if lead else []
    out += [e for e in _subs(text, MANY_SPACES, " ", *s, "repeated spaces") if lead <= e.start and e.end <= tail]
    if tail < len(text):
        out.append(Edit(tail, len(text), text[tail:], "", *s, "space at the end"))
    return out


_WORD = re.compile(f"{letter_class()}+")


def words(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]


@functools.lru_cache(1 << 16)
def respell(word: str, new_style: bool) -> str | None:
    """The word with its tone mark in place, in the word's case: all upper, first upper, or lower."""
    s = parse(word)
    if s is None:
        return None
    out = spell(s, new_style)
    if len(word) > 1 and word == word.upper():
        return out.upper()
    return out[0].upper() + out[1:] if word[0].isupper() else out


#: Longest word that can be a syllable; lower-casing may lengthen, never shorten one of letters.
_LONGEST = max(map(len, frames()))
_MARKED_WORD = re.compile(f"[A-Za-z]*{letter_class().replace('A-Za-z', '')}{letter_class()}*")


@functools.lru_cache(1 << 16)
def _tone_fix(word: str, new_style: bool, consistent: bool) -> tuple[str, str, str, str] | None:
    """What replaces a word, with kind, certainty and reason."""
    if token_class(word) != "viet" or (right := respell(word, new_style)) is None:
        return None
    if right.lower() == word.lower():
        return None
    if respell(word, not new_style) != word:
        return right, "tone_mark", "sure", "tone mark on the wrong vowel"
    s = parse(word)
    if consistent and s.rhyme in TWO_STYLES and s.tone:
        return right, "tone_style", "likely", f"both are right; the book's {'new' if new_style else 'old'} style"
    return None


def tone_edits(text: str, new_style: bool, consistent: bool) -> list[Edit]:
    """Marks on the wrong vowel, and, if `consistent`, spellings of the style that is not the book's."""
    if text.isascii():
        return []
    out = []
    for m in _MARKED_WORD.finditer(text):
        word = m.group()
        if len(word) <= _LONGEST and (fix := _tone_fix(word, new_style, consistent)):
            out.append(Edit(m.start(), m.end(), word, *fix))
    return out


def confusable_edits(text: str, table: list[tuple[str, list[str], str, int]]) -> list[Edit]:
    """Phrases of the table: always-wrong rows first, longest keys first; a claimed word is not used again."""
    if {key[0] for _, key, _, _ in table}.isdisjoint(" ".join(_WORD.findall(text)).lower().split(" ")):
        return []
    tokens = words(text)
    low = [w.lower() for _, _, w in tokens]
    at: dict[str, list[int]] = {}
    for i, w in enumerate(low):
        at.setdefault(w, []).append(i)
    taken: set[int] = set()
    out = []
    for section, key, value, _ in table:
        n = len(key)
        for i in at.get(key[0], ()):
            if low[i : i + n] != key or not taken.isdisjoint(range(i, i + n)):
                continue
            if any(text[tokens[k][1] : tokens[k + 1][0]].strip(" ") for k in range(i, i + n - 1)):
                continue
            start, end = tokens[i][0], tokens[i + n - 1][1]
            old = text[start:end]
            new = value[0].upper() + value[1:] if old[0].isupper() else value
            if new == old:
                continue
            taken.update(range(i, i + n))
            phrase = " ".join(key)
            if section == "always":
                out.append(Edit(start, end, old, new, "confusable", "sure", f"`{phrase}` is no word"))
            else:
                out.append(Edit(start, end, old, new, "confusable", "doubtful", f"`{phrase}` and `{value}` differ in meaning"))
    return out


class Layered(NamedTuple):
    text: str
    edits: list[tuple[int, Edit]]  # (layer, edit), applied ones only
    open: list[Edit]  # doubtful phrases, anchored in `text`


def run_layers(text: str, new_style: bool, options: Options, table: list[tuple[str, list[str], str, int]]) -> Layered:
    """Layers 1 to 6 over one paragraph."""
    log: list[tuple[int, Edit]] = []

    def apply(layer: int, text: str, edits: list[Edit]) -> str:
        edits = [e for e in edits if e.before != e.after]
        new, used = apply_edits(text, [(e.start, e.end, e.after) for e in edits])
        log.extend((layer, edits[i]) for i in used)
        return new

    if options.unicode:
        text = apply(1, text, unicode_edits(text))
        text, composed = compose_edits(text)
        log += [(2, e) for e in composed]
    if options.punctuation:
        text = apply(3, text, punctuation_edits(text, options))
    if options.spacing:
        text = apply(4, text, spacing_edits(text))
    text = apply(5, text, tone_edits(text, new_style, options.consistent_tone_style))
    doubtful: list[Edit] = []
    if options.confusables:
        found = confusable_edits(text, table)
        before = text
        text = apply(6, text, [e for e in found if e.certainty == "sure"])
        for e in (e for e in found if e.certainty == "doubtful"):
            at = e.start if text == before else nearest(text, e.before, e.start)
            if at is not None:
                doubtful.append(e._replace(start=at, end=at + len(e.before)))
    return Layered(text, log, doubtful)
