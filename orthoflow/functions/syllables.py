"""Structure of Vietnamese syllables: frames (onset + rhyme), tones, spelling, and all valid syllables as a table."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..staging import local_table
from .charset import BASE_OF, LEVEL, MARKED, NANG, ONSETS, RHYMES, SAC, TONE_OF, TWO_STYLES, WITH_TONE, is_vowel

_RHYMES = frozenset(RHYMES)
#: The letter that an onset shares with the rhyme's first one, so that it is written once.
_SHARED = {"gi": "i", "qu": "u"}


@dataclass(frozen=True)
class Syllable:
    onset: str
    rhyme: str
    tone: int


def stopped(rhyme: str) -> bool:
    return rhyme.endswith(("ch", "p", "t", "c"))


def tone_fits(rhyme: str, tone: int) -> bool:
    """Rhymes that end in a stop carry sắc or nặng only."""
    return tone in (SAC, NANG) or not stopped(rhyme)


def _onset_fits(onset: str, written: str) -> bool:
    narrow = written[:1] in ("i", "e", "ê", "y") and written != ""
    if onset in ("k", "gh", "ngh"):
        return narrow
    if onset in ("c", "g", "ng"):
        return not narrow
    return onset != "qu" or written[:1] not in ("u", "o")


@functools.cache
def split_frame(frame: str) -> tuple[str, str] | None:
    """(onset, rhyme) of a word without tone, or None; whether it needs a tone is not asked."""
    onset = next((o for o in ONSETS if frame.startswith(o)), "")
    written = rhyme = frame[len(onset) :]
    if rhyme not in _RHYMES and onset in _SHARED:
        rhyme = _SHARED[onset] + written
    if rhyme not in _RHYMES or not _onset_fits(onset, written):
        return None
    return onset, rhyme


def parse(word: str) -> Syllable | None:
    """The syllable that a word in any case spells, or None where its structure is not valid."""
    low = word.lower()
    marks = [t for c in low if (t := TONE_OF.get(c, 0))]
    if len(marks) > 1:
        return None
    parts = split_frame("".join(BASE_OF.get(c, c) for c in low))
    tone = marks[0] if marks else LEVEL
    if parts is None or not tone_fits(parts[1], tone):
        return None
    return Syllable(*parts, tone)


def tone_place(rhyme: str, new_style: bool) -> int:
    """Index of the letter of the rhyme that takes the tone mark."""
    vowels = [i for i, c in enumerate(rhyme) if is_vowel(c)]
    if len(vowels) == 1:
        return vowels[0]
    marked = [i for i in vowels if rhyme[i] in MARKED]
    if marked:
        return marked[-1]
    if vowels[-1] + 1 < len(rhyme) or (new_style and rhyme in TWO_STYLES):
        return vowels[-1]
    return vowels[-2]


def spell(s: Syllable, new_style: bool = False) -> str:
    """The word in lower case."""
    at = tone_place(s.rhyme, new_style)
    rhyme = "".join(WITH_TONE[c][s.tone] if i == at else c for i, c in enumerate(s.rhyme))
    onset = s.onset[:-1] if _SHARED.get(s.onset) == s.rhyme[0] else s.onset
    return onset + rhyme


@functools.cache
def frames() -> dict[str, tuple[str, str]]:
    """Every frame that splits, with its onset and rhyme."""
    found = {}
    for onset in ["", *ONSETS]:
        for rhyme in RHYMES:
            for frame in {onset + rhyme, spell(Syllable(onset, rhyme, LEVEL))}:
                if parts := split_frame(frame):
                    found[frame] = parts
    return found


@functools.cache
def all_words() -> dict[str, tuple[str, str, int, str, str]]:
    """Every valid lower-case word in either style, and with the mark on any other vowel of its rhyme.

    Maps the word as written to (onset, rhyme, tone, old spelling, new spelling).
    """
    found = {}
    for frame, (onset, rhyme) in frames().items():
        start = len(frame) - len(frame[len(next((o for o in ONSETS if frame.startswith(o)), "")) :])
        for tone in range(6):
            if not tone_fits(rhyme, tone):
                continue
            s = Syllable(onset, rhyme, tone)
            info = (onset, rhyme, tone, spell(s), spell(s, True))
            if tone == LEVEL:
                found[frame] = info
                continue
            # A mark may be misplaced on any vowel, those of the onset's shared letter too.
            for i, c in enumerate(frame):
                if is_vowel(c) and (i >= start - 1):
                    found[frame[:i] + WITH_TONE[c][tone] + frame[i + 1 :]] = info
    return found


def syllable_table(spark: SparkSession) -> DataFrame:
    """(word, onset, rhyme, tone, old_spelling, new_spelling): a word is structurally valid if it is in this table.

    About 37 thousand rows of a few dozen bytes, by construction; it may always be broadcast.
    """
    rows = [(w, *v) for w, v in sorted(all_words().items())]
    return local_table(spark, rows, "word string, onset string, rhyme string, tone int, old_spelling string, new_spelling string")
