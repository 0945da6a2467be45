"""Candidate corrections of one token, and splits of glued words: kernels for vectorised functions over distinct tokens.

The generator works on frames without tone. Each one-letter edit of the token's frame is looked up by its plain form in an
index of all valid frames, so only variants that are syllables are ever built.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Collection

from .charset import PLAIN_OF, TYPED_LETTERS, is_vowel, strip_tone, tones
from .syllables import Syllable, frames, parse, spell, tone_fits

# --- Fixed values: costs of an edit and the length of the list. ---
DOUBLED, ADD_MARK, CHANGE_MARK, OTHER_TONE, OTHER_LENGTH = 0, 2, 3, 3, 1
SWAP, EDIT, VOWEL_EDIT = 4, 6, 2
MOST_CANDIDATES = 40
MOST_MARK_PLACES = 3
SPLIT_LENGTHS = (5, 24)
MOST_PIECES = 4

#: Letters that have variants with another mark. đ has only itself: it never becomes d.
_VARIANTS = {"a": "aăâ", "ă": "aăâ", "â": "aăâ", "e": "eê", "ê": "eê", "o": "oôơ", "ô": "oôơ", "ơ": "oôơ", "u": "uư", "ư": "uư", "d": "dđ", "đ": "đ"}


@functools.cache
def _frames_by_plain() -> dict[str, list[str]]:
    index: dict[str, list[str]] = {}
    for frame in frames():
        index.setdefault("".join(PLAIN_OF.get(c, c) for c in frame), []).append(frame)
    return index


@functools.cache
def _longest_frame() -> int:
    return max(map(len, frames()))


@functools.cache
def _letters_for_gap() -> dict[str, str]:
    """For the plain form of a valid frame with one letter as a gap: the typed letters that fill it to the plain form of a valid frame."""
    fits: dict[str, set[str]] = {}
    for plain in _frames_by_plain():
        for i, c in enumerate(plain):
            fits.setdefault(f"{plain[:i]}*{plain[i + 1 :]}", set()).add(c)
    return {gap: "".join(c for c in TYPED_LETTERS if PLAIN_OF.get(c, c) in found) for gap, found in fits.items()}


@functools.cache
def _spellings(frame: str) -> tuple[tuple[int, str], ...]:
    onset, rhyme = frames()[frame]
    words = ((t, spell(Syllable(onset, rhyme, t))) for t in range(6) if tone_fits(rhyme, t))
    return tuple((t, w) for t, w in words if parse(w))


def mark_variants(frame: str) -> list[tuple[str, int]]:
    """Valid frames that differ from `frame` in marks only, with their cost.

    With more than `MOST_MARK_PLACES` letters that have variants, only the frame itself.
    """
    if sum(c in _VARIANTS for c in frame) > MOST_MARK_PLACES:
        return [(frame, 0)] if frame in frames() else []
    out = []
    for other in _frames_by_plain().get("".join(PLAIN_OF.get(c, c) for c in frame), ()):
        cost = 0
        for a, b in zip(frame, other, strict=True):
            if a != b:
                if b not in _VARIANTS.get(a, ""):
                    break
                cost += CHANGE_MARK if a in PLAIN_OF else ADD_MARK
        else:
            out.append((other, cost))
    return out


def undoubled(frame: str) -> list[str]:
    """The frame without one letter of a doubled pair; `oo` and letters with marks are left alone."""
    return [
        frame[:i] + frame[i + 1 :]
        for i in range(len(frame) - 1)
        if frame[i] == frame[i + 1] and frame[i] != "o" and frame[i] not in PLAIN_OF and len(frame) > 2
    ]


def one_letter_edits(frame: str) -> list[tuple[str, int]]:
    """Deletions, swaps, replacements and insertions of one letter, with their cost: those whose plain form is that of a valid frame."""
    out = []
    n = len(frame)
    known, fits = _frames_by_plain(), _letters_for_gap()
    plain = "".join(PLAIN_OF.get(c, c) for c in frame)
    for i, old in enumerate(frame):
        head, tail = frame[:i], frame[i + 1 :]
        if n > 2 and plain[:i] + plain[i + 1 :] in known:
            out.append((head + tail, EDIT))
        if i + 1 < n and plain[:i] + plain[i + 1] + plain[i] + plain[i + 2 :] in known:
            out.append((head + frame[i + 1] + old + frame[i + 2 :], SWAP))
        for new in fits.get(f"{plain[:i]}*{plain[i + 1 :]}", ""):
            if new != old and not (old == "đ" and new == "d"):
                out.append((head + new + tail, EDIT + VOWEL_EDIT * (is_vowel(old) or is_vowel(new))))
    for i in range(n + 1):
        out += [(frame[:i] + c + frame[i:], EDIT) for c in fits.get(f"{plain[:i]}*{plain[i:]}", "")]
    return out


def candidates(token: str) -> list[tuple[str, int]]:
    """At most 40 (word, cost), cheapest first, equal costs by code point; the first letter's case follows the token.

    The same word may stand in the list at several costs: only neighbours with one text are merged.
    """
    low = token.lower()
    frame = strip_tone(low)
    if len(frame) > _longest_frame() + 1:  # no edit makes it short enough
        return []
    own_tone = next(iter(tones(low)), 0)
    found: set[tuple[int, str]] = set()

    def add(frame: str, cost: int) -> None:
        for tone, word in _spellings(frame):
            found.add((cost + (tone != own_tone) * OTHER_TONE + (len(word) != len(low)) * OTHER_LENGTH, word))

    known = frames()
    for f in undoubled(frame):
        if f in known:
            add(f, DOUBLED)
    for f, cost in mark_variants(frame):
        add(f, cost)
    for edited, cost in one_letter_edits(frame):
        if edited in known:
            add(edited, cost)
        for f, more in mark_variants(edited):
            add(f, cost + more)
    out: list[tuple[str, int]] = []
    last = None
    for cost, word in sorted(found):
        if word != last and word != low:
            out.append((word, cost))
        last = word
    upper = token[:1].isupper()
    return [(w[0].upper() + w[1:] if upper else w, c) for w, c in out[:MOST_CANDIDATES]]


def strong_split(pieces: list[str]) -> bool:
    """Every piece after the first begins with a consonant."""
    return all(not is_vowel(p[0]) for p in pieces[1:])


def splits(token: str, is_word: Callable[[str], bool], compounds: Collection[str], longest: int | None = None) -> list[str]:
    """Ways to cut a glued word into 2 to 4 lexicon words, best first, in lower case.

    A cut that makes a compound comes first, then strong ones, then fewer pieces, then more neighbouring compounds. `longest`: the
    length of the longest lexicon word, if it is known.
    """
    low = token.lower()
    n = len(low)
    if not SPLIT_LENGTHS[0] <= n <= SPLIT_LENGTHS[1]:
        return []
    most = n if longest is None else longest
    ways: list[list[str]] = []

    @functools.cache
    def stops(i: int) -> list[int]:
        """Ends of the lexicon words with a vowel that begin at i: asked only where a cut gets to."""
        return [j for j in range(i + 1, min(n, i + most) + 1) if is_word(low[i:j]) and any(map(is_vowel, low[i:j]))]

    def cut(at: int, pieces: list[str]) -> None:
        if at == n:
            ways.append(pieces)
        elif len(pieces) < MOST_PIECES:
            for j in stops(at):
                cut(j, [*pieces, low[at:j]])

    cut(0, [])

    def sound(p: list[str]) -> bool:
        if len(p) < 2 or max(map(len, p)) < 3:
            return False
        if len(p) > 2 and min(map(len, p)) < 2 and " ".join(p) not in compounds:
            return False
        return not any((a := strip_tone(x[-1])) == strip_tone(y[0]) and is_vowel(a) for x, y in zip(p, p[1:], strict=False))

    def rank(p: list[str]):
        pairs = sum(f"{x} {y}" in compounds for x, y in zip(p, p[1:], strict=False))
        return " ".join(p) not in compounds, not strong_split(p), len(p), -pairs

    return [" ".join(p) for p in sorted(filter(sound, ways), key=rank)]


def put_spaces(token: str, split: str) -> str:
    """The breaks of a lower-case split set into the token itself, whose case is kept."""
    out, at = [], 0
    for piece in split.split(" "):
        out.append(token[at : at + len(piece)])
        at += len(piece)
    return " ".join(out) if at == len(token) else split


def repair_uo(token: str) -> str | None:
    """`uơ` before a final consonant, not after q, as `ươ`; tone and case kept. None where there is none."""
    bare = strip_tone(token.lower())
    if "uơ" not in bare:
        return None
    at = [i for i in range(len(bare) - 1) if bare[i : i + 2] == "uơ" and bare[i - 1 : i] != "q"]
    if not any(bare[i + 2 : i + 3] in set("cmnpth") for i in at):
        return None
    out = list(token)
    for i in at:
        tone = next(iter(tones(token[i].lower())), 0)
        new = "ưừứửữự"[tone]
        out[i] = new.upper() if token[i].isupper() else new
    return "".join(out)
