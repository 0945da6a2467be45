"""Vietnamese letters, tones and the fixed tables of the correction rules, with column functions over them."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: they must be exactly these for right results. ---

#: Each base vowel with its six tones: level, huyền, sắc, hỏi, ngã, nặng.
VOWELS = "aàáảãạ ăằắẳẵặ âầấẩẫậ eèéẻẽẹ êềếểễệ iìíỉĩị oòóỏõọ ôồốổỗộ ơờớởỡợ uùúủũụ ưừứửữự yỳýỷỹỵ".split()

#: Initial consonants, longest first.
ONSETS = "ngh ng nh ch tr th ph kh gh gi qu b c d đ g h k l m n p r s t v x".split()

#: All rhymes without tone, by ending: open, -i/-y, -u/-o, -m, -n, -ng, -nh, -p, -t, -c, -ch.
RHYMES = """
a e ê i o ô ơ u ư y ia ua ưa uơ oa oe uê uy uya
ai ay ây oi ôi ơi ui ưi oai oay uây uôi ươi
ao au âu eo êu iu ưu iêu yêu ươu oao oeo uyu
am ăm âm em êm im om ôm ơm um ưm ươm iêm yêm uôm oam oăm oem
an ăn ân en ên in on ôn ơn un ưn iên yên uôn ươn oan oăn oen uân uyên
ang ăng âng eng êng ong ông ung ưng iêng uông ương oang oăng oong uâng
anh ênh inh oanh uynh uênh
ap ăp âp ep êp ip op ôp ơp up ươp iêp oap
at ăt ât et êt it ot ôt ơt ut ưt iêt yêt uôt ươt oat oăt oet uât uyt uyêt
ac ăc âc ec êc ic oc ôc uc ưc iêc uôc ươc oac oăc oec ooc
ach êch ich oach uêch uych
""".split()

#: Letters that may be inserted or put in another's place.
TYPED_LETTERS = "abcdđeghiklmnopqrstuvxyfjwz"

#: Characters that are deleted, and spaces of other kinds that become a plain one.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad\u2060"
ODD_SPACES = "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t"

CLOSING = ",.;:!?…)]}"
OPENING = "([{"

#: Rhymes whose tone mark has an old and a new place.
TWO_STYLES = ("oa", "oe", "uy")

# --- Derived. ---

LEVEL, HUYEN, SAC, HOI, NGA, NANG = range(6)
MARKED = "ăâêôơư"
TONED = "".join(v[1:] for v in VOWELS)
BARE = "".join(v[0] * 5 for v in VOWELS)
VOWEL_CHARS = "".join(VOWELS)
CONSONANTS = "bcdđghklmnpqrstvxfjwz"
#: Lower-case letters of words; `LETTERS` has both cases.
LOWER_LETTERS = "".join(dict.fromkeys(VOWEL_CHARS + CONSONANTS))
LETTERS = LOWER_LETTERS + LOWER_LETTERS.upper()
_STRIP_FROM = "ăâêôơưđ"
_STRIP_TO = "aaeooud"

TONE_OF = {c: t for v in VOWELS for t, c in enumerate(v)}
BASE_OF = {c: v[0] for v in VOWELS for c in v}
WITH_TONE = {v[0]: v for v in VOWELS}
#: A letter's plain form: what is typed without the key for its hook, hat or bar.
PLAIN_OF = dict(zip(_STRIP_FROM, _STRIP_TO, strict=True))


def char_ranges(chars: Iterable[str]) -> str:
    """The characters as the ranges of a regex class: short classes are fast."""
    codes, out = sorted(map(ord, set(chars))), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}{chr(b)}" if b == a + 1 else f"{chr(a)}-{chr(b)}" for a, b in out)


@functools.cache
def letter_class(compat_lowercase_letters: bool = False) -> str:
    """Regex class of word letters. Upper-case accented vowels count as letters unless the compatibility switch is on.

    With the switch, only lower-case vowels, ASCII letters and đ/Đ are letters, so `Ước` gives the token `ớc`.
    """
    if compat_lowercase_letters:
        return "[" + char_ranges(LOWER_LETTERS + "ABCDEFGHIJKLMNOPQRSTUVWXYZĐ") + "]"
    return "[" + char_ranges(LETTERS) + "]"


def strip_tone(s: str) -> str:
    return "".join(BASE_OF.get(c, c) for c in s)


def strip_all(s: str) -> str:
    """Without tones, hats, hooks and bars: đ becomes d."""
    return "".join(PLAIN_OF.get(c, c) for c in strip_tone(s))


def tones(s: str) -> list[int]:
    return [t for c in s if (t := TONE_OF.get(c, 0))]


def is_vowel(c: str) -> bool:
    return c in TONE_OF


def strip_tone_col(c: Column) -> Column:
    """Lower case without tone marks; ă â ê ô ơ ư đ stay."""
    return F.translate(F.lower(c), TONED, BARE)


def strip_all_col(c: Column) -> Column:
    return F.translate(strip_tone_col(c), _STRIP_FROM, _STRIP_TO)


def tone_marks_col(c: Column) -> Column:
    """How many tone marks the word carries."""
    return F.length(F.regexp_replace(F.lower(c), f"[^{TONED}]", ""))


def tone_col(c: Column) -> Column:
    """The tone of a word: that of its last toned letter, 0 where it has none."""
    last = F.regexp_extract(F.lower(c), f"([{TONED}])[^{TONED}]*$", 1)
    return F.when(last == "", F.lit(0)).otherwise(F.translate(last, TONED, "12345" * len(VOWELS)).cast("int"))


def is_vowel_col(c: Column) -> Column:
    return c.rlike(f"^[{VOWEL_CHARS}]$")


def is_letters_col(c: Column, compat_lowercase_letters: bool = False) -> Column:
    return c.rlike(f"^{letter_class(compat_lowercase_letters)}+$")


def same_letter_col(a: Column, b: Column) -> Column:
    """Whether two words begin with the same letter but for tone and diacritic; đ and d differ."""

    def plain(c):
        return F.translate(strip_tone_col(F.left(c, F.lit(1))), "ăâêôơư", "aaeoou")

    return plain(a) == plain(b)


def keeps_onset_col(old: Column, new: Column) -> Column:
    """False only where a first consonant is replaced: same length, other first letter, not both vowels."""

    def vowel(c):
        return is_vowel_col(F.lower(F.left(c, F.lit(1))))

    return (F.length(old) != F.length(new)) | same_letter_col(old, new) | (vowel(old) & vowel(new))


def recapitalise_col(old: Column, new: Column) -> Column:
    """`new` with an upper-case first letter where `old` has one; the rest as it is."""
    first = F.left(old, F.lit(1))
    upper = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(upper, F.concat(F.upper(F.left(new, F.lit(1))), F.substr(new, F.lit(2)))).otherwise(new)


def letters_class_col(c: Column) -> Column:
    """acronym, nonword, viet or plain of a word that is known to hold letters only."""
    return (
        F.when((F.length(c) > 1) & (c == F.upper(c)), "acronym")
        .when(~F.lower(c).rlike(f"[{char_ranges(VOWEL_CHARS)}]"), "nonword")
        .when(F.octet_length(c) != F.length(c), "viet")
        .otherwise("plain")
    )


def token_class_col(c: Column, compat_lowercase_letters: bool = False) -> Column:
    """nonword, acronym, viet or plain of any string."""
    return F.when((c == "") | ~is_letters_col(c, compat_lowercase_letters), "nonword").otherwise(letters_class_col(c))


@functools.lru_cache(1 << 16)
def token_class(s: str) -> str:
    if not s or not re.fullmatch(letter_class() + "+", s):
        return "nonword"
    if s == s.upper() and len(s) > 1:
        return "acronym"
    if not any(is_vowel(c) for c in s.lower()):
        return "nonword"
    return "viet" if not s.isascii() else "plain"
