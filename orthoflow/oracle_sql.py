"""Pieces of DuckDB SQL that state rules on their own: syllable structure, text normalisation, the correction tables' formats.

Only fixed values (letters, onsets, rhymes, the tables' texts) are shared with the Spark code.
"""

from __future__ import annotations

from .fixtures import sql_values
from .functions.charset import INVISIBLE, ODD_SPACES, ONSETS, RHYMES, VOWELS
from .functions.tables import CONFUSABLES, TYPOS

_ALL = "".join(VOWELS)
_BASE = "".join(v[0] for v in VOWELS)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _place(rhyme: str, new_style: str) -> str:
    """1-based place of the tone mark: the only vowel, else the last marked one, else by what follows and by style."""
    vowels = f"length(regexp_extract({rhyme}, '^[{_BASE}]+'))"
    marked = f"length(regexp_extract({rhyme}, '^.*[ăâêôơư]'))"
    return f"""CASE WHEN {vowels} = 1 THEN 1 WHEN {marked} > 0 THEN {marked} WHEN {vowels} < length({rhyme}) THEN {vowels}
        WHEN {new_style} AND {rhyme} IN ('oa', 'oe', 'uy') THEN {vowels} ELSE {vowels} - 1 END"""


def _toned(word: str, at: str, tone: str) -> str:
    return f"substr({word}, 1, {at} - 1) || substr('{_ALL}', strpos('{_ALL}', substr({word}, {at}, 1)) + {tone}, 1) || substr({word}, {at} + 1)"


def _spelt(new_style: str) -> str:
    onset = "CASE WHEN onset = 'gi' AND rhyme[1] = 'i' THEN 'g' WHEN onset = 'qu' AND rhyme[1] = 'u' THEN 'q' ELSE onset END"
    return f"({onset}) || {_toned('rhyme', '(' + _place('rhyme', new_style) + ')', 'tone')}"


#: CTEs up to `words` (word, onset, rhyme, tone, old_spelling, new_spelling): every word with a valid structure.
WORDS = f"""ons AS (SELECT unnest(string_split('{' '.join(ONSETS)}', ' ')) AS o), rhy AS (SELECT unnest(string_split('{' '.join(RHYMES)}', ' ')) AS r),
    written AS (
        SELECT r AS frame FROM rhy UNION SELECT o || r FROM ons, rhy
        UNION SELECT 'g' || r FROM rhy WHERE r[1] = 'i' UNION SELECT 'q' || r FROM rhy WHERE r[1] = 'u'),
    cut AS (SELECT frame, coalesce((SELECT arg_max(o, length(o)) FROM ons WHERE starts_with(frame, o)), '') AS onset FROM written),
    rest AS (SELECT frame, onset, substr(frame, length(onset) + 1) AS tail FROM cut),
    frames AS (
        SELECT frame, onset, tail, CASE WHEN tail IN (SELECT r FROM rhy) THEN tail WHEN onset = 'gi' THEN 'i' || tail WHEN onset = 'qu' THEN 'u' || tail ELSE '' END AS rhyme FROM rest
        WHERE CASE WHEN onset IN ('k', 'gh', 'ngh') THEN regexp_matches(tail, '^[ieêy]') WHEN onset IN ('c', 'g', 'ng') THEN NOT regexp_matches(tail, '^[ieêy]')
              WHEN onset = 'qu' THEN NOT regexp_matches(tail, '^[uo]') ELSE true END),
    syllables AS (SELECT f.*, tone FROM frames f, (SELECT unnest(range(6)) AS tone) WHERE rhyme IN (SELECT r FROM rhy) AND (tone IN (2, 5) OR NOT regexp_matches(rhyme, '(ch|p|t|c)$'))),
    spelt AS (SELECT *, {_spelt('false')} AS old_spelling, {_spelt('true')} AS new_spelling FROM syllables),
    words AS (
        SELECT frame AS word, onset, rhyme, tone, old_spelling, new_spelling FROM spelt WHERE tone = 0
        UNION ALL
        SELECT {_toned('frame', 'nr', 'tone')}, onset, rhyme, tone, old_spelling, new_spelling FROM (SELECT *, unnest(range(1, length(frame) + 1)) AS nr FROM spelt WHERE tone > 0)
        WHERE nr >= length(onset) AND contains('{_BASE}', substr(frame, nr, 1)))"""

_INVISIBLE = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in INVISIBLE) + "]"
_SPACES = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in ODD_SPACES) + "]"


def clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_INVISIBLE}', '', 'g'), '{_SPACES}', ' ', 'g')"


def missing_space(x: str) -> str:
    """A comma, semicolon or colon gets a space behind it, unless it comes first, a space or mark follows, or it stands between digits.

    What stands between digits is first marked with U+E000, in two rounds, since such places share their digits.
    """
    for _ in range(2):
        x = rf"regexp_replace({x}, '([0-9][,;:])([0-9])', '\1' || chr(57344) || '\2', 'g')"
    rest = rf"regexp_replace(substr({x}, 2), '([,;:])([^ ,.;:!?…)\]}}\x{{E000}}])', '\1 \2', 'g')"
    return f"replace(substr({x}, 1, 1) || {rest}, chr(57344), '')"


def sentence_space(x: str) -> str:
    return rf"regexp_replace({x}, '(\p{{Ll}}[.!?])(\p{{Lu}})', '\1 \2', 'g')"


def dots(x: str, when: str, then: str) -> str:
    """Runs of dots of the length that `when` says, as `then`."""
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\.+|[^.]+'), lambda r: CASE WHEN r[1] = '.' AND length(r) {when} THEN '{then}' ELSE r END), '')"


def before_closing(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, ' ([,;:!?…)\]}}])', '\1', 'g'), ' \.([^.]|$)', '.\1', 'g')"


def after_opening(x: str) -> str:
    return rf"regexp_replace({x}, '([(\[{{]) ', '\1', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, ' {{2,}}', ' ', 'g'), ' ')"


def normalised(source: str, column: str = "text") -> str:
    """CTEs up to `normal`: `source` with the column through all text rules, one step per CTE."""
    steps = [f"nfc_normalize({clean(column)})", missing_space(column), sentence_space(column), dots(column, ">= 4", "..."), after_opening(before_closing(column)), collapse(column)]
    names = [source, *(f"step{i}" for i in range(1, len(steps))), "normal"]
    return ", ".join(f"{b} AS MATERIALIZED (SELECT * REPLACE ({step} AS {column}) FROM {a})" for a, b, step in zip(names, names[1:], steps, strict=False))


_LINES = "(SELECT unnest(string_split({0}, chr(10))) AS line, generate_subscripts(string_split({0}, chr(10)), 1) AS nr)"

#: The typo table, read from its text: `typo => answer | answer`; of a repeated typo the last line stands.
TYPO_ROWS = f"""lines AS (SELECT nr, trim(line) AS line FROM {_LINES.format(_text(TYPOS))}),
    typos AS (
        SELECT lower(trim(split_part(line, '=>', 1))) AS typo,
               arg_max(list_filter(list_transform(string_split(split_part(line, '=>', 2), '|'), lambda a: trim(a)), lambda a: a <> ''), nr) AS answers
        FROM lines WHERE line NOT LIKE '#%' AND contains(line, '=>') GROUP BY 1)"""

#: The confusable table, read from its text: a row belongs to the last heading above it.
CONFUSABLE_ROWS = f"""c_lines AS (SELECT nr, trim(line) AS line FROM {_LINES.format(_text(CONFUSABLES))}),
    c_headed AS (
        SELECT nr, line, last_value(CASE WHEN line = '[always wrong]' THEN 'always' WHEN line LIKE '[%' THEN 'meaning' END IGNORE NULLS) OVER (ORDER BY nr) AS section FROM c_lines),
    c_cut AS (SELECT section, CASE section WHEN 'always' THEN '=>' ELSE '|' END AS mark, line FROM c_headed WHERE line NOT LIKE '#%' AND line NOT LIKE '[%'),
    confusable AS (
        SELECT section, array_to_string(regexp_extract_all(lower(split_part(line, mark, 1)), '\\S+'), ' ') AS phrase, trim(split_part(line, mark, 2)) AS value
        FROM c_cut WHERE contains(line, mark))"""


def values(rows, columns: str) -> str:
    return sql_values(rows, columns)
