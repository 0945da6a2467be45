"""One query per operator over the driver's tables, and SQL for DuckDB where SQL can say it.

Texts are the lines of all `documents`, as paragraphs of the book that their source names, with the Vietnamese fixture
paragraphs beside them: the documents hold no Vietnamese. Correction, its candidates and its ranking run over all of
them too. Where answers must be known, the generated book (`book`) is corrected: its edits, open cases and reports have SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import book, fixtures, oracle_sql
from .functions import candidates, charset, editing, layers
from .functions.charset import LETTERS, TONED, VOWEL_CHARS
from .functions.syllables import syllable_table
from .functions.tables import BLOCK_TAGS, CONFUSABLES, ENTITIES, STYLE_KINDS, TYPOS
from .operators import confusables, curate, decide, edits, rank, report, stats, tokens
from .plans.correct import correct
from .sources import epub, lexicon, models, xhtml
from .staging import Scratch, spread
from .streaming import rules

KEY = tokens.KEY
L = f"[{LETTERS}]"
V = f"[{VOWEL_CHARS}]"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("entry_ix"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("para_ix", "text")
    )
    own = fixtures.paragraphs(spark).withColumn("entry_ix", F.col("entry_ix").cast("bigint"))
    return docs.unionByName(own).withColumn("para_ix", F.col("para_ix").cast("bigint"))


def _novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated book; its size does not depend on the driver's tables."""
    return book.paragraphs(spark)


def _toks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens(paragraphs(spark, sf_dir))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _values(rows, columns: str) -> str:
    return fixtures.sql_values(rows, columns)


_LINES = "string_split(coalesce(text, ''), chr(10))"
PARAS = f"""paras AS (
    SELECT source AS book_id, doc_id AS entry_ix, generate_subscripts({_LINES}, 1)::BIGINT - 1 AS para_ix, unnest({_LINES}) AS text FROM documents
    UNION ALL SELECT book_id, entry_ix::BIGINT, para_ix::BIGINT, text FROM {_values(fixtures.PARAGRAPHS, "book_id, entry_ix, para_ix, text")})"""
TOKS = f"""{PARAS},
parts AS (SELECT book_id, entry_ix, para_ix, regexp_extract_all(text, '{L}+|[^{L[1:-1]}]+') AS ps FROM paras),
items AS (SELECT *, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS tok FROM parts),
toks AS (
    SELECT book_id, entry_ix, para_ix, pos, tok, CASE WHEN pos >= 2 THEN ps[pos - 1] END AS prev, ps[pos + 3] AS next,
           CASE WHEN pos >= 1 THEN ps[pos] END AS gap, ps[pos + 2] AS gap_after,
           CASE WHEN tok = upper(tok) AND length(tok) > 1 THEN 'acronym' WHEN NOT regexp_matches(lower(tok), '{V}') THEN 'nonword'
                WHEN regexp_matches(tok, '[^\\x00-\\x7F]') THEN 'viet' ELSE 'plain' END AS token_class
    FROM items WHERE regexp_matches(tok, '^{L}'))"""
LEX = f"lex AS (SELECT syllable FROM {_values([(s,) for s in fixtures.SYLLABLES], 'syllable')})"
COMP = f"comp AS (SELECT compound FROM {_values([(c,) for c in fixtures.COMPOUNDS], 'compound')})"
UPPER = r"^\p{Lu}"


VALID = f"{oracle_sql.WORDS}, valid AS (SELECT word FROM words)"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scratch(spark, "seen").table(stats.seen(paragraphs(spark, sf_dir)), "seen")


def _counts(spark: SparkSession, sf_dir: str, keys: list[str] = []) -> DataFrame:
    return tokens.token_counts(paragraphs(spark, sf_dir), keys)


def _mapped(f, kind: str):
    """A kernel over one text as a column function."""
    return F.pandas_udf(lambda s: s.map(f, na_action="ignore"), kind)


# --- Tokens and character functions ---


@query(f"WITH {TOKS} SELECT book_id, token_class, count(*) AS n FROM toks GROUP BY ALL")
def gen1_token_class_counts(spark, sf_dir):
    counts = _counts(spark, sf_dir, ["book_id"])
    return counts.groupBy("book_id", charset.letters_class_col(F.col("tok")).alias("token_class")).agg(F.sum("n").alias("n"))


@query(f"WITH {TOKS} SELECT lower(tok) AS first, lower(next) AS second, count(*) AS n FROM toks WHERE gap_after = ' ' AND next IS NOT NULL GROUP BY ALL")
def gen2_bigrams(spark, sf_dir):
    pairs = tokens.bigrams(_toks(spark, sf_dir))
    return pairs.groupBy(F.lower("first").alias("first"), F.lower("second").alias("second")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PARAS} SELECT book_id, sum(len(regexp_extract_all(text, '\\s+|\\S+')))::BIGINT AS n_pieces FROM paras GROUP BY ALL")
def gen5_pieces(spark, sf_dir):
    pieces = F.regexp_extract_all("text", F.lit(r"(\s+|\S+)"), F.lit(1))
    return paragraphs(spark, sf_dir).groupBy("book_id").agg(F.sum(F.size(pieces)).alias("n_pieces"))


@query(f"WITH {TOKS} SELECT length(regexp_replace(lower(tok), '[^{TONED}]', '', 'g'))::INT AS marks, count(*) AS n FROM toks GROUP BY ALL")
def scl6_tone_marks(spark, sf_dir):
    return _counts(spark, sf_dir).groupBy(charset.tone_marks_col(F.col("tok")).alias("marks")).agg(F.sum("n").alias("n"))


@query(f"""WITH {TOKS} SELECT translate(translate(lower(tok), '{TONED}', '{charset.BARE}'), 'ăâêôơưđ', 'aaeooud') AS plain,
    count(*) AS n, count(DISTINCT lower(tok)) AS forms FROM toks GROUP BY ALL""")
def scl8_plain_forms(spark, sf_dir):
    low = _counts(spark, sf_dir).groupBy(F.lower("tok").alias("low")).agg(F.sum("n").alias("k"))
    return low.groupBy(charset.strip_all_col(F.col("low")).alias("plain")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("forms"))


@query(f"""WITH {TOKS}, p AS (SELECT lower(tok) AS a, lower(next) AS b FROM toks WHERE gap_after = ' ' AND next IS NOT NULL),
    f AS (SELECT a, b, translate(translate(a[1], '{TONED}', '{charset.BARE}'), 'ăâêôơư', 'aaeoou') AS x, translate(translate(b[1], '{TONED}', '{charset.BARE}'), 'ăâêôơư', 'aaeoou') AS y FROM p)
    SELECT (length(a) <> length(b) OR x = y OR (regexp_matches(a, '^{V}') AND regexp_matches(b, '^{V}'))) AS keeps, count(*) AS n FROM f GROUP BY ALL""")
def scl17_keeps_onset(spark, sf_dir):
    pairs = tokens.bigrams(_toks(spark, sf_dir))
    return pairs.groupBy(charset.keeps_onset_col(F.lower("first"), F.lower("second")).alias("keeps")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOKS} SELECT translate(lower(tok), '{TONED}', '{charset.BARE}') AS bare, count(*) AS n FROM toks GROUP BY ALL")
def scl5_strip_tone(spark, sf_dir):
    return _counts(spark, sf_dir).groupBy(charset.strip_tone_col(F.col("tok")).alias("bare")).agg(F.sum("n").alias("n"))


@query(f"""WITH {PARAS}, c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM paras)
    SELECT c, contains('{VOWEL_CHARS}', c) AS is_vowel, contains('{LETTERS}', c) AS is_letter FROM c WHERE c <> ''""")
def scl9_letters_and_vowels(spark, sf_dir):
    chars = paragraphs(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).filter("c <> ''").distinct()
    return chars.select("c", charset.is_vowel_col(F.col("c")).alias("is_vowel"), charset.is_letters_col(F.col("c")).alias("is_letter"))


@query(f"WITH {TOKS} SELECT DISTINCT tok, substr(tok, 1, 2) || ' ' || substr(tok, 3) AS cut FROM toks WHERE length(tok) >= 4")
def scl12_put_spaces(spark, sf_dir):
    cut = _mapped(lambda t: candidates.put_spaces(t, f"{t[:2].lower()} {t[2:].lower()}"), "string")
    return _counts(spark, sf_dir).filter(F.length("tok") >= 4).select("tok", cut("tok").alias("cut"))


@query(f"""WITH {PARAS} SELECT book_id, entry_ix, para_ix, CASE WHEN text = '' THEN '∅' ELSE array_to_string(list_transform(string_split(text, ''), lambda c: CASE
    WHEN c = ' ' THEN '␣' WHEN c = chr(9) THEN '⇥' WHEN regexp_matches(c, '[\\x{{00}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}\\x{{AD}}\\x{{200B}}-\\x{{200F}}]') THEN '⟨U+' || format('{{:04X}}', ord(c)) || '⟩' ELSE c END), '') END AS text
    FROM paras""")
def scl15_visible(spark, sf_dir):
    return paragraphs(spark, sf_dir).select(*KEY, _mapped(report.visible, "string")("text").alias("text"))


@query(f"""WITH {TOKS}, p AS (SELECT lower(tok) AS a, lower(next) AS b FROM toks WHERE gap_after = ' ' AND next IS NOT NULL)
    SELECT translate(translate(a[1], '{TONED}', '{charset.BARE}'), 'ăâêôơư', 'aaeoou') = translate(translate(b[1], '{TONED}', '{charset.BARE}'), 'ăâêôơư', 'aaeoou') AS same, count(*) AS n
    FROM p GROUP BY ALL""")
def scl16_same_letter(spark, sf_dir):
    pairs = tokens.bigrams(_toks(spark, sf_dir))
    return pairs.groupBy(charset.same_letter_col(F.col("first"), F.col("second")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


_CASES = [("Duơng", "dương"), ("xử dụng", "sử dụng"), ("Xử dụng", "sử dụng"), ("ẩnh", "ảnh"), ("Ước", "ước mơ")]


@query(f"""SELECT old, new, CASE WHEN old[1] = upper(old[1]) AND old[1] <> lower(old[1]) THEN upper(new[1]) || substr(new, 2) ELSE new END AS recased FROM {_values(_CASES, "old, new")}""")
def scl11_recapitalise(spark, sf_dir):
    df = spark.createDataFrame(_CASES, "old string, new string")
    return df.withColumn("recased", charset.recapitalise_col(F.col("old"), F.col("new")))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def scl4_escape(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", xhtml.encode_entities_col(F.col("text")).alias("escaped"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS plain FROM pages""")
def scl3_named_entities(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", xhtml.decode_named_col(F.col("html")).alias("plain"))


_ENTITY_CASES = [("a&amp;b", "a&b"), ("&#273;i", "đi"), ("&#x111;i", "đi"), ("&khonghieu;", "&khonghieu;"), ("&amp;lt;", "&lt;"), ("&#38;amp;", "&amp;"), ("&#xD800;", "&#xD800;"), ("& alone", "& alone")]


@query(f"SELECT raw, plain FROM {_values(_ENTITY_CASES, 'raw, plain')}")
def scl3_entities(spark, sf_dir):
    df = spark.createDataFrame([(r,) for r, _ in _ENTITY_CASES], "raw string")
    return df.withColumn("plain", F.pandas_udf(lambda s: s.map(lambda t: xhtml.decode_entities(t)[0]), "string")(F.col("raw")))


# --- Normalisation: each rule over every line ---


def _rule(sql: str | None, rule):
    def run(spark, sf_dir):
        return paragraphs(spark, sf_dir).select(*KEY, rule(F.col("text")).alias("text"))

    return run, (f"WITH {PARAS} SELECT book_id, entry_ix, para_ix, {sql} AS text FROM paras" if sql else None)


_CODES = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in charset.INVISIBLE) + "]"
_ODD = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in charset.ODD_SPACES) + "]"
_RULES = {
    "scl1_unicode": (f"regexp_replace(regexp_replace(text, '{_CODES}', '', 'g'), '{_ODD}', ' ', 'g')", layers.clean_unicode),
    "scl2_nfc": ("nfc_normalize(text)", layers.compose),
    "pun1_space_before_closing": (r"regexp_replace(regexp_replace(text, ' ([,;:!?…)\]}])', '\1', 'g'), ' \.([^.]|$)', '.\1', 'g')", layers.space_before_closing),
    "pun2_space_after_opening": (r"regexp_replace(text, '([(\[{]) ', '\1', 'g')", layers.space_after_opening),
    "pun3_missing_space": (oracle_sql.missing_space("text"), layers.missing_space),
    "pun4_sentence_space": (oracle_sql.sentence_space("text"), layers.missing_sentence_space),
    "pun5_many_dots": (r"regexp_replace(text, '\.{4,}', '...', 'g')", layers.merge_dots),
    "pun6_ellipsis": (oracle_sql.dots("text", "= 3", "…"), layers.ellipsis_char),
    "wsp_collapse_trim": ("trim(regexp_replace(text, ' {2,}', ' ', 'g'), ' ')", layers.collapse_spaces),
}
for _name, (_sql, _f) in _RULES.items():
    QUERIES[_name], _oracle = _rule(_sql, _f)
    if _oracle:
        ORACLE_SQL[_name] = _oracle


@query(f"WITH {PARAS}, {oracle_sql.normalised('paras')} SELECT * FROM normal")
def dec1_normalised(spark, sf_dir):
    """All stateless text rules, as the streaming plan runs them."""
    return rules.normalised(paragraphs(spark, sf_dir))


# --- Syllables and tone ---


@query(f"WITH {VALID} SELECT length(word)::INT AS letters, count(*) AS n FROM valid GROUP BY ALL")
def syl1_valid_words(spark, sf_dir):
    return syllable_table(spark).groupBy(F.length("word").alias("letters")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {oracle_sql.WORDS} SELECT word, onset, rhyme, tone::INT AS tone, old_spelling, new_spelling FROM words")
def syl6_spellings(spark, sf_dir):
    """Every valid word with its onset, rhyme, tone and both spellings: frames, stops, shared letters and places of marks."""
    return syllable_table(spark)


_VIET = f"c AS (SELECT lower(tok) AS word, count(*) AS n FROM toks WHERE token_class = 'viet' GROUP BY ALL)"
_REST = f"regexp_replace(translate(word, '{TONED}', '{charset.BARE}'), '^({'|'.join(charset.ONSETS)})', '')"
_AUDIT = f"bad AS (SELECT word, n, n / (SELECT sum(n) FROM c) AS share, {_REST} AS rest FROM c ANTI JOIN valid USING (word))"


def _viet_words(spark, sf_dir):
    viet = _counts(spark, sf_dir).filter(charset.letters_class_col(F.col("tok")) == "viet")
    return viet.groupBy(F.lower("tok").alias("word")).agg(F.sum("n").alias("n"))


@query(f"WITH {VALID}, {TOKS}, {_VIET}, {_AUDIT} SELECT * FROM bad")
def agg11_invalid_words(spark, sf_dir):
    return stats.audit(_viet_words(spark, sf_dir), syllable_table(spark), top=None)


@query(f"WITH {VALID}, {TOKS}, {_VIET}, {_AUDIT} SELECT *, row_number() OVER (ORDER BY n DESC, word)::INT AS place FROM bad ORDER BY n DESC, word LIMIT 60")
def agg11_audit(spark, sf_dir):
    return stats.audit(_viet_words(spark, sf_dir), syllable_table(spark))


@query(f"""WITH {TOKS} SELECT DISTINCT tok, {"".join("regexp_replace(" for _ in range(12))}tok{"".join(f", '(^|[^qQ]){u}([ơờớởỡợƠỜỚỞỠỢ])', '\\1{w}\\2')" for u, w in zip("uùúủũụUÙÚỦŨỤ", "ưừứửữựƯỪỨỬỮỰ"))} AS repaired
    FROM toks WHERE regexp_matches(translate(lower(tok), '{TONED}', '{charset.BARE}'), '(^|[^q])uơ[cmnpth]')""")
def syl10_repaired_uo(spark, sf_dir):
    toks = paragraphs(spark, sf_dir).select("text").unionByName(_novel(spark, sf_dir).select("text"))
    found = tokens.token_counts(toks, []).select("tok", _mapped(candidates.repair_uo, "string")("tok").alias("repaired"))
    return found.filter("repaired IS NOT NULL")


_TWO = "two AS (SELECT word, old_spelling, new_spelling FROM words WHERE rhyme IN ('oa', 'oe', 'uy') AND tone > 0)"


def _style_sql(toks: str) -> str:
    return f"""v AS (
        SELECT book_id, count(*) FILTER (WHERE word = old_spelling) AS n_old, count(*) FILTER (WHERE word <> old_spelling AND word = new_spelling) AS n_new
        FROM (SELECT book_id, lower(tok) AS low FROM {toks} WHERE token_class = 'viet') t LEFT JOIN two ON two.word = t.low GROUP BY ALL),
    style AS (SELECT book_id, n_old, n_new, CASE WHEN n_new > n_old THEN 'new' ELSE 'old' END AS style,
           CASE WHEN n_old + n_new = 0 THEN 0.0 ELSE least(n_old, n_new) / (n_old + n_new) END::DOUBLE AS minority FROM v)"""


@query(f"WITH {oracle_sql.WORDS}, {_TWO}, {TOKS}, {_style_sql('toks')} SELECT * FROM style")
def agg1_tone_style(spark, sf_dir):
    return stats.tone_style(_seen(spark, sf_dir), syllable_table(spark))


@query(f"""WITH {oracle_sql.WORDS}, {TOKS}, {_VIET} SELECT word, old_spelling, n FROM c JOIN words USING (word) WHERE word <> old_spelling AND word <> new_spelling""")
def ton1_respelled(spark, sf_dir):
    """Words whose tone mark stands on the wrong vowel, with their right spelling, in every line's words."""
    table = syllable_table(spark).select("word", "old_spelling", "new_spelling")
    return _viet_words(spark, sf_dir).join(F.broadcast(table), "word").filter("word <> old_spelling AND word <> new_spelling").select("word", "old_spelling", "n")


@query(f"""WITH {oracle_sql.WORDS}, {TOKS}, low AS (SELECT DISTINCT tok, lower(tok) AS word FROM toks WHERE token_class = 'viet' AND (tok = lower(tok) OR tok = upper(tok[1]) || lower(substr(tok, 2)))),
    w AS (SELECT tok, CASE WHEN tok = word THEN old_spelling ELSE upper(old_spelling[1]) || substr(old_spelling, 2) END AS old, CASE WHEN tok = word THEN new_spelling ELSE upper(new_spelling[1]) || substr(new_spelling, 2) END AS new
          FROM low JOIN words USING (word)) SELECT tok, old, new FROM w""")
def ton1_layer_words(spark, sf_dir):
    """The tone layer's spelling of every word of one case in both styles."""
    toks = _counts(spark, sf_dir).filter(charset.letters_class_col(F.col("tok")) == "viet").select("tok")
    low = toks.filter((F.col("tok") == F.lower("tok")) | (F.col("tok") == F.concat(F.upper(F.left("tok", F.lit(1))), F.lower(F.substr("tok", F.lit(2))))))
    spelt = [_mapped(lambda t, style=style: layers.respell(t, style), "string")("tok").alias(name) for name, style in (("old", False), ("new", True))]
    return low.select("tok", *spelt).filter("old IS NOT NULL")


# --- Book statistics and detection ---


@query(f"WITH {TOKS} SELECT book_id, lower(tok) AS word, count(*) AS n FROM toks WHERE token_class = 'viet' GROUP BY ALL HAVING count(*) >= 3")
def agg6_used_words(spark, sf_dir):
    return stats.used_words(_seen(spark, sf_dir))


_NAMES = f"""names AS (
    SELECT book_id, lower(tok) AS word, count(*) AS n FROM toks
    WHERE token_class = 'viet' AND regexp_matches(tok, '{UPPER}') AND prev IS NOT NULL AND regexp_matches(gap, '^[ ,;]*$') AND lower(tok) NOT IN (SELECT syllable FROM lex)
    GROUP BY ALL HAVING count(*) >= 3)"""


@query(f"WITH {TOKS}, {LEX}, {_NAMES} SELECT * FROM names")
def agg4_names(spark, sf_dir):
    return stats.names(_seen(spark, sf_dir), fixtures.syllables(spark))


@query(f"""WITH {TOKS}, {LEX}, {COMP} SELECT book_id, lower(tok) || ' ' || lower(next) AS phrase, count(*) AS n FROM toks
    WHERE gap_after = ' ' AND token_class IN ('viet', 'plain') AND regexp_matches(tok, '{UPPER}') AND regexp_matches(next, '{UPPER}') AND prev IS NOT NULL
      AND regexp_matches(gap, '^[ ,;]*$') AND NOT (next = upper(next) AND length(next) > 1) AND lower(tok) IN (SELECT syllable FROM lex) AND lower(next) IN (SELECT syllable FROM lex)
      AND lower(tok) || ' ' || lower(next) NOT IN (SELECT compound FROM comp)
    GROUP BY ALL HAVING count(*) >= 3""")
def agg5_name_clusters(spark, sf_dir):
    return stats.name_clusters(_seen(spark, sf_dir), fixtures.syllables(spark), fixtures.compounds(spark))


@query(f"""WITH {VALID}, {TOKS}, {LEX}, {_NAMES}
    SELECT book_id, lower(tok) AS word, count(*) AS n FROM toks t
    WHERE token_class = 'viet' AND lower(tok) NOT IN (SELECT syllable FROM lex) AND lower(tok) NOT IN (SELECT word FROM valid)
      AND NOT EXISTS (SELECT 1 FROM names WHERE names.book_id = t.book_id AND names.word = lower(t.tok)) GROUP BY ALL""")
def flt2_suspicious_words(spark, sf_dir):
    seen, lex = _seen(spark, sf_dir), fixtures.syllables(spark)
    return stats.suspicious_words(seen, lex, syllable_table(spark), stats.names(seen, lex))


@query(f"WITH {TOKS} SELECT book_id, count(*) AS n_tokens, count(prev) AS with_prev, count(next) AS with_next, count(*) FILTER (WHERE prev = next) AS same_sides FROM toks GROUP BY ALL")
def win1_neighbours(spark, sf_dir):
    t = _toks(spark, sf_dir).groupBy("book_id")
    return t.agg(F.count(F.lit(1)).alias("n_tokens"), F.count("prev").alias("with_prev"), F.count("next").alias("with_next"), F.count_if(F.col("prev") == F.col("next")).alias("same_sides"))


@query("""SELECT conv_id AS book_id, 0::BIGINT AS entry_ix, turn AS para_ix, text, coalesce(lag(text) OVER w, '') AS before, coalesce(lead(text) OVER w, '') AS after
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def win2_paragraph_context(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.lit(0).cast("bigint").alias("entry_ix"), F.col("turn").alias("para_ix"), "text")
    return tokens.paragraph_context(turns)


# --- Confusables ---

def _cnf_sql(section: str) -> str:
    grams = " UNION ALL ".join(
        f"SELECT book_id, entry_ix, para_ix, pos, {n} AS n, array_to_string(ps[pos + 1:pos + {2 * n - 1}], '') AS before FROM items WHERE regexp_matches(tok, '^{L}') AND len(ps) >= pos + {2 * n - 1}"
        for n in (2, 3, 4)
    )
    return f"""WITH {TOKS}, {oracle_sql.CONFUSABLE_ROWS},
        conf AS (SELECT phrase, len(string_split(phrase, ' ')) AS n, value FROM confusable WHERE section = '{section}' AND phrase <> lower(value)), grams AS ({grams}),
        hits AS (SELECT g.*, c.phrase, CASE WHEN before[1] = upper(before[1]) AND before[1] <> lower(before[1]) THEN upper(value[1]) || substr(value, 2) ELSE value END AS after
                 FROM grams g JOIN conf c ON g.n = c.n AND regexp_replace(lower(before), ' +', ' ', 'g') = c.phrase)
        SELECT book_id, entry_ix, para_ix, pos::INT AS pos, phrase, before, after FROM hits"""


def _cnf(section: str):
    def run(spark, sf_dir):
        found = confusables.phrase_matches(paragraphs(spark, sf_dir), lexicon.confusable_table(spark))
        return found.filter(F.col("section") == section).drop("section", "n")

    return run


for _key, _section in (("joi7_always_wrong", "always"), ("joi7_depends_on_meaning", "meaning")):
    QUERIES[_key], ORACLE_SQL[_key] = _cnf(_section), _cnf_sql(_section)


def _text_lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_ix int, value string")


@query(f"WITH {oracle_sql.TYPO_ROWS} SELECT typo, array_to_string(answers, ',') AS answers FROM typos")
def src8_typos(spark, sf_dir):
    return lexicon.typo_lines(_text_lines(spark, TYPOS)).select("typo", F.array_join("answers", ",").alias("answers"))


@query(f"WITH {oracle_sql.CONFUSABLE_ROWS} SELECT section, phrase, value FROM confusable WHERE phrase <> lower(value)")
def src9_confusables(spark, sf_dir):
    return lexicon.confusable_lines(_text_lines(spark, CONFUSABLES)).select("section", F.array_join("key", " ").alias("phrase"), "value")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def src10_json_text(spark, sf_dir):
    lines = _read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.to_json(F.struct("text")).alias("value"))
    return lines.select("doc_id", F.get_json_object("value", "$.text").alias("text"))


# --- Candidates, ranking, decisions ---

_TOKENS = "khôngg phảii mộtt ẩnh đnag khôgn đing lưư măy thuơng Duơng chúg nhưmg cẳu hoat Phúlần củangười khôngbiết erằng ngồiở việcc cuốic".split()


def _found(spark, sf_dir):
    """Suspicious tokens of all lines, and the listed ones between two words of a book of their own: book_id, tok, prev, next."""
    lex = fixtures.syllables(spark)
    toks = tokens.tokens(paragraphs(spark, sf_dir), keep=tokens.has_marks)
    found = stats.suspicious(toks, lex, syllable_table(spark), stats.names(_seen(spark, sf_dir), lex)).select("book_id", "tok", "prev", "next")
    return found.unionByName(spark.createDataFrame([("vi", t, "tình", "ta") for t in _TOKENS], "book_id string, tok string, prev string, next string"))


def _made(spark, found):
    return rank.candidate_table(found.select("tok").distinct(), fixtures.syllables(spark), fixtures.compounds(spark))


@query()
def gen3_candidates(spark, sf_dir):
    return _made(spark, _found(spark, sf_dir)).select("tok", F.posexplode("cands").alias("place", "c")).select("tok", "place", "c.cand", "c.cost")


@query()
def gen4_splits(spark, sf_dir):
    return _made(spark, _found(spark, sf_dir)).select("tok", F.posexplode("splits").alias("place", "split"))


def _correction(spark, sf_dir, **kw):
    return correct(paragraphs(spark, sf_dir), fixtures.syllables(spark), fixtures.compounds(spark), **kw)


@query()
def srt1_ranked_candidates(spark, sf_dir):
    seen, lex, comps = _seen(spark, sf_dir), fixtures.syllables(spark), fixtures.compounds(spark)
    found = Scratch(spark, "ranked").table(_found(spark, sf_dir).withColumn("case_id", F.monotonically_increasing_id()), "found")
    cases = found.join(_made(spark, found), "tok")
    clusters = stats.name_clusters(seen, lex, comps).select("book_id", "phrase")
    clusters = clusters.unionByName(spark.createDataFrame([("vi", "hỏa dương")], "book_id string, phrase string"))
    used = stats.used_words(seen).select("book_id", "word").unionByName(spark.createDataFrame([("vi", "không")], "book_id string, word string"))
    out = rank.rank_candidates(cases, lex, comps, clusters, used, lexicon.typo_table(spark))
    return out.drop("case_id")


@query()
def dec6_corrected_paragraphs(spark, sf_dir):
    return _correction(spark, sf_dir).paragraphs


@query()
def dec6_edit_log(spark, sf_dir):
    return _correction(spark, sf_dir).edits


@query()
def dec6_open_cases(spark, sf_dir):
    return _correction(spark, sf_dir).open


@query()
def dec7_scored_paragraphs(spark, sf_dir):
    scorer = decide.SharedBigramScorer([t for *_, t in fixtures.PARAGRAPHS])
    return _correction(spark, sf_dir, scorer=scorer, options=lexicon.Options.with_scoring(False)).paragraphs


@query()
def dec10_blank_fill_paragraphs(spark, sf_dir):
    scorer = decide.SharedBigramScorer([t for *_, t in fixtures.PARAGRAPHS])
    return _correction(spark, sf_dir, scorer=scorer, options=lexicon.Options.with_scoring(True)).paragraphs


# --- The generated book: every answer is known ---

NOVEL = book.sql()


def _book_correction(spark):
    return correct(_novel(spark, ""), fixtures.syllables(spark), fixtures.compounds(spark))


@query(f"WITH {NOVEL} SELECT book_id, entry_ix, para_ix, given AS text_before, fixed AS text FROM novel")
def dec6_book_paragraphs(spark, sf_dir):
    return _book_correction(spark).paragraphs


@query(f"WITH {NOVEL} SELECT book_id, entry_ix, para_ix, layer, before, after, kind, count(*) AS n FROM planted GROUP BY ALL")
def dec6_book_edits(spark, sf_dir):
    return _book_correction(spark).edits.groupBy(*KEY, "layer", "before", "after", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOVEL} SELECT book_id, entry_ix, para_ix, before, candidate, 'confusable' AS kind FROM left_open")
def dec6_book_open_cases(spark, sf_dir):
    return _book_correction(spark).open.select(*KEY, "before", F.array_join("cands", ", ").alias("candidate"), "kind")


@query(f"WITH {NOVEL} SELECT kind, count(*) AS n FROM planted GROUP BY ALL")
def agg7_edits_by_kind(spark, sf_dir):
    return report.edits_by_kind(_book_correction(spark).edits)


@query(f"WITH {NOVEL} SELECT kind, before, after, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, before, after)::INT AS place FROM (SELECT kind, before, after, count(*) AS n FROM planted GROUP BY ALL)")
def agg8_report_top(spark, sf_dir):
    return report.grouped_edits(_book_correction(spark).edits).drop("reason")


@query(f"WITH {NOVEL} SELECT before, candidate AS candidates, count(*) AS n FROM left_open GROUP BY ALL")
def agg9_open_cases(spark, sf_dir):
    return report.grouped_open(_book_correction(spark).open)


@query(f"WITH {NOVEL} SELECT book_id, count(*) * 2 AS n_calls FROM left_open GROUP BY ALL")
def agg14_scorer_calls(spark, sf_dir):
    return report.scorer_calls(_book_correction(spark).open)


@query(f"""WITH {oracle_sql.WORDS}, {_TWO}, {NOVEL},
    book_toks AS (SELECT book_id, unnest(regexp_extract_all(nfc_normalize(given), '{L}+')) AS tok FROM novel),
    toks AS (SELECT *, CASE WHEN regexp_matches(tok, '[^\\x00-\\x7F]') AND NOT (tok = upper(tok) AND length(tok) > 1) AND regexp_matches(lower(tok), '{V}') THEN 'viet' END AS token_class FROM book_toks),
    {_style_sql('toks')}
    SELECT p.*, e.n_edits, e.n_errors, 0::BIGINT AS n_doubtful, o.n_open, s.n_old, s.n_new, s.style, s.minority
    FROM (SELECT book_id, count(DISTINCT entry_ix) AS n_files, count(*) AS n_paragraphs, sum(length(given))::BIGINT AS n_chars FROM novel GROUP BY ALL) p
    JOIN (SELECT book_id, count(*) AS n_edits, count(*) FILTER (WHERE kind NOT IN ({", ".join(map(repr, STYLE_KINDS))})) AS n_errors FROM planted GROUP BY ALL) e USING (book_id)
    JOIN (SELECT book_id, count(*) AS n_open FROM left_open GROUP BY ALL) o USING (book_id) JOIN style s USING (book_id)""")
def snk4_book_summary(spark, sf_dir):
    c = _book_correction(spark)
    return report.book_summary(c.paragraphs, c.edits, c.open, c.stats.style)


# --- Edits ---

_EDITS = [
    ("abc", [(0, 2, "X"), (1, 3, "Y")], "Xc", 1),
    ("nói , rồi đi .", [(3, 4, ""), (12, 13, "")], "nói, rồi đi.", 2),
    ("bỏ hết", [(0, 6, "")], "", 1),
    ("", [(0, 0, "thêm mới")], "thêm mới", 1),
    ("abc", [(2, 9, "Z")], "abc", 0),
]


@query(f"SELECT text, result, n::INT AS n FROM {_values([(t, r, n) for t, _, r, n in _EDITS], 'text, result, n')}")
def edt1_apply_edits(spark, sf_dir):
    df = spark.createDataFrame([(t, e) for t, e, _, _ in _EDITS], "text string, edits array<struct<start:int,end:int,after:string>>")
    out = df.withColumn("x", edits.apply_edits_col(F.col("text"), F.col("edits")))
    return out.select("text", F.col("x.text").alias("result"), F.col("x.n_applied").alias("n"))


@query(f"WITH {PARAS}, {oracle_sql.normalised('paras')} SELECT n.* FROM normal n JOIN paras p USING (book_id, entry_ix, para_ix) WHERE n.text <> p.text")
def edt4_diff(spark, sf_dir):
    """The lines that the text rules change, made again by applying the hunks between the line and its new text."""
    changed = paragraphs(spark, sf_dir).withColumnRenamed("text", "old")
    new = rules.normalised(changed.withColumn("text", F.col("old"))).filter("old <> text")
    hunks = F.pandas_udf(_hunk_lists, "array<struct<start:int,end:int,after:string>>")
    return new.select(*KEY, edits.apply_edits_col(F.col("old"), hunks(F.col("old"), F.col("text")))["text"].alias("text"))


def _hunk_lists(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"start": h.start, "end": h.end, "after": h.text} for h in editing.diff(x, y)] for x, y in zip(a, b, strict=True)])


@query("""WITH c AS (SELECT conv_id, turn, text, regexp_extract(text, '\\S+') AS piece, length(text) // 2 AS near FROM conversations WHERE regexp_matches(text, '\\S'))
    SELECT conv_id, turn, (list_min(list_transform(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(piece)) = piece), lambda i: abs(i - near) * 1000000 + i)) % 1000000)::INT AS place FROM c""")
def edt3_nearest(spark, sf_dir):
    """Where the first word of a turn stands nearest to its middle."""
    turns = _read(spark, sf_dir, "conversations").filter(F.col("text").rlike(r"\S"))
    place = F.pandas_udf(lambda t, p: pd.Series([editing.nearest(x, y, len(x) // 2) for x, y in zip(t, p, strict=True)], dtype="int32"), "int")
    return turns.select("conv_id", "turn", place("text", F.regexp_extract("text", r"(\S+)", 1)).alias("place"))


@query(f"""WITH c AS (SELECT conv_id, turn, text, length(text) // 2 AS s, least(length(text) // 2 + 3, length(text)) AS e FROM conversations WHERE text IS NOT NULL),
    w AS (SELECT *, length(regexp_extract(substr(text, 1, s + 1), '(?s)^(.*[.!?] )', 1)) AS lo,
                 e + length(CASE WHEN regexp_matches(substr(text, e + 1), '[.!?]') THEN regexp_extract(substr(text, e + 1), '(?s)^[^.!?]*[.!?]') ELSE substr(text, e + 1) END) AS hi FROM c),
    x AS (SELECT *, substr(text, lo + 1, s - lo) AS l, substr(text, e + 1, hi - e) AS r, strlen(substr(text, lo + 1, hi - lo)) > 400 AS far FROM w)
    SELECT conv_id, turn, (CASE WHEN far THEN s - list_max(list_filter(range(0, 201), lambda n: n <= length(l) AND strlen(right(l, n::INT)) <= 200)) ELSE lo END)::INT AS lo,
           (CASE WHEN far THEN e + list_max(list_filter(range(0, 201), lambda n: n <= length(r) AND strlen(left(r, n::INT)) <= 200)) ELSE hi END)::INT AS hi FROM x""")
def dec9_sentence_windows(spark, sf_dir):
    """The sentence around three characters in the middle of each turn, by its offsets."""

    def windows(texts: pd.Series) -> pd.Series:
        return pd.Series([dict(zip(("lo", "hi"), editing.sentence_window(t, len(t) // 2, min(len(t) // 2 + 3, len(t))), strict=True)) for t in texts])

    turns = _read(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    found = turns.select("conv_id", "turn", F.pandas_udf(lambda t: pd.DataFrame(windows(t).tolist(), columns=["lo", "hi"]), "lo int, hi int")("text").alias("w"))
    return found.select("conv_id", "turn", "w.lo", "w.hi")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, vec_id % 70 AS i FROM embeddings WHERE embedding IS NOT NULL)
    SELECT vec_id, round(CASE WHEN i < len(x) THEN x[i + 1] - list_max(x) - ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) ELSE -20 END, 5) AS log_p FROM e""")
def udf4_log_softmax(spark, sf_dir):
    score = F.pandas_udf(lambda x, i: pd.Series([decide.log_softmax_at(a.astype("float64"), int(b)) for a, b in zip(x, i, strict=True)]), "double")
    found = _read(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    return found.select("vec_id", F.round(score("embedding", F.col("vec_id") % 70), 5).alias("log_p"))


@query(f"""WITH {PARAS}, c AS (SELECT book_id, entry_ix, para_ix, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1)::INT - 1 AS start FROM paras)
    SELECT book_id, entry_ix, para_ix, start, ord(c)::INT AS code FROM c WHERE regexp_matches(c, '^({_CODES}|{_ODD})$')""")
def edt7_character_edits(spark, sf_dir):
    found = paragraphs(spark, sf_dir).filter(F.col("text").rlike(f"[{charset.INVISIBLE}{charset.ODD_SPACES}]"))
    each = found.select(*KEY, F.posexplode(F.split("text", "")).alias("start", "c"))
    return each.filter(F.col("c").rlike(f"^[{charset.INVISIBLE}{charset.ODD_SPACES}]$")).select(*KEY, "start", F.expr("conv(hex(encode(c, 'utf-16be')), 16, 10)").cast("int").alias("code"))


_FRAGMENTS = [(0, 4, 10), (4, 9, 20)]
_RANGES = [(1, 3, 11, 13), (4, 6, 20, 22), (3, 5, None, None), (0, 9, None, None)]


@query(f"SELECT s::INT AS s, e::INT AS e, f_start::INT AS f_start, f_end::INT AS f_end FROM {_values(_RANGES, 's, e, f_start, f_end')}")
def joi8_file_ranges(spark, sf_dir):
    df = spark.createDataFrame([(_FRAGMENTS, s, e) for s, e, _, _ in _RANGES], "f array<struct<p_start:int,p_end:int,f_start:int>>, s int, e int")
    r = edits.file_range_col(F.col("f"), F.col("s"), F.col("e"))
    return df.withColumn("r", r).select("s", "e", "r.f_start", "r.f_end")


# --- Pages and archives ---


def _page_texts() -> str:
    gone = "regexp_replace(html, '(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|<\\?.*?\\?>|<![^>]*>', '', 'g')"
    for tag in ("script", "style", "code", "pre"):
        gone = f"regexp_replace({gone}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    cut = f"string_split(regexp_replace({gone}, '(?i)</?({'|'.join(BLOCK_TAGS)})([^a-zA-Z0-9:>][^>]*)?>', chr(30), 'g'), chr(30))"
    plain = "regexp_replace(x, '<[^>]*>', '', 'g')"
    for name, char in ENTITIES.items():
        if name != "amp":
            plain = f"replace({plain}, '&{name};', chr({ord(char)}))"
    return f"""WITH t AS (SELECT page_id, list_filter(list_transform({cut}, lambda x: replace({plain}, '&amp;', '&')), lambda x: regexp_replace(x, '[\\s\\x{{A0}}]', '', 'g') <> '') AS texts FROM pages)
        SELECT page_id, generate_subscripts(texts, 1)::INT - 1 AS ix, unnest(texts) AS text FROM t"""


@query(f"SELECT page_id, ix AS para_ix, text FROM ({_page_texts()})")
def src5_page_paragraphs(spark, sf_dir):
    return xhtml.paragraphs(_read(spark, sf_dir, "pages"), ["page_id"]).drop("fragments")


@query(f"SELECT page_id, ix AS block_ix, text FROM ({_page_texts()})")
def src5_block_texts(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.posexplode(xhtml.block_texts_col(F.col("html"))).alias("block_ix", "text"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(html, '<[^>]*>')) AS tag FROM pages)
    SELECT lower(regexp_extract(tag, '^<+/?(?:[A-Za-z0-9]*:)*([A-Za-z0-9]*)', 1)) AS name, starts_with(ltrim(tag, '<'), '/') AS closes, count(*) AS n FROM t GROUP BY ALL""")
def src6_tag_names(spark, sf_dir):
    tags = _read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("(<[^>]*>)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("k"))
    names = F.pandas_udf(lambda s: pd.DataFrame([xhtml.tag_name(t) for t in s], columns=["name", "closes"]), "name string, closes boolean")
    return tags.select(names("tag").alias("t"), "k").groupBy("t.name", "t.closes").agg(F.sum("k").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN text END AS text FROM documents")
def src4_decoded_text(spark, sf_dir):
    """Files with a byte order mark, without one, and (every fifth) with bytes that are not UTF-8."""
    mark = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.lit(b""))
    wrong = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("C3"))).otherwise(F.lit(b""))
    content = F.concat(mark, F.encode("text", "UTF-8"), wrong)
    return _read(spark, sf_dir, "documents").select("doc_id", epub.decode_text(content).alias("text"))


@query(f"WITH {TOKS} SELECT DISTINCT lower(tok) AS syllable FROM toks")
def src7_word_files(spark, sf_dir):
    """All words of the texts, written as a lexicon file and read again."""
    path = f"{Scratch(spark, 'lexicon').path}/words"
    lexicon.write_words(_counts(spark, sf_dir).select(F.lower("tok").alias("syllable")), path)
    return lexicon.read_words(spark, path)


@query("SELECT doc_id, doc_id % 3 = 0 OR starts_with(coalesce(text, ''), 'GGUF') AS is_model FROM documents")
def src12_model_magic(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, F.lit(b"GGUF")).otherwise(F.lit(b""))
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", models.is_model(F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("is_model"))


@query("SELECT s_nationkey AS nation, arg_min(s_name, (-s_acctbal, s_name)) AS name, max(s_acctbal) AS memory FROM supplier GROUP BY ALL")
def top3_largest_card(spark, sf_dir):
    """The card with the most memory of each group, over suppliers and their balances."""
    cards = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("memory"))
    return models.largest_card(cards, ["nation"])


@query("SELECT s_name AS name, s_acctbal AS memory FROM supplier WHERE s_acctbal >= 4000")
def udf5_usable_cards(spark, sf_dir):
    cards = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("memory"))
    return models.usable_cards(cards, 4000)


@query("""SELECT 'doc-' || doc_id AS book_id, unnest([0, 1])::INT AS entry_ix, unnest(['mimetype', 'OEBPS/text.xhtml']) AS name, unnest(['application/epub+zip', text]) AS body
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def snk2_new_archives(spark, sf_dir):
    """Every document as an archive of its own, built and read again."""
    build = _mapped(lambda t: epub.build_archive([("mimetype", b"application/epub+zip"), ("OEBPS/text.xhtml", t.encode())]), "binary")
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("book_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = epub.entries(docs.select("book_id", build("text").alias("content")))
    return found.select("book_id", "entry_ix", "name", epub.decode_text(F.col("content")).alias("body"))


_PATHS = "'/books/' || source || '/doc.' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.epub' WHEN 1 THEN '' ELSE '/file' END"


@query(f"""WITH p AS (SELECT doc_id, {_PATHS} AS path FROM documents), f AS (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS file FROM p)
    SELECT doc_id, substr(path, 1, length(path) - length(file)) || CASE WHEN contains(file, '.') THEN regexp_extract(file, '^(.*)\\.', 1) || ' (đã sửa).' || regexp_extract(file, '[^.]*$') ELSE file || ' (đã sửa).epub' END AS path FROM f""")
def snk7_output_names(spark, sf_dir):
    end = F.when(F.col("doc_id") % 3 == 0, ".epub").when(F.col("doc_id") % 3 == 1, "").otherwise("/file")
    path = F.concat(F.lit("/books/"), "source", F.lit("/doc."), F.col("doc_id").cast("string"), end)
    return _read(spark, sf_dir, "documents").select("doc_id", _mapped(epub.output_name, "string")(path).alias("path"))


_CHAPTER = '<html><head><title>Chương một</title></head><body><p>Anh ấy xử dụng máy.</p><p>Cách x<i>ử</i> dụng &amp; máy , nhé.</p><p>Anh x<img src="a.png"/>ử dụng nó.</p><pre>xử dụng</pre></body></html>'
_OPF = "<package><metadata><dc:title>Sách thử &amp; nghiệm</dc:title></metadata></package>"
_FILES = [("mimetype", "application/epub+zip"), ("OEBPS/content.opf", _OPF), ("OEBPS/toc.xhtml", "<p>mục lục , nhé</p>"), ("OEBPS/ch1.xhtml", _CHAPTER)]


def _archives(spark):
    content = epub.build_archive([(n, t.encode()) for n, t in _FILES])
    return spark.createDataFrame([("book.epub", bytearray(content))], "book_id string, content binary")


@query(f"SELECT 'book.epub' AS book_id, ix::INT AS entry_ix, name, body FROM {_values([(i, n, t) for i, (n, t) in enumerate(_FILES)], 'ix, name, body')}")
def src1_epub_entries(spark, sf_dir):
    return epub.entries(_archives(spark)).select("book_id", "entry_ix", "name", epub.decode_text(F.col("content")).alias("body"))


@query("SELECT 'book.epub' AS book_id, 'OEBPS/ch1.xhtml' AS name")
def src2_text_entries(spark, sf_dir):
    return epub.entries(_archives(spark)).filter(epub.is_text_entry(F.col("name"))).select("book_id", "name")


@query("SELECT 'book.epub' AS book_id, 'Sách thử & nghiệm' AS title")
def src3_titles(spark, sf_dir):
    return epub.titles(epub.entries(_archives(spark)))


def correct_archives(spark, archives, lex, comps, **kw):
    """Entries, their paragraphs corrected, and the patched entries of archives (book_id, content)."""
    found = epub.entries(archives)
    files = found.filter(epub.is_text_entry(F.col("name"))).withColumn("html", epub.decode_text(F.col("content")))
    paras = xhtml.paragraphs(files, ["book_id", "entry_ix"])
    fixed = correct(paras.drop("fragments"), lex, comps, **kw)
    return fixed, epub.patch_entries(found, fixed.paragraphs)


_FIXED = _CHAPTER.replace("Anh ấy xử dụng máy.", "Anh ấy sử dụng máy.").replace("x<i>ử</i> dụng &amp; máy , nhé", "sử<i></i> dụng &amp; máy, nhé")


@query(f"SELECT ix::INT AS entry_ix, name, body FROM {_values([(i, n, _FIXED if n.endswith('ch1.xhtml') else t) for i, (n, t) in enumerate(_FILES)], 'ix, name, body')}")
def snk1_corrected_archive(spark, sf_dir):
    archives = _archives(spark)
    _, patched = correct_archives(spark, archives, fixtures.syllables(spark), fixtures.compounds(spark))
    return epub.entries(epub.rebuild(archives, patched)).select("entry_ix", "name", epub.decode_text(F.col("content")).alias("body"))


@query("SELECT 'OEBPS/ch1.xhtml' AS name, 1::INT AS conflicts")
def snk3_tag_conflicts(spark, sf_dir):
    _, patched = correct_archives(spark, _archives(spark), fixtures.syllables(spark), fixtures.compounds(spark))
    return patched.select("name", "conflicts")


# --- Reports ---

@query(f"WITH {PARAS} SELECT book_id, count(DISTINCT entry_ix) AS n_files, count(*) AS n_paragraphs, sum(length(text))::BIGINT AS n_chars FROM paras GROUP BY ALL")
def agg10_book_totals(spark, sf_dir):
    paras = paragraphs(spark, sf_dir).withColumnRenamed("text", "text_before")
    none = spark.createDataFrame([], "book_id string, kind string, certainty string")
    cases = spark.createDataFrame([], "book_id string, before string")
    style = spark.createDataFrame([], "book_id string, n_old bigint, n_new bigint, style string, minority double")
    return report.book_summary(paras, none, cases, style).select("book_id", "n_files", "n_paragraphs", "n_chars")


@query(f"""WITH {oracle_sql.TYPO_ROWS}, {oracle_sql.CONFUSABLE_ROWS}
    SELECT 'typos' AS what, count(*) AS n FROM typos UNION ALL SELECT 'confusables', count(*) FROM confusable WHERE phrase <> lower(value)
    UNION ALL SELECT 'syllables', count(DISTINCT w) FROM (SELECT unnest({[w.lower() for w in fixtures.SYLLABLES]}) AS w) UNION ALL SELECT 'compounds', {len(set(fixtures.COMPOUNDS))}""")
def agg13_cardinalities(spark, sf_dir):
    return lexicon.cardinalities(
        typos=lexicon.typo_table(spark), confusables=lexicon.confusable_table(spark), syllables=fixtures.syllables(spark).distinct(), compounds=fixtures.compounds(spark).distinct()
    )


# --- Lexicon curation ---

_ENTRIES = ["Chúng ta", "tình thương", "từ: nghĩa", "e rằng", "bêtông", "qúy", "món qúy", "alô", "abc"]


def _lexicons(spark):
    return curate.build_lexicons(spark.createDataFrame([(e,) for e in _ENTRIES], "text string"))


def _built(spark, sf_dir):
    return curate.build_lexicons(_read(spark, sf_dir, "conversations").select("text"))


@query(f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{L}+')) AS syllable FROM conversations WHERE text NOT LIKE '%:%'")
def agg12_lexicon_syllables(spark, sf_dir):
    return _built(spark, sf_dir)[0]


@query(f"SELECT DISTINCT array_to_string(w, ' ') AS compound FROM (SELECT regexp_extract_all(lower(text), '{L}+') AS w FROM conversations WHERE text NOT LIKE '%:%') WHERE len(w) > 1")
def agg12_lexicon_compounds(spark, sf_dir):
    return _built(spark, sf_dir)[1]


@query(f"WITH {VALID}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{L}+')) AS syllable FROM conversations WHERE text NOT LIKE '%:%') SELECT syllable FROM w WHERE syllable NOT IN (SELECT word FROM valid)")
def dic3_rejected_words(spark, sf_dir):
    return curate.rejected_entries(_built(spark, sf_dir)[0], syllable_table(spark))


@query(f"SELECT * FROM {_values([('bêtông',), ('alô',), ('abc',)], 'syllable')}")
def dic3_rejected_entries(spark, sf_dir):
    return curate.rejected_entries(_lexicons(spark)[0], syllable_table(spark))


_MISSPELT = ["thuơng", "bêtông", "alô", "nguời", "abc", "hoà"]


@query(f"SELECT * FROM {_values([('thuơng',), ('nguời',)], 'syllable')}")
def dic1_misspelt(spark, sf_dir):
    return curate.misspelt(spark.createDataFrame([(w,) for w in _MISSPELT], "syllable string"), syllable_table(spark))


@query(f"SELECT * FROM {_values([('tình ta',)], 'compound')}")
def dic2_cascade(spark, sf_dir):
    comps = spark.createDataFrame([("tình thuơng",), ("tình ta",), ("nguời ta",)], "compound string")
    lex = spark.createDataFrame([(w,) for w in [*_MISSPELT, "tình", "ta"]], "syllable string")
    bad = curate.misspelt(lex, syllable_table(spark))
    return curate.drop_misspelt(lex, comps, bad)[1]


_TRAPS = [(m, w, g, 0.0, s, r) for m in ("sentence", "blank") for w, g, s, r in [("a", 0.05, True, True), ("b", 0.02, True, True), ("c", 0.2, False, False), ("d", -0.1, False, False), ("e", 0.3, True, False)]]


@query(f"""SELECT mode, t.threshold, count(*) FILTER (WHERE CASE WHEN should_change THEN gain > t.threshold AND right_fix ELSE NOT gain > t.threshold END) AS n_right, count(*) AS n
    FROM {_values(_TRAPS, "mode, word, gain, first_gain, should_change, right_fix")}, (SELECT unnest([0.01, 0.03, 0.1])::DOUBLE AS threshold) t GROUP BY ALL""".replace(") AS t(mode", ") AS x(mode"))
def dic4_trap_scores(spark, sf_dir):
    traps = spark.createDataFrame(_TRAPS, "mode string, word string, gain double, first_gain double, should_change boolean, right_fix boolean")
    return curate.trap_scores(traps, [0.01, 0.03, 0.1])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token classes and rule edits per book over all documents and the fixture books."""
    counts = gen1_token_class_counts(spark, sf_dir).groupBy("book_id").pivot("token_class", ["viet", "plain", "acronym", "nonword"]).sum("n").na.fill(0)
    paras = paragraphs(spark, sf_dir)
    new = rules.normalised(paras.withColumn("old", F.col("text"))).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(F.col("old") != F.col("text")).alias("n_changed")
    )
    return counts.join(new, "book_id")
