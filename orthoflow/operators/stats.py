"""What a whole book says about itself: tone style, names, name clusters, words in use.

All of it follows from one table, `seen`: the counts of the tokens that any statistic asks for, made in one scan with partial
aggregation, so frequent words stay cheap however large a book is. Lexicons are joined to distinct words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.charset import LETTERS, ONSETS, TWO_STYLES, char_ranges, letter_class, letters_class_col, strip_tone_col

#: A word must occur this often to count as a name, cluster or word in use.
LEAST = 3


#: So many distinct tokens are counted in a task before their counts go on.
MOST_COUNTED = 200_000
#: As the column `mid_sentence`: in Java `$` also stands ahead of a last line end.
_MID_SENTENCE = r"[ ,;]*(?:\r\n|[\n\r\x85\u2028\u2029])?"


def seen(paras: DataFrame, compose: bool = False) -> DataFrame:
    """(book_id, tok, token_class, named, next, n) of the tokens that statistics ask for: with marks, or the first of a capitalised pair.

    `named`: capitalised in mid-sentence. `next`: the token after it, where both make such a pair of clean words with one space between.
    With `compose`, of the composed texts (NFC). A kernel counts within a task; texts that can hold no such token cost it one look.
    """
    letters, book = letter_class(), paras.schema["book_id"].dataType.simpleString()
    upper = "[" + char_ranges(c for c in LETTERS if c.isupper()) + "]"
    kind = to_arrow_type(paras.schema["book_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pair = re.compile(f"{letters}+").finditer, re.compile(f"{upper}{letters}* {upper}").search
        begins, mid = re.compile(upper).match, re.compile(_MID_SENTENCE).fullmatch
        counts: Counter[tuple] = Counter()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*counts, strict=True)) or [()] * 4
            kinds = (kind, pa.string(), pa.bool_(), pa.string())
            out = [*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(counts.values(), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["book_id", "tok", "mid", "beside", "n"])

        for batch in batches:
            for own, text in zip(batch.column("book_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None:
                    continue
                text = unicodedata.normalize("NFC", text) if compose else text
                plain = text.isascii()
                if plain and not pair(text):
                    continue
                words = [(m.start(), m.end(), m.group()) for m in find(text)]
                last = len(words) - 1
                for i, (start, end, tok) in enumerate(words):
                    if begins(tok):
                        beside = i < last and text[end : words[i + 1][0]] == " " and begins(words[i + 1][2])
                        if beside or not (plain or tok.isascii()):
                            middle = i > 0 and mid(text[words[i - 1][1] : start]) is not None
                            counts[own, tok, middle, words[i + 1][2] if beside else None] += 1
                    elif not (plain or tok.isascii()):
                        counts[own, tok, False, None] += 1
            if len(counts) >= MOST_COUNTED:
                yield flush()
        yield flush()

    found = paras.select("book_id", "text").mapInArrow(run, f"book_id {book}, tok string, mid boolean, beside string, n bigint")
    found = found.groupBy("book_id", "tok", "mid", "beside").agg(F.sum("n").alias("n")).withColumn("token_class", letters_class_col(F.col("tok")))
    clean = F.col("token_class").isin("viet", "plain") & letters_class_col(F.col("beside")).isin("viet", "plain")
    pair = F.col("mid") & clean & F.col("beside").isNotNull()
    rows = found.select("book_id", "tok", "token_class", F.col("mid").alias("named"), F.when(pair, F.col("beside")).alias("next"), "n")
    rows = rows.filter("token_class = 'viet' OR next IS NOT NULL")
    return rows.groupBy("book_id", "tok", "token_class", "named", "next").agg(F.sum("n").alias("n"))


def _words(counts: DataFrame, condition: str) -> DataFrame:
    return counts.filter(condition).groupBy("book_id", F.lower("tok").alias("word")).agg(F.sum("n").alias("n"))


def tone_style(counts: DataFrame, syllables: DataFrame) -> DataFrame:
    """(book_id, n_old, n_new, style, minority) from `seen`: votes of the words whose mark has two places; a tie is old."""
    two = syllables.filter(F.col("rhyme").isin(*TWO_STYLES) & (F.col("tone") != 0)).select("word", "old_spelling", "new_spelling")
    votes = _words(counts, "token_class = 'viet'").join(F.broadcast(two), "word", "left")
    old, new = F.expr("word = old_spelling"), F.expr("word <> old_spelling AND word = new_spelling")
    counted = votes.groupBy("book_id").agg(F.sum(F.when(old, F.col("n")).otherwise(0)).alias("n_old"), F.sum(F.when(new, F.col("n")).otherwise(0)).alias("n_new"))
    total = F.col("n_old") + F.col("n_new")
    return counted.select(
        "book_id", "n_old", "n_new", F.when(F.col("n_new") > F.col("n_old"), "new").otherwise("old").alias("style"),
        F.when(total == 0, F.lit(0.0)).otherwise(F.least("n_old", "n_new") / total).alias("minority"),
    )


def _known(df: DataFrame, column: str, lexicon: DataFrame, how: str) -> DataFrame:
    return df.join(lexicon.select(F.col("syllable").alias(column)), column, how)


def names(counts: DataFrame, lexicon: DataFrame, least: int = LEAST) -> DataFrame:
    """(book_id, word, n) from `seen`: capitalised words in mid-sentence that the lexicon lacks, at least `least` times."""
    return _known(_words(counts, "token_class = 'viet' AND named").filter(F.col("n") >= least), "word", lexicon, "left_anti").select("book_id", "word", "n")


def name_clusters(counts: DataFrame, lexicon: DataFrame, compounds: DataFrame, least: int = LEAST) -> DataFrame:
    """(book_id, phrase, n) from `seen`: capitalised pairs of lexicon words in mid-sentence that are no compound, at least `least` times."""
    pairs = counts.filter("next IS NOT NULL").groupBy("book_id", F.lower("tok").alias("a"), F.lower("next").alias("b")).agg(F.sum("n").alias("n"))
    pairs = _known(_known(pairs.filter(F.col("n") >= least), "a", lexicon, "left_semi"), "b", lexicon, "left_semi")
    pairs = pairs.select("book_id", F.concat_ws(" ", "a", "b").alias("phrase"), "n")
    return pairs.join(compounds.select(F.col("compound").alias("phrase")), "phrase", "left_anti").select("book_id", "phrase", "n")


def used_words(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(book_id, word, n) from `seen`: words with a diacritic or tone, at least `least` times in the book."""
    return _words(counts, "token_class = 'viet'").filter(F.col("n") >= least)


def _suspicious(words: DataFrame, lexicon: DataFrame, syllables: DataFrame, book_names: DataFrame) -> DataFrame:
    """Of (book_id, word, ...) those that the lexicon lacks, that no syllable structure allows and that are no name of the book."""
    found = _known(words, "word", lexicon, "left_anti")
    found = found.join(F.broadcast(syllables.select("word")), "word", "left_anti")
    return found.join(book_names.select("book_id", "word"), ["book_id", "word"], "left_anti")


def suspicious_words(counts: DataFrame, lexicon: DataFrame, syllables: DataFrame, book_names: DataFrame) -> DataFrame:
    """(book_id, word, n) from `seen`: the distinct suspicious words."""
    return _suspicious(_words(counts, "token_class = 'viet'"), lexicon, syllables, book_names).select("book_id", "word", "n")


def suspicious(toks: DataFrame, lexicon: DataFrame, syllables: DataFrame, book_names: DataFrame, plain_words: bool = False) -> DataFrame:
    """The suspicious ones of tokens, rows as they are; plain words only with `plain_words`."""
    kinds = ["viet", "plain"] if plain_words else ["viet"]
    found = toks.filter(F.col("token_class").isin(*kinds)).withColumn("word", F.lower("tok"))
    return _suspicious(found, lexicon, syllables, book_names).drop("word")


def audit(words: DataFrame, syllables: DataFrame, top: int | None = 60) -> DataFrame:
    """(word, n, share, rest, place) of the viet words (word, n) without a valid structure, the most frequent `top` first.

    `share` is the word's share of all viet tokens, `rest` is what follows its first
    consonants, where a rhyme should be. `top` None gives all, unplaced.
    """
    bad = words.join(F.broadcast(syllables.select("word")), "word", "left_anti")
    total = words.agg(F.sum("n").alias("total"))  # one row
    onset = "^(?:" + "|".join(ONSETS) + ")?"
    out = bad.join(F.broadcast(total)).select("word", "n", (F.col("n") / F.col("total")).alias("share"), F.regexp_replace(strip_tone_col(F.col("word")), onset, "").alias("rest"))
    if top is None:
        return out
    first = out.orderBy(F.desc("n"), "word").limit(top)
    return first.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "word")))
