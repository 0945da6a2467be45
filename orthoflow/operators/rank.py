"""Open cases of suspicious tokens: candidates once per distinct token, evidence by joins, ranking by a window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import candidates as C
from ..functions.charset import VOWEL_CHARS, keeps_onset_col, tone_marks_col
from ..staging import BROADCAST_BYTES, Scratch, small_side
from .tokens import capitalised

#: Cost of a split beside the candidates' costs: trusted, and not.
SPLIT, WEAK_SPLIT = 3, 9
#: A lexicon goes to the workers only up to this many entries; dictionaries do not grow with the texts.
MOST_ENTRIES = 1_000_000

_CANDS = "tok string, cands array<struct<cand:string,cost:int>>, splits array<string>, strong array<boolean>, compound array<boolean>, repaired string"


def _entries(df: DataFrame, column: str) -> Broadcast[frozenset[str]]:
    """The entries of a lexicon, sent to each executor once."""
    rows = df.select(column).distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"{column} lexicon has more than {MOST_ENTRIES} entries")
    return df.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in rows if r[0]))


def candidate_table(distinct: DataFrame, lexicon: DataFrame, compounds: DataFrame) -> DataFrame:
    """(tok, cands, splits, strong, compound, repaired) for each row of `distinct` (tok).

    cands: at most 40 (cand, cost) in order; splits with their flags in order; repaired: `uơ` set right, or null.
    """
    known_words, known_phrases = _entries(lexicon, "syllable"), _entries(compounds, "compound")
    longest = max(map(len, known_words.value), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("cand", pa.string()), ("cost", pa.int32())]))
        words, phrases = known_words.value, known_phrases.value
        for batch in batches:
            toks = batch.column(0).to_pylist()
            cut = [C.splits(t, words.__contains__, phrases, longest) for t in toks]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(toks, pa.string()),
                    pa.array([[{"cand": w, "cost": c} for w, c in C.candidates(t)] for t in toks], pair),
                    pa.array([[C.put_spaces(t, s) for s in ss] for t, ss in zip(toks, cut, strict=True)], pa.list_(pa.string())),
                    pa.array([[C.strong_split(s.split(" ")) for s in ss] for ss in cut], pa.list_(pa.bool_())),
                    pa.array([[s in phrases for s in ss] for ss in cut], pa.list_(pa.bool_())),
                    pa.array([C.repair_uo(t) for t in toks], pa.string()),
                ],
                ["tok", "cands", "splits", "strong", "compound", "repaired"],
            )

    # A token takes up to a millisecond, so even a few thousand are dealt over all cores.
    cores = distinct.sparkSession.sparkContext.defaultParallelism
    wide = max(cores, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return distinct.select("tok").repartition(wide, "tok").mapInArrow(run, _CANDS)


def _has(df: DataFrame, key: Column, table: DataFrame, column: str, name: str) -> DataFrame:
    """`df` with a boolean `name`: whether `key` is in `table`.`column`."""
    known = table.select(F.col(column).alias(f"{name}_key"), F.lit(True).alias(name)).distinct()
    out = df.withColumn(f"{name}_key", key).join(known, f"{name}_key", "left").drop(f"{name}_key")
    return out.withColumn(name, F.coalesce(name, F.lit(False)))


def _phrases(df: DataFrame, table: DataFrame, column: str, on: list[str], name: str) -> DataFrame:
    """`df` with an int `name`: how many of (prev, first piece) and (last piece, next) are phrases of `table`."""
    pieces = F.split(F.lower("cand"), " ")
    left = F.concat(F.lower("prev"), F.lit(" "), F.get(pieces, F.lit(0)))
    right = F.concat(F.element_at(pieces, -1), F.lit(" "), F.lower("next"))
    known = table.select(*on, F.col(column).alias("phrase"), F.lit(1).alias("hit")).distinct()
    for side, key in (("l", left), ("r", right)):
        df = df.withColumn("phrase", key).join(known.withColumnRenamed("hit", f"hit_{side}"), [*on, "phrase"], "left").drop("phrase")
    return df.withColumn(name, F.coalesce("hit_l", F.lit(0)) + F.coalesce("hit_r", F.lit(0))).drop("hit_l", "hit_r")


def _ranked(cases: DataFrame, lexicon: DataFrame, compounds: DataFrame, clusters: DataFrame, typos: DataFrame) -> DataFrame:
    """As `rank_candidates`, with `first`, the case's first candidate; whether a book uses that is not asked yet."""
    # What depends on the token alone is found once per distinct token.
    weak = F.transform("splits", lambda s: ~F.forall(F.slice(F.split(F.lower(s), " "), F.lit(2), F.lit(9)), lambda p: ~p.rlike(f"^[{VOWEL_CHARS}]")))
    trusted = tone_marks_col(F.col("tok")) > 1
    split_cands = F.zip_with("splits", weak, lambda s, w: F.struct(s.alias("cand"), F.when(w & ~trusted, WEAK_SPLIT).otherwise(SPLIT).alias("cost")))
    toks = cases.select("tok", "cands", "splits", "repaired").dropDuplicates(["tok"])
    toks = toks.join(typos.select(F.col("typo").alias("t_key"), "answers"), F.lower("tok") == F.col("t_key"), "left")
    answers = F.coalesce("answers", F.when(F.col("repaired").isNotNull(), F.array("repaired")), F.array().cast("array<string>"))
    toks = toks.withColumn("answers", answers).select("tok", "answers", F.posexplode(F.concat("cands", split_cands)).alias("made", "c"))
    toks = toks.select("tok", "answers", "made", "c.cand", "c.cost")
    toks = _has(toks, F.lower("cand"), lexicon, "syllable", "single")
    toks = _has(toks, F.when(F.contains("cand", F.lit(" ")), F.lower("cand")), compounds, "compound", "whole")
    made = F.struct(
        "made", "cand", "cost", (F.col("single") | F.contains("cand", F.lit(" "))).alias("is_real"), F.array_contains("answers", F.lower("cand")).cast("int").alias("typo"),
        keeps_onset_col(F.col("tok"), F.col("cand")).cast("int").alias("keep"), F.col("whole").cast("int").alias("whole"),
    )
    toks = toks.groupBy("tok", "answers").agg(F.collect_list(made).alias("made"))
    real = F.filter("made", lambda m: m["is_real"])
    toks = toks.select("tok", "answers", F.when(F.size(real) > 0, real).otherwise(F.col("made")).alias("made"))
    rows = cases.select("case_id", "book_id", "tok", "prev", "next").join(toks, "tok")
    rows = rows.select("case_id", "book_id", "tok", "prev", "next", "answers", F.inline("made"))
    # Without a neighbour there is no phrase: those rows, nearly all, skip the joins, where their null keys would meet in one task.
    beside = F.col("prev").isNotNull() | F.col("next").isNotNull()
    near = _phrases(rows.filter(beside), clusters, "phrase", ["book_id"], "cluster")
    near = near.withColumn("cluster", F.when(capitalised(F.col("tok")), F.col("cluster")).otherwise(0))
    near = _phrases(near, compounds, "compound", [], "compound")
    alone = rows.filter(~beside).withColumn("cluster", F.lit(0)).withColumn("compound", F.lit(0))
    rows = near.unionByName(alone)
    rows = rows.withColumn("compound", F.col("compound") + F.col("whole")).drop("whole")
    order = W.partitionBy("case_id").orderBy(*(F.desc(c) for c in ("typo", "cluster", "keep", "compound")), "cost", "made")
    rows = rows.withColumn("rank", F.row_number().over(order))
    for c in ("typo", "cluster", "keep", "compound", "cost"):
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))

    def ties(*names: str) -> Column:
        same = F.lit(True)
        for n in names:
            same = same & (F.col(n) == F.col(f"next_{n}"))
        return F.coalesce(same, F.lit(False))

    top = (
        F.when((F.size("answers") == 1) & (F.col("typo") > 0), "typo")
        .when((F.col("cluster") > 0) & ~ties("typo", "cluster", "cost"), "cluster")
        .when((F.col("compound") > 0) & ~ties("typo", "cluster", "keep", "compound", "cost"), "compound")
        .when(
            (F.col("cost") == C.ADD_MARK) & F.col("is_real") & (F.col("next_cost").isNull() | (F.col("next_cost") > F.col("cost"))),
            "diacritic",
        )
    )
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("evidence", F.first(F.when(F.col("rank") == 1, F.coalesce(top, F.lit("none")))).over(whole)).withColumn("first", F.first("cand").over(whole))
    return rows.select("case_id", "book_id", "tok", "cand", "cost", "rank", "typo", "cluster", "keep", "compound", "is_real", "evidence", "first")


def _in_use(df: DataFrame, used: DataFrame) -> DataFrame:
    """`df` (book_id, evidence, first, ...) where a diacritic is evidence only if the book uses the first candidate, or has no words in use."""
    asked = df.filter("evidence = 'diacritic'").withColumn("word", F.lower("first"))
    asked = asked.join(used.select("book_id", "word", F.lit(True).alias("in_use")).distinct(), ["book_id", "word"], "left")
    asked = asked.join(used.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_used")), "book_id", "left")
    stands = F.col("n_used").isNull() | F.col("in_use").isNotNull()
    asked = asked.withColumn("evidence", F.when(stands, F.col("evidence")).otherwise("none"))
    return df.filter("evidence <> 'diacritic'").unionByName(asked.select(df.columns))


def rank_candidates(
    cases: DataFrame, lexicon: DataFrame, compounds: DataFrame, clusters: DataFrame, used: DataFrame, typos: DataFrame
) -> DataFrame:
    """Ranked candidate rows with their evidence.

    `cases`: case_id, book_id, tok, prev, next, cands (array of struct cand, cost), splits, repaired. Returns one row
    per kept candidate: case_id, book_id, tok, cand, cost, rank (from 1), typo, cluster, keep, compound, is_real, evidence (of the
    case). Candidates that are no lexicon words go if any candidate of the case is one. The order is typo,
    name cluster, kept onset, compound, cost, then the order in which candidates were made.
    """
    return _in_use(_ranked(cases, lexicon, compounds, clusters, typos), used).drop("first")


def _contexts(cases: DataFrame, compounds: DataFrame, clusters: DataFrame) -> DataFrame:
    """`cases` with c_book, c_prev and c_next in place of prev and next: what a ranking can depend on beside the token.

    A neighbour matters if a compound of two words has it in that place, and for a capitalised token also if a cluster of its book has; the book
    matters in the latter case only. All else is null, so that few contexts are left of many cases.
    """
    df = cases.withColumn("c_prev", F.lower("prev")).withColumn("c_next", F.lower("next")).drop("prev", "next")
    for side, place in (("prev", 0), ("next", 1)):
        for table, column, on, name in ((compounds, "compound", [], "word"), (clusters, "phrase", ["book_id"], "name")):
            pair = F.split(column, " ")
            known = table.filter(F.size(pair) == 2).select(*on, pair[place].alias(f"c_{side}"), F.lit(True).alias(f"{name}_{side}")).distinct()
            df = df.join(known, [*on, f"c_{side}"], "left")
        named = F.coalesce(capitalised(F.col("tok")) & F.col(f"name_{side}"), F.lit(False))
        df = df.withColumn(f"name_{side}", named).withColumn(f"c_{side}", F.when(F.col(f"word_{side}") | named, F.col(f"c_{side}")))
    return df.withColumn("c_book", F.when(F.col("name_prev") | F.col("name_next"), F.col("book_id"))).drop("word_prev", "word_next", "name_prev", "name_next")


def open_cases(
    found: DataFrame, lexicon: DataFrame, compounds: DataFrame, clusters: DataFrame, used: DataFrame, typos: DataFrame, scratch: Scratch | None = None
) -> DataFrame:
    """Suspicious tokens (book_id, tok, prev, next, ...) to cases: their columns without prev and next, and cands (ranked), kind, evidence, reason.

    A token whose best split is strong, and is its only one or a compound, is settled by that split. Cases
    without a candidate are left out. Candidates are made once per distinct token, and ranked once per distinct token and
    neighbours that any phrase has.
    """
    scratch = scratch or Scratch(found.sparkSession, "cases")
    made = candidate_table(found.select("tok").distinct(), lexicon, compounds).filter("size(cands) + size(splits) > 0")
    decisive = F.coalesce(F.get("strong", F.lit(0)) & ((F.size("splits") == 1) | F.get("compound", F.lit(0))), F.lit(False))
    made = scratch.table(made.withColumn("decisive", decisive), "made", F.octet_length("tok") + 32)
    hits = made.select("tok", "decisive")
    cases = found.join(F.broadcast(hits) if made._scratch_bytes <= BROADCAST_BYTES else hits, "tok")
    cases = scratch.table(_contexts(cases, compounds, clusters), "contexts")
    context = ["tok", "c_book", "c_prev", "c_next"]
    asked = cases.filter(~F.col("decisive")).select(context).distinct().withColumn("case_id", F.monotonically_increasing_id())
    asked = scratch.table(asked, "asked")
    ranking = asked.select("case_id", "tok", F.col("c_book").alias("book_id"), F.col("c_prev").alias("prev"), F.col("c_next").alias("next"))
    ranked = _ranked(ranking.join(made, "tok"), lexicon, compounds, clusters, typos)
    gathered = ranked.groupBy("case_id", "evidence", "first").agg(F.sort_array(F.collect_list(F.struct("rank", "cand"))).alias("ranked"))
    gathered = gathered.select("case_id", "evidence", "first", F.transform("ranked", lambda r: r["cand"]).alias("cands"))
    split = made.filter("decisive").select(
        "tok", *(F.lit(None).cast("string").alias(c) for c in context[1:]), F.lit("split").alias("evidence"), F.get("splits", F.lit(0)).alias("first"), F.col("splits").alias("cands")
    )
    answers = asked.join(gathered, "case_id").select(*context, "evidence", "first", "cands").unionByName(split)
    # A settled token has one answer whatever its neighbours are.
    plain = [F.when(~F.col("decisive"), F.col(c)).alias(c) for c in context[1:]]
    own = [c for c in cases.columns if c not in (*context, "decisive")]
    keyed = cases.select(*own, "tok", *plain).alias("x")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in context[1:]]
    size = F.octet_length("tok") + 64 + F.octet_length(F.array_join("cands", "")) + 16 * F.size("cands")
    answers = small_side(scratch.table(answers, "answers", size)).alias("y")
    out = keyed.join(answers, [F.col("x.tok") == F.col("y.tok"), *same])
    out = _in_use(out.select(*(f"x.{c}" for c in own), "x.tok", "y.evidence", "y.first", "y.cands"), used)
    why = {
        "typo": ": a common typo with one known answer",
        "cluster": ": not in the lexicon; the best candidate restores a name of this book",
        "compound": ": not in the lexicon; the best candidate makes a compound with a neighbour",
        "diacritic": ": lacks one diacritic, and no other way is as cheap",
        "none": ": neither in the lexicon nor a possible syllable",
    }
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in why.items() for x in kv)), F.col("evidence"))
    reason = F.when(F.col("evidence") == "split", F.concat(F.lit(" is words without a space: `"), "first", F.lit("`"))).otherwise(reason)
    glued = (F.col("evidence") == "split") | F.contains("first", F.lit(" "))
    return out.select(*own, "tok", "cands", F.when(glued, "glued").otherwise("bad_syllable").alias("kind"), "evidence", F.concat(F.lit("`"), "tok", F.lit("`"), reason).alias("reason"))
