"""Operators on Spark: fixture books, edge cases, and every registered query with SQL against DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orthoflow import fixtures, queries
from orthoflow.functions import layers
from orthoflow.operators import decide, edits, rank, report, stats, tokens
from orthoflow.plans.correct import layered, correct
from orthoflow.sources import epub, lexicon
from orthoflow.streaming import rules

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def flat(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(flat, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted(repr([flat(r[c]) for c in columns]) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    theirs = sorted(repr([flat(r[i]) for i in at]) for r in want.fetchall())
    assert mine == theirs


def books(spark, rows):
    return spark.createDataFrame(rows, fixtures.PARAGRAPH_SCHEMA)


@pytest.fixture(scope="module")
def fixed(spark):
    return correct(fixtures.paragraphs(spark), fixtures.syllables(spark), fixtures.compounds(spark))


@pytest.fixture(scope="module")
def texts(fixed):
    return {r["text_before"]: r["text"] for r in fixed.paragraphs.collect()}


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("Anh ấy xử dụng máy tính , rồi   đi ra .", "Anh ấy sử dụng máy tính, rồi đi ra."),
        ("Tình thuơng của mẹ thật lớn.", "Tình thương của mẹ thật lớn."),
        ("Chúg ta đi trên đường xá xa xôi.", "Chúng ta đi trên đường sá xa xôi."),
        ("Ừ Duơng à, nhà Phúlần ở cuối làng.", "Ừ Dương à, nhà Phú lần ở cuối làng."),
        ("Ừ nhưmg à.", "Ừ nhưmg à."),
        ("Đám cao tầng Hỏa Duơng Tộc không dám tới.", "Đám cao tầng Hỏa Dương Tộc không dám tới."),
        ("Cô ở Hồng Kông, rồi về Hồng Kông.", "Cô ở Hồng Kông, rồi về Hồng Kông."),
        ("Cột bêtông và cái micrô cùng cái rađa", "Cột bêtông và cái micrô cùng cái rađa"),
        ("THầy KHông CHúng NHưng", "THầy KHông CHúng NHưng"),
        ("Trời khô­ng mưa nữa​.", "Trời không mưa nữa."),
    ],
)
def test_corrected(texts, before, after):
    assert texts[before] == after


def test_evidence(fixed):
    log = {(r["before"], r["after"]): r["reason"] for r in fixed.edits.filter("layer = 7").collect()}
    assert "typo" in log["thuơng", "thương"]
    assert "compound" in log["Chúg", "Chúng"]
    assert "without a space" in log["Phúlần", "Phú lần"]
    opened = {r["before"]: r for r in fixed.open.collect()}
    assert opened["nhưmg"]["evidence"] == "none" and len(opened["nhưmg"]["cands"]) >= 2
    assert "chia xẻ" in opened


def test_book_statistics(fixed):
    assert {(r["book_id"], r["word"]) for r in fixed.stats.names.collect()} >= {("vi-2", "kông")}
    assert [tuple(r) for r in fixed.stats.clusters.collect()] == [("vi-2", "hỏa dương", 3)]
    assert {r["book_id"]: r["style"] for r in fixed.stats.style.collect()} == {"vi-1": "old", "vi-2": "old"}
    # Capitals at the start of a sentence make no name, however often they come.
    assert "chẵng" not in {r["word"] for r in fixed.stats.names.collect()}


def test_second_run_changes_only_what_stacked_spaces_left(spark, fixed):
    again = correct(fixed.paragraphs.select(*tokens.KEY, "text"), fixtures.syllables(spark), fixtures.compounds(spark))
    changed = {r["text_before"]: r["text"] for r in again.paragraphs.filter("text <> text_before").collect()}
    assert changed == {"nói , rồi không đi, của người không biết ngồiở e rằng": "nói, rồi không đi, của người không biết ngồiở e rằng"}


def test_edge_paragraphs(spark):
    rows = [("b", 0, 0, None), ("b", 0, 1, ""), ("b", 0, 2, "x " * 5000 + "khôgn"), ("b", 0, 3, "đ"), (None, None, None, "xử dụng")]
    out = correct(books(spark, rows), fixtures.syllables(spark), fixtures.compounds(spark))
    got = {(r["book_id"], r["para_ix"]): r["text"] for r in out.paragraphs.collect()}
    assert ("b", 0) not in got
    assert got["b", 1] == "" and got["b", 3] == "đ"
    assert got["b", 2].endswith("không")
    assert got[None, None] == "sử dụng"
    empty = correct(books(spark, []), fixtures.syllables(spark), fixtures.compounds(spark))
    assert empty.paragraphs.count() == empty.edits.count() == empty.open.count() == 0


class Fixed(decide.BigramScorer):
    def __init__(self, value):
        super().__init__([])
        self.value = value

    def score(self, texts):
        return pd.Series([self.value] * len(texts), dtype="float64")


def test_scorers(spark):
    rows = books(spark, [("b", 0, 0, "Ừ nhưmg à. Anh chia xẻ nỗi buồn."), ("b", 0, 1, "Câu kế.")])
    args = (rows, fixtures.syllables(spark), fixtures.compounds(spark))
    for value in (0.0, float("nan"), float("-inf")):
        out = correct(*args, scorer=Fixed(value))
        assert out.paragraphs.filter("text <> text_before").count() == 0
        assert out.open.count() == 0

    class Prefers(Fixed):
        def score(self, texts):
            return texts.str.contains("những").astype("float64")

    out = correct(*args, scorer=Prefers(0))
    assert [r["text"] for r in out.paragraphs.orderBy("para_ix").collect()][0].startswith("Ừ những à.")
    assert {r["certainty"] for r in out.edits.collect()} == {"doubtful"}
    blank = correct(*args, scorer=decide.BigramScorer(["nỗi buồn chia sẻ"]), options=lexicon.Options.with_scoring(True))
    assert blank.paragraphs.count() == 2


def test_columns_agree_with_kernels(spark, tmp_path):
    """The column rules give the kernel's text; layers on one text, whatever order columns run in."""
    cases = [t for *_, t in fixtures.PARAGRAPHS] + ["5 ,6", "a .B", "(  )", "a ... b....c", ". . .", "x…y ,z", "a,\nb", "http://x"]
    df = books(spark, [("b", 0, i, t) for i, t in enumerate(cases)])
    for options in (lexicon.Options(), lexicon.Options(ellipsis_char=True), lexicon.Options(merge_dots=False)):
        mine = {r["para_ix"]: r["text"] for r in rules.normalised(df, options).collect()}
        only = lexicon.Options(**(options.__dict__ | {"confusables": False, "consistent_tone_style": False}))
        for i, t in enumerate(cases):
            log = layers.run_layers(t, False, only, [])
            if not any(e.kind.startswith("tone") for _, e in log.edits):
                assert mine[i] == log.text, t


def test_tokens(spark):
    df = books(spark, [("b", 0, 0, "Anh ấy nói: “không”."), ("b", 0, 1, "ki-lô-mét Ước VIỆT USB đ")])
    toks = tokens.tokens(df).collect()
    assert [r["tok"] for r in toks if r["para_ix"] == 0] == ["Anh", "ấy", "nói", "không"]
    second = {r["tok"]: r["token_class"] for r in toks if r["para_ix"] == 1}
    assert second == {"ki": "plain", "lô": "viet", "mét": "viet", "Ước": "viet", "VIỆT": "acronym", "USB": "acronym", "đ": "nonword"}
    compat = [r["tok"] for r in tokens.tokens(df, compat_lowercase_letters=True).filter("para_ix = 1").collect()]
    assert compat[3:6] == ["ớc", "VI", "T"]
    by_pos = {r["tok_ix"]: r for r in toks if r["para_ix"] == 0}
    assert (by_pos[0]["prev"], by_pos[0]["next"], by_pos[3]["next"]) == (None, "ấy", None)


def test_token_starts(spark):
    df = books(spark, [("b", 0, 0, "“Ừ, đúng.” Nó")])
    toks = tokens.tokens(df).join(df, tokens.KEY)
    start = tokens.part_start(tokens.parts_col(F.col("text")), F.col("pos"))
    for r in toks.select("tok", start.alias("s"), "text").collect():
        assert r["text"][r["s"] : r["s"] + len(r["tok"])] == r["tok"]


def test_tone_style_votes(spark):
    from orthoflow.functions.syllables import syllable_table

    seen = stats.seen(books(spark, [("b", 0, 0, "hòa khòe thùy hoà"), ("c", 0, 0, "hoà thuỳ"), ("d", 0, 0, "không")]))
    got = {r["book_id"]: (r["n_old"], r["n_new"], r["style"]) for r in stats.tone_style(seen, syllable_table(spark)).collect()}
    assert got == {"b": (3, 1, "old"), "c": (0, 2, "new"), "d": (0, 0, "old")}


def test_claimed_phrases(spark):
    from orthoflow.operators.confusables import phrase_matches

    df = books(spark, [("b", 0, 0, "thái độ bàng quang và tựu chung lại xử  dụng, xử, dụng dành cho")])
    got = {(r["phrase"], r["section"]) for r in phrase_matches(df, lexicon.confusable_table(spark)).collect()}
    assert got == {("thái độ bàng quang", "always"), ("tựu chung lại", "always"), ("xử dụng", "always"), ("dành cho", "meaning")}


def test_apply_edits_column_agrees_with_kernel(spark):
    from orthoflow.functions.editing import apply_edits

    cases = [("abcdef", [(0, 2, "X"), (1, 3, "Y"), (3, 3, "_"), (5, 6, "")]), ("", [(0, 0, "z")]), ("ab", []), ("ab", [(1, 9, "q")])]
    df = spark.createDataFrame(cases, "text string, e array<struct<start:int,end:int,after:string>>")
    got = {r["text"] + str(len(r["e"])): r["x"]["text"] for r in df.withColumn("x", edits.apply_edits_col(F.col("text"), F.col("e"))).collect()}
    for text, es in cases:
        assert got[text + str(len(es))] == apply_edits(text, es)[0]


def test_stable_ranking_keeps_made_order(spark):
    cases = spark.createDataFrame(
        [(1, "b", "xyz", None, None, [("aa", 5), ("bb", 5), ("cc", 4)], [], None)],
        "case_id long, book_id string, tok string, prev string, next string, cands array<struct<cand:string,cost:int>>, splits array<string>, repaired string",
    )
    none = spark.createDataFrame([], "book_id string, phrase string")
    used = spark.createDataFrame([], "book_id string, word string")
    out = rank.rank_candidates(cases, fixtures.syllables(spark), fixtures.compounds(spark), none, used, lexicon.typo_table(spark))
    assert [r["cand"] for r in out.orderBy("rank").collect()] == ["cc", "aa", "bb"]
    assert {r["evidence"] for r in out.collect()} == {"none"}


def test_reports(spark, fixed):
    summary = {r["book_id"]: r.asDict() for r in report.book_summary(fixed.paragraphs, fixed.edits, fixed.open, fixed.stats.style).collect()}
    log, opened = report.grouped_edits(fixed.edits).collect(), report.grouped_open(fixed.open).collect()
    page = report.html_report(summary["vi-1"], log, opened, "Sách <một>", conflicts=2)
    assert "Sách &lt;một&gt;" in page and "2 chỗ vướng thẻ" in page and "xử dụng" in page
    text = report.text_report(summary["vi-1"], log, fixed.open.collect())
    assert "→?" in text and "Dễ nhầm" in text
    assert report.visible_pair("ê", "ê")[0].endswith("⟨U+0065 U+0302⟩")
    assert report.visible("a \t­") == "a␣⇥⟨U+00AD⟩" and report.visible("") == "∅"


def test_archives(spark, tmp_path):
    files = [("mimetype", b"application/epub+zip"), ("a.opf", b"<title>T &amp; x</title>"), ("toc.xhtml", "<p>xử dụng</p>".encode()), ("x/bad.html", b"\xc3\x28")]
    source = tmp_path / "in" / "my book.epub"
    source.parent.mkdir()
    source.write_bytes(epub.build_archive(files))
    archives = spark.read.format("binaryFile").load(str(source.parent)).select(F.col("path").alias("book_id"), "content")
    found = epub.read_entries(spark, str(source.parent))
    assert [r["name"] for r in found.orderBy("entry_ix").collect()] == [n for n, _ in files]
    assert [r["title"] for r in epub.titles(found).collect()] == ["T & x"]
    assert [r["t"] for r in found.filter("name = 'x/bad.html'").select(epub.decode_text(F.col("content")).alias("t")).collect()] == [None]
    fixed, patched = queries.correct_archives(spark, archives, fixtures.syllables(spark), fixtures.compounds(spark))
    rebuilt = epub.rebuild(archives, patched)
    out = tmp_path / "out"
    out.mkdir()
    assert epub.write_archives(rebuilt, str(out), dry_run=True)
    assert list(out.iterdir()) == []
    ((_, path),) = epub.write_archives(rebuilt, str(out))
    assert path.endswith("my book (đã sửa).epub") or path.endswith("my%20book (đã sửa).epub")
    import zipfile

    (written,) = out.iterdir()
    with zipfile.ZipFile(written) as z:
        assert [i.filename for i in z.infolist()] == [n for n, _ in files]
        assert z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert z.read("toc.xhtml").decode() == "<p>sử dụng</p>"
        assert all(z.read(n) == c for n, c in files if n != "toc.xhtml")


def test_lexicon_files(spark, tmp_path):
    path = str(tmp_path / "words")
    lexicon.write_words(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "syllable string"), path)
    assert sorted(r["syllable"] for r in lexicon.read_words(spark, path).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="exists"):
        lexicon.write_words(spark.createDataFrame([("b",)], "syllable string"), path)
    (tmp_path / "x.json").write_text('{"text": "a\\tb"}\n{"other": 1}\n')
    assert [r["text"] for r in lexicon.read_json_text(spark, str(tmp_path / "x.json")).collect()] == ["a\tb"]


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    source = str(tmp_path / "paras")
    fixtures.paragraphs(spark).repartition(3).write.parquet(source)
    stream = rules.normalised(spark.readStream.schema(fixtures.PARAGRAPH_SCHEMA).parquet(source))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*tokens.KEY, "text").collect()))
    assert got == sorted(map(tuple, rules.normalised(fixtures.paragraphs(spark)).select(*tokens.KEY, "text").collect()))


def test_stream_counts(spark, tmp_path):
    source = str(tmp_path / "timed")
    timed = fixtures.paragraphs(spark).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    timed.write.parquet(source)
    counts = rules.token_class_counts(spark.readStream.schema(timed.schema).parquet(source), tokens.KEY, "ts")
    q = counts.writeStream.format("memory").queryName("classes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r["token_class"]: r["n"] for r in rules.token_class_counts(fixtures.paragraphs(spark), tokens.KEY).collect()}
    assert {r["token_class"]: r["n"] for r in spark.table("classes").collect()} == batch


def test_repeated_and_missing_keys(spark):
    """Rows with the same keys, or without, are paragraphs of their own: each error is logged once."""
    rows = [("b", 0, 0, "Tình thuơng của mẹ.")] * 2 + [(None, None, None, "Tình thuơng của mẹ."), (None, 1, None, "Ừ nhưmg à.")]
    out = correct(books(spark, rows), fixtures.syllables(spark), fixtures.compounds(spark))
    assert [(r["before"], r["after"]) for r in out.edits.collect()] == [("thuơng", "thương")] * 3
    assert [r["text"] for r in out.paragraphs.filter("entry_ix IS NULL OR book_id IS NOT NULL").collect()] == ["Tình thương của mẹ."] * 3
    assert [(r["book_id"], r["before"]) for r in out.open.collect()] == [(None, "nhưmg")]


def test_composition_is_asked_about_all_that_it_changes(spark):
    import unicodedata

    texts = [c + d for c in "aeo\u1100\uac00\u00e2" for d in map(chr, [*range(0x300, 0x370), 0x1161, 0x11A8, 0x3099])] + ["\u212a", "\u0958x", "\ufb1d", "\u2126", "plain", "Ước"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("c", layers.compose(F.col("t")))
    assert all(r["c"] == unicodedata.normalize("NFC", r["t"]) for r in df.collect())


def test_stream_of_corrected_batches(spark, tmp_path):
    source, done = tmp_path / "in", {}
    fixtures.paragraphs(spark).write.parquet(str(source))
    style = spark.createDataFrame([("vi-1", "old")], "book_id string, style string")
    stream = spark.readStream.schema(fixtures.PARAGRAPH_SCHEMA).parquet(str(source))
    keep = rules.correct_batches(style, lambda df, number: done.update({r["text_before"]: r["text"] for r in df.collect()}))
    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert done["Anh ấy xử dụng máy tính , rồi   đi ra ."] == "Anh ấy sử dụng máy tính, rồi đi ra." and len(done) == len({t for *_, t in fixtures.PARAGRAPHS})


def test_model_files(spark, tmp_path):
    from orthoflow.sources import models

    for name in ("a.gguf", "sub/b.gguf", "sub/deep/c.gguf", "d.txt"):
        (tmp_path / "models" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "models" / name).write_bytes(b"GGUF1")
    found = models.model_files(spark, str(tmp_path / "models")).collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in found) == ["a.gguf", "b.gguf"]
    cards = spark.createDataFrame([("x", 3), ("b", 9), ("a", 9), ("n", None)], "name string, memory long")
    assert [tuple(r) for r in models.largest_card(cards).collect()] == [("a", 9)]
    assert {r["name"] for r in models.usable_cards(cards, 9).collect()} == {"a", "b"}
    assert models.largest_card(cards.limit(0)).collect() == []


def test_candidates_of_all_lines(spark):
    """The list of each token is the kernel's; ranks are gapless and start with what evidence names."""
    from orthoflow.functions.candidates import candidates

    made: dict[str, list] = {}
    for r in queries.QUERIES["gen3_candidates"](spark, SF).collect():
        made.setdefault(r["tok"], []).append((r["place"], r["cand"], r["cost"]))
    assert len(made) > 100
    for tok, rows in made.items():
        assert [(c, k) for _, c, k in sorted(rows)] == candidates(tok) and len(rows) <= 40
    for r in queries.QUERIES["gen4_splits"](spark, SF).collect():
        assert r["split"].replace(" ", "") == r["tok"]
    ranked = queries.QUERIES["srt1_ranked_candidates"](spark, SF)
    assert ranked.filter("rank < 1 OR (evidence = 'typo' AND rank = 1 AND typo = 0)").count() == 0 and ranked.count() > 1000


@pytest.mark.parametrize("name", ["dec6_corrected_paragraphs", "dec7_scored_paragraphs", "dec10_blank_fill_paragraphs"])
def test_correction_runs_over_all_lines(spark, name):
    lines = queries.paragraphs(spark, SF)
    got = queries.QUERIES[name](spark, SF).select(*tokens.KEY, F.col("text_before").alias("text"))
    assert got.count() == lines.count() and got.exceptAll(lines).count() == 0


def test_correction_results_hold_documents_and_fixtures(spark, fixed):
    own = {book for book, *_ in fixtures.PARAGRAPHS}
    log = queries.QUERIES["dec6_edit_log"](spark, SF)
    assert log.filter(~F.col("book_id").isin(*own)).count() > 0
    mine = log.filter(F.col("book_id").isin(*own)).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, map(tuple, fixed.edits.collect())))
    found = {r["word"] for r in queries.QUERIES["flt2_suspicious_words"](spark, SF).collect()}
    assert found <= {r["tok"].lower() for r in queries.QUERIES["srt1_ranked_candidates"](spark, SF).select("tok").collect()} | {
        r["tok"].lower() for r in rank.candidate_table(spark.createDataFrame([(w,) for w in found], "tok string"), fixtures.syllables(spark), fixtures.compounds(spark)).filter("size(cands) + size(splits) = 0").collect()
    }


def test_lines_that_skip_the_kernel_are_those_it_leaves_alone(spark):
    lines = ["Anh ta phong thanh di", "PHONG Thanh di", "5 \u212a", "5 \u212b", "a\u037eb", "\uf900", "\u1100\u1161", "\U0002f800", "plain text"]
    paras = books(spark, [("b", 0, i, t) for i, t in enumerate(lines)]).withColumn("row_id", F.col("para_ix"))
    style = spark.createDataFrame([("b", "old")], "book_id string, style string")
    table = lexicon.confusable_rows()
    for r in layered(paras, style, lexicon.Options()).collect():
        want = layers.run_layers(r["text_before"], False, lexicon.Options(), table)
        assert (r["text"], len(r["edits"]), len(r["doubtful"])) == (want.text, len(want.edits), len(want.open)), r["text_before"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
