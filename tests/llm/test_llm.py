"""Corpus operators against brute force on small inputs, with nulls, empties, repeats, ties and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orthoflow.llm import exact_dedup, hamming_search, license_scan, line_dedup, minhash_dedup, packing, quality, queries, sentencepiece_codec, shingles, token_files, url_filter
from orthoflow.llm._shared import Scratch
from orthoflow.llm.components import components, roots_of

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Columns that share names with ones the operators make.
EXTRA = ["lang", "row", "length", "n", "th", "g_id", "g_sha", "g_th", "y", "l_id", "s_id", "grp", "rest", "keep_id", "cls", "h1", "part", "key"]
SCHEMA = "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in EXTRA)


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, *("x",) * len(EXTRA)) for i, t in rows], SCHEMA)


def rng_words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Exact copies, near copies, shared lines and passages, short and long texts, nulls, repeats."""
    r = random.Random(7)
    rows = []
    passage = rng_words(r, 60)
    for i in range(120):
        rows.append((i, rng_words(r, r.randrange(1, 120)) + ("\n" + passage if i % 3 == 0 else "") + ("\n Common LINE \n" if i % 2 else "")))
    base = rng_words(r, 100)
    for i in range(120, 160):
        words = base.split()
        for _ in range(r.randrange(0, 6)):
            words[r.randrange(len(words))] = f"v{r.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(i, base) for i in range(160, 175)]
    rows += [(175, None), (176, ""), (177, " \t\n"), (178, "one"), (179, "ONE"), (180, "one two three"), (181, "é À ß"), (182, "x" * 3000), (183, "x" * 3000)]
    rows += [(184, rng_words(r, 5000)), (184, rows[0][1]), (184, rows[0][1]), (None, base), (None, None), (None, "alone with no id at all here")]
    return rows


def same(df, want):
    assert Counter(map(tuple, df.collect())) == Counter(want)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_queries_on_empty_tables(spark, tmp_path):
    for t in ("documents", "pages", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


# --- 1 ---


@pytest.mark.parametrize(("limit", "together"), [(32 << 20, 10_000), (0, 10_000), (0, 2)])
def test_top_k_equals_brute_force(spark, limit, together):
    r = random.Random(3)
    codes = [(i, r.getrandbits(64) - (1 << 63)) for i in range(300)]
    codes += [(300 + i, codes[0][1]) for i in range(40)] + [(400, codes[1][1] ^ 3), (400, codes[1][1] ^ 3)]
    codes += [(None, 5), (401, None)]
    df = spark.createDataFrame([(*c, "x") for c in codes], "vec_id bigint, code bigint, distance string")
    got = hamming_search.top_k(df, df.filter("vec_id % 50 = 0"), k=7, limit=limit, together=together)
    clean = sorted({(i, c) for i, c in codes if i is not None and c is not None})
    want = []
    for q, qc in clean:
        if q % 50 == 0:
            near = sorted((((qc ^ c) & (2**64 - 1)).bit_count(), i) for i, c in clean if i != q)[:7]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    same(got, want)


def test_top_k_with_too_few_rows(spark):
    df = spark.createDataFrame([(0, 1), (50, 2)], "vec_id bigint, code bigint")
    same(hamming_search.top_k(df, df, k=5), [(0, 1, 50, 2), (50, 1, 0, 2)])


@pytest.mark.parametrize("bits", [8, 20, 64])
def test_segments_cover_the_code(bits):
    widths = hamming_search.segment_widths(bits)
    assert sum(widths) == bits and max(widths) - min(widths) <= 1 and max(widths) <= 16


def test_sign_codes(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 2.0]), (2, None), (3, []), (4, [None, 1.0])], "vec_id bigint, embedding array<float>")
    same(hamming_search.sign_codes(df), [(1, 5), (2, 0), (3, 0), (4, 2)])


# --- 2 ---


@pytest.mark.parametrize("digit", [(1, 4, 4096), (128, 4, 1 << 20)])
def test_exact_groups_equal_brute_force(spark, corpus, digit):
    groups: dict[str, list] = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in corpus:
        known = [x for x in groups[t or ""] if x is not None]
        keep = max(known, default=None)
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    same(exact_dedup.exact_groups(docs_frame(spark, corpus), *digit), want)


def test_exact_keep_one(spark, corpus):
    rows = [*corpus, *[(3000, "repeated row")] * 5, *[(None, "repeated without id")] * 3, (3001, "repeated row")]
    df = docs_frame(spark, rows)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    best: dict[str, int | None] = {}
    for i, t in rows:
        best[t or ""] = max((x for x in (best.get(t or ""), i) if x is not None), default=None)
    same(kept.select("doc_id", F.coalesce("text", F.lit(""))), [(i, t) for t, i in best.items()])


# --- 3 ---


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(tested) > 500
    assert sum(p == y for p, y in tested) / len(tested) >= 0.99


def test_additive_model_learns_pairs():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    # A score is nothing but the sum of its tables.
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
    total = total + sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, t in model.pairs)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-total)))


def test_quality_edges(spark, corpus):
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    df = docs_frame(spark, corpus)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(100)] + [(5, None, "x"), (None, 1, "x"), (6, 7, "x"), (3, 0, "x")], "doc_id bigint, quality int, text string")
    model = quality.train(df, labels)
    scored = quality.score(df, model)
    assert scored.count() == len(corpus)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == scored.filter("score >= 0.3").count()


def test_features_do_not_depend_on_neighbours():
    texts = ["Ab cd. ab\nX | y", "", "aa aa aa", "é!!", "\n\n", "x" * 5000]
    whole = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.features(pa.array([t]))[0])
    assert np.allclose(whole[1], 0)
    assert quality.features(pa.array(["so.", "!no"]))[:, quality.FEATURES.index("mark_run_share")].tolist() == [0, 0]


def test_features_and_words_of_long_texts(monkeypatch):
    long = "y" * 9000
    texts = [f"{long} {long}z {long} short {long}", "short", f"a{long}", "w " * 3000]
    whole, words = quality.features(pa.array(texts)), shingles.word_hashes(pa.array(texts))[0]
    assert words[0] == words[2] == words[4] != words[1] and words[3] == words[5] and len(set(words[:7].tolist())) == 4
    assert words[5] == shingles.word_hashes(pa.array(["short"]))[0][0]
    assert np.isclose(whole[0][quality.FEATURES.index("distinct_words")], 3 / 5)
    for module in (quality, shingles):
        monkeypatch.setattr(module, "STEP", 100)
    assert np.allclose(whole, quality.features(pa.array(texts)))
    assert (words == shingles.word_hashes(pa.array(texts))[0]).all()


# --- 4 ---


def one_by_one(lengths, capacities):
    bins, left = [], sum(lengths)
    for length in sorted(lengths, reverse=True):
        left -= length
        able = [(c - used, c, i) for i, (c, used, _) in enumerate(bins) if c - used >= length]
        if able:
            i = min(able)[2]
        else:
            c = min((c for c in sorted(capacities) if c >= length), key=lambda c: (packing.default_cost(c) / (length + min(c - length, left)), c))
            bins.append([c, 0, []])
            i = len(bins) - 1
        bins[i][1] += length
        bins[i][2].append(length)
    return Counter((next(c for c in sorted(capacities) if c >= used), tuple(x)) for _, used, x in bins)


@given(st.sets(st.integers(2, 20), min_size=1, max_size=3), st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=200, deadline=None)
def test_plan_equals_one_by_one(capacities, lengths):
    lengths = [min(x, max(capacities)) for x in lengths]
    got: Counter = Counter()
    for p in packing.plan_bins(dict(Counter(lengths)), capacities):
        contents = tuple(length for length, each, _ in p.parts for _ in range(each))
        got[next(c for c in sorted(capacities) if c >= sum(contents)), contents] += p.count
    assert got == one_by_one(lengths, capacities)


def test_packing_places_every_token_once(spark):
    r = random.Random(2)
    rows = [(i, r.choice([5, 5, 5, 17, r.randrange(1, 90)])) for i in range(400)] + [(1, 5), (None, 7), (500, None), (501, 0), (502, -3)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "doc_id bigint, n_tokens bigint, part string")
    caps = (8, 16, 32)
    out = packing.pack(df, caps).collect()
    empty = [x for x in out if x["length"] == 0]
    assert {x["doc_id"] for x in empty} == {500, 501, 502} and all(x["bin_id"] is None for x in empty)
    bins: dict[int, list] = {}
    tokens: Counter = Counter()
    for x in out:
        if x["length"]:
            bins.setdefault(x["bin_id"], []).append(x)
            tokens[x["doc_id"]] += x["length"]
            assert x["start"] == 32 * x["piece"]
    want: Counter = Counter()
    for i, n in rows:
        want[i] += max(0, n or 0)
    assert tokens == +want
    assert sorted(bins) == list(range(len(bins)))
    shapes: Counter = Counter()
    for parts in bins.values():
        parts.sort(key=lambda x: x["offset"])
        ends = [x["offset"] + x["length"] for x in parts]
        assert [x["offset"] for x in parts] == [0, *ends[:-1]]
        assert len({x["capacity"] for x in parts}) == 1
        assert parts[0]["capacity"] == next(c for c in caps if c >= ends[-1])
        shapes[parts[0]["capacity"], tuple(sorted((x["length"] for x in parts), reverse=True))] += 1
    pieces = [min(32, n - s) for _, n in rows if n and n > 0 for s in range(0, n, 32)]
    assert shapes == one_by_one(pieces, caps)


def test_packed_sequences_decode_to_the_documents(spark, corpus):
    rows = [*corpus, (990, "very long " * 3000)]
    caps = (64, 256, 1024)
    out = packing.pack_texts(docs_frame(spark, rows), BPE, caps).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    pieces: dict = {}
    for x in out:
        assert x["capacity"] in caps and len(x["ids"]) == x["n_tokens"] <= x["capacity"]
        assert x["capacity"] == min(c for c in caps if c >= x["n_tokens"])
        assert x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
        at = 0
        for s in x["segments"]:
            pieces.setdefault((s["doc_id"], s["row"]), []).append((s["start"], x["ids"][at : at + s["length"]]))
            at += s["length"]
        assert at == x["n_tokens"]
    whole = Counter((doc, tuple(i for _, part in sorted(p) for i in part)) for (doc, _), p in pieces.items())
    assert whole == Counter((i, (*tok.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)
    lengths = [len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    cut = [min(1024, n - s) for n in lengths for s in range(0, n, 1024)]
    got = Counter((x["capacity"], tuple(sorted((s["length"] for s in x["segments"]), reverse=True))) for x in out)
    assert got == one_by_one(cut, caps)


# --- 5 ---


def brute_components(rows, words):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), doc) if x is not None), default=None)
    out = []
    for i, (doc, _) in enumerate(rows):
        c = doc if not sets[i] else least[top(i)]
        out.append((doc, len(sets[i]), c, doc == c))
    return out


@pytest.mark.parametrize("limits", [(1000, 1500, 500), (3, 1500, 500), (4, 3, 2), (1000, 5, 3), (1000, 1500, 500, 300)])
def test_near_groups_equal_brute_force(spark, corpus, limits):
    got = minhash_dedup.near_groups(docs_frame(spark, corpus), 4, *limits).drop("th", "grp")
    same(got, brute_components(corpus, 4))


def test_near_keep_one(spark, corpus):
    long = " ".join(f"u{i}" for i in range(60))
    rows = [*corpus, *[(3000, "five words of repeated row")] * 4, *[(3001, " ")] * 3, (3002, " "), (4000, long), (4000, long + " end"), (4001, long)]
    df = docs_frame(spark, rows)
    kept = minhash_dedup.keep_one(df, words=5)
    assert kept.columns == df.columns
    want: dict = {}
    for (i, t), (_, n, c, keep) in zip(rows, brute_components(rows, 5), strict=True):
        if keep:
            # One row a group; wordless rows stand alone, but for repeats.
            want.setdefault((c, t if i is None or i == 184 else None, t or "" if not n else None), []).append((i, t))
    got = Counter(map(tuple, kept.select("doc_id", "text").collect()))
    assert set(got.values()) == {1} and all(any(w in got for w in ws) for ws in want.values()) and sum(got.values()) == len(want)


def test_pairs_within_the_signature_distance_always_meet():
    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 1 << 16, 32).astype(np.uint16)
        b = a.copy()
        at = r.choice(32, minhash_dedup.ERRORS, replace=False)
        b[at] += 1
        chunks = (a != b).reshape(8, 4).sum(1)
        assert chunks.min() <= 1  # one left out symbol makes the chunk agree
        others = np.delete(chunks, int(chunks.argmin()))
        assert others.min() <= 2


@pytest.mark.parametrize("local", [10**6, 0])
def test_components(spark, local):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300, 300), (301 + 0, 302)] + [(400 + i, 401 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t"), local).collect()}
    real = [(a, b) for a, b in edges if a != b]
    nodes, roots = roots_of(np.array([a for a, _ in real]), np.array([b for _, b in real]))
    assert got == dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    for a, b in real:
        assert got[a] == got[b] <= min(a, b)
    assert got[440] == 400 and 300 not in got


# --- 6 ---

PIECES = public_tokenizers.path("piece_bpe_32k.model")


ODD_TEXTS = ["", "a", " ", "  Hello  wörld 日本 \U0001f9ff", "x   y ", "a\nb\n\n c", "the and of", "a▁b c", "▁▁ x▁", "<s> </s> <0x41> <unk>", "......... ------", "    a\n\tb  \n", "\x00é e\u0301"]


def split_ids(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_ids_equal_the_library_on_whole_tables(scale):
    import sentencepiece

    docs = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '/root/testdata/sf{scale}/documents.parquet'").fetchall()]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert split_ids(*sentencepiece_codec.encode_texts(pa.array(docs + ODD_TEXTS), PIECES)) == library.encode(docs + ODD_TEXTS)


@given(st.lists(st.text(alphabet=" aeinorst.,\n▁é日Tx-", max_size=40), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_library_on_random_texts(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert split_ids(*sentencepiece_codec.encode_texts(pa.array(texts), PIECES)) == library.encode(texts)


def model_file(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    change(proto)
    path = tmp_path / "changed.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_unigram_ids_equal_the_library(tmp_path):
    """The same pieces as a unigram model, with scores that the library's floats can add up."""
    import sentencepiece

    def unigram(proto):
        for p in proto.pieces:
            p.score = max(p.score, -32000.0)
        proto.trainer_spec.model_type = 1

    path = model_file(tmp_path, unigram)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    docs = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts = ODD_TEXTS + [t[s : s + 120] for t in docs for s in [r.randrange(max(1, len(t)))]]
    assert split_ids(*sentencepiece_codec.encode_texts(pa.array(texts), path)) == [library.encode(t) for t in texts]


def test_other_models_are_refused(tmp_path):
    def char(proto):
        proto.trainer_spec.model_type = 4

    def no_bytes(proto):
        for p in proto.pieces[3:259]:
            p.type = 1

    for change, why in ((char, "unigram and BPE"), (no_bytes, "byte pieces")):
        with pytest.raises(ValueError, match=why):
            sentencepiece_codec.PieceModel(model_file(tmp_path, change))


def test_codec_round_trip(spark, corpus):
    rows = [*corpus, (900, " lead"), (901, "\x00\x01 \u2028mark"), (902, "日本語 😀 é")]
    df = docs_frame(spark, rows)
    encoded = sentencepiece_codec.encode(df, PIECES)
    same(sentencepiece_codec.decode(encoded, PIECES), [(i, t or "") for i, t in rows])
    assert all(r["same"] for r in sentencepiece_codec.round_trip(df, PIECES).collect())
    by_id = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert by_id[176] == []


def test_codec_reads_a_mark_as_a_space(spark):
    df = docs_frame(spark, [(1, "a▁b c"), (2, "a b c")])
    encoded = sentencepiece_codec.encode(df, PIECES)
    same(sentencepiece_codec.decode(encoded, PIECES), [(1, "a b c"), (2, "a b c")])
    assert {r["doc_id"]: r["same"] for r in sentencepiece_codec.round_trip(df, PIECES).collect()} == {1: False, 2: True}


# --- 7 ---


def full_alignment(doc, template):
    """Best local alignment without a band: (score, matched words)."""
    n = len(template)
    above = [(0, 0)] * (n + 1)
    best = (0, 0)
    for word in doc:
        row = [(0, 0)]
        for j in range(1, n + 1):
            s, m = above[j - 1]
            cell = (s + 2, m + 1) if word == template[j - 1] else (s - 1, m)
            cell = max(cell, (above[j][0] - 1, above[j][1]), (row[j - 1][0] - 1, row[j - 1][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1])
        above = row
    return best


def test_alignment_equals_full_alignment():
    r = random.Random(6)
    for _ in range(150):
        template = [r.randrange(30) for _ in range(r.randrange(4, 25))]
        doc = list(template)
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(doc))
            r.choice([lambda: doc.pop(at) if len(doc) > 3 else None, lambda: doc.insert(at, 99), lambda: doc.__setitem__(at, 98)])()
        lead = [r.randrange(100, 130) for _ in range(r.randrange(5))]
        matched, start, stop = license_scan.align(np.array(lead + doc, np.uint64), np.array(template, np.uint64), -8, 8)
        assert matched == full_alignment(lead + doc, template)[1]
        assert 0 <= start < stop <= len(lead + doc)


def test_winnowing_guarantee():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 50):
        picked = license_scan.winnow(r.integers(0, 1 << 40, n).astype(np.uint64))
        assert picked[0] < license_scan.W and n - picked[-1] <= license_scan.W and (np.diff(picked) <= license_scan.W).all()


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    rows = [
        (1, "x y z\nReleased under the MIT License.\nmore é"),
        (2, "é " + mit.replace("free of charge", "gratis", 1).upper() + " END"),
        (3, "Licensed under the Apache License, Version 2.0. And: licensed under the apache LICENSE version 2.0"),
        (4, "nothing here"), (5, None), (6, ""), (None, "All rights reserved."), (7, " ".join(mit.split()[:20])),
    ]
    got = license_scan.scan(docs_frame(spark, rows)).collect()
    names = Counter((r["doc_id"], r["license"]) for r in got)
    assert names == {(1, "MIT"): 1, (2, "MIT"): 1, (3, "Apache-2.0"): 2, (None, "proprietary"): 1}
    texts = dict(rows)
    for r in got:
        part = texts[r["doc_id"]][r["start"] : r["stop"]]
        assert part[0].isalnum() and part[-1].isalnum() and 0.8 <= r["coverage"] <= 1
    assert [texts[1][r["start"] : r["stop"]] for r in got if r["doc_id"] == 1] == ["Released under the MIT License"]


def license_rows(text):
    """(license, matched, coverage, span) of one text's matches, without Spark."""
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    words, starts, stops, _, _ = license_scan._words(pa.array([text]))
    hits = index.hits(license_scan._grams(words)) + index.anchor_hits(words)
    found = license_scan.scan_words(words, hits, index)
    raw = text.encode()
    return [(index.names[t], m, m / len(index.words[t]), raw[starts[a] : stops[b - 1]].decode()) for t, m, a, b in found]


@pytest.mark.parametrize("times", [2, 3, 100])
@pytest.mark.parametrize(("name", "which"), [(n, i) for n, texts in license_scan.TEMPLATES.items() for i in range(len(texts))])
def test_license_scan_finds_adjacent_repeats(name, which, times):
    text = license_scan.TEMPLATES[name][which]
    got = license_rows("\n".join([text] * times))
    whole = license_rows(text)
    assert len(whole) == 1 and got == whole * times


def test_license_scan_rescans_what_another_template_leaves():
    apache, rights = license_scan.TEMPLATES["Apache-2.0"], license_scan.TEMPLATES["proprietary"][0]
    got = license_rows(" ".join([rights, apache[0], apache[1], apache[0], rights, rights]))
    assert [(n, m) for n, m, _, _ in got] == [("proprietary", 3), ("Apache-2.0", 8), ("Apache-2.0", len(license_scan._words(pa.array([apache[1]]))[0])), ("Apache-2.0", 8)] + [("proprietary", 3)] * 2


@pytest.mark.parametrize("many", [9, 11, 13])
def test_license_scan_bridges_missing_and_inserted_words(many):
    mit = license_scan.TEMPLATES["MIT"][1].replace("and/or", "and or").split()
    middle = len(mit) // 2
    missing = " ".join(mit[: middle - many // 2] + mit[middle - many // 2 + many :])
    inserted = " ".join([*mit[:middle], *(f"holder{i}" for i in range(many)), *mit[middle:]])
    assert [(n, m, s) for n, m, _, s in license_rows(missing)] == [("MIT", len(mit) - many, missing.rstrip(":"))]
    assert [(n, m, s) for n, m, _, s in license_rows(inserted)] == [("MIT", len(mit), inserted.rstrip(":"))]


@pytest.mark.parametrize("text", ["Released under MIT License", "Released under an MIT License", "Released under our the very MIT fine License", "licensed CC BY own NC 4.0"])
def test_license_scan_finds_short_notices_without_a_shared_run(text):
    got = license_rows(f"before {text} after")
    assert len(got) == 1 and got[0][2] >= license_scan.MIN_COVERAGE and text.endswith(got[0][3][-3:])


def test_license_scan_equals_unbanded_alignment():
    """Whatever is changed, a match is reported exactly where an alignment over the whole text, without index and band, has one."""
    r = random.Random(9)
    seen = Counter()
    for _ in range(300):
        n = r.randrange(3, 40)
        template = [f"w{r.randrange(25)}" for _ in range(n)]
        index = license_scan.TemplateIndex({"t": [" ".join(template)]})
        doc = list(template)
        for _ in range(r.randrange(0, 4)):
            at, many = r.randrange(len(doc) + 1), r.randrange(1, 2 + n // 3)
            r.choice([lambda: doc.__delitem__(slice(at, at + max(1, many // 3))), lambda: doc.__setitem__(slice(at, at), [f"x{i}" for i in range(many)])])()
        text = " ".join([f"y{i}" for i in range(r.randrange(60))] + doc + [f"z{i}" for i in range(r.randrange(60))])
        words = license_scan._words(pa.array([text]))[0]
        whole = license_scan.align_all(words, index.words[0], -len(words) - n, len(words) + n, index.need[0])
        hits = index.hits(license_scan._grams(words)) + index.anchor_hits(words)
        got = license_scan.scan_words(words, hits, index)
        assert [g[1:] for g in got[:1]] == whole[:1] and len(whole) <= 1
        seen[len(got)] += 1
    assert min(seen[0], seen[1]) > 20


# --- 8 ---


@pytest.mark.parametrize("rule_bytes", [url_filter.RULE_BYTES, 0])
def test_url_rules_equal_brute_force(spark, rule_bytes):
    r = random.Random(8)
    hosts = ["com", "example.com", "a.example.com", "xexample.com", "net", "b.net", "EXAMPLE.com:80", "", "org.", "user@com"]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['', '/', '/en', '/en/', '/en/7', '/en/71', '/de/8'])}{r.choice(['', '?q=/en/', '#f', '?x#y'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://com\n/en/"]
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "", "block"), ("net", "/de/", "allow"), ("com", "/en/", "allow"), ("b.net", "", "block"), ("", "/x", "block"), (None, "/", "block"), ("com", None, "block")]
    pages = spark.createDataFrame([(i if i % 17 else None, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), rule_bytes=rule_bytes)
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + (p or "")), len(h), v == "allow", h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=None)
        want.append((i if i % 17 else None, host, path, best[3] if best else None, best[4] if best else "allow"))
    same(got, want)


# --- 9 ---


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    odd = [(800 + i, t) for i, t in enumerate(["  a  b ", "é x  y", "a　b", "<|endoftext|> hi <|endoftext|>x", "don't  stop\n\n x \t y", " ", "e\u0301 a", "ÿ × ñ", "日本 語"])]
    unique = {i: t for i, t in [*corpus, *odd] if i is not None}
    rows = [*unique.items(), (None, "no id"), (None, None)]
    df = docs_frame(spark, rows)
    folder = Scratch(spark, "test").mkdirs("shards")
    shards, dictionary = token_files.write_token_files(df, BPE, folder)
    got = token_files.read_token_files(shards, folder, dictionary).collect()

    def ids_of(t):
        return [*tok.encode(t or "", add_special_tokens=False).ids, 0]

    start = sum(len(ids_of(t)) for i, t in rows if i is None)
    want = []
    for i in sorted(unique):
        ids = ids_of(unique[i])
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert sorted(r["start"] for r in got if r["doc_id"] is None)[0] == 0
    # One document alone, and a wrong dictionary.
    part = next(r["shard"] for r in shards.collect() if r["n_docs"])
    shard = token_files.TokenShard(folder, part, dictionary)
    row = shard.index[0]
    if not row["is_null"]:
        assert shard.ids(0).tolist() == ids_of(unique[int(row["doc_id"])])
    with pytest.raises(ValueError, match="dictionary"):
        token_files.TokenShard(folder, part, b"other" * 10)


@pytest.mark.parametrize("rows", [1, 3, 40])
def test_token_files_of_few_documents(spark, rows):
    """From one document, too little for a dictionary, to enough for a small one."""
    r = random.Random(rows)
    df = docs_frame(spark, [(i, rng_words(r, 300, 60)) for i in range(rows)])
    folder = Scratch(spark, "test").mkdirs("shards")
    shards, dictionary = token_files.write_token_files(df, BPE, folder)
    assert (len(dictionary) == 0) == (rows == 1) and len(dictionary) <= token_files.DICTIONARY_BYTES
    got = token_files.read_token_files(shards, folder, dictionary).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(rows))


def test_order_of_equal_ids_is_defined(spark):
    rows = [(1, f"text {i}") for i in range(30)]
    read = [sorted(map(tuple, token_files.round_trip(docs_frame(spark, rows[::step]), BPE).collect())) for step in (1, -1)]
    assert read[0] == read[1]


@pytest.mark.parametrize("most", [64, 1000])
def test_long_texts_are_encoded_in_parts(monkeypatch, most):
    """A text cut into parts of a few bytes has the ids it has as a whole, for both tokenizers."""
    from orthoflow.llm import chunk_cache

    r = random.Random(1)
    texts = pa.array(["", rng_words(r, 400), "x" * 3000, "a\n" * 500 + "é é\u3000é" * 200, " " * 500 + "end", rng_words(r, 30)])
    whole = token_files.encode_texts(texts, BPE), sentencepiece_codec.encode_texts(texts, PIECES)
    cut = chunk_cache.encode_chunks
    for module in (token_files, sentencepiece_codec):
        monkeypatch.setattr(module, "encode_chunks", lambda raw, ends, cuts, cache: cut(raw, ends, cuts, cache, most))
    for (ids, counts), (p_ids, p_counts) in zip(whole, (token_files.encode_texts(texts, BPE), sentencepiece_codec.encode_texts(texts, PIECES)), strict=True):
        assert ids.tolist() == p_ids.tolist() and counts.tolist() == p_counts.tolist()


@given(st.lists(st.text(alphabet=" ab'é\u00a0\u3000\n\t<|1.日", max_size=20), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_chunks_encode_like_whole_texts(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    ids, counts = token_files.encode_texts(pa.array(texts), BPE, end_id=None)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


# --- 10 ---


def brute_lines(rows, min_docs, keep):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [[(x, x.strip(" \t\n\x0b\x0c\r").translate(lower)) for x in (t or "").split("\n")] for _, t in rows]
    found: dict[str, set] = {}
    for (doc, text), lines in zip(rows, split, strict=True):
        for _, k in lines:
            found.setdefault(k, set()).add((doc, text or "" if doc is None else None))
    frequent = {k for k, docs in found.items() if k and len(docs) >= min_docs}
    out, seen = [], set()
    for (doc, _), lines in zip(rows, split, strict=True):
        stays = []
        for line, k in lines:
            if k not in frequent or (keep == "first" and k not in seen):
                stays.append(line)
            if k in frequent:
                seen.add(k)
        out.append((doc, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_line_dedup_equals_brute_force(spark, corpus, limit):
    rows = [*corpus, *((1000 + i, "Common line\n" * 3 + "\n" * 130 + "tail") for i in range(3))]
    got = line_dedup.dedup_lines(docs_frame(spark, rows), min_docs=10, limit=limit).drop("dropped")
    same(got, brute_lines(rows, 10, "none"))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_line_dedup_keeps_first(spark, corpus, limit):
    rows = sorted({i: t for i, t in corpus if i is not None}.items())
    got = line_dedup.dedup_lines(docs_frame(spark, rows), min_docs=2, keep="first", limit=limit).drop("dropped")
    same(got, brute_lines(rows, 2, "first"))


def test_line_dedup_counts_documents_not_rows(spark):
    rows = [(1, f"often\nseldom {i}") for i in range(10)] + [(2, "often")]
    got = line_dedup.dedup_lines(docs_frame(spark, rows), min_docs=10)
    assert got.agg(F.sum("n_dropped")).first()[0] == 0
    rows += [(i, "often") for i in range(3, 11)]
    got = line_dedup.dedup_lines(docs_frame(spark, rows), min_docs=10)
    assert got.agg(F.sum("n_dropped")).first()[0] == len(rows)


def test_line_dedup_streams_sorted_ranges(spark):
    """The stream is dealt in ranges of (hash, document): its window needs no exchange of its own, and a popular line is split."""
    docs = docs_frame(spark, [(i, f"common\nline {i}") for i in range(300)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = line_dedup.line_stream(docs, Scratch(spark, "t")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_part: dict[int, list] = {}
    for r in stream:
        by_part.setdefault(r["part"], []).append((r["h1"], r["h2"], r["doc_id"]))
    bounds = sorted((min(keys), max(keys)) for keys in by_part.values())
    assert len(bounds) > 2 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    popular = Counter((r["h1"], r["h2"]) for r in stream).most_common(1)[0][0]
    assert len({r["part"] for r in stream if (r["h1"], r["h2"]) == popular}) > 1
    assert sum(r["fresh"] for r in stream) == 600


def test_line_dedup_runs_no_python(spark):
    plan = queries.op10_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- the pipeline ---


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = corpus_pipeline.quality_filter(spark, docs, SF)
    assert good.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    judged = [(i in kept) == labels[i] for i in labels if i in rows]
    assert sum(judged) / len(judged) > 0.9
    single = corpus_pipeline.exact_copies(spark, docs, SF)
    newest: dict[str, int] = {}
    for i, r in rows.items():
        newest[r["text"]] = max(i, newest.get(r["text"], i))
    assert {r["doc_id"] for r in single.collect()} == set(newest.values())
    pairs = [(i, r["text"]) for i, r in sorted(rows.items())]
    near = corpus_pipeline.near_copies(spark, docs, SF)
    assert near.columns == docs.columns
    assert {r["doc_id"] for r in near.collect()} == {i for i, _, _, keep in brute_components(pairs, 5) if keep}
    packed = corpus_pipeline.best_fit(spark, docs, SF).select(F.inline("segments"))
    want = {r["doc_id"]: r["n_tokens"] for r in queries.op9_token_files(spark, SF).collect()}
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    # The whole run is the stages one after another.
    end = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in end.select(F.inline("segments")).select("doc_id").distinct().collect()}
    assert ids and ids <= kept
