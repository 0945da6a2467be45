"""The corpus operators as queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, hamming_search, license_scan, line_dedup, minhash_dedup, packing, quality, sentencepiece_codec, token_files, url_filter
from ._shared import read
from ._shared import tokenizer as tokenizer_file

#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_hamming_top_k(spark, sf_dir):
    codes = hamming_search.sign_codes(read(spark, sf_dir, "embeddings"))
    return hamming_search.top_k(codes, codes.filter("vec_id % 50 = 0"), k=10)


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels), threshold=0.3)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_packing(spark, sf_dir, tokenizer: str | None = None):
    """One row per packed sequence; the ids themselves are given by their checksum."""
    packed = packing.pack_texts(read(spark, sf_dir, "documents"), tokenizer or tokenizer_file("byte_bpe_50k.json"))
    segments = F.transform("segments", lambda s: F.struct(s["doc_id"].alias("doc_id"), s["piece"].alias("piece"), s["start"].alias("start"), s["length"].alias("length")))
    return packed.select("bin_id", "capacity", "n_tokens", segments.alias("segments"), "ids_crc32")


def op5_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_groups(read(spark, sf_dir, "documents"), words=4).drop("th", "grp")


def op6_sentencepiece(spark, sf_dir, model: str | None = None):
    return sentencepiece_codec.round_trip(read(spark, sf_dir, "documents"), model or tokenizer_file("piece_bpe_32k.model"))


def op7_license_scan(spark, sf_dir):
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), rules)


def op10_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_token_files(spark, sf_dir, tokenizer: str | None = None):
    return token_files.round_trip(read(spark, sf_dir, "documents"), tokenizer or tokenizer_file("byte_bpe_50k.json"))


QUERIES = {
    "op1_hamming_top_k": op1_hamming_top_k,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_license_scan": op7_license_scan,
    "op8_url_filter": op8_url_filter,
    "op9_token_files": op9_token_files,
    "op10_line_dedup": op10_line_dedup,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op1_hamming_top_k": """
        WITH c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i], 0) > 0) AS b FROM embeddings),
        codes AS (
            SELECT vec_id, list_sum(list_transform(range(0, 32), lambda i: CASE WHEN b[i + 1] THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS lo,
                   list_sum(list_transform(range(0, 32), lambda i: CASE WHEN b[i + 33] THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS hi
            FROM c),
        d AS (
            SELECT q.vec_id AS query_id, r.vec_id, (bit_count(xor(q.lo, r.lo)) + bit_count(xor(q.hi, r.hi)))::INT AS distance
            FROM codes q JOIN codes r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM d)
        SELECT query_id, rank, vec_id, distance FROM n WHERE rank <= 10""",
    "op2_exact_dedup": """
        WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
        FROM documents d JOIN g ON coalesce(d.text, '') = g.t""",
    "op5_minhash_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
            FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, p.v FROM r JOIN p ON p.u = r.v)
        SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) c ON c.u = s.doc_id""",
    "op8_url_filter": f"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        p AS (
            SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
                   regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
            FROM parts),
        r(rhost, rpath, rverdict) AS (VALUES {", ".join(repr(x) for x in URL_RULES)}),
        hits AS (
            SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, rverdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
            FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
        SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.rverdict, 'allow') AS verdict
        FROM p LEFT JOIN hits h ON h.page_id = p.page_id AND h.n = 1""",
    "op10_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        k AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON f.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
