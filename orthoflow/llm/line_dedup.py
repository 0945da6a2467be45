"""Line dedup in DataFrame functions only: a range-partitioned, sorted stream of line hashes, and keep bitmaps.

1. Every line's key becomes one row (h1, h2, doc_id, th, pos): two 64-bit hashes and the place. Texts are left behind.
2. Rows are range-partitioned by (hash, document) and sorted by (hash, document, position) within a partition. The first row of a
   hash and document in that stream is marked as the document's first occurrence. A document counts once for a
   key, by its doc_id. The range goes on into the document, so a line that stands in a third of all documents is dealt over
   many partitions, and no partition holds part of a document's rows of a key.
3. Marks are counted per hash within each partition first; a key then has at most one row a partition. Beside the count stands
   the key's first occurrence, the least mark.
4. Rows of the keys to drop become one sparse bitmap per document: (word, bits) pairs of 64 positions, only for words with a
   dropped line. Keys to drop are broadcast within a checked size. Beyond it they are joined by (partition, hash), so that
   a popular key stays dealt over the partitions of step 2.

Nulls and repeats: a null or empty text is one empty line. Rows that share a doc_id are one document to the count, and each is
cleaned by itself; rows without a doc_id are one document where their texts are equal. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, SPACES, Scratch, ascii_lower, rows, small_side, text_or_empty

KEY = ["h1", "h2"]
#: A document to the count: its doc_id, or without one its text.
DOC = ["doc_id", "own"]


def line_key(line):
    """The line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th tells apart rows that share a doc_id; equal rows get equal bitmaps."""
    text = text_or_empty()
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def line_stream(docs: DataFrame, scratch: Scratch, min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc_id, own, th, pos, fresh, part) of every line whose key has `min_chars` characters: the sorted stream, as a table.

    `fresh` marks a document's first row of a key, `part` is the partition of the stream.
    """
    lines = _rows(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    own = F.when(F.col("doc_id").isNull(), F.col("th")).otherwise(F.lit(0).cast("bigint"))
    hashed = lines.filter(F.length(key) >= min_chars).select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), "doc_id", own.alias("own"), "th", "pos"
    )
    # A table of its own: the range partitioner reads its input twice.
    hashed = scratch.table(hashed, "hashed")
    ranged = hashed.repartitionByRange(*KEY, *DOC).sortWithinPartitions(*KEY, *DOC, "th", "pos")
    nth = F.row_number().over(W.partitionBy(*KEY, *DOC).orderBy("th", "pos"))
    stream = scratch.table(ranged.withColumn("fresh", nth == 1).withColumn("part", F.spark_partition_id()), "stream")
    scratch.drop(hashed)
    return stream


def line_totals(stream: DataFrame, min_docs: int = 10) -> DataFrame:
    """(h1, h2, n_docs, first): keys found in at least `min_docs` documents, and the place of the first line of each."""
    place = F.struct("doc_id", "own", "th", "pos")
    marked = stream.filter("fresh").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.min(place).alias("first"))
    return marked.filter(F.col("n_docs") >= min_docs)


def drop_bitmaps(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", scratch: Scratch | None = None, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """(doc_id, th, n_dropped, dropped): one row per document that loses lines.

    `dropped` is the compressed bitmap, an array of (word, bits): bit i of word w set means that line
    64 * w + i goes. keep="first" spares the first line of each key in (doc_id, position) order;
    keep="none" drops every line of a key that reaches `min_docs`.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    stream = line_stream(docs, scratch, min_chars)
    totals = scratch.table(line_totals(stream, min_docs), "totals")
    if rows(totals) * 72 <= limit:
        hit = stream.join(F.broadcast(totals), KEY)
    else:
        dealt = stream.filter("fresh").select("part", *KEY).distinct().join(totals.hint("merge"), KEY)
        hit = stream.join(dealt.hint("merge"), ["part", *KEY])
    if keep == "first":
        hit = hit.filter(F.struct("doc_id", "own", "th", "pos") != F.col("first"))
    word, bit = F.shiftright("pos", 6), F.expr("shiftleft(1L, pos & 63)")
    words = hit.groupBy("doc_id", "th", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "th").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped")
    )


def kept_text(text, dropped):
    """`text` without the lines whose bit is set; the others joined by a newline."""
    words = F.map_from_entries(dropped)

    def stays(_, i):
        bits = F.coalesce(words[F.shiftright(i, 6)], F.lit(0).cast("bigint"))
        return bits.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i.bitwiseAND(63))) == 0

    return F.when(dropped.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of `docs` as (doc_id, n_lines, n_dropped, dropped, text): `text` holds the kept lines.

    The bitmaps are joined to the documents: broadcast within `limit` bytes as they are, by sort-merge beyond it.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    maps = drop_bitmaps(docs, min_docs, min_chars, keep, scratch, limit).withColumnsRenamed({"doc_id": "m_id", "th": "m_th"})
    maps = scratch.table(maps, "bitmaps", F.size("dropped") * 40 + 80)
    joined = _rows(docs).join(small_side(maps, limit=limit), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    return joined.select(
        "doc_id",
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        "dropped",
        kept_text(F.col("text"), F.col("dropped")).alias("text"),
    )
