"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments of at most 16 bits, as even as can be. Two codes that differ in fewer than m * (r + 1) bits have a
segment in which they differ in at most r. So each round probes every segment with all values at exactly radius r;
after it, every code nearer than m * (r + 1) has been seen and verified. A query leaves when its k-th neighbour
is nearer than that; the rest go on with r + 1.

Rows with one code are one entry of the index with its k + 1 smallest ids: no other row of that code can be in a
top-k result, and a vector that a third of all rows share is one entry. Equal queries are asked once.
A round is an equi-join of the probed values of the queries still open with the index on (segment, value): the index is broadcast
within a checked size. Beyond it both are dealt by (segment, value, salt), where a value that many codes share has its
codes dealt over as many salts as its count asks for, and the probes go to each. A hit farther than the query's k-th so far is
dropped where it is found, before any shuffle.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, Scratch, rows, small_side

BITS, SEGMENT = 64, 16
#: Codes of one segment value that meet in one place when the index is not broadcast.
TOGETHER = 10_000


def sign_codes(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """(vec_id, code): bit i is set where component i + 1 is over 0. Missing and null components count as 0."""
    code = F.aggregate(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(
            F.when(F.coalesce(F.try_element_at("embedding", i + 1), F.lit(0)) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
                F.lit(0).cast("bigint")
            )
        ),
    )
    return vectors.select("vec_id", F.when(F.col("embedding").isNull(), F.lit(0).cast("bigint")).otherwise(code).alias("code"))


def segment_widths(bits: int = BITS) -> list[int]:
    """Bits of each segment, the same at every size of the table: wider ones for more rows would make probes outgrow the queries."""
    m = -(-bits // SEGMENT)
    return [bits // m + (s < bits % m) for s in range(m)]


def _segments(code, widths: list[int]):
    """Array of (seg, val) of a code."""
    at = [sum(widths[:s]) for s in range(len(widths))]
    return F.array(
        *[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(code, at[s]).bitwiseAND((1 << w) - 1).cast("int").alias("val")) for s, w in enumerate(widths)]
    )


def _probes(live: DataFrame, widths: list[int], radius: int) -> DataFrame:
    """(q, bound, seg, val): every segment's values at exactly `radius` from the query's."""

    def masks(width: int):
        return F.split(F.lit(",".join(str(sum(1 << b for b in c)) for c in combinations(range(width), radius))), ",").cast("array<int>")

    own = live.select("q", "bound", F.inline(_segments(F.col("q"), widths)))
    parts = [own.filter(F.col("seg").isin([s for s, w in enumerate(widths) if w == width])).withColumn("mask", F.explode(masks(width))) for width in sorted(set(widths)) if radius <= width]
    return reduce(DataFrame.unionAll, parts).select("q", "bound", "seg", F.col("val").bitwiseXOR(F.col("mask")).alias("val"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS, limit: int = BROADCAST_BYTES, together: int = TOGETHER) -> DataFrame:
    """The k rows of `codes` nearest to each row of `queries`, both (vec_id, code): query_id, rank, vec_id, distance.

    Distance is the number of differing bits; ties go to the smaller vec_id; a row is not its own neighbour. Rows with a
    null vec_id or code take no part; rows that repeat a vec_id with the same code are one row. With fewer than k other rows, all
    of them are returned. Other columns are not read. An index within `limit` bytes is broadcast.
    """
    scratch = Scratch(codes.sparkSession, "hamming")
    clean = "vec_id IS NOT NULL AND code IS NOT NULL"
    near = W.partitionBy("code").orderBy("vec_id")
    ids = codes.filter(clean).select("code", "vec_id").distinct().withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    entries = scratch.table(ids.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    widths = segment_widths(bits)
    m = len(widths)
    index = scratch.table(entries.select("code", F.size("ids").alias("held"), F.inline(_segments(F.col("code"), widths))), "index")
    asked = scratch.table(queries.filter(clean).select("vec_id", "code").distinct(), "asked")
    total = entries.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    want = min(k + 1, total)  # a query's own row may be among the rows held for its code
    if rows(index) * 40 <= limit:
        index = F.broadcast(index)
        salts = None
    else:
        popular = index.groupBy("seg", "val").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("salts")).filter("salts > 1")
        salts = scratch.table(popular, "popular")
        dealt = index.join(small_side(salts, 32), ["seg", "val"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        index = dealt.withColumn("salt", F.pmod(F.xxhash64("code"), F.col("salts")).cast("int")).drop("salts").hint("merge")
    live = scratch.table(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(bits)), "live")
    found, results = None, []
    for radius in range(max(widths) + 1):
        if not rows(live):
            break
        probes, on = _probes(live, widths, radius), ["seg", "val"]
        if salts is not None:
            probes = probes.join(small_side(salts, 32), on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
            on = [*on, "salt"]
        hits = probes.join(index, on)
        hits = hits.select("q", "bound", "code", "held", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int").alias("distance"))
        both = hits.filter(F.col("distance") <= F.col("bound")).drop("bound")
        both = both if found is None else both.unionByName(found.drop("near"))
        # Of an entry's rows at most `want` are ever needed: keep the entries nearer than the want-th row, and its ties.
        order = W.partitionBy("q").orderBy("distance")
        ahead = F.coalesce(F.sum("held").over(order.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
        # How many rows the round has proved to be all that are so near.
        proved = F.sum(F.when(F.col("distance") < m * (radius + 1), F.col("held")).otherwise(0)).over(W.partitionBy("q"))
        kept = both.dropDuplicates(["q", "code"]).withColumn("ahead", ahead).filter(F.col("ahead") < want).withColumn("near", proved)
        new = scratch.table(kept.drop("ahead"), "found")
        scratch.drop(found)
        results.append(new.filter(F.col("near") >= want).drop("near"))
        state = new.groupBy("q").agg(F.max("near").alias("near"), F.sum("held").alias("n"), F.max("distance").alias("far"))
        rest = live.select("q").join(state, "q", "left").filter(F.coalesce("near", F.lit(0)) < want)
        rest = scratch.table(rest.select("q", F.when(F.col("n") >= want, F.col("far")).otherwise(bits).alias("bound")), "live")
        scratch.drop(live)
        live = rest
        found = scratch.table(new.join(live.select("q"), "q", "left_semi"), "open")
    if not results:
        return asked.limit(0).selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "1 AS distance")
    everything = reduce(DataFrame.unionByName, results)
    held = everything.join(entries, "code").select("q", "distance", F.explode("ids").alias("vec_id"))
    # Per code the k + 1 first rows; each query drops itself and takes k.
    first = W.partitionBy("q").orderBy("distance", "vec_id")
    per_code = held.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    mine = asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).join(per_code, "q").filter("query_id <> vec_id")
    ranked = mine.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "q").orderBy("distance", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))
