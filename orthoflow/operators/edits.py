"""Edit algebra on arrays of edits: applying, claiming, mapping to file ranges. JVM-side folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apply_edits_col(text: Column, edits: Column) -> Column:
    """struct(text, n_applied, applied): `edits` is an array of struct with `start`, `end` and `after` first.

    Edits are taken in order of (start, end, rest); one that begins before the last one's end or leaves the text is skipped.
    """
    kind = "array<int>"

    def step(acc, e):
        ok = (e["start"] >= acc["at"]) & (e["end"] >= e["start"]) & (e["end"] <= F.length(text))
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, e["start"] - acc["at"]), e["after"])
        return F.struct(
            F.when(ok, e["end"]).otherwise(acc["at"]).alias("at"),
            F.when(ok, piece).otherwise(acc["out"]).alias("out"),
            F.when(ok, F.concat(acc["starts"], F.array(e["start"]))).otherwise(acc["starts"]).alias("starts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(kind).alias("starts"))
    done = F.aggregate(F.array_sort(edits), start, step)
    return F.struct(
        F.concat(done["out"], F.substr(text, done["at"] + 1)).alias("text"), F.size(done["starts"]).alias("n_applied"), done["starts"].alias("starts")
    )


def claim_phrases_col(matches: Column) -> Column:
    """Of phrase matches, struct(section, minus_len, file_ix, pos, n, ...), those left by greedy claiming.

    In order of the struct; a match that touches a token claimed before is dropped.
    """

    def step(acc, m):
        mine = F.sequence(m["pos"], m["pos"] + m["n"] - 1)
        free = ~F.arrays_overlap(acc["taken"], mine)
        return F.struct(
            F.when(free, F.concat(acc["taken"], mine)).otherwise(acc["taken"]).alias("taken"),
            F.when(free, F.concat(acc["kept"], F.array(m["match"]))).otherwise(acc["kept"]).alias("kept"),
        )

    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<int>").alias("kept"))
    ordered = F.transform(F.array_sort(matches), lambda m, i: F.struct(m["pos"].alias("pos"), m["n"].alias("n"), i.alias("match")))
    kept = F.aggregate(ordered, start, step)["kept"]
    return F.transform(kept, lambda i: F.element_at(F.array_sort(matches), i + 1))


def file_range_col(fragments: Column, start: Column, end: Column) -> Column:
    """The file range of [start, end) where one fragment holds it (p_start, p_end, f_start), else null. Without entity maps."""
    inside = F.filter(fragments, lambda f: (start >= f["p_start"]) & (end <= f["p_end"]))
    first = F.get(inside, F.lit(0))
    return F.when(
        F.size(inside) > 0,
        F.struct((first["f_start"] + start - first["p_start"]).alias("f_start"), (first["f_start"] + end - first["p_start"]).alias("f_end")),
    )
