"""Reports over edit logs and open cases: grouped counts in Spark, then a small page made on the driver."""

from __future__ import annotations

import unicodedata
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import KIND_NAMES, STYLE_KINDS

TOP_EDITS, TOP_OPEN, TOP_TEXT = 200, 300, 40


def edits_by_kind(edits: DataFrame) -> DataFrame:
    return edits.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def grouped_edits(edits: DataFrame, top: int = TOP_EDITS, order: list[str] = ["book_id", "entry_ix", "para_ix", "layer", "start"]) -> DataFrame:
    """(kind, before, after, n, reason, place): the `top` most frequent edits of each kind; the reason is the first one's."""
    groups = edits.groupBy("kind", "before", "after").agg(F.count(F.lit(1)).alias("n"), F.min_by("reason", F.struct(*order)).alias("reason"))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "before", "after"))
    return groups.withColumn("place", place).filter(F.col("place") <= top)


def grouped_open(cases: DataFrame) -> DataFrame:
    """(before, candidates, n) of open cases."""
    return cases.groupBy("before", F.array_join("cands", ", ").alias("candidates")).agg(F.count(F.lit(1)).alias("n"))


def book_summary(paragraphs: DataFrame, edits: DataFrame, open_cases: DataFrame, style: DataFrame) -> DataFrame:
    """One row per book: paragraphs, characters, edits, edits that are no matter of style, doubtful ones, open cases, style."""
    para = paragraphs.groupBy("book_id").agg(
        F.countDistinct("entry_ix").alias("n_files"), F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.length("text_before")).alias("n_chars")
    )
    ed = edits.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_edits"), F.count_if(~F.col("kind").isin(*STYLE_KINDS)).alias("n_errors"), F.count_if(F.col("certainty") == "doubtful").alias("n_doubtful")
    )
    op = open_cases.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_open"))
    joined = para.join(ed, "book_id", "left").join(op, "book_id", "left").join(style, "book_id", "left")
    return joined.na.fill(0, ["n_edits", "n_errors", "n_doubtful", "n_open", "n_old", "n_new"])


def scorer_calls(cases: DataFrame) -> DataFrame:
    """(book_id, n_calls): texts that a scorer is asked for, the original and every candidate of each case without evidence."""
    return cases.filter("evidence = 'none'").groupBy("book_id").agg(F.sum(F.size("cands") + 1).alias("n_calls"))


def visible(s: str) -> str:
    """Spaces, line ends and invisible characters made visible."""
    if not s:
        return "∅"

    def one(c: str) -> str:
        if c in " \t\n":
            return {" ": "␣", "\t": "⇥", "\n": "⏎"}[c]
        odd = unicodedata.category(c) == "Cc" or c == "\u00ad" or "\u200b" <= c <= "\u200f"
        return f"⟨U+{ord(c):04X}⟩" if odd else c

    return "".join(map(one, s))


def visible_pair(old: str, new: str) -> tuple[str, str]:
    """Both made visible; where they look the same, with their code points."""
    a, b = visible(old), visible(new)
    if unicodedata.normalize("NFC", a) != unicodedata.normalize("NFC", b):
        return a, b
    codes = [" ".join(f"U+{ord(c):04X}" for c in s) for s in (old, new)]
    return f"{a} ⟨{codes[0]}⟩", f"{b} ⟨{codes[1]}⟩"


def _text(s: str) -> str:
    return escape(s, quote=False)


def html_report(summary: dict, edits: list, open_cases: list, title: str | None = None, has_scorer: bool = False, conflicts: int = 0) -> str:
    """A page from one book's `book_summary` row, its `grouped_edits` and its `grouped_open` rows (bounded lists)."""
    s = summary
    out = [
        "<!doctype html><html lang='vi'><head><meta charset='utf-8'><title>Báo cáo sửa chính tả</title></head><body>",
        f"<h1>{_text(title or '(không rõ nhan đề)')}</h1>",
        f"<p>{s['n_files']} file, {s['n_paragraphs']} đoạn, {s['n_chars']} chữ: {s['n_edits']} phép sửa, {s['n_errors']} lỗi chữ nghĩa, {s['n_open']} chỗ ngờ.</p>",
    ]
    if not has_scorer:
        out.append("<p class='warning'>Không có mô hình: chỗ cần hiểu câu được để ngỏ.</p>")
    if conflicts:
        out.append(f"<p class='warning'>{conflicts} chỗ vướng thẻ, không vá được.</p>")
    if (s.get("minority") or 0) > 0.2:
        out.append(f"<p class='warning'>Kiểu đặt dấu không nhất quán: {s['n_old']} cũ, {s['n_new']} mới.</p>")
    kinds: dict[str, list] = {}
    for e in edits:
        kinds.setdefault(e["kind"], []).append(e)
    for kind in sorted(kinds, key=lambda k: KIND_NAMES.get(k, k)):
        rows = sorted(kinds[kind], key=lambda e: (-e["n"], e["before"], e["after"]))[:TOP_EDITS]
        out.append(f"<h2>{_text(KIND_NAMES.get(kind, kind))}</h2><table>")
        for e in rows:
            a, b = visible_pair(e["before"], e["after"])
            out.append(f"<tr><td>{_text(a)}</td><td>{_text(b)}</td><td>{_text(e['reason'])}</td><td>{e['n']}</td></tr>")
        out.append("</table>")
    out.append("<h2>Chỗ ngờ, chưa sửa</h2><table>")
    for c in sorted(open_cases, key=lambda c: (-c["n"], c["before"], c["candidates"]))[:TOP_OPEN]:
        out.append(f"<tr><td>{_text(c['before'])}</td><td>{_text(c['candidates'])}</td><td>{c['n']}</td></tr>")
    return "".join([*out, "</table></body></html>"])


def text_report(summary: dict, edits: list, open_cases: list, title: str | None = None) -> str:
    """The same for a terminal: 40 edits of each kind, and the first 40 open cases (`before`, `cands`) one by one."""
    s = summary
    out = [title or "(không rõ nhan đề)", one_line(s), ""]
    kinds: dict[str, list] = {}
    for e in edits:
        kinds.setdefault(e["kind"], []).append(e)
    for kind in sorted(kinds, key=lambda k: KIND_NAMES.get(k, k)):
        rows = sorted(kinds[kind], key=lambda e: (-e["n"], e["before"], e["after"]))
        out.append(f"{KIND_NAMES.get(kind, kind)} ({sum(e['n'] for e in rows)})")
        out += [f"   {' → '.join(visible_pair(e['before'], e['after']))}   ×{e['n']}" for e in rows[:TOP_TEXT]]
    out += [f"   {c['before']}  →?  {', '.join(c['cands'])}" for c in open_cases[:TOP_TEXT]]
    return "\n".join(out) + "\n"


def one_line(s: dict) -> str:
    open_part = f", {s['n_open']} chỗ để ngỏ" if s["n_open"] else ""
    return f"Đã sửa {s['n_edits']} chỗ ({s['n_errors']} lỗi chữ nghĩa){open_part} trên {s['n_paragraphs']} đoạn."
