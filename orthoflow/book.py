"""A generated Vietnamese book with planted errors and known answers, as large as a novel.

Paragraph i joins three sentences, picked by its number; so Spark makes the text as given and the oracle the text as it should
become, each from the same table of sentences by the same rule.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import sql_values

#: Paragraphs of the book, and of one of its files.
PARAGRAPHS, PER_ENTRY = 9577, 400
#: Sentence of a paragraph's place: (factor * number + shift) modulo the sentences.
PICKS = ((1, 0), (7, 3), (11, 5))


class Sentence(NamedTuple):
    """text as given, as it should become, and its edits (layer, before, after, kind); `open`: cases that stay (before, candidate)."""

    text: str
    right: str
    edits: tuple[tuple[int, str, str, str], ...] = ()
    open: tuple[tuple[str, str], ...] = ()


def _p(before: str, after: str) -> tuple[int, str, str, str]:
    return 3, before, after, "punctuation"


SENTENCES = [
    Sentence("Anh ấy xử dụng máy tính , rồi   đi ra ngoài.", "Anh ấy sử dụng máy tính, rồi đi ra ngoài.", (_p(" ", ""), (4, "   ", " ", "spacing"), (6, "xử dụng", "sử dụng", "confusable"))),
    Sentence("Trời mưa , gió tạnh.Anh đi ra sân......", "Trời mưa, gió tạnh. Anh đi ra sân...", (_p(" ", ""), _p("", " "), _p("......", "..."))),
    Sentence("Tình thuơng của mẹ thật lớn.", "Tình thương của mẹ thật lớn.", ((7, "thuơng", "thương", "bad_syllable"),)),
    Sentence(
        "Một món quà rất qúy gía, qúa hòa nhã và khoẻ mạnh.", "Một món quà rất quý giá, quá hòa nhã và khỏe mạnh.",
        ((5, "qúy", "quý", "tone_mark"), (5, "gía", "giá", "tone_mark"), (5, "qúa", "quá", "tone_mark"), (5, "khoẻ", "khỏe", "tone_style")),
    ),
    Sentence("Trời khô­ng mưa nữa​.", "Trời không mưa nữa.", ((1, "­", "", "unicode"), (1, "​", "", "unicode"))),
    Sentence("Anh viết thư ( trong ngoặc ) và một,hai;ba.", "Anh viết thư (trong ngoặc) và một, hai; ba.", (_p(" ", ""), _p(" ", ""), _p("", " "), _p("", " "))),
    Sentence("Giá 1,5 triệu lúc 10:30 và 12.000 đồng.", "Giá 1,5 triệu lúc 10:30 và 12.000 đồng."),
    Sentence("Hòa bình và thủy tinh còn đây.", "Hòa bình và thủy tinh còn đây.", ((2, "Hòa", "Hòa", "unicode"),)),
    Sentence("Người khôgn biết đường về nhà.", "Người không biết đường về nhà.", ((7, "khôgn", "không", "bad_syllable"),)),
    Sentence("Họ nói chuyện với nhau cả đêm dài.", "Họ nói chuyện với nhau cả đêm dài."),
    Sentence("Chúg ta đi trên đường xá xa xôi.", "Chúng ta đi trên đường sá xa xôi.", ((6, "đường xá", "đường sá", "confusable"), (7, "Chúg", "Chúng", "bad_syllable"))),
    Sentence("Phúlần ở cuối làng.", "Phú lần ở cuối làng.", ((7, "Phúlần", "Phú lần", "glued"),)),
    Sentence("Nó nói củangười ta rồi về.", "Nó nói của người ta rồi về.", ((7, "củangười", "của người", "glued"),)),
    Sentence("Em chia xẻ nỗi buồn với mẹ.", "Em chia xẻ nỗi buồn với mẹ.", (), (("chia xẻ", "chia sẻ"),)),
    Sentence("Cột bêtông và cái micrô vẫn đứng đó.", "Cột bêtông và cái micrô vẫn đứng đó."),
    Sentence("Quyển sách nguời ta bắt trước đã cũ.", "Quyển sách người ta bắt chước đã cũ.", ((6, "bắt trước", "bắt chước", "confusable"), (7, "nguời", "người", "bad_syllable"))),
    Sentence("Đám đông của Hỏa Dương đi trước, rồi Hỏa Dương cười vang một hồi lâu.", "Đám đông của Hỏa Dương đi trước, rồi Hỏa Dương cười vang một hồi lâu."),
    Sentence("Cô ở Hồng Kông mấy năm, rồi từ Hồng Kông trở về quê nhà.", "Cô ở Hồng Kông mấy năm, rồi từ Hồng Kông trở về quê nhà."),
    Sentence("Bà mở cửa sổ nhìn ra vườn cây xanh mát.", "Bà mở cửa sổ nhìn ra vườn cây xanh mát."),
]


def paragraphs(spark: SparkSession, many: int = PARAGRAPHS) -> DataFrame:
    """(book_id, entry_ix, para_ix, text) of the book as given."""
    texts = F.array(*[F.lit(s.text) for s in SENTENCES])
    picked = [F.get(texts, ((F.col("id") * a + b) % len(SENTENCES)).cast("int")) for a, b in PICKS]
    rows = spark.range(many)
    return rows.select(
        F.lit("novel").alias("book_id"), F.expr(f"id div {PER_ENTRY}").alias("entry_ix"), (F.col("id") % PER_ENTRY).alias("para_ix"), F.concat_ws(" ", *picked).alias("text")
    )


def sql(many: int = PARAGRAPHS) -> str:
    """CTEs for the oracle: `novel` (book_id, entry_ix, para_ix, given, fixed), `planted` (one row per edit), `left_open`."""
    n = len(SENTENCES)
    rows = sql_values([(i, s.text, s.right) for i, s in enumerate(SENTENCES)], "ix, given, fixed")
    edits = sql_values([(i, *e) for i, s in enumerate(SENTENCES) for e in s.edits], "ix, layer, before, after, kind")
    cases = sql_values([(i, *c) for i, s in enumerate(SENTENCES) for c in s.open], "ix, before, candidate")
    picks = " UNION ALL ".join(f"SELECT i, {k} AS k, (i * {a} + {b}) % {n} AS ix FROM range({many}) r(i)" for k, (a, b) in enumerate(PICKS))
    keys = f"'novel' AS book_id, i // {PER_ENTRY} AS entry_ix, i % {PER_ENTRY} AS para_ix"
    return f"""picks AS ({picks}),
        novel AS (SELECT {keys}, string_agg(given, ' ' ORDER BY k) AS given, string_agg(fixed, ' ' ORDER BY k) AS fixed FROM picks JOIN {rows} USING (ix) GROUP BY i),
        planted AS (SELECT {keys}, layer::INT AS layer, before, after, kind FROM picks JOIN {edits} USING (ix)),
        left_open AS (SELECT {keys}, before, candidate FROM picks JOIN {cases} USING (ix))"""
