"""Small hand-written Vietnamese inputs: the driver's documents hold none, so queries join these to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .staging import local_table

SYLLABLES = (
    "phú lần của người không biết e rằng ngồi ở chúng ta thương tình mẹ dương nhưng những hỏa tộc hàn lập thiên uyên "
    "bêtông micrô rađa nilông cafê pittông quýt méc được"
).split()
COMPOUNDS = ["chúng ta", "tình thương", "e rằng", "vương tộc", "cuộc gọi", "cửa sổ"]

#: (book_id, entry_ix, texts)
_BOOKS = [
    (
        "vi-1",
        0,
        [
            "Anh ấy xử dụng máy tính , rồi   đi ra .",
            "Tình thuơng của mẹ thật lớn.",
            "Chúg ta đi trên đường xá xa xôi.",
            "Ừ Duơng à, nhà Phúlần ở cuối làng.",
            "Ừ nhưmg à.",
            "Một món quà rất qúy gía, qúa hòa nhã và khoẻ mạnh.",
            "Trời mưa , rồi   tạnh.Anh đi ra......",
            "Trời khô­ng mưa nữa​.",
            "Anh viết thư ( trong ngoặc ) và một,hai;ba.",
            "Xong.Rồi đi. Thế à? Ừ! Đi thôi...",
            "Giá 1,5 triệu và 12.000 đồng lúc 10:30. Xem TP.HCM và v.v. rồi thôi.",
            "  Giáo sư Dumbledore nhìn Voldemort , bỏ đi.  ",
            "Cột bêtông và cái micrô cùng cái rađa",
            "phần dành cho em là chia xẻ nỗi buồn",
            "thái độ bàng quang của anh, xử, dụng cụ kia",
            "nói  , rồi khôgn đi , củangười khôngbiết ngồiở erằng",
        ],
    ),
    (
        "vi-2",
        0,
        [
            "Tôi thấy Hỏa Dương hiện ra, rồi Hỏa Dương cười.",
            "Đám người của Hỏa Dương Tộc không dám tới.",
            "Đám cao tầng Hỏa Duơng Tộc không dám tới.",
            "Cô ở Hồng Kông, rồi về Hồng Kông.",
            "Người ta nói Hồng Kông đẹp. Chẵng ai biết. Chẵng ai hay.",
            "hòa bình, khỏe mạnh, hòa nhạc, thủy tinh và hoà thuận.",
        ],
    ),
    ("vi-2", 1, ["Chẵng ai biết. Chẵng ai hay. Chẵng ai thấy.", "", "THầy KHông CHúng NHưng", "Duơng Thiên Yyên Thành"]),
]
PARAGRAPHS = [(book, entry, i, text) for book, entry, texts in _BOOKS for i, text in enumerate(texts)]

PARAGRAPH_SCHEMA = "book_id string, entry_ix int, para_ix int, text string"


def paragraphs(spark: SparkSession) -> DataFrame:
    return local_table(spark, PARAGRAPHS, PARAGRAPH_SCHEMA)


def syllables(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(s,) for s in SYLLABLES], "syllable string")


def compounds(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(c,) for c in COMPOUNDS], "compound string")


def sql_values(rows, columns: str) -> str:
    """Rows as a SQL relation with the given columns, for the oracle."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"
