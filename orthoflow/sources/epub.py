"""EPUB archives as entries, and corrected archives written back. One archive is one row in and one file out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .xhtml import decode_entities, patch, scan

_ENTRY = "book_id string, entry_ix int, name string, content binary"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, entry_ix, name, content) of the files in all archives under `path`, in archive order; directories are skipped."""
    return entries(spark.read.format("binaryFile").load(path).select(F.col("path").alias("book_id"), "content"))


def entries(archives: DataFrame) -> DataFrame:
    """As `read_entries`, of archives (book_id, content). An archive without a file fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, content in zip(batch.column("book_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [i for i in z.infolist() if not i.is_dir()]
                    if not names:
                        raise ValueError(f"{book}: archive without files")
                    for ix, info in enumerate(names):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([book]), pa.array([ix], pa.int32()), pa.array([info.filename]), pa.array([z.read(info)], pa.binary())],
                            ["book_id", "entry_ix", "name", "content"],
                        )

    return archives.filter("content IS NOT NULL").mapInArrow(run, _ENTRY)


def is_text_entry(name: Column) -> Column:
    """.xhtml, .html and .htm files, without tables of contents in a folder."""
    low = F.lower(name)
    return low.rlike(r"\.(xhtml|html|htm)$") & ~F.contains(low, F.lit("/toc."))


def decode_text(content: Column) -> Column:
    """Text of UTF-8 bytes without their byte order mark; null where they are not valid UTF-8."""
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2**31 - 1)).otherwise(content)
    return F.try_validate_utf8(bare.cast("string"))


def titles(found: DataFrame) -> DataFrame:
    """(book_id, title): from the first .opf entry's first `<dc:title`, else `<title`; null if empty or absent."""
    opf = found.filter(F.lower("name").endswith(".opf")).groupBy("book_id").agg(F.min_by("content", "entry_ix").alias("content"))
    text = decode_text(F.col("content"))
    raw = F.coalesce(
        F.nullif(F.regexp_extract(text, r"(?s)<dc:title[^>]*>(.*?)</", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)<title[^>]*>(.*?)</", 1), F.lit(""))
    )
    decode = F.pandas_udf(lambda s: s.map(lambda t: decode_entities(t)[0], na_action="ignore"), "string")
    return opf.select("book_id", F.nullif(F.trim(decode(F.trim(raw))), F.lit("")).alias("title"))


def build_archive(files: list[tuple[str, bytes]]) -> bytes:
    """A new archive; an entry `mimetype` is stored uncompressed if it comes first, all others are deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (name, content) in enumerate(files):
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_STORED if i == 0 and name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rebuild_archive(content: bytes, changed: dict[str, bytes]) -> bytes:
    """The archive with the entries named in `changed` replaced; order, and how the others are stored, stay."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as w:
        for info in z.infolist():
            if info.is_dir():
                continue
            new = changed.get(info.filename)
            if new is None:
                w.writestr(info, z.read(info), info.compress_type)
            else:
                w.writestr(zipfile.ZipInfo(info.filename, info.date_time), new, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def patch_entries(found: DataFrame, corrected: DataFrame) -> DataFrame:
    """(book_id, name, content, conflicts) of text entries that change.

    `corrected`: book_id, entry_ix, para_ix, text_before, text. The scan of an entry is repeated and its paragraphs, by
    number, take the new texts.
    """
    changes = corrected.filter("text <> text_before").groupBy("book_id", "entry_ix").agg(F.map_from_entries(F.collect_list(F.struct("para_ix", "text"))).alias("new"))
    rows = found.join(changes, ["book_id", "entry_ix"]).select("book_id", "name", decode_text(F.col("content")).alias("file"), "new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, conflicts = [], []
            for file, new in zip(batch.column("file").to_pylist(), batch.column("new").to_pylist(), strict=True):
                by_ix = dict(new)
                content, n = patch(file, [(p, by_ix[i]) for i, p in enumerate(scan(file)) if i in by_ix])
                files.append(content.encode())
                conflicts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("book_id"), batch.column("name"), pa.array(files, pa.binary()), pa.array(conflicts, pa.int32())], ["book_id", "name", "content", "conflicts"]
            )

    return rows.mapInArrow(run, "book_id string, name string, content binary, conflicts int")


def rebuild(archives: DataFrame, patched: DataFrame) -> DataFrame:
    """(book_id, content) of every archive of `archives` (book_id, content) with its patched entries; others as they are."""
    changed = patched.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("changed"))
    rows = archives.join(changed, "book_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                rebuild_archive(c, dict(ch or [])) for c, ch in zip(batch.column("content").to_pylist(), batch.column("changed").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), pa.array(out, pa.binary())], ["book_id", "content"])

    return rows.select("book_id", "content", "changed").mapInArrow(run, "book_id string, content binary")


def output_name(path: str) -> str:
    """`book.epub` -> `book (đã sửa).epub` in the same folder: never the input itself."""
    folder, _, file = path.rpartition("/")
    stem, dot, end = file.rpartition(".")
    name = f"{stem} (đã sửa).{end}" if dot and stem else f"{file} (đã sửa).epub"
    return f"{folder}/{name}" if folder else name


def as_uri(path: str) -> str:
    """A path, with or without a scheme, as a URI with its odd characters quoted."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = "file", path
    authority = ""
    if rest.startswith("//"):
        authority, _, rest = rest[2:].partition("/")
        rest = "/" + rest
    return f"{scheme}://{authority}{quote(rest)}"


def write_archives(books: DataFrame, folder: str | None = None, dry_run: bool = False) -> list[tuple[str, str]]:
    """Write each (book_id, content) beside its source, or into `folder`; returns (book_id, path written).

    The tasks write whole files under a temporary name and rename them. A path that is a book's own is refused. A dry
    run computes everything and writes nothing.
    """
    import uuid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        for batch in batches:
            paths = []
            for book, content in zip(batch.column("book_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = output_name(book)
                if folder is not None:
                    target = f"{folder.rstrip('/')}/{target.rpartition('/')[2]}"
                if target == book:
                    raise ValueError(f"{book}: output would replace the input")
                if not dry_run:
                    fs, path = pafs.FileSystem.from_uri(as_uri(target))
                    own = f"{path}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(own) as f:
                        f.write(content)
                    fs.move(own, path)
                paths.append(target)
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), pa.array(paths)], ["book_id", "path"])

    return [(r["book_id"], r["path"]) for r in books.mapInArrow(run, "book_id string, path string").collect()]
