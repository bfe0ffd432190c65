"""Text, CSV and HTML files as segments. Input: binaryFile rows or a table with the bytes."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "doc_id string, seg_no long, text string"
SNIFF_BYTES = 65_536
MAX_CELLS = 1_000_000


def decoded(raw: bytes) -> str:
    """UTF-8, with or without a mark at its start; else Windows-1251, undecodable bytes replaced."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1251", "replace")


def segment_batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    ids, numbers, texts = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "seg_no", "text"])


def scanned(files: DataFrame, segments_of) -> DataFrame:
    """files: doc_id (string), content. A segment row for each text that ``segments_of(bytes)`` yields; a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = []
                for k, text in enumerate(segments_of(content or b"")):
                    held.append((doc, k, text))
                    if len(held) == 4096:
                        yield segment_batch(held)
                        held = []
                yield segment_batch(held)

    return files.select(F.col("doc_id").cast("string"), F.col("content").cast("binary")).mapInArrow(run, SEGMENTS)


def text_lines(files: DataFrame) -> DataFrame:
    """Lines with their breaks, by all breaks that Unicode knows."""
    return scanned(files, lambda raw: decoded(raw).splitlines(keepends=True))


def csv_rows(raw: bytes, max_cells: int = MAX_CELLS) -> list[str]:
    """Rows of a CSV with their cells joined by tabs; the dialect is guessed from the start; breaks within cells become spaces."""
    text = decoded(raw)
    try:
        dialect = csv.Sniffer().sniff(text[:SNIFF_BYTES], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    out, cells = [], 0
    for row in csv.reader(io.StringIO(text, newline=""), dialect):
        cells += len(row)
        if cells > max_cells:
            raise ValueError(f"more than {max_cells} cells")
        out.append("\t".join(" ".join(c.replace("\t", " ").splitlines()) for c in row) + "\n")
    return out


def csv_lines(files: DataFrame) -> DataFrame:
    return scanned(files, csv_rows)


def flattened(table: DataFrame, columns: list[str]) -> Column:
    """The cells of a row joined by tabs, breaks and tabs within cells as spaces: a table that Spark has read itself."""
    return F.concat_ws("\t", *(F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[\r\n\t]", " "), F.lit("")) for c in columns))


# Elements whose content is not text, and elements that stand on lines of their own.
SILENT = ("script", "style", "template", "noscript")
LINES = ("address", "article", "aside", "blockquote", "br", "div", "dl", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "p", "section", "table", "tr")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag in LINES:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))
        if tag in LINES:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def visible_text(page: str | None) -> str:
    """Visible text of a page, a line for each block; attributes never show, the title does."""
    parser = _Visible()
    parser.feed(page or "")
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


def html_lines(files: DataFrame) -> DataFrame:
    return scanned(files, lambda raw: visible_text(decoded(raw)).splitlines(keepends=True))


def html_column(table: DataFrame, key: str, html: str) -> DataFrame:
    """key and the visible text of a column of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([visible_text(x) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, F.col(html).cast("string")).mapInArrow(run, f"{key} {kind}, text string")


EXTENSIONS = ("txt", "csv", "html", "docx", "xlsx", "pdf")


def intake(spark: SparkSession, folder: str, most: int | None = None, largest: int = 100 << 20) -> DataFrame:
    """A row for each file of a folder and those below it with a known extension: path, ext, length, content, sha256, doc_id, reason.

    Kinds are chosen from the listing; contents of files larger than ``largest`` are never read, since the reader gets
    the limit as a filter. With ``most``, the files behind the first ``most`` by path have a reason and no content, too. Files without
    any bytes, and hidden ones, have no row: Spark's readers pass over them.
    """
    kinds = ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{kinds}}}").load(folder)
    past = F.lit(False)
    if most is not None and (first := found.select("path").orderBy("path").offset(most).limit(1).first()):  # paths alone: no content is read for this
        past = F.col("path") >= first[0]
    whole = found.where(F.col("length") <= largest).select("path", "length", "content")
    rows = whole.unionByName(found.where(F.col("length") > largest).select("path", "length", F.lit(None).cast("binary").alias("content")))
    rows = rows.withColumn("reason", F.when(past, f"behind the first {most} files").when(F.col("length") > largest, "too large"))
    content = F.when(F.col("reason").isNull(), F.col("content"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return rows.select("path", ext.alias("ext"), "length", content.alias("content"), F.sha2(content, 256).alias("sha256"), F.col("path").alias("doc_id"), "reason")
