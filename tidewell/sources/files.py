"""Files, archives and split documents as rows.

Readers go through Spark's binary file source, so paths may be of any store that Spark reads.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "origin string, name string, content binary, error string"
# How archives begin.
ZIP_START, GZIP_START = b"PK\x03\x04", b"\x1f\x8b"
#: Unpacked files are handed on in frames of at most so many rows, and of so many bytes besides the last file's.
FRAME_ROWS, FRAME_BYTES = 2000, 16 << 20


def read_files(spark: SparkSession, path: str, pattern: str = "*", newest_last: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder whose names match."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.orderBy(F.asc("path") if newest_last else F.desc("path"))


def watch_files(spark: SparkSession, path: str, pattern: str = "*", archive: str | None = None) -> DataFrame:
    """The same as a stream: new files as they come; finished ones are moved to an archive folder if one is named."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def unpacked(name: str, data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, content, error) of the plain files within an archive, however deep; other files as they are.

    Archives are told by extension, and those of files without one by how they begin.  A broken one gives a row with
    an error and without content.
    """
    low = name.lower()
    bare = "." not in low.rpartition("/")[2]
    try:
        if low.endswith(".zip") or (bare and data.startswith(ZIP_START)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for entry in sorted(z.infolist(), key=lambda e: e.filename):
                    if not entry.is_dir():
                        yield from unpacked(f"{name}!/{entry.filename}", z.read(entry))
        elif low.endswith(".gz") or (bare and data.startswith(GZIP_START)):
            yield from unpacked(name[:-3] if low.endswith(".gz") else f"{name}!/", gzip.decompress(data))
        else:
            yield name, data, None
    except (zipfile.BadZipFile, zlib.error, RuntimeError, OSError, EOFError) as problem:
        yield name, None, f"{type(problem).__name__}: {problem}"


def read_archives(files: DataFrame, pattern: str = "*") -> DataFrame:
    """(origin, name, content, error) of all plain files in files and archives whose inner names match, and of all
    archives that can't be read."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["origin", "name", "content", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for name, data, error in unpacked(path, bytes(content)):
                    if error or fnmatch.fnmatch(name.rpartition("/")[2], pattern):
                        rows.append((path, name, data, error))
                        held += len(data or b"")
                        # A frame of its own for each row would cost far more than to unpack it.
                        if len(rows) >= FRAME_ROWS or held >= FRAME_BYTES:
                            yield frame(rows)
                            rows, held = [], 0
        if rows:
            yield frame(rows)

    return files.select("path", "content").mapInPandas(run, ENTRY)


def pulled(listing: DataFrame, text: str = "content", most: int = 100_000) -> list[str]:
    """Locations named in a listing, one to a line; a listing is configuration, and one of over `most` lines is an error."""
    rows = listing.select(F.explode(F.split(F.col(text).cast("string"), r"\R")).alias("line")).where(F.trim("line") != "")
    lines = [r["line"].strip() for r in rows.limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"the listing has more than {most} lines")
    return lines


def read_xml(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def split_xml(documents: DataFrame, text: str, element: str, id_expression: str, base: str, id_prefix: str = "", id_postfix: str = "") -> DataFrame:
    """(id, base, content): a record for each element of a name; id_expression is an XPath within the element.

    Elements of the name that are within another one stay part of it only if they differ in name.
    """
    pattern = rf"(?s)<(?:\w+:)?{element}(?=[\s>/])(?:[^>]*/>|.*?</(?:\w+:)?{element}>)"
    records = documents.select(F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(pattern), F.lit(0))).alias("content"))
    bare = F.regexp_replace("content", r"\sxmlns(:\w+)?=\"[^\"]*\"|(?<=</?)\w+:", "")
    found = F.xpath_string(bare, F.lit(id_expression))
    return records.select(F.concat(F.lit(id_prefix), found, F.lit(id_postfix)).alias("id"), F.lit(base).alias("base"), "content").where(found != "")


def extract_html(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Adds title, body text, language and links of HTML pages."""
    html = F.col(markup)
    quiet = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(quiet, r"<[^>]*>", " "), r"\s+", " "))
    return pages.withColumns(
        {
            "title": F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1),
            "language": F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?(\w+)", 1),
            "links": F.regexp_extract_all(html, F.lit(r"(?i)\bhref=[\"']([^\"']*)"), F.lit(1)),
            "body": body,
        }
    )


def generated(spark: SparkSession, count: int, template: dict[str, str], seed: int = 87) -> DataFrame:
    """Records from templates: $n is the number, $words(k) are k words, $pick(a|b) one of several.

    Everything is a hash of seed, number and place, so any task makes the same rows again.
    """
    import re

    def draw(place: str, bound: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(place), F.col("id")), F.lit(bound))

    def value(name: str, text: str):
        parts = []
        for i, piece in enumerate(x for x in re.split(r"(\$n|\$words\(\d+\)|\$pick\([^)]*\))", text) if x):
            place = f"{name}.{i}"
            if piece == "$n":
                parts.append(F.col("id").cast("string"))
            elif piece.startswith("$words("):
                k = int(piece[7:-1])
                words = [F.concat(F.lit("w"), draw(f"{place}.{j}", 1000).cast("string")) for j in range(k)]
                parts.append(F.concat_ws(" ", *words))
            elif piece.startswith("$pick("):
                options = piece[6:-1].split("|")
                parts.append(F.element_at(F.array(*map(F.lit, options)), draw(place, len(options)).cast("int") + 1))
            else:
                parts.append(F.lit(piece))
        return F.concat(*parts).alias(name) if parts else F.lit("").alias(name)

    return spark.range(count).select(*[value(n, t) for n, t in template.items()])


def generated_pages(spark: SparkSession, count: int, lines: int = 10, words: int = 8, seed: int = 87) -> DataFrame:
    """(id, page): synthetic scanned pages in the shape that the layout operators read."""
    def number(place, bound: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), place), F.lit(bound)).cast("int")

    def word(line, i):
        at = line * words + i
        text = F.concat(F.lit("w"), number(at, 500).cast("string"))
        return F.struct(text.alias("content"), (i * 100).cast("int").alias("hpos"), (line * 30).cast("int").alias("vpos"), (number(at + 7, 60) + 30).alias("width"), F.lit(20).alias("height"))

    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    body = F.transform(numbers(lines), lambda y: F.struct(F.transform(numbers(words), lambda x: word(y, x)).alias("strings")))
    page = F.struct(F.lit(words * 100).alias("width"), F.lit(lines * 30).alias("height"), F.array(F.struct(body.alias("lines"))).alias("blocks"))
    return spark.range(count).select("id", page.alias("page"))
