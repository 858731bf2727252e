"""Clone reports of five formats, read through Spark's own readers, so from any store.

All give group_id, file, start_line, end_line (and offsets where the format has them). A record that can't be read is
dropped; a report without a group is an error. Groups of one instance are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAGIC = b"ccfxraw0"


class EmptyReport(ValueError):
    """A report without a clone group."""


def _groups(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).over(W.partitionBy("group_id"))
    return rows.withColumn("__n", n).filter("__n > 1").drop("__n")


def checked(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise EmptyReport("the report has no clone group")
    return rows


def decode_pairs(data: bytes) -> tuple[list[str], list[tuple[int, str, int]], list[tuple[tuple[int, int, int], tuple[int, int, int], int]]]:
    """Options, files (id, path, tokens) and pairs of (file, begin, end) with their group, of a binary report.

    Integers of the header are big-endian, those of files and pairs little-endian; records end at left file 0.
    """
    if data[:8] != MAGIC:
        raise ValueError("not a binary clone report")
    version = struct.unpack(">3i", data[8:20])
    if version[0] < 0 or data[20:24] != b"pa:d":
        raise ValueError("a binary clone report of another version")
    at = 24

    def line() -> str:
        nonlocal at
        end = data.index(b"\n", at)
        text = data[at:end].decode()
        at = end + 1
        return text

    options = []
    while (text := line()) != "":
        options.append(text)
    line()  # the language
    files = []
    while True:
        path = line()
        number, length = struct.unpack_from("<2i", data, at)
        at += 8
        if path == "" and number == 0 and length == 0:
            break
        files.append((number, path, length))
    while True:  # remarks
        text = line()
        (number,) = struct.unpack_from("<i", data, at)
        at += 4
        if text == "" and number == 0:
            at += 4
            break
    pairs = []
    while at + 4 <= len(data):
        left = struct.unpack_from("<3i", data, at)
        if left[0] == 0:
            return options, files, pairs
        right = struct.unpack_from("<3i", data, at + 12)
        (group,) = struct.unpack_from("<q", data, at + 24)
        pairs.append((left, right, group))
        at += 32
    raise ValueError("the report has no end mark")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """report, group_id, file, begin, end (token numbers) of binary reports; a whole report is one row, as its file is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["report", "group_id", "file", "begin", "end"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
        for b in batches:
            rows: dict[tuple, None] = {}
            for report, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, files, pairs = decode_pairs(data)
                paths = {n: p for n, p, _ in files}
                for left, right, group in pairs:
                    for f, begin, end in (left, right):
                        rows[report, group, paths[f], begin, end] = None
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _groups(files.mapInArrow(run, "report string, group_id long, file string, begin int, end int"))


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """token, line, column, offset, length of a token sidecar: hexadecimal line.column.offset, then +length or the end's triple."""
    lines = spark.read.text(path).withColumn("token", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    pos, end = F.split(parts[0], r"\."), parts[1]
    number = lambda c: F.conv(c, 16, 10).cast("int")
    offset = number(pos[2])
    length = F.when(end.startswith("+"), number(F.substring(end, 2, 16))).otherwise(number(F.split(end, r"\.")[2]) - offset)
    return lines.select("token", number(pos[0]).alias("line"), number(pos[1]).alias("column"), offset.alias("offset"), length.alias("length"))


def read_dictionary_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML with a table of files: sourceFile(id, location), cloneClass(id)/clone(sourceFileId, startLine, endLine)."""
    files = spark.read.format("xml").option("rowTag", "sourceFile").option("mode", "PERMISSIVE").schema("_id long, _location string").load(path)
    one = "array<struct<_sourceFileId:long,_startLine:int,_endLine:int>>"
    classes = spark.read.format("xml").option("rowTag", "cloneClass").schema(f"_id long, clone {one}").load(path)
    clones = classes.select(F.col("_id").alias("group_id"), F.explode("clone").alias("c"))
    rows = clones.join(files, F.col("c._sourceFileId") == F.col("_id")).select("group_id", F.col("_location").alias("file"), F.col("c._startLine").alias("start_line"), F.col("c._endLine").alias("end_line"))
    return _groups(rows.filter("start_line IS NOT NULL AND end_line IS NOT NULL"))


def read_flat_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML of class(classid)/source(file, startline, endline)."""
    schema = "_classid long, source array<struct<_file:string,_startline:int,_endline:int>>"
    classes = spark.read.format("xml").option("rowTag", "class").option("mode", "PERMISSIVE").schema(schema).load(path)
    rows = classes.select(F.col("_classid").alias("group_id"), F.inline("source")).select("group_id", F.col("_file").alias("file"), F.col("_startline").alias("start_line"), F.col("_endline").alias("end_line"))
    return _groups(rows.filter("file IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL"))


#: Fixed value: the form of a record in text reports.
TEXT_RECORD = r"^\d+\sdist:\d+\.\d+\sFILE\s(.+)\sLINE:(\d+):(\d+)"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text of records, their groups separated by lines that aren't records; the last line is start + length - 1.

    A report is one file; its lines are numbered within it, so that groups of several reports stay apart.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    record = F.col("text").rlike(TEXT_RECORD)
    w = W.partitionBy("report").orderBy("line")
    rows = whole.withColumn("group_id", F.sum((~record).cast("long")).over(w)).filter(record)
    part = lambda k: F.regexp_extract("text", TEXT_RECORD, k)
    start = part(2).cast("int")
    rows = rows.select(F.dense_rank().over(W.orderBy("report", "group_id")).cast("long").alias("group_id"), part(1).alias("file"), start.alias("start_line"), (start + part(3).cast("int") - 1).alias("end_line"))
    return _groups(rows)


#: The marks of a clone and of the common prefix in HTML reports.
HTML_CLONE = r"(?s)<td>Line Count<br/>(\d+)</td><td>Source Line<br/>(\d+).*?Source File</div><pre>(.*?)</pre>"
HTML_PREFIX = r"<h2>Common Path Prefix: <tt>(.+?)</tt></h2>"


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """A folder with a page xCloneSet<id>.html for each group, and jFilesAnalyzed.html with the files' common prefix."""
    pages = spark.read.text(f"{folder}/xCloneSet*.html", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"xCloneSet(\d+)\.html", 1).cast("long").alias("group_id"), "value")
    index = spark.read.text(f"{folder}/jFilesAnalyzed.html", wholetext=True)
    prefix = index.select(F.regexp_extract("value", HTML_PREFIX, 1).alias("prefix"))
    found = F.explode(F.regexp_extract_all("value", F.lit(HTML_CLONE), F.lit(0)))
    rows = pages.select("group_id", found.alias("r")).join(F.broadcast(prefix))  # one row
    part = lambda k: F.regexp_extract("r", HTML_CLONE, k)
    start = part(2).cast("int")
    file = F.when(F.col("prefix") == "", part(3)).otherwise(F.concat("prefix", F.lit("/"), part(3)))
    return _groups(rows.select("group_id", file.alias("file"), start.alias("start_line"), (start + part(1).cast("int") - 1).alias("end_line")))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "binary pairs": read_binary, "dictionary xml": read_dictionary_xml, "flat xml": read_flat_xml, "text": read_text, "html": read_html,
}


def read_report(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The clone instances of a report of this kind."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of report: {kind}")
    return checked(READERS[kind](spark, path))


def line_offsets(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 1), start, end: character offsets of lines, the end without the line's end mark. One row of text at a time."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "value"))
    w = W.partitionBy(key).orderBy("n")
    start = F.coalesce(F.sum(F.length("value") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.select(key, (F.col("n") + 1).alias("line"), start.alias("start"), (start + F.length("value")).alias("end"), "value")


def trimmed(start: Column, text: Column) -> tuple[Column, Column]:
    """Offsets of a fragment without blanks at its ends."""
    return start + F.length(text) - F.length(F.ltrim(text)), start + F.length(F.rtrim(text))


def relocated(text: Column, fragment: Column) -> Column:
    """Where a fragment lies in a text now, from 0; -1 if it doesn't."""
    return F.position(fragment, text) - 1


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """word: one a line, lower-cased; comments and blanks go."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> '' AND NOT startswith(word, '#')").distinct()
