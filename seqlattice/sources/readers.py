"""Readers: FASTA, pair tables, annotations, saved pyramids, configuration."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kmers import CHUNK
from ..plans.params import IdentityQuery

# Executors need not have the library installed: functions are shipped with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bases of a record that wait for its end; a longer one is handed on in pieces before its length is known.
HELD = 4 << 20

BEDPE = T.StructType([
    T.StructField("query_name", T.StringType()), T.StructField("query_start", T.LongType()), T.StructField("query_end", T.LongType()),
    T.StructField("reference_name", T.StringType()), T.StructField("reference_start", T.LongType()), T.StructField("reference_end", T.LongType()),
    T.StructField("perID_by_events", T.DoubleType()),
])
BED = T.StructType([
    T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("strand", T.StringType()),
    T.StructField("thickStart", T.LongType()), T.StructField("thickEnd", T.LongType()), T.StructField("itemRgb", T.StringType()),
])


def _plain(path: str) -> str:
    """A path without scheme and host."""
    return re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", path) if re.match(r"^[a-z0-9]+:", path) else os.path.abspath(path)


def _file(path: str = "_metadata.file_path") -> Column:
    """The path of a row's file, without scheme and host."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:(//[^/]*)?", "")


def _place(paths: list[str]) -> Column:
    """The first path that is the file or a folder that holds it; files of a pattern come last."""
    given = F.array(*(F.lit(_plain(p).rstrip("/")) for p in paths))
    place = F.array_position(F.transform(given, lambda p: (F.col("file") == p) | F.startswith("file", F.concat(p, F.lit("/")))), True)
    return F.when(place > 0, place - 1).otherwise(len(paths)).cast("int")


def _records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, seq_ord, head, record``: records in the order of the paths given, of paths inside a folder, and of places in a file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.option("lineSep", "\n>").text(paths)
    lines = lines.select("value", _file().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    place = _place(paths)
    record = F.when(F.startswith("value", F.lit(">")), F.substring("value", 2, (1 << 31) - 1)).otherwise(F.col("value"))
    head = F.replace(F.substring_index("record", "\n", 1), F.lit("\r"), F.lit(""))
    out = lines.withColumns({"record": record, "seq_ord": F.struct(place.alias("place"), "file", "block", "row")})
    return out.select("file", "seq_ord", head.alias("head"), "record")


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, seq_ord, seq_id, seq, n``: one row a record of (multi-)FASTA files, ``.gz`` included.

    ``seq_ord`` sorts records in input order: by the place of the path in the list, then by the place in the file. Names
    may repeat; ``seq_ord`` does not. Records are split at line starts that begin with ``>``; one in a header's
    description stays part of it. A record is one row, so it is bounded by what a row can hold (2 GB); :func:`fasta_pieces`
    has no such bound.
    """
    body = F.upper(F.regexp_replace("record", r"^[^\n]*(?:\n|$)|\s+", ""))
    out = _named(_records(spark, paths)).withColumn("seq", body).drop("record")
    return out.withColumn("n", F.octet_length("seq").cast("long"))


def _named(records: DataFrame) -> DataFrame:
    return records.select("file", "seq_ord", F.regexp_extract("head", r"^(\S+)", 1).alias("seq_id"), "record").filter("seq_id <> ''")


def fasta_pieces(spark: SparkSession, paths: str | list[str], k: int = 21, size: int = CHUNK) -> DataFrame:
    """``file, seq_ord, seq_id, off, piece, length``: records in pieces of up to ``size`` bases, each with the next ``k - 1``.

    Records may be of any length and are never one row: files are read by lines, in as many byte ranges as Spark makes of
    them (a ``.gz`` is one), and each task cuts what it reads. Records of up to ``HELD`` bases that begin and end in a range
    are complete where they are cut. Others are put together through a table with up to a few rows for each range: which
    record reaches into it, how many bases that has so far and in all, and the ``k - 1`` bases that follow. Pieces without
    a whole k-mer are left out, so a record shorter than ``k`` has none; all k-mers of a record are in its pieces exactly
    once. A line is one row, so lines are bounded by 2 GB.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    of = lambda name: F.col(f"_metadata.file_{name}")
    # Each column of a line costs as much as its text: the start of its range is doubled, plus 1 in a file's last range.
    place = F.shiftleft(of("block_start"), 1) + F.when(of("block_start") + of("block_length") >= of("size"), 1).otherwise(0)
    lines = spark.read.text(paths).select(of("path").alias("path"), place.alias("place"), "value")
    schema = "path string, block long, ordinal long, head string, at long, n long, bases binary, whole boolean"
    # A read in ranges, twice: once for the table of ranges, with k - 1 bases of a piece at most, once for the pieces.
    part = lines.mapInArrow(_cut(k, size, True), schema)
    part = part.groupBy("path", "block", "ordinal").agg(F.max("head").alias("head"), F.sum("n").alias("n"), F.min_by("bases", "at").alias("first"))
    zero = lambda c: F.max(F.when(F.col("ordinal") == 0, F.col(c)))
    one = F.struct("ordinal", "head", "n")
    ranges = part.groupBy("path", "block").agg(F.collect_list(one).alias("all"), F.max(one).alias("last"), F.coalesce(zero("n"), F.lit(0)).alias("n0"), zero("first").alias("first0"))
    order = Window.partitionBy("path").orderBy("block")  # a row for each range of a file
    ranges = ranges.withColumns({"has": F.col("last.ordinal") > 0, "through": F.sum("n0").over(order)})
    mark = F.when(F.col("has"), F.struct(F.col("block").alias("block"), F.col("last.ordinal").alias("ordinal"), F.col("last.head").alias("head"), F.col("last.n").alias("n"), "through"))
    later = order.rowsBetween(1, Window.unboundedFollowing)
    ranges = ranges.withColumns({
        "from": F.last(mark, True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "until_next": F.coalesce(F.first(F.when(F.col("has"), F.col("through")), True).over(later), F.max("through").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))),
        "nexts": F.collect_list(F.struct(F.coalesce("first0", F.lit(b"")).alias("b"), "has")).over(order.rowsBetween(1, max(k - 1, 1))),
    })
    begun = F.struct(F.lit(b"").alias("b"), F.lit(False).alias("has"))
    grown = lambda a, x: F.when(a["has"], a).otherwise(F.struct(F.concat(a["b"], x["b"]).alias("b"), x["has"].alias("has")))
    ranges = ranges.select(
        "path", "block", "all", F.col("last.ordinal").alias("last"), "from", F.aggregate("nexts", begun, grown)["b"].alias("follow"),
        (F.col("last.n") + F.col("until_next") - F.col("through")).alias("n_last"),
        (F.col("from.n") + F.when(F.col("has"), F.col("through")).otherwise(F.col("until_next")) - F.col("from.through")).alias("n_from"),
        (F.col("from.n") + F.col("through") - F.col("n0") - F.col("from.through")).alias("base"),
    )
    ordinal = F.col("own.ordinal")
    carried = ordinal == 0
    own = ranges.withColumn("own", F.explode("all")).select(
        "path", "block", "own.ordinal", F.when(carried, F.col("from.head")).otherwise(F.col("own.head")).alias("name"), F.when(carried, F.col("base")).otherwise(0).alias("base"),
        F.when(carried, F.col("from.block")).otherwise(F.col("block")).alias("from_block"), F.when(carried, F.col("from.ordinal")).otherwise(ordinal).alias("from_ordinal"),
        F.when(carried, F.col("n_from")).when(ordinal == F.col("last"), F.col("n_last")).otherwise(F.col("own.n")).alias("length"),
        F.when(ordinal == F.col("last"), F.col("follow")).otherwise(F.lit(b"")).alias("follow"),
    )
    # The table has a few rows of some 100 bytes for each border between two ranges, and for each record of over HELD bases.
    out = lines.mapInArrow(_cut(k, size, False), schema).join(F.broadcast(own), ["path", "block", "ordinal"], "left")
    or_own = lambda c, known: F.when(F.col("whole"), known).otherwise(F.col(c))
    piece = F.substring(F.concat("bases", "follow"), F.lit(1), (F.col("n") + (k - 1)).cast("int"))
    out = out.select(
        _file("path").alias("file"), or_own("from_block", F.col("block")).alias("block"), or_own("from_ordinal", F.col("ordinal")).alias("ordinal"), or_own("name", F.col("head")).alias("name"),
        or_own("length", F.col("n")).alias("length"), F.when(F.col("whole"), F.col("at")).otherwise(F.col("base") + F.col("at")).alias("off"), F.when(F.col("whole"), F.col("bases")).otherwise(piece).alias("piece"),
    ).filter((F.octet_length("piece") >= k) & F.col("name").isNotNull() & (F.col("name") != ""))
    return out.select("file", F.struct(_place(paths).alias("place"), "file", "block", F.col("ordinal").alias("row")).alias("seq_ord"), F.col("name").alias("seq_id"), "off", "piece", "length")


def _cut(k: int, size: int, table: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of byte ranges to pieces. ``ordinal`` numbers the records of a range from 1; 0 is what goes on from the range before.
    ``n`` is the record's length where it is ``whole``, else the piece's own. For the ``table`` whole records are left out, and what
    waits is one row."""
    blank, most, limit = b" \t\r\x0b\x0c", max(HELD, 4 * (size + k)), 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = ordinal = at = waiting = 0
        where, ends, head = None, False, None
        parts: list[bytes] = []

        def emit(at: int, n: int, bases: bytes, whole: bool = False) -> None:
            nonlocal held
            rows.append((*where, ordinal, head, at, n, bases, whole))
            held += len(bases)

        def cut(done: bool, last: bool) -> None:
            """Pieces of what waits: all of it if the record or the range is ``done``, else those with all that must follow."""
            nonlocal at, waiting, parts
            data = b"".join(parts)
            n, complete = len(data), done and ordinal and not at and (ends or not last)
            stop = n - k + 1 if complete else n if done else n - (size + k) + 2
            starts = range(0, stop, size)
            if complete:
                for o in () if table else starts:
                    emit(o, n, data[o : o + size + k - 1], True)
            else:
                reach, kept = (len(starts) * size, k - 1) if table else (size, size + k - 1)
                for o in starts[:1] if table else starts:
                    emit(at + o, min(reach, n - o), data[o : o + kept])
                if done and ordinal and not (n or at):
                    emit(0, 0, b"")  # a record without bases so far
            at += len(starts) * size
            parts = [] if done else [data[len(starts) * size :]]
            waiting = sum(map(len, parts))

        def packed() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "block", "ordinal", "head", "at", "n", "bases", "whole"])

        for batch in batches:
            if not batch.num_rows:
                continue
            path, place, value = batch.columns
            value = value.cast(pa.large_binary())
            offsets = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + len(value) + 1]
            text = memoryview(value.buffers()[2] or b"")
            # Lines that begin something, a range or a record; what is between two of them is cleaned at once.
            heads = np.zeros(len(value), bool)
            some = offsets[1:] > offsets[:-1]
            if some.any():
                heads[some] = np.frombuffer(text, np.uint8)[offsets[:-1][some]] == ord(">")
            files, places = path.dictionary_encode().indices.to_numpy(), place.to_numpy()
            fresh = np.append(True, (files[1:] != files[:-1]) | (places[1:] != places[:-1]))
            marks = np.flatnonzero(heads | fresh)
            for i, end in zip(marks.tolist(), [*marks[1:].tolist(), len(value)], strict=True):
                if fresh[i] and (path[i].as_py(), int(places[i]) >> 1) != where:
                    if where:
                        cut(True, True)
                    where, ends, ordinal, at, head = (path[i].as_py(), int(places[i]) >> 1), bool(places[i] & 1), 0, 0, None
                if heads[i]:
                    cut(True, False)
                    line = bytes(text[offsets[i] : offsets[i + 1]]).decode()
                    ordinal, at, i = ordinal + 1, 0, i + 1
                    head = (line[1:].split(None, 1) or [""])[0] if line[1:2].strip() else ""
                if ordinal or where[1]:  # what stands before a file's first header belongs to no record
                    data = bytes(text[offsets[i] : offsets[end]]).upper().translate(None, blank)
                    parts.append(data)
                    waiting += len(data)
                    if waiting >= most:
                        cut(False, False)
                if held > limit:
                    yield packed()
        if where:
            cut(True, True)
        if rows:
            yield packed()

    return run


def fasta_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, seq_ord, seq_id``; bases are not cleaned for this."""
    return _named(_records(spark, paths)).drop("record")


def check_fasta(spark: SparkSession, path: str) -> bool:
    """True if the path can be read and holds a record with bases; a missing path raises."""
    return not fasta(spark, path).filter("n > 0").isEmpty()


def bedpe(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Saved pair tables; the schema is fixed, nothing is inferred, and a row that does not fit fails the run (see :func:`bedpe_checked`)."""
    return spark.read.csv(paths, sep="\t", header=True, schema=BEDPE, enforceSchema=True, mode="FAILFAST")


def bed(spark: SparkSession, path: str, columns: int = 9) -> DataFrame:
    """Annotations of 3 to 9 columns by place, the last ones may be missing; ``#`` lines are skipped, rows must fit and have start
    and end (see :func:`bed_checked`)."""
    found = spark.read.csv(path, sep="\t", comment="#", schema=T.StructType([T.StructField(f.name, T.StringType()) for f in _bed(columns)]))
    out = found.select(*(F.expr(f"cast({f.name} as {f.dataType.simpleString()})").alias(f.name) for f in _bed(columns)))  # a text that is no number raises
    missing = F.col("start").isNull() | F.col("end").isNull()
    return out.withColumn("start", F.when(missing, F.raise_error(F.lit("an annotation has no start or end")).cast("long")).otherwise(F.col("start")))


def _bed(columns: int) -> T.StructType:
    if not 3 <= columns <= 9:
        raise ValueError("an annotation table has 3 to 9 columns")
    return T.StructType(BED.fields[:columns])


def bedpe_checked(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of saved pair tables that fit the format, and the rejected ones: ``file, line, text``."""
    return _checked(spark, paths, BEDPE, len(BEDPE))


def bed_checked(spark: SparkSession, paths: str | list[str], columns: int = 9) -> tuple[DataFrame, DataFrame]:
    """Annotations that fit and have start and end, and the rejected rows: ``file, line, text``."""
    return _checked(spark, paths, _bed(columns), 3)


def _checked(spark: SparkSession, paths: str | list[str], schema: T.StructType, needed: int) -> tuple[DataFrame, DataFrame]:
    """Lines that parse as ``schema``, with values in the first columns that are ``needed``, and the others with their place.

    Comments and empty lines are neither. Lines are numbered from 1 in their file: by their order in their byte range
    and the number of lines in the ranges before it, for the rejected ones only.
    """
    lines = spark.read.text(paths).select(_file().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    rows = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).withColumn("f", F.split("value", "\t"))
    rows = rows.select("*", *(F.nullif(F.get("f", i), F.lit("")).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))
    fits = F.size("f") <= len(schema)
    for i, f in enumerate(schema.fields):
        absent = F.coalesce(F.get("f", i), F.lit("")) == "" if i >= needed else F.lit(False)
        fits = fits & (F.col(f.name).isNotNull() | absent)
    ranges = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    ranges = ranges.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bad = rows.filter(~fits).select("file", "block", "row", F.col("value").alias("text")).join(ranges, ["file", "block"])
    good = rows.filter(fits).select(*schema.names)
    return good, bad.select("file", (F.col("base") + F.col("row") - F.col("first") + 1).alias("line"), "text")


def pyramid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Saved layers and their metadata; a level or title filter prunes partitions."""
    return spark.read.parquet(f"{folder}/layers"), spark.read.parquet(f"{folder}/metadata")


def pyramid_with_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Layers joined with the metadata of their title, by title, then level as a number. Layers without metadata are left out."""
    layers, metadata = pyramid(spark, folder)
    return layers.join(metadata, "title").orderBy("title", F.col("level").cast("int"), "i", "j")


def config(path: str, base: IdentityQuery | None = None) -> IdentityQuery:
    with open(path) as f:
        return (base or IdentityQuery()).overridden(json.load(f))
