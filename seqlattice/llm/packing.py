"""Best-fit packing of token sequences by a plan over the histogram of lengths.

Texts become token ids, longer ones are cut into pieces of a sequence's size, and
only the *number of pieces of each length* is planned: lengths go from longest to
shortest, and all pieces of a length are placed at once, into the fullest
sequences that still have room, then into new ones. Sequences that are filled
alike stay one entry of the plan, so planning costs what the histogram has, not
what the corpus has. Pieces then take the planned places by a join on their rank
among those of equal length. The outcome has exactly as many sequences as
best-fit decreasing over single pieces.

Nothing but the histogram (a row for each length that occurs, ``size`` at most)
reaches the driver. The plan has at most ``1 + 3 * size`` groups of sequences,
and no sequence holds more than ``sqrt(2 * size)`` different lengths, so at most
about 390,000 ranges for a size of 2048 are broadcast, whatever the corpus holds.
Ranks need no sort: each task numbers its own pieces of each length while it
writes them, and a running sum over the tasks' counts of a length gives the rest.

Edge cases: a null or empty text has no ids of its own and becomes one piece that
holds the end id alone; texts of any length are cut whole; ties go by task and
place, so repeated rows and null ids each keep their pieces; an empty table gives
an empty result; other columns of the input are not carried, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import persisted, scratch

#: Tokens of a sequence.
SIZE = 2048
#: Entries of a task's cache and characters of what is kept in it; results do not depend on them.
CACHE, CACHED = 400_000, 64

#: The tokenizer's split (fixed values of the tokenizer) for lower-cased text of Latin-1 characters.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\t-\r \x85\xa0]+")
#: What that does not do for: other characters, and strings of special tokens.
_OTHER = re.compile(r"[^!-~¡-ÿ\t-\r \x85\xa0]|<\|")
#: Characters that Python's ``split`` takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: The characters that stand for bytes: printable ones for themselves, the others from 256 on in order.
_LETTERS = [chr(b if 33 <= b < 127 or 161 <= b != 173 else 256 + (b if b < 33 else b - 94 if b < 161 else 67)) for b in range(256)]


class WordIds(dict):
    """Packed ids (little-endian, unsigned, 32 bits) of the parts that the tokenizer splits normalised text into, bounded.

    Text of Latin-1 characters, which normalisation leaves alone but for capitals, is split here, and each distinct part
    is encoded once while the cache lasts. White space is dropped by the tokenizer, and neither its normalisation nor its
    split reaches across it, so other text is cut at white space and only its runs with other characters cost a call of
    the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.merge = self.tokenizer.model.tokenize  # of a part that is normalised and split already

    def __missing__(self, part: str) -> bytes:
        packed = b"".join([t.id.to_bytes(4, "little") for t in self.merge("".join(map(_LETTERS.__getitem__, part.encode())))])
        if len(self) >= CACHE:
            self.clear()
        if len(part) <= CACHED:
            self[part] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def text(self, text: str) -> bytes:
        if not _OTHER.search(text):
            return b"".join(map(self.__getitem__, _PARTS.findall(text.lower())))
        return self.encode(text) if _ODD.search(text) else b"".join(map(self._run, text.split()))

    def _run(self, run: str) -> bytes:
        """A run without white space; one with other characters is no part, so it can share the cache."""
        if not _OTHER.search(run):
            return self.text(run)
        packed = self.get(run)
        if packed is None:
            packed = self.encode(run)
            if len(run) <= CACHED and len(self) < CACHE:
                self[run] = packed
        return packed


def pieces(df: DataFrame, path: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every text: ``id_col, piece, start, length, ids_crc32`` (and ``ids``), with ``part`` (the task) and ``nth`` (before it in its task, of this length)."""
    with open(path, encoding="utf-8") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())
    key = T.StructField(id_col, df.schema[id_col].dataType)
    longs = ["start", "length", "ids_crc32", "part", "nth"]
    schema = T.StructType([key, T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in longs), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part, seen = WordIds(shipped.value), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            at, rows, held = [], [], 0

            def flush(batch=batch, at=at, rows=rows):
                columns = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6))]
                ids = [pa.array([r[6] for r in rows], pa.binary())] if with_ids else []
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns, *ids], names=schema.names)

            for row, text in enumerate(batch.column(1)):
                ids = words.text(text.as_py() or "") + end
                for number, start in enumerate(range(0, len(ids) // 4, size)):
                    own = ids[4 * start : 4 * (start + size)]
                    n = len(own) // 4
                    at.append(row)
                    rows.append((number, start, n, zlib.crc32(own), part, seen[n], own if with_ids else b""))
                    seen[n] += 1
                    held += len(own)
                if len(rows) > 50_000 or (with_ids and held > 16 << 20):
                    yield flush()
                    at.clear(), rows.clear()
                    held = 0
            if rows:
                yield flush()

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows of (length, first rank, rank after the last, pieces a sequence, first sequence, offset).

    Pieces of a length with ranks in the range fill sequences from the first one on, so many in each, from the offset on.
    """
    rooms: list[int] = []  # what is left in sequences that are open, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # by that: (first sequence, number)
    out, opened = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = room // length
            full = min(n, left // each)  # sequences that take as many as they can
            if full:
                out.append((length, rank, rank + full * each, each, first, size - room))
                rank, left = rank + full * each, left - full * each
                add(room - each * length, first, full)
            if full < n and left:  # one takes the rest
                out.append((length, rank, rank + left, left, first + full, size - room))
                add(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            add(room, first + full, n - full)
    return out


def placed(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``found`` (a table of :func:`pieces` that was written, so that its numbers are fixed) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    counted = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length: ``size`` at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranges = spark.createDataFrame(plan(histogram, size), "p_length long, first_rank long, next_rank long, each long, first_sequence long, at long")
    ranked = found.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    inside = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("next_rank"))
    met = ranked.join(F.broadcast(ranges), inside)  # bounded, see above
    nth = F.col("rank") - F.col("first_rank")
    sequence = F.expr("first_sequence + (rank - first_rank) div each")
    kept = [c for c in found.columns if c not in ("part", "nth")]
    return met.select(*(f"`{c}`" for c in kept), sequence.alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"))


def packed(df: DataFrame, path: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every text with its sequence and its place there."""
    with scratch() as keep:
        found = keep(persisted(pieces(df, path, size, end_id, id_col, text_col, with_ids), "pieces"))
        return placed(found, size)


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the packed sequences themselves; one holds ``size`` tokens at most."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces_with_ids.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_join(F.transform(rows, lambda r: F.hex(r["ids"])), "").alias("h")).select("sequence_id", "length", F.unhex("h").alias("ids"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
