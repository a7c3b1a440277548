"""Phrase collocation mining with set-oriented, relational steps (SETM).

Relation ``R_k`` holds every occurrence of a frequent-so-far phrase of ``k``
words, sorted by piece and position. A step joins it with itself on the same
piece and the next position (a merge join: both sides have the order), groups the
joined rows and counts them, keeps the groups that are frequent (``F_k+1``), and a
semi-join with these leaves the occurrences that the next step may extend.

``R_k`` is kept as blocks of columns: a row is a block of about ``block`` words
of one language, with one code for each position and an empty position between
pieces, so that the sorted join is one of an array with itself shifted by one.
The block's distinct words and their numbers are rows of their own when they are
counted; this is an ordinary shuffle of pre-aggregated rows, so a word of a third of
all positions is one row of each block. Longer groups, of which there are many more and
most occur once, are added up over a few blocks, dealt into parts by hash, and shuffled as sorted,
packed columns (a row for each part); a part's number of groups is bounded, and it counts exactly. The semi-join with ``F_1`` is a shuffle, too,
behind a bitmap of fixed size, and gives each block the numbers of its frequent words.
A longer phrase is named by those numbers (4 bytes a word), so its semi-join needs no
answer from elsewhere: the block keeps what a bitmap of ``F_k`` says may be in it. A
phrase that passes by chance is work and no more, since what extends it is counted
exactly and cannot be frequent. A block's groups lie in its row as one value, sorted, in packed
columns, so that no row is an array of hundreds of thousands of names. Every ``R_k`` and
``F_k`` is written to the shared folder before it is used.

A piece may go on in the next block: a block has up to ``longest - 1`` further
positions behind its own, which can end a phrase but do not begin one.

Whatever ``block`` is, results are the same. Memory is bounded by a few blocks and
one text.

Edge cases: a null language is ``und``; null, empty and blank texts have no words;
repeated rows and null ids count as often as they occur; ties follow the stated
order, so results are the same from run to run; an empty table gives an empty
result; columns but the two that are named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, persisted, scratch

#: Positions of a block. The semi-join with F_1 has a row for each block and word, so that larger ones save shuffles.
BLOCK = 1 << 19
#: Bits of the filter of frequent groups: what reaches the driver and every task, whatever is in it.
FILTER_BITS = 1 << 24
#: Groups that a task adds up before it shuffles them, and that a part counts, about.
GATHERED, PART = 1 << 20, 1 << 20
#: Parts in which each language's best are found first.
PARTS = 128

#: Bytes that end a piece become a byte that UTF-8 never has; a tab becomes a space.
_GAP = b"\xff"
_MARKS = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))


def _compressed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case, with ``_GAP`` between pieces."""
    return text.lower().translate(_MARKS).replace(_GAP, b" \xff ").split()


def _squeezed(codes: np.ndarray) -> bytes:
    """int32 codes, byte by byte, compressed: frequent words have small codes, and the gap's is 0 here, so that most high bytes are 0."""
    return len(codes).to_bytes(4, "little") + _compressed((codes + np.int32(1)).view(np.uint8).reshape(-1, 4).T.tobytes())


def _codes(squeezed: bytes) -> np.ndarray:
    n = int.from_bytes(squeezed[:4], "little")
    raw = pa.decompress(squeezed[4:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(np.int32).ravel() - np.int32(1)


def occurrences(df: DataFrame, longest: int, block: int = BLOCK, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``R_1``: ``block, lang, own`` (positions that may begin a phrase), ``codes`` (of each position, -1 between pieces), ``words, counts`` (by code)."""

    def cut(run: pa.Array, own: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        found = run.dictionary_encode()
        codes, words = found.indices.to_numpy().astype(np.int32), found.dictionary
        gap = words.index(pa.scalar(_GAP, pa.binary())).as_py()
        if gap >= 0:
            codes = np.where(codes == gap, -1, codes - (codes > gap)).astype(np.int32)
            words = pa.concat_arrays([words.slice(0, gap), words.slice(gap + 1)])
        order = np.argsort(-np.bincount(codes[codes >= 0], minlength=len(words)), kind="stable")
        place = np.full(len(words) + 1, -1, np.int32)  # its last entry is for code -1
        place[order] = np.arange(len(words))
        codes, words = place[codes], words.take(pa.array(order))
        mine = codes[:own]
        return codes, words.cast(pa.string()), np.bincount(mine[mine >= 0], minlength=len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[pa.Array]] = {}  # words take a few bytes each, and not an object
        waiting: dict[str, int] = {}

        def row(lang: str, words: pa.Array, own: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            codes, names, counts = cut(words, own)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), x) for x in (names, pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([lang]), pa.array([own], pa.int32()), pa.array([_squeezed(codes)], pa.binary()), *lists], names=["block", "lang", "own", "codes", "words", "counts"])

        def rest() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                if waiting[lang]:
                    yield row(lang, pa.concat_arrays(found), waiting[lang])
            held.clear()
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                lang, new = lang.as_py(), [*tokens(text.as_py()), _GAP]
                for start in range(0, len(new), block):
                    held.setdefault(lang, []).append(pa.array(new[start : start + block], pa.binary()))
                    size += len(held[lang][-1])
                    waiting[lang] = waiting.get(lang, 0) + len(held[lang][-1])
                    if waiting[lang] >= block + longest - 1:
                        words, at = pa.concat_arrays(held[lang]), 0
                        while len(words) - at >= block + longest - 1:
                            yield row(lang, words.slice(at, block + longest - 1), block)
                            at += block
                        held[lang], waiting[lang] = [words.slice(at)], len(words) - at
                        size -= at
                if size > 4 * block:  # many languages, each with little
                    yield from rest()
                    size = 0
        yield from rest()

    schema = "block long, lang string, own int, codes binary, words array<string>, counts array<long>"
    return df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def _matrix(keys: pa.Array, k: int) -> np.ndarray:
    """Word numbers of phrases of ``k`` words, a row each."""
    keys = keys.cast(pa.binary())
    if not len(keys):
        return np.zeros((0, k), ">i4")
    ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    return np.frombuffer(keys.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(">i4").reshape(-1, k)


def _keys(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(4 * matrix.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix.astype(">i4").tobytes())])


def _places(matrix: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each phrase."""
    h = np.full(len(matrix), 0x9E3779B97F4A7C15, np.uint64)
    for column in matrix.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
    return (h % np.uint64(bits)).astype(np.int64)


def joined(known: DataFrame, k: int, bits: np.ndarray | None = None) -> DataFrame:
    """``R_k`` joined with itself at the next position: ``block, own, codes`` of the pairs, and their ``n`` groups, ``packed`` with their counts in the order of the codes.

    ``known``: ``block, own, codes`` and, for words, ``known`` (codes and numbers of those that are frequent, 4 bytes each), else
    ``n, packed``, of which ``bits`` says those that may be frequent.
    """
    shipped = None if bits is None else known.sparkSession.sparkContext.broadcast(bits)

    def named(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and names of groups, in the order of the names."""
        if k == 1:
            found = batch.column(3)[i].values.to_numpy()
            found = found[np.argsort(found & 0xFFFFFFFF)]
            return found >> 32, (found & 0xFFFFFFFF).astype(np.int32).reshape(-1, 1)
        names = _unpack(batch.column(4)[i].as_py(), batch.column(3)[i].as_py(), k)[0]
        return np.arange(len(names)), names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = _codes(batch.column(2)[i].as_py())
                kept, names = named(batch, i)
                if shipped is not None:
                    at = _places(names, 64 * len(shipped.value))
                    may = (shipped.value[at >> 6] >> (at & 63)) & 1 == 1
                    kept, names = kept[may], names[may]
                place = np.full(max(int(codes.max(initial=-1)), int(kept.max(initial=-1))) + 2, -1, np.int32)  # its last entry is for code -1
                place[kept] = np.arange(len(kept))
                at = place[codes]
                both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
                groups, inverse = np.unique(at[both] * np.int64(len(kept)) + at[both + 1], return_inverse=True)
                if not len(groups):
                    continue
                out = np.full(len(at) - 1, -1, np.int32)
                out[both] = inverse
                own = min(batch.column(1)[i].as_py(), len(out))
                counts = np.bincount(inverse[both < own], minlength=len(groups))
                made = np.concatenate([names[groups // len(kept)], names[groups % len(kept)][:, -1:]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([own], pa.int32()), pa.array([_squeezed(out)], pa.binary()), pa.array([len(made)], pa.int32()), pa.array([_pack(made, counts)], pa.binary())],
                    names=["block", "own", "codes", "n", "packed"],
                )

    return known.select("block", "own", "codes", *(["known"] if k == 1 else ["n", "packed"])).mapInArrow(run, "block long, own int, codes binary, n int, packed binary")


def _summed(matrix: np.ndarray, counts: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their sums, in order (by ``first``, of which equal rows have the same, and by columns)."""
    order = np.lexsort([*matrix.T[::-1], *([] if first is None else [first])])
    matrix, counts = matrix[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (matrix[1:] != matrix[:-1]).any(axis=1)])) if len(matrix) else np.zeros(0, np.int64)
    return matrix[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _pack(matrix: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted rows of int32 and their counts, column by column and byte by byte, compressed."""
    columns = [np.diff(matrix[:, 0], prepend=np.int32(0)), *matrix.T[1:], counts]
    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns)
    return _compressed(raw)


def _unpack(packed: bytes, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=n * (4 * k + 8), codec="zstd", asbytes=True), np.uint8)
    columns = [np.ascontiguousarray(raw[4 * n * i : 4 * n * (i + 1)].reshape(4, n).T).view(np.int32).ravel() for i in range(k)]
    columns[0] = np.cumsum(columns[0], dtype=np.int32)
    return np.stack(columns, axis=1), np.ascontiguousarray(raw[4 * n * k :].reshape(8, n).T).view(np.int64).ravel()


def counted(relation: DataFrame, k: int, least: int) -> DataFrame:
    """``id, f``: the groups of ``R_k`` that occur ``least`` times or more."""
    groups = relation.agg(F.sum("n")).first()[0] or 0
    parts, gathered = max(1, -(-groups // PART)), GATHERED

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            matrix, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            matrix, counts = _summed(matrix, counts, _places(matrix, parts))
            at = _places(matrix, parts)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            ends = [*starts[1:], len(at)]
            packed = [_pack(matrix[i:j], counts[i:j]) for i, j in zip(starts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), pa.array(ends - starts, pa.int32()), pa.array(packed, pa.binary())], names=["part", "n", "packed"])

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(_unpack(batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), k))
                if sum(len(x) for x, _ in held) >= gathered:
                    yield flush()
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        """Of one part. Whenever so many rows are there, they are added up."""
        matrix, counts, waiting = np.zeros((0, k), np.int32), np.zeros(0, np.int64), []
        for n, packed in zip(table.column("n").to_pylist(), table.column("packed"), strict=True):
            waiting.append(_unpack(packed.as_py(), n, k))
            if sum(len(x) for x, _ in waiting) >= gathered:
                matrix, counts = _summed(*(np.concatenate(x) for x in zip((matrix, counts), *waiting, strict=True)))
                waiting = []
        matrix, counts = _summed(*(np.concatenate(x) for x in zip((matrix, counts), *waiting, strict=True)))
        return pa.table({"id": _keys(matrix[counts >= least]), "f": counts[counts >= least]})

    dealt = relation.select("n", "packed").mapInArrow(deal, "part int, n int, packed binary")
    return dealt.groupBy("part").applyInArrow(add, "id binary, f long")


def _bitmap(places: DataFrame) -> np.ndarray:
    """The bits of column ``place``."""
    place = F.col("place")
    words = places.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():  # FILTER_BITS / 64 rows at most
        bits[r.word] = r.bits
    return bits


def _filter(frequent: DataFrame, k: int) -> np.ndarray:
    """Bitmap of the phrases ``F_k``; never wrong about one that is in it."""
    size = FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(_matrix(batch.column(0), k), size), pa.int64())], names=["place"])

    return _bitmap(frequent.select("id").mapInArrow(run, "place long"))


def _possible(frequent: DataFrame, on: list[str]) -> Column:
    """Whether a group may be in ``frequent``, by a bitmap of fixed size; never wrong about one that is."""
    place = F.xxhash64(*on).bitwiseAND(FILTER_BITS - 1)
    bits = _bitmap(frequent.select(place.alias("place")))
    shipped = frequent.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def held(at: pa.Array) -> pa.Array:
        x = at.to_numpy(zero_copy_only=False)
        return pa.array((shipped.value[x >> 6] >> (x & 63)) & 1 == 1)

    return held(place)


def _semi_joined(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    """Blocks of ``R_1`` with codes and numbers of their words that are frequent, one long each. Most that are not stay away from the shuffle."""
    on = ["lang", "word"]
    groups = relation.select("block", "lang", F.posexplode("words").alias("code", "word")).filter(_possible(frequent, on))
    number = F.conv(F.hex("id"), 16, 10).cast("long")
    met = groups.join(frequent.select(*on, number.alias("number")), on).select("block", (F.shiftleft(F.col("code").cast("long"), 32) + F.col("number")).alias("known"))
    return relation.select("block", "own", "codes").join(met.groupBy("block").agg(F.collect_list("known").alias("known")), "block")  # a block's groups at most


def _numbered(found: DataFrame) -> DataFrame:
    """``found`` with ``id``, a gapless number from 0, as 4 bytes; frequent words come first, so that names compress well."""
    placed = persisted(found.orderBy(F.desc("f"), "lang", "word").withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    before, starts = 0, {}
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row for each partition that wrote
        starts[r["part"]], before = before, before + r["count"]
    if before > 1 << 31:
        raise ValueError("more than 2**31 frequent words")
    first = F.get(F.lit([starts.get(i, 0) for i in range(max(starts, default=0) + 1)]).cast("array<long>"), part.cast("int"))
    number = first + F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("id", F.unhex(F.lpad(F.hex(number), 8, "0"))).drop("__at")


def frequent_phrases(df: DataFrame, least: int, longest: int, block: int = BLOCK, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language, and ``F_1`` to ``F_longest``: ``id`` (its words' numbers, 4 bytes each), ``lang, phrase, f``, numbers of its first and last 1, 2 ... words
    (``heads``, ``tails``) and, from two words on, the ids ``left`` and ``right`` of the phrases without its last and first word."""
    relation = persisted(occurrences(df, longest, block, lang_col, text_col), "occurrences-1")
    none = F.array().cast("array<long>")
    words = relation.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    totals = persisted(relation.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "words")
    found = _numbered(words.filter(F.col("f") >= least)).select("id", "lang", "word", F.col("word").alias("phrase"), "f", none.alias("heads"), none.alias("tails"))
    levels = [persisted(found, "frequent-1")]
    for k in range(2, longest + 1):
        if k == 2:
            pairs = joined(_semi_joined(relation, levels[-1]), 1)
        else:
            pairs = joined(relation, k - 1, _filter(levels[-1], k - 1))
        before, relation = relation, persisted(pairs, f"occurrences-{k}")
        discard(before)
        found = counted(relation, k, least).withColumns({"left": F.substring("id", 1, 4 * (k - 1)), "right": F.substring("id", 5, 4 * (k - 1))})
        a = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("a"), F.col("heads").alias("ah"), F.col("f").alias("af"))
        b = levels[-1].select(F.col("id").alias("right"), F.col("phrase").alias("b"), F.col("tails").alias("bt"), F.col("f").alias("bf"))
        made = found.join(a, "left").join(b, "right")
        phrase = F.concat("a", F.lit(" "), F.substring_index("b", " ", -1))
        made = made.select("id", "lang", phrase.alias("phrase"), "f", F.array_append("ah", F.col("af")).alias("heads"), F.array_append("bt", F.col("bf")).alias("tails"), "left", "right")
        levels.append(persisted(made, f"frequent-{k}"))
    return totals, levels


def lowest_cut(a: Column, heads: Column, tails: Column, n: Column) -> Column:
    """The cut with the lowest ``floor(1000 * a * n / (l * r))`` as ``score, k, l, r``; equal scores go to the least ``k``. Exact: products are decimals."""
    exact = lambda c: c.cast("decimal(19,0)")
    score = lambda left, right: F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact(a) * exact(n), exact(left) * exact(right))

    def cut(left: Column, i: Column) -> Column:
        right = F.element_at(tails, F.size(heads) - i)
        return F.struct(score(left, right).alias("score"), (i + 1).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(heads, cut))


def mine(df: DataFrame, least: int = 100, longest: int = 5, inside: int = 100, top: int = 2000, block: int = BLOCK, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``longest`` words with ``a >= least``.

    A phrase is left out where a longer one that holds it has ``inside`` per cent of its number or more. A phrase between
    the two has at least that too, so looking one word further is enough.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    with scratch() as keep:
        totals, levels = frequent_phrases(df, least, longest, block, lang_col, text_col)
        parts = []
        for level, longer in zip(levels[1:], [*levels[2:], None], strict=True):
            if longer is not None:
                held = longer.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
                level = level.join(held, "id", "left").filter(F.coalesce(100 * F.col("most") < inside * F.col("f"), F.lit(True)))
            parts.append(level.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails"))
        scored = reduce(DataFrame.unionByName, parts).join(totals, "lang").withColumn("c", lowest_cut(F.col("a"), F.col("heads"), F.col("tails"), F.col("n")))
        rows = scored.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        split = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        some = split.withColumn("__place", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).filter(F.col("__place") <= top)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)  # PARTS * top rows a language at most
        return keep(persisted(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations"))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op11_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    names = [f"w{i}" for i in range(1, longest + 1)]
    out = [
        "WITH p AS (SELECT lang, row_number() OVER () AS piece, part FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS part FROM documents))",
        "w AS MATERIALIZED (SELECT lang, piece, unnest(ws) AS w1, unnest(range(len(ws))) AS pos FROM (SELECT lang, piece, regexp_extract_all(part, '[^\\x20\\x09]+') AS ws FROM p))",
        "n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang)",
        "o AS MATERIALIZED (SELECT lang, w1, " + ", ".join(f"lead(w1, {i}) OVER (PARTITION BY piece ORDER BY pos) AS w{i + 1}" for i in range(1, longest)) + " FROM w)",
    ]
    for k in range(1, longest + 1):
        cols = ", ".join(names[:k])
        out.append(f"f{k} AS MATERIALIZED (SELECT lang, {cols}, count(*) AS f FROM o WHERE w{k} IS NOT NULL GROUP BY lang, {cols} HAVING count(*) >= {least})")
    rows = []
    for k in range(2, longest + 1):
        same = lambda t, mine, theirs: f"{t}.lang = c.lang AND " + " AND ".join(f"{t}.{x} = c.{y}" for x, y in zip(theirs, mine, strict=True))
        cuts, joins = [], []
        for i in range(1, k):
            joins.append(f"JOIN f{i} l{i} ON {same(f'l{i}', names[:i], names[:i])} JOIN f{k - i} r{i} ON {same(f'r{i}', names[i:k], names[: k - i])}")
            cuts.append(f"{{'score': (1000::HUGEINT * c.f * n.n) // (l{i}.f::HUGEINT * r{i}.f), 'k': {i}, 'l': l{i}.f, 'r': r{i}.f}}")
        longer = "" if k == longest else " WHERE " + " AND ".join(f"NOT EXISTS (SELECT 1 FROM f{k + 1} x WHERE x.f >= c.f AND {same('x', names[:k], names[s : s + k])})" for s in (0, 1))
        rows.append(f"SELECT c.lang, concat_ws(' ', {', '.join('c.' + x for x in names[:k])}) AS phrase, c.f AS a, n.n, list_min([{', '.join(cuts)}]) AS b FROM f{k} c JOIN n ON n.lang = c.lang {' '.join(joins)}{longer}")
    out.append(f"c AS ({' UNION ALL '.join(rows)})")
    ranked = "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, n, b.score::BIGINT AS score FROM c"
    return ", ".join(out) + f" SELECT * FROM ({ranked}) WHERE rank <= {top}"


OP11_SQL = _op11_sql()
