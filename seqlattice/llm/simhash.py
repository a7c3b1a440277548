"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: the majority bit over the XXH64 values of a text's word shingles.
Two documents are linked if their fingerprints differ in at most ``RADIUS`` (2)
bits. Each *distinct* fingerprint emits every value within half the radius (1
bit: itself and its 64 neighbours). Two fingerprints meet in a value exactly if
they are within 2 bits of each other. A value is met by 65 distinct
fingerprints at most, all of them within 2 bits of one another, so consecutive
members in sorted order are enough links: a group of n gives n - 1 links, never
all pairs. Links are deduplicated and their distance verified.

Copies collapse before the shuffle on values, so a group of copies of any size
costs one row. The rows shuffled are 65 pairs of longs for each distinct
fingerprint, in proportion to the input.

Edge cases: a text without words (null, empty, blank) has fingerprint zero and
is linked like any other; fewer words than a shingle: the whole sequence is one
shingle; repeated rows link to each other; null ids never become a component id
unless the whole component has no other; an empty table gives an empty result;
:func:`fingerprints` replaces an input column named as its own, other results
have the columns named only.

With ``similarity`` links are between sets of shingles of at least that Jaccard
similarity. Ball hashing of the sets' fingerprints gives pairs as above (sets with
one fingerprint are paired with the least of them), which are then compared by
their whole sets. At 0.8 fingerprints may differ in about ten bits, and no ball of
half that radius can be emitted, so more pairs come from the sets themselves: two
of at least that similarity always share one of the first
``n - ceil(similarity * n) + 1`` hashes of either (any global order does), so texts
are also met on these. Each pair met in either way is compared exactly. In the
order, hashes that two texts of a sample (every ``SAMPLE``-th by hash) share come
last, so a passage of many documents brings together only texts that hold little
else; the sample decides about work, never about results.

Where at most ``ALL`` texts share a hash, all their pairs are met. Where more do,
each first meets the ``HUBS`` texts that share most with others (the original of
many altered copies is one) and the ``NEXT`` before it in this order. What these
link needs no more comparing. All other pairs that share the hash, of texts that
are not linked yet, are then met in blocks of ``BLOCK`` texts: no pair is left out. Pairs that
could not be similar if this were the first hash they share are not compared there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import persisted, scratch
from .components import components

WIDTH = 3
SEED = 42
RADIUS = 2
ALL, HUBS, NEXT, BLOCK = 16, 4, 3, 512
SAMPLE = 16
#: Bits by which texts that are in no pair are left out before their sets are made again.
BITS = 1 << 24


def shingles(tokens: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``width`` words; of all words if they are no more."""
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, tokens), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(tokens) - width + 1)
    return np.fromiter((digest(line[i:j], seed) for i, j in zip(starts[:n], ends[-n:])), np.uint64, n)


def fingerprint(data: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    tokens = (data or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    return majority(shingles(tokens, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; of one hash, itself."""
    total, n = np.zeros(64, np.int64), len(hashes)
    for lo in range(0, n, 65536):
        part = hashes[lo : lo + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp", width: int = WIDTH) -> DataFrame:
    """``df`` without its text column, with the fingerprint as a signed long."""
    keep = [f for f in df.schema.fields if f.name not in (text_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(batch.num_columns - 1).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in data), np.uint64, len(data))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=[*(f.name for f in keep), out])

    schema = T.StructType([*keep, T.StructField(out, T.LongType())])
    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text_col).cast("string")).mapInArrow(run, schema)


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links ``(a, b)``, a < b, between distinct fingerprints at ``RADIUS`` bits or less; enough to connect all of them."""
    ball = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = distinct_fps.select("fp", F.explode(ball).alias("value"))
    pairs = met.select(F.lag("fp").over(Window.partitionBy("value").orderBy("fp")).alias("a"), F.col("fp").alias("b")).filter("a is not null")
    return pairs.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def _bits(slots: DataFrame) -> bytes:
    """Bitmap of ``BITS`` bits with those of the column ``bit`` set."""
    at = F.call_function("shiftright", F.col("bit"), F.lit(15))
    maps = slots.groupBy(at.alias("k")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits")).collect()  # BITS / 32768 rows at most
    out = bytearray(BITS // 8)
    for row in maps:
        out[row.k * 4096 : (row.k + 1) * 4096] = row.bits
    return bytes(out)


def _in(bits: bytes, values: np.ndarray) -> np.ndarray:
    at = values.view(np.uint64) % np.uint64(8 * len(bits))
    return (np.frombuffer(bits, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def common_shingles(texts: DataFrame, width: int) -> bytes:
    """Bitmap of the shingles that two different texts of the sample hold; ``texts``: th and text."""
    sample = texts.filter(F.pmod(F.xxhash64("th"), F.lit(SAMPLE)) == 0)
    grams = shingle_sets(sample, width, 0.0).select("th", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo <> hi")
    return _bits(shared.select(F.col("gram").bitwiseAND(F.lit(BITS - 1)).alias("bit")))


def shingle_sets(df: DataFrame, width: int, similarity: float, text_col: str = "text", only: bytes | None = None, common: bytes | None = None) -> DataFrame:
    """``df`` without its text column, with the set of shingle hashes: fp (hash of the set), n (its size), grams (what two
    similar sets share one of; of 63 bits, the highest set for ``common`` ones, so that they come last) and mark (the set's
    fingerprint). With ``only``, a bitmap of ``th`` modulo its size, grams is the whole set, of these rows alone, and mark is null."""
    keep = [f for f in df.schema.fields if f.name != text_col]
    names = [*(f.name for f in keep), "fp", "n", "grams", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(_in(only, batch.column("th").to_numpy())))
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                whole = [np.unique(shingles((x.as_py() or b"").lower().split(), width)) for x in part.column(part.num_columns - 1).cast(pa.binary())]
                marks = pa.array(np.array([majority(x) for x in whole], np.uint64).view(np.int64)) if only is None else pa.nulls(len(whole), pa.int64())
                sets = [np.unique(_ordered(x, common)) for x in whole]
                fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                sizes = [len(x) for x in sets]
                if only is None:
                    sets = [x[: _head(len(x), similarity)] for x in sets]
                grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps), pa.array(sizes, pa.int64()), grams, marks], names=names)

    schema = T.StructType([*keep, T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("mark", T.LongType())])
    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def _ordered(hashes: np.ndarray, common: bytes | None) -> np.ndarray:
    """62 bits of each hash, with one more above them for common ones."""
    low = (hashes >> np.uint64(2)).view(np.int64)
    return low if common is None or not len(low) else low | (_in(common, low).astype(np.int64) << 62)


def _head(n: int, similarity: float) -> int:
    return n - ceil(similarity * n - 1e-9) + 1 if n else 0


def ball_pairs(heads: DataFrame) -> DataFrame:
    """Pairs ``(fp, other)`` that connect all sets that have hashes and marks at ``RADIUS`` bits or less; ``heads``: fp, n, mark."""
    marked = heads.filter("n > 0").select("fp", "mark")
    marks = persisted(marked.groupBy("mark").agg(F.min("fp").alias("other")), "marks")
    same = marked.join(marks, "mark").filter("fp <> other").select("fp", "other")
    a, b = marks.select(F.col("mark").alias("a"), F.col("other").alias("fp")), marks.select(F.col("mark").alias("b"), "other")
    return same.unionByName(links(marks.select(F.col("mark").alias("fp"))).join(a, "a").join(b, "b").select("fp", "other"))


def similar(texts: DataFrame, prints: DataFrame, width: int, similarity: float, common: bytes) -> DataFrame:
    """Links ``(a, b)``, a < b, that connect all distinct sets of at least this Jaccard similarity; ``texts``: th and text, ``prints``: of :func:`shingle_sets`."""
    heads = persisted(prints.groupBy("fp").agg(F.first("n").alias("n"), F.first("grams").alias("grams"), F.min("th").alias("th"), F.min("mark").alias("mark")), "heads")
    rows = heads.select("fp", "n", F.posexplode("grams").alias("at", "gram")).withColumn("texts", F.count("*").over(Window.partitionBy("gram"))).filter("texts > 1")
    rows = persisted(rows, "shared")
    scores = rows.groupBy("fp").agg(F.sum("texts").alias("score"))
    order = Window.partitionBy("gram").orderBy(F.desc("score"), "fp")
    other = F.struct("fp", "n", "at")
    few = F.array(*(F.lag(other, k).over(order) for k in range(1, ALL)))
    many = F.array(*(F.lag(other, k).over(order) for k in range(1, NEXT + 1)), *(F.nth_value(other, k).over(order) for k in range(1, HUBS + 1)))
    scored = rows.join(scores, "fp")
    met = [part.select("fp", "n", "at", o.alias("o")).select("fp", "n", "at", F.explode("o").alias("o")) for part, o in ((scored.filter(F.col("texts") <= ALL), few), (scored.filter(F.col("texts") > ALL), many))]
    met = met[0].filter(_reach("n", "at", "o.n", "o.at", similarity)).unionByName(met[1]).filter((F.col("o.fp") != F.col("fp")) & _near(F.col("n"), F.col("o.n"), similarity))
    found = persisted(_verified(met.select("fp", F.col("o.fp").alias("other")).unionByName(ball_pairs(heads)), heads, texts, width, similarity, common), "found")

    # The rest of the hashes that many share, between texts that are not linked yet.
    hot = rows.filter(F.col("texts") > ALL)
    if hot.isEmpty():
        return found
    roots = components(found)
    hot = hot.select("fp", "n", "at", "gram", "texts").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    hot = persisted(hot, "hot")
    mixed = hot.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("gram")
    blocks = F.ceil(F.col("texts") / BLOCK).cast("int")
    rest = hot.join(mixed, "gram", "left_semi").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("fp", F.lit(1)), blocks).cast("int")})
    rest = rest.select("fp", "n", "at", "gram", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("facing"))
    left = rest.filter("block <= facing").select("gram", F.col("block").alias("x"), F.col("facing").alias("y"), "fp", "n", "at", "root")
    right = rest.filter("facing <= block").select("gram", F.col("facing").alias("x"), F.col("block").alias("y"), F.col("fp").alias("other"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("root").alias("r"))
    pairs = left.join(right, ["gram", "x", "y"]).filter((F.col("root") != F.col("r")) & _near(F.col("n"), F.col("m"), similarity) & _reach("n", "at", "m", "to", similarity))
    return found.unionByName(_verified(pairs.select("fp", "other"), heads, texts, width, similarity, common))


def _near(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _reach(n: str, at: str, m: str, to: str, similarity: float) -> Column:
    """False if two sets that share a hash at these places of their order, and none before, are too far apart. A pair that
    shares an earlier one is met there."""
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(to)) >= similarity / (1 + similarity) * (F.col(n) + F.col(m)) - 1e-9


def _verified(met: DataFrame, heads: DataFrame, texts: DataFrame, width: int, similarity: float, common: bytes) -> DataFrame:
    """Pairs ``(a, b)`` of those met (fp, other) that are similar by their whole sets."""
    met = met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    # Up to the lesser of both last hashes the sets are known; beyond it the smaller rest may be common.
    top = F.least(F.element_at("ga", -1), F.element_at("gb", -1))
    beyond = lambda x: F.col(f"n{x}") - F.size(F.filter(f"g{x}", lambda g: g <= top))
    most = F.size(F.array_intersect("ga", "gb")) + F.least(beyond("a"), beyond("b"))
    pairs = persisted(_with_sets(met, heads).filter(_alike(most, similarity)).select("a", "b"), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    shown = persisted(heads.select("fp", "th").join(nodes, "fp", "left_semi"), "shown")
    only = _bits(shown.select(F.col("th").bitwiseAND(F.lit(BITS - 1)).alias("bit")))
    whole = shingle_sets(texts, width, similarity, only=only, common=common).groupBy("fp").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    sets = persisted(whole.join(shown, "fp", "left_semi"), "sets")
    return _with_sets(pairs, sets).filter(_alike(F.size(F.array_intersect("ga", "gb")), similarity)).select("a", "b")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = (sets.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b")


def _alike(common: Column, similarity: float) -> Column:
    return common >= similarity * (F.col("na") + F.col("nb") - common) - 1e-9


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), width: int = WIDTH, similarity: float | None = None) -> DataFrame:
    """One row per row of ``df``: id, ``extra``, fp, root (least fingerprint of the component), component_id.

    With ``similarity``, links are between sets of ``width`` words of at least that Jaccard similarity.
    """
    texts = df.select(F.col(id_col).alias("id"), *extra, F.col(text_col).alias("text"))
    with scratch() as kept:
        if similarity is None:
            prints = persisted(fingerprints(texts, width=width), "prints")
        else:
            hashed = texts.withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)))
            common = common_shingles(hashed.select("th", "text"), width)
            prints = persisted(shingle_sets(hashed.select("id", *(c for c in extra if c != "th"), "th", "text"), width, similarity, common=common), "prints")
        classes = persisted(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
        roots = components(links(classes.select("fp")) if similarity is None else similar(hashed.select("th", "text"), prints, width, similarity, common))
        members = classes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
        heads = members.groupBy("root").agg(F.min("least").alias("component"))
        linked = persisted(members.join(heads, "root").select("fp", "root", "component"), "linked")
        whole = classes.join(linked, "fp", "left").select(F.col("fp"), F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
        whole = persisted(whole, "membership")
        out = prints.join(whole, "fp", "left").select(F.col("id").alias(id_col), *extra, "fp", "root", F.col("component").alias("component_id"))
        return kept(persisted(out, "grouped"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float | None = None) -> DataFrame:
    """``df`` with one row of each component: that with the least id (nulls last), then the least text hash."""
    tagged = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    found = near_duplicates(tagged, "id", "text", ("th",), width, similarity)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("best"))
    keep = best.select(F.col("best.id").alias("__id"), F.col("best.th").alias("__th")).distinct()
    wide = df.withColumns({"__key": F.col(id_col), "__hash": F.xxhash64(text_col)})
    kept = wide.join(keep, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left_semi")
    return kept.dropDuplicates(["__key", "__hash"]).drop("__key", "__hash")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
