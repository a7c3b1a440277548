"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, lower-cased. An item counts as leaked if
some stretch of ``min(len(item), STRETCH)`` aligned tokens agrees in ``AGREE``
(80 %) of its positions with a document; items below ``VERBATIM`` tokens must
agree in all.

Each of three fixed seeds looks at a block of three tokens and one of two, and
ignores 0, 1 or 4 positions between them: ``11111``, ``11*111``, ``111****11``.
Whatever positions are substituted in a stretch that still counts as leaked, at
least one seed looks at intact tokens only (by enumeration of all placements for
all lengths from 5 to ``STRETCH``; a test repeats it). Items of three or four
tokens have one block of three, shorter ones are looked up whole. So no leak by
substitution is missed, at any length; tokens that are added or left out inside
a stretch are not searched for.

Masked windows of documents and of items are hashed and joined. Every hit fixes
an alignment of the item to the document, which is verified token by token.

The documents are read in one pass that moves hits only, whatever the size of the
benchmark: positions are generated, those whose first block is in no item by a
bitmap are dropped, the rest are masked and hashed, those whose hash is in no item
by a second bitmap are dropped, and what is left is joined with the items' masked
windows. A bitmap has ``BITS`` bits and is broadcast as rows of 64 bits, so at most
``BITS / 64`` rows of 16 bytes; a full one lets more through, but never drops a hit. No other side
carries a hint: Spark broadcasts it by its measured size or shuffles. A position
carries hashes, never the text. Hits are written as a table; the tokens of the rows
that have any are fetched by a join with it.

Edge cases: null and empty texts and items have no tokens and no hits; repeated
rows and null ids keep their rows, as rows are told apart by id and text hash;
repeated items count once each by their id; empty tables on either side give no
hits; very short items flag every document that holds them; other columns of
``docs`` may have any name that does not start with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persisted, scratch

BLOCK, SECOND = 3, 2
#: Where the block of two begins, counted from the block of three.
SEEDS = [-2, -3, 7]
#: Stands for the gap of items with no block of two.
ALONE = 0
VERBATIM = 8
STRETCH = 20
AGREE = 0.8
#: Size of a bitmap of the benchmark's hashes, a power of two.
BITS = 1 << 26


def token_hashes(text: Column) -> Column:
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _at(i: Column) -> Column:
    """The token at a place; null before the first and after the last."""
    return F.when(i >= 0, F.get("tokens", i))


def _block(at: Column, n: int) -> Column:
    """Hash of ``n`` tokens from a place on; null where they do not fit."""
    return F.when((at >= 0) & (at + n <= F.size("tokens")), F.xxhash64(F.lit(n), *(_at(at + i) for i in range(n))))


def _key(at: Column, gap: int, n: int = BLOCK) -> Column:
    """Hash of what a seed looks at; null where it does not fit."""
    if gap == ALONE:
        return F.when((at >= 0) & (at + n <= F.size("tokens")), F.xxhash64(F.lit(ALONE), F.lit(n), *(_at(at + i) for i in range(n))))
    fits = (at >= 0) & (at + gap >= 0) & (at + max(BLOCK, gap + SECOND) <= F.size("tokens"))
    return F.when(fits, F.xxhash64(F.lit(gap), *(_at(at + i) for i in range(BLOCK)), *(_at(at + gap + i) for i in range(SECOND))))


def _seeds(at: Column, lengths: list[int]) -> Column:
    """``key`` and ``before`` (the same seed one place earlier) of all seeds at a place; ``lengths`` of items that are looked up alone."""
    forms = [(g, BLOCK) for g in SEEDS] + [(ALONE, n) for n in lengths]
    both = [F.struct(_key(at, g, n).alias("key"), _key(at - 1, g, n).alias("before")) for g, n in forms]
    return F.filter(F.array(*both), lambda s: s["key"].isNotNull())


def _needed(n: Column) -> Column:
    """Tokens that must agree in a stretch of ``n``."""
    return F.when(n < VERBATIM, n).otherwise(F.ceil(AGREE * n)).cast("int")


def _held(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``values`` (one column of hashes), by a bitmap; none that is gets lost."""
    word = lambda x: F.shiftright(x.bitwiseAND(BITS - 1), 6)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    x = F.col(values.columns[0])
    bitmap = values.groupBy(word(x).alias("__word")).agg(F.bit_or(bit(x)).alias("__bits"))
    met = df.withColumn("__word", word(F.col(column))).join(F.broadcast(bitmap), "__word")  # at most BITS / 64 rows
    return met.filter(F.col("__bits").bitwiseAND(bit(F.col(column))) != 0).drop("__word", "__bits")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``id, text_hash, item_id, start``: alignments that a seed proposes. ``docs``: id, text_hash, tokens; ``items``: item_id, tokens."""
    short = [r.n for r in items.select(F.size("tokens").alias("n")).filter("n between 1 and 4").distinct().collect()]  # four rows at most
    alone = sorted({min(n, BLOCK) for n in short})
    places = sorted({BLOCK, *alone})
    at = F.col("at")
    positions = lambda df, keep: df.select(*keep, "tokens", F.posexplode("tokens").alias("at", "__token")).drop("__token")
    own = F.when(F.size("tokens") < BLOCK + SECOND, _seeds(at, alone)).otherwise(_seeds(at, []))
    wanted = positions(items, ["item_id"]).select("item_id", "at", F.explode(own).alias("s"))
    wanted = wanted.select("s.key", F.col("s.before").alias("item_before"), "item_id", F.col("at").alias("item_at")).distinct()
    blocks = positions(items, []).select(F.explode(F.array(*(_block(at, n) for n in places))).alias("block")).filter("block is not null")
    block = F.explode(F.array(*(_block(at, n) for n in places))) if len(places) > 1 else _block(at, BLOCK)
    found = _held(positions(docs, ["id", "text_hash"]).withColumn("block", block), "block", blocks)
    found = found.select("id", "text_hash", "at", F.explode(_seeds(at, alone)).alias("s")).select("id", "text_hash", "at", "s.key", "s.before")
    met = _held(found, "key", wanted.select("key")).join(wanted, "key")
    # Of a run of hits of one seed on one alignment, the first is enough.
    met = met.filter(F.col("before").isNull() | F.col("item_before").isNull() | (F.col("before") != F.col("item_before")))
    return met.select("id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified leaks ``(id, text_hash, item_id, at, agreeing)``, one row for each row key, item and alignment."""
    items = benchmark.select(F.col(item_col).alias("item_id"), token_hashes(F.col(item_text)).alias("tokens")).filter(F.size("tokens") > 0)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    with scratch() as kept:
        proposed = persisted(hits(rows.select("id", "text_hash", token_hashes(F.col("text")).alias("tokens")), items), "hits")
        named = proposed.withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
        met = rows.join(named, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).drop("__id", "__hash")
        met = met.select("id", "text_hash", "item_id", "start", token_hashes(F.col("text")).alias("tokens")).join(items.withColumnRenamed("tokens", "item_tokens"), "item_id")
        equal = F.transform("item_tokens", lambda t, j: F.coalesce(_at(F.col("start") + j) == t, F.lit(False)).cast("int"))
        met = met.withColumn("equal", equal)
        length = F.least(F.size("equal"), F.lit(STRETCH))
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - length + 1), lambda s: F.aggregate(F.slice("equal", s, length), F.lit(0), lambda a, x: a + x)))
        # The test comes after the aggregate so that it is not pushed into the join and evaluated again.
        verified = met.groupBy("id", "text_hash", "item_id", F.col("start").alias("at")).agg(F.max(best).alias("agreeing"), F.min(_needed(length) - best).alias("lacking"))
        return kept(persisted(verified.filter("lacking <= 0").drop("lacking"), "leaks"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, contaminated, n_items, items (sorted ids of leaked items)."""
    found = leaks(docs, benchmark, id_col, text_col).groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"))
    out = rows.join(found, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("text_hash")), "left")
    return out.select(F.col("__id").alias(id_col), F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is leaked."""
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    tagged = docs.withColumns({"__id": F.col(id_col), "__hash": F.xxhash64(text_col)})
    return tagged.join(bad, F.col("__id").eqNullSafe(F.col("__bad_id")) & (F.col("__hash") == F.col("__bad_hash")), "left_anti").drop("__id", "__hash")


def op7_decontam(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
