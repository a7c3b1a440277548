"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number ``r`` in ``[0, N)``; a keyed permutation maps it
to a position ``p`` in ``[0, N)``; ``shard = p mod S`` and ``slot = p div S``.
Shard sizes therefore differ by one row at most (the ``rows`` law), slots are
gapless from 0, and both can be computed from the row number alone.

The row number does not depend on how the input is split into files or tasks.
Rows are pre-aggregated on (id, size, crc32): rows equal in all three are
interchangeable in the result, so a group of any size is one counted row. A
group of more than ``CHUNK`` rows becomes several counted rows, so no task ever
expands an unbounded group. Counted rows go to ``BUCKETS`` hash buckets, are
ordered inside each by (id, size, crc32, chunk), and start at the sum of the
lengths before them. Only the table of bucket totals (at most ``BUCKETS`` rows
by construction) is broadcast. The plan is DataFrame operations only.

Edge cases: a null text has no bytes (size 8, crc32 of the empty text, 0); a
null id is a value like any other, first in order; repeated rows get a slot
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
SEED = 20240229
ROUNDS = 4
BUCKETS = 4096
CHUNK = 65536
#: Parts in which rows of equal id, size and crc32 are numbered when shards are attached to whole rows.
PIECES = 256
#: Steps of cycle walking tried before the query fails loudly. At most
#: sqrt(N) of the domain's numbers lie outside [0, N), and a walk meets each of
#: them once at most, so 64 is exact for N up to 4096 and missed with a
#: probability below 10**-115 beyond.
WALK = 64


def _sides(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n.cast("double") / a), F.lit(1)).cast("long")
    return a, b


def _mix(value: Column, key: Column, modulus: Column) -> Column:
    return F.pmod(F.xxhash64(value, key), modulus)


def _pass(x: Column, a: Column, b: Column, seed: int, rounds: int, inverse: bool) -> Column:
    """One application of the keyed permutation of ``[0, a*b)``."""
    keys = [F.lit(seed + i).cast("long") for i in range(rounds)]
    start = F.struct((F.floor(x / b)).cast("long").alias("l"), F.pmod(x, b).alias("r"))

    def forward(s: Column, key: Column) -> Column:
        left = F.pmod(s["l"] + _mix(s["r"], key, a), a)
        return F.struct(left.alias("l"), F.pmod(s["r"] + _mix(left, -key, b), b).alias("r"))

    def back(s: Column, key: Column) -> Column:
        right = F.pmod(s["r"] - _mix(s["l"], -key, b), b)
        return F.struct(F.pmod(s["l"] - _mix(right, key, a), a).alias("l"), right.alias("r"))

    return F.aggregate(F.array(*(keys[::-1] if inverse else keys)), start, back if inverse else forward, lambda s: s["l"] * b + s["r"])


def permute(df: DataFrame, col: str, n: Column, out: str, seed: int = SEED, rounds: int = ROUNDS, inverse: bool = False) -> DataFrame:
    """Add ``out``: the permuted value of ``col``, a number in ``[0, n)``. ``inverse`` undoes it."""
    a, b = F.col("__a"), F.col("__b")
    step = lambda x: _pass(x, a, b, seed, rounds, inverse)
    a_side, b_side = _sides(n)
    df = df.withColumns({"__n": n, "__a": a_side, "__b": b_side})
    df = df.withColumn("__x", step(F.col(col)))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("__x"), lambda x, _: F.when(x < F.col("__n"), x).otherwise(step(x)))
    df = df.withColumn("__y", F.when(F.col("__x") < F.col("__n"), F.col("__x")).otherwise(walked))
    checked = F.when(F.col("__y") < F.col("__n"), F.col("__y")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return df.withColumn(out, checked).drop("__n", "__a", "__b", "__x", "__y")


def row_numbers(df: DataFrame, keys: list[str], buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """``keys``, a gapless global number ``row`` from 0 and the number of rows ``n_rows``, for every row of ``df``."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    pieces = counted.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk))))
    pieces = pieces.withColumns({
        "__len": F.least(F.lit(chunk).cast("long"), F.col("__n") - F.col("__c") * chunk),
        "__b": F.pmod(F.xxhash64(*keys, "__c"), F.lit(buckets)).cast("int"),
    })
    totals = pieces.groupBy("__b").agg(F.sum("__len").alias("__t"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select("__b", (F.sum("__t").over(before) - F.col("__t")).alias("__off"), F.sum("__t").over(Window.partitionBy()).alias("n_rows"))
    inside = Window.partitionBy("__b").orderBy(*keys, "__c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("__start", F.sum("__len").over(inside) - F.col("__len"))
    placed = placed.join(F.broadcast(offsets), "__b")  # at most `buckets` rows
    first = F.col("__off") + F.col("__start")
    return placed.select(*keys, F.explode(F.sequence(first, first + F.col("__len") - 1)).alias("row"), "n_rows")


def assign_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, shard, slot."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    narrow = df.select(F.col(id_col).alias("id"), (F.octet_length(data).cast("long") + 8).alias("size"), F.crc32(data).alias("text_crc32"))
    placed = permute(row_numbers(narrow, ["id", "size", "text_crc32"]), "row", F.col("n_rows"), "__p", seed)
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32",
        F.pmod(F.col("__p"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__p") / shards).cast("long").alias("slot"),
    )


def _numbered(df: DataFrame, salt: Column, order: list[str], weight: Column) -> DataFrame:
    """``df`` with ``nth``: gapless numbers from 0 in its groups of equal ``key``, ``weight`` of them for each row (one output row each).

    A group is numbered in up to ``PIECES`` parts by ``salt``, which start at the sum of the parts before.
    """
    df = df.withColumns({"__salt": F.pmod(salt, F.lit(PIECES)), "__w": weight})
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("key", "__salt").agg(F.sum("__w").alias("__total"))
    offsets = parts.select("key", "__salt", F.coalesce(F.sum("__total").over(past(Window.partitionBy("key").orderBy("__salt"))), F.lit(0)).alias("__off"))  # PIECES rows a key at most
    inside = F.coalesce(F.sum("__w").over(past(Window.partitionBy("key", "__salt").orderBy(*order))), F.lit(0))
    first = F.col("__off") + F.col("__in")
    numbers = F.explode(F.sequence(first, first + F.col("__w") - 1))
    return df.withColumn("__in", inside).join(offsets, ["key", "__salt"]).withColumn("nth", numbers).drop("__salt", "__w", "__off", "__in")


def attach_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (its own columns of these names give way), one row for each of its rows.

    Rows that share id, size and crc32 get their group's slots, one each. Equal rows are counted first, and groups are
    numbered in parts, so no group is one task's. Columns must be of types that Spark can group by.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    data = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), (F.octet_length(data).cast("long") + 8).alias("size"), F.crc32(data).alias("text_crc32"))
    rows = df.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).groupBy("key", "row").agg(F.count(F.lit(1)).alias("n"))
    rows = _numbered(rows.withColumn("h", F.xxhash64("row")), F.col("h"), ["h", "row"], F.col("n"))
    placed = assign_shards(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), shards, seed, "id", "text")
    placed = _numbered(placed.select(F.struct("id", "size", "text_crc32").alias("key"), "shard", "slot"), F.col("slot"), ["slot", "shard"], F.lit(1).cast("long"))
    return rows.join(placed, ["key", "nth"]).select(*(F.col(f"row.`{c}`").alias(c) for c in names), "shard", "slot")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
