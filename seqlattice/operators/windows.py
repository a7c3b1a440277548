"""Fixed windows over k-mer positions and the assignment of k-mers to them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(window: int, k: int, delta: float) -> None:
    if window < k:
        raise ValueError("a window must hold at least one k-mer")
    if not 0 <= delta <= 1:
        raise ValueError("delta lies between 0 and 1")


def full_windows(n: Column, window: int, k: int) -> Column:
    """Number of full windows after the first one, for ``n`` k-mers."""
    return F.greatest(F.lit(0).cast("long"), F.floor((n - (2 * window - k + 1)) / window) + 1)


def bounds(n: Column, w: Column, window: int, k: int, delta: float) -> tuple[Column, Column, Column]:
    """First k-mer, one past the last, and whether window ``w`` exists.

    Windows are widened by ``window * delta`` on both sides and cut at the ends.
    Ties are rounded to even. Between the unwidened first and second window one
    k-mer belongs to neither.
    """
    d = window * delta
    half_even = lambda c: F.bround(c, 0).cast("long")
    first = window - k + 1
    begin = (F.lit(first) + (w - 1) * window).cast("double")
    full = full_windows(n, window, k)
    low = F.when(w == 0, F.lit(0).cast("long")).otherwise(F.greatest(half_even(begin + 1 - d), F.lit(0).cast("long")))
    high = F.when(w == 0, half_even(F.lit(float(first + d)))).when(w <= full, half_even(begin + window + 1 + d)).otherwise(n)
    exists = (w <= full) | ((w == full + 1) & (begin <= n - 2))
    return low, F.least(high, n), exists


def window_table(seqs: DataFrame, window: int, k: int, delta: float = 0.0, n: str = "n_kmers") -> DataFrame:
    """All windows of each sequence: the columns of ``seqs``, ``w``, ``lo``, ``hi`` (half-open)."""
    check(window, k, delta)
    last = full_windows(F.col(n), window, k) + 1
    df = seqs.filter(F.col(n) > 0).withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    low, high, exists = bounds(F.col(n), F.col("w"), window, k, delta)
    return df.filter(exists).withColumns({"lo": low, "hi": high})


def assign(kmers: DataFrame, window: int, k: int, delta: float = 0.0, n: str = "n_kmers") -> DataFrame:
    """A row for each k-mer and window that holds it, found by arithmetic instead of a range join."""
    check(window, k, delta)
    centre = F.floor((F.col("idx") - (window - k + 2)) / window) + 1
    reach = math.ceil(delta) + 1
    df = kmers.withColumn("w", F.explode(F.sequence(centre - reach, centre + reach))).filter("w >= 0")
    low, high, exists = bounds(F.col(n), F.col("w"), window, k, delta)
    return df.filter(exists & (F.col("idx") >= low) & (F.col("idx") < high))


def region(kmers: DataFrame, start: int, end: int, k: int, n: str = "n_kmers") -> DataFrame:
    """k-mers inside the 1-based closed region, renumbered from 0."""
    count = end - start + 1 - k + 1
    inside = kmers.filter(F.col("idx").between(start - 1, end - k))
    return inside.withColumns({"idx": F.col("idx") - (start - 1), n: F.least(F.lit(count).cast("long"), F.col(n) - (start - 1))})


def uncovered(table: DataFrame, n: str = "n_kmers") -> DataFrame:
    """Sequences of a window table whose last k-mer lies in no window: key columns, ``covered`` and the number of k-mers."""
    keys = [c for c in table.columns if c not in ("w", "lo", "hi", n)]
    return table.groupBy(*keys).agg(F.max("hi").alias("covered"), F.max(n).alias(n)).filter(F.col("covered") < F.col(n))
