"""Comparison grids: pairs of sequences, their order and their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered


def by_size(seqs: DataFrame, k: int) -> DataFrame:
    """Sequences by number of k-mers, longest first; ties stay in input order."""
    return seqs.withColumn("n_kmers", F.col("n") - (k - 1)).orderBy(F.desc("n_kmers"), "seq_ord")


def size_places(seqs: DataFrame, k: int, ties: list[str]) -> DataFrame:
    """``seqs`` with ``n_kmers`` and ``place``, from 0 for the longest; ties go by columns ``ties``. No task sorts all sequences."""
    return numbered(seqs.withColumn("n_kmers", F.col("n") - (k - 1)), -F.col("n_kmers"), ties)


def first(seqs: DataFrame, n: int = 2) -> DataFrame:
    """The first sequences in input order."""
    return seqs.orderBy("seq_ord").limit(n)


def sequence_pairs(seqs: DataFrame) -> DataFrame:
    """Every pair of sequences once, the earlier as the query. One row for each pair is the result, so it is quadratic by
    definition: only names and places take part; a grid that is drawn has few (see ``grid_complete``)."""
    a = seqs.select(F.col("seq_id").alias("query"), F.col("seq_ord").alias("q_ord"))
    b = seqs.select(F.col("seq_id").alias("reference"), F.col("seq_ord").alias("r_ord"))
    return a.join(b, F.col("q_ord") < F.col("r_ord"))


def matched_pairs(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted (query, reference) with the stored pair of the same two names and whether it must be transposed."""
    key = lambda a, b: [F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b")]
    left = wanted.select("query", "reference", *key(F.col("query"), F.col("reference")))
    right = stored.select(F.col("query").alias("stored_query"), F.col("reference").alias("stored_reference"), *key(F.col("query"), F.col("reference")))
    out = left.join(right, ["__a", "__b"])
    return out.select("query", "reference", "stored_query", "stored_reference", (F.col("query") != F.col("stored_query")).alias("transposed"))


def lower_order(pairs: DataFrame) -> DataFrame:
    """``pairs`` (all of a grid's sequences) with their places in row order of the upper and of the lower triangle.

    Only the sequences are put in order; the place of a pair follows from those of its two.
    """
    ords = pairs.select(F.explode(F.array("q_ord", "r_ord")).alias("ord")).distinct()
    ords = ords.select("ord", (F.row_number().over(Window.orderBy("ord")) - 1).alias("at"))  # a row for each sequence
    n = ords.agg(F.count(F.lit(1)).alias("__n"))
    side = lambda name, at: ords.select(F.col("ord").alias(name), F.col("at").alias(at))
    met = pairs.join(side("q_ord", "__q"), "q_ord").join(side("r_ord", "__r"), "r_ord").join(F.broadcast(n))  # one row
    q, r = F.col("__q"), F.col("__r")
    upper = q * F.col("__n") - F.expr("__q * (__q + 1) div 2") + r - q - 1
    lower = F.expr("__r * (__r - 1) div 2") + q
    return met.withColumns({"upper_order": upper.cast("int"), "lower_order": lower.cast("int")}).select(*pairs.columns, "upper_order", "lower_order")


def cells(singles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every cell of the grid: diagonal, pairs below it as they are and above it transposed."""
    diagonal = singles.select(F.col("seq_ord").alias("grid_row"), F.col("seq_ord").alias("grid_col"), F.col("seq_id").alias("query"), F.col("seq_id").alias("reference"), F.lit(False).alias("transposed"))
    below = pairs.select(F.col("r_ord").alias("grid_row"), F.col("q_ord").alias("grid_col"), "query", "reference", F.lit(False).alias("transposed"))
    above = pairs.select(F.col("q_ord").alias("grid_row"), F.col("r_ord").alias("grid_col"), "query", "reference", F.lit(True).alias("transposed"))
    return diagonal.unionByName(below).unionByName(above)
