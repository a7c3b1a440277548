"""Pair tables as plot frames: renaming, binning, mirroring, statistics, annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import rank_selection

#: The long and short column names of the format.
SHORT = {
    "query_name": "q", "query_start": "q_st", "query_end": "q_en",
    "reference_name": "r", "reference_start": "r_st", "reference_end": "r_en",
}
VALUE = "perID_by_events"
HISTOGRAM_BINS = 300


def renamed(df: DataFrame) -> DataFrame:
    """Short column names; a frame that has them already is unchanged."""
    return df.withColumnsRenamed(SHORT) if "query_name" in df.columns else df


def positions(df: DataFrame) -> DataFrame:
    """``first_pos`` and ``second_pos``: starts in units of the widest row (null where that is 0)."""
    df = renamed(df)
    widest = df.agg(F.coalesce(F.max(F.col("q_en") - F.col("q_st")), F.lit(0)).alias("__width"))
    df = df.join(F.broadcast(widest))  # one row
    place = lambda c: F.try_divide(F.col(c).cast("double"), F.col("__width").cast("double"))
    return df.withColumns({"first_pos": place("q_st"), "second_pos": place("r_st")}).drop("__width")


def bin_column(value: Column, edges: Column) -> Column:
    """Index of the right-closed interval between consecutive ascending edges (an array); the first includes its lower edge."""
    last = F.size(edges) - 2
    index = F.size(F.filter(F.slice(edges, 2, F.greatest(last, F.lit(0))), lambda e: e < value))
    return F.when((value >= F.get(edges, F.lit(0))) & (value <= F.element_at(edges, -1)), index).cast("int")


def equal_width_edges(df: DataFrame, colours: int, value: str = VALUE) -> DataFrame:
    """One row, ``edges``: from the floor of the least value to 100."""
    low = F.coalesce(F.floor(F.min(value)).cast("double"), F.lit(0.0))
    return df.agg(F.array(*(low + i * (100.0 - low) / colours for i in range(colours + 1))).alias("edges"))


def equal_frequency_edges(df: DataFrame, colours: int, value: str = VALUE) -> DataFrame:
    """One row, ``edges``: distinct exact quantiles (linear) at 0, 1/n ... 1."""
    return quantiles(df, [i / colours for i in range(colours + 1)], value).agg(F.array_sort(F.collect_set("value")).alias("edges"))


def discretised(df: DataFrame, colours: int, by_frequency: bool = False, breakpoints: list[float] | None = None, value: str = VALUE) -> DataFrame:
    """``discrete``: the colour bin of each row; breakpoints given outright win over both rules.

    Edges that follow from the data are one row that is joined, so nothing runs before the result is asked for but, for
    equal frequencies, the sketch of :func:`quantiles`. With a single edge, rows are in bin 0; where all values are the same
    and bins have equal width, in the top one.
    """
    if breakpoints:
        return df.withColumn("discrete", bin_column(F.col(value), F.array(*(F.lit(float(x)) for x in breakpoints))))
    if not 2 < colours < 12:
        raise ValueError("3 to 11 colours")
    edges = equal_frequency_edges(df, colours, value) if by_frequency else equal_width_edges(df, colours, value)
    at = F.col("__edges")
    index = F.when(F.size(at) < 2, 0).when(F.get(at, F.lit(0)) == F.element_at(at, -1), 0 if by_frequency else colours - 1).otherwise(bin_column(F.col(value), at))
    return df.join(F.broadcast(edges.withColumnRenamed("edges", "__edges"))).withColumn("discrete", index).drop("__edges")  # one row


def mirrored(df: DataFrame) -> DataFrame:
    """All rows, and again with places exchanged (not names) where start or end differ; duplicates stay."""
    df = renamed(df)
    swap = {"q_st": "r_st", "q_en": "r_en", "r_st": "q_st", "r_en": "q_en"}
    other = df.filter((F.col("q_st") != F.col("r_st")) | (F.col("q_en") != F.col("r_en")))
    return df.unionByName(other.select(*(F.col(swap.get(c, c)).alias(c) for c in df.columns)))


def split_self(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows within one sequence, and rows between two."""
    same = F.col("query_name") == F.col("reference_name")
    return df.filter(same), df.filter(~same)


def names_per_side(df: DataFrame) -> DataFrame:
    """Counts that a saved table must have: one name a side."""
    return df.agg(F.countDistinct("query_name").alias("query_names"), F.countDistinct("reference_name").alias("reference_names"), F.count(F.lit(1)).alias("n_rows"))


def check_contract(df: DataFrame) -> None:
    row = names_per_side(df).first()
    if row.query_names != 1 or row.reference_names != 1:
        raise ValueError("a saved pair table holds one query and one reference")
    if row.n_rows < 2:
        raise ValueError("a saved pair table holds more than one row")


def histogram(df: DataFrame, bins: int = HISTOGRAM_BINS, value: str = VALUE, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in equal-width bins between least and greatest value, the top edge in the last bin."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    df = df.join(F.broadcast(ends))  # one row
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.when(width > 0, F.least(F.floor(F.try_divide(F.col(value) - F.col("__lo"), width)), F.lit(bins - 1))).otherwise(0)
    return df.filter(F.col(value).isNotNull()).groupBy(place.cast("int").alias("bin"), *by).agg(F.count(F.lit(1)).alias("n"))


def axis_limits(df: DataFrame, triangular: bool = False) -> DataFrame:
    """Least start and greatest end of both axes; triangular plots take the greater of the two starts."""
    df = renamed(df)
    pick = F.greatest if triangular else F.least
    return df.agg(pick(F.min("q_st"), F.min("r_st")).alias("axis_min"), F.greatest(F.max("q_en"), F.max("r_en")).alias("axis_max"))


def quantiles(df: DataFrame, at: list[float], value: str) -> DataFrame:
    """Exact quantiles with linear interpolation, one row each: ``pos``, ``value``. No rows where there are no values.

    Nulls and NaN are no values; infinities are the least and the greatest ones, and between two that differ in sign
    there is NaN. Ranges of values for :func:`.ranges.rank_selection` are sketched while the plan is made.
    """
    return rank_selection(df, at, value)


def row_label(n: Column) -> Column:
    """Number of rows, in thousands above a million."""
    return F.when(n > 1_000_000, F.concat(F.format_number(n / 1000, 0), F.lit("k"))).otherwise(n.cast("string"))


def overlapping(beds: DataFrame, chrom: str, low: int, high: int) -> DataFrame:
    """Annotations of a chromosome that touch the closed interval."""
    return beds.filter((F.col("chrom") == chrom) & (F.col("end") >= low) & (F.col("start") <= high))


def overlap_join(beds: DataFrame, regions: DataFrame, width: int = 100_000) -> DataFrame:
    """Annotations with every region of their chromosome that they touch (closed intervals).

    Both sides are cut into cells of ``width``; each pair is kept in the cell
    where the later of the two begins, so an ordinary equi-join finds it once.
    """
    def cells(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))))

    a = cells(beds, "start", "end")
    b = cells(regions.select(F.col("chrom"), F.col("region_start"), F.col("region_end")), "region_start", "region_end")
    joined = a.join(b, ["chrom", "__cell"]).filter((F.col("end") >= F.col("region_start")) & (F.col("start") <= F.col("region_end")))
    return joined.filter(F.col("__cell") == F.floor(F.greatest("start", "region_start") / width)).drop("__cell")


def triangle(df: DataFrame) -> DataFrame:
    """Coordinates turned by 45 degrees for triangular plots."""
    df = renamed(df)
    return df.withColumns({"x": (F.col("q_st") + F.col("r_st")) / 2, "y": (F.col("r_st") - F.col("q_st")) / 2})
