"""Multi-resolution pyramids and the queries of their viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import layered_identity, layered_pair_identity
from .ranges import as_of


def build(seqs: DataFrame, layers: list[tuple[int, int]], other: DataFrame | None = None, **options) -> DataFrame:
    """All layers, coarsest first as level 0, with their ``window``. ``layers``: (window, sparsity), finest first.

    Sequences are hashed once, whatever the number of layers, and all layers are counted in one grouping.
    """
    made = layered_identity(seqs, layers, **options) if other is None else layered_pair_identity(seqs, other, layers, **options)
    return made.withColumn("level", F.lit(len(layers) - 1) - F.col("layer")).drop("layer")


def z_order(i: Column, j: Column) -> Column:
    """Place of a cell (coordinates below 2**31) on a curve that keeps near cells together: the bits of both, interleaved."""
    def spread(c: Column) -> Column:
        c = c.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(mask)
        return c

    return F.shiftleft(spread(i), 1).bitwiseOR(spread(j))


def masked(df: DataFrame, low: float, high: float, value: str = "identity") -> DataFrame:
    """Values outside the closed range become 0; rows stay."""
    return df.withColumn(value, F.when(F.col(value).between(low, high), F.col(value)).otherwise(0.0))


def level_of(width: Column, size: Column, layers: int) -> Column:
    """Layer for a view of some width; a width on a threshold belongs to the coarser layer."""
    level = F.lit(layers - 1)
    for i in range(layers - 1, 0, -1):
        level = F.when(width >= size / 2**i, i - 1).otherwise(level)
    return level.cast("int")


def clamped(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """A view cut to the sequence."""
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), size)
    return inside(low), inside(high)


def nearest_edges(edges: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with the index of the nearest edge (``nearest``, the lower one on ties) and of its predecessor (``before``), both 0 at the left end.

    ``edges``: ``edge`` and ``edge_index``, at any distances. Every row of ``points`` comes back, however far off; a null
    ``point`` has no nearest edge, and without edges no point has one.
    """
    met = as_of(edges, points, "edge", "point", "edge_index")
    lower, upper = F.col("point") - F.col("prev.at"), F.col("next.at") - F.col("point")
    index = F.when(upper.isNull() | (lower <= upper), F.col("prev.edge_index")).otherwise(F.col("next.edge_index"))
    out = met.withColumn("nearest", index).withColumn("before", F.when(F.col("nearest") > 0, F.col("nearest") - 1).when(F.col("nearest").isNotNull(), 0))
    return out.select(*points.columns, "before", "nearest")


def mirrored(df: DataFrame) -> DataFrame:
    """All cells of a self map, of which pairs ``i <= j`` are stored."""
    cols = df.columns
    return df.unionByName(df.filter("i <> j").select(*(F.col({"i": "j", "j": "i"}.get(c, c)).alias(c) for c in cols)))


def crop(df: DataFrame, x: tuple[int, int], y: tuple[int, int], own: bool = False) -> DataFrame:
    """Cells inside a view given by edges, ends excluded, widened to a square at its upper ends. A self map (``own``) is mirrored first."""
    side = max(x[1] - x[0], y[1] - y[0])
    inside = lambda c, low: (F.col(c) >= low) & (F.col(c) < low + side)
    if not own:
        return df.filter(inside("i", y[0]) & inside("j", x[0]))
    near = (inside("i", y[0]) & inside("j", x[0])) | (inside("j", y[0]) & inside("i", x[0]))
    return mirrored(df.filter(near)).filter(inside("i", y[0]) & inside("j", x[0]))


def dense(df: DataFrame, x: tuple[int, int], y: tuple[int, int], value: str = "identity") -> DataFrame:
    """A view as a matrix, zeros included: a row for each ``i`` of ``y`` (from its first place, its end excluded) with an array of the values of ``x``.

    Only a row's stored cells move; the array is filled where the row is. Of cells stored twice the greater value counts;
    cells outside the view are ignored. The array of a row is as long as the view is wide.
    """
    seen = df.filter(F.col("i").between(y[0], y[1] - 1) & F.col("j").between(x[0], x[1] - 1))
    best = seen.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.max(value).alias("v"))
    rows = best.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    axis = df.sparkSession.range(y[0], y[1]).withColumnRenamed("id", "i")
    places = F.sequence(F.lit(x[0]).cast("long"), F.lit(x[1] - 1).cast("long")) if x[1] > x[0] else F.array().cast("array<long>")
    filled = F.transform(places, lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    return axis.join(rows, "i", "left").select("i", filled.alias("cells"))


def shown(layers: DataFrame, title: str, level: int) -> DataFrame:
    """The layer of one plot; both filters prune partitions of a saved pyramid."""
    return layers.filter((F.col("title") == title) & (F.col("level") == level))


def axis_edges(size: int, n: int, loaded: bool = False) -> list[float]:
    """Edges of ``n`` windows: evenly spaced, or in whole steps with the size at the end for maps that were loaded."""
    if loaded:
        return [i * round(size / n) for i in range(n)] + [size]
    return [i * size / n for i in range(n + 1)]


def is_blank(df: DataFrame, value: str = "identity") -> bool:
    """True if no cell has a value above 0."""
    return df.filter(F.col(value) > 0).isEmpty()


def least_positive(df: DataFrame, row: int = 0, value: str = "identity") -> DataFrame:
    """Least value above 0 of a row of the map."""
    return df.filter((F.col("i") == row) & (F.col(value) > 0)).agg(F.min(value).alias("least"))
