"""Values cut into ranges that hold about as many rows each, so that order can be had without sorting everything in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values.
CELLS = 2048


def splitters(df: DataFrame, value: str, cells: int = CELLS) -> list[float]:
    """Values that cut the column into ranges of about equal numbers of rows: ``cells - 1`` at most, whatever the table holds.

    They come from a mergeable sketch of all values, so neither outliers nor ties concentrate rows: a value of many rows
    has a range of its own, and only rows of equal value cannot be cut.
    """
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / cells for i in range(1, cells)], 8 * cells).alias("at")).first().at
    return sorted({x for x in found or [] if x == x and abs(x) != float("inf")})


def placed(df: DataFrame, value: str, at: list[float], out: str = "__cell") -> DataFrame:
    """``df`` with the number of the range of each value (a double that is not NaN), by binary search."""
    if not at:
        return df.withColumn(out, F.lit(0))
    bounds = [float("-inf"), *at, float("inf")]
    return Bucketizer(splits=bounds, inputCol=value, outputCol=out, handleInvalid="keep").transform(df).withColumn(out, F.col(out).cast("int"))


def rank_selection(df: DataFrame, at: list[float], value: str, cells: int = CELLS) -> DataFrame:
    """Values at the places ``q * (rows - 1)`` of the order, interpolated: ``pos, value``.

    All rows are counted by range; only the ranges that hold a place that is asked for are then grouped by value and
    sorted, each by itself.
    """
    df = df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    found = placed(df, "v", splitters(df, "v", cells))
    totals = found.groupBy("__cell").agg(F.count(F.lit(1)).alias("c"))  # ``cells`` rows at most
    running = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__cell", "c", F.coalesce(F.sum("c").over(running), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy()).alias("n"))
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    wanted = F.array(*(F.struct(F.lit(i).alias("pos"), place(q).alias("p")) for i, q in enumerate(at)))
    inside = lambda p: (p >= F.col("base")) & (p < F.col("base") + F.col("c"))
    met = totals.withColumn("wanted", F.filter(wanted, lambda x: inside(F.floor(x["p"])) | inside(F.ceil(x["p"])))).filter(F.size("wanted") > 0)
    near = found.join(F.broadcast(met.select("__cell", "base", "wanted")), "__cell")  # ``cells`` rows at most
    counted = near.groupBy("__cell", "v").agg(F.count(F.lit(1)).alias("c"), F.first("base").alias("base"), F.first("wanted").alias("wanted"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("__cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.select("v", "c", "wanted", (F.col("base") + before).alias("first"))
    holds = lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("c"))
    hit = ranked.select("v", F.explode(F.transform("wanted", lambda x: F.struct(x["pos"].alias("pos"), x["p"].alias("p"), holds(F.floor(x["p"])).alias("low"), holds(F.ceil(x["p"])).alias("high")))).alias("x")).filter("x.low or x.high")
    both = hit.groupBy("x.pos", "x.p").agg(F.max(F.when(F.col("x.low"), F.col("v"))).alias("a"), F.max(F.when(F.col("x.high"), F.col("v"))).alias("b"))
    part = F.col("p") - F.floor("p")
    return both.select("pos", F.when((part == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("value"))


def numbered(df: DataFrame, value: Column, ties: list[str], out: str = "place", cells: int = CELLS) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of a number (nulls last) and then of columns ``ties``.

    Rows are sorted within ranges of the number only; a range's first place follows from how many rows others hold.
    """
    found = df.withColumn("__v", F.coalesce(value.cast("double"), F.lit(float("inf"))))
    found = placed(found, "__v", splitters(found, "__v", cells))
    totals = found.groupBy("__cell").agg(F.count(F.lit(1)).alias("__c"))  # ``cells`` rows at most
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__cell", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__cell").orderBy("__v", *ties)) - 1
    return found.withColumn("__n", within).join(F.broadcast(bases), "__cell").withColumn(out, F.col("__base") + F.col("__n")).drop("__cell", "__v", "__n", "__base")


def as_of(edges: DataFrame, points: DataFrame, edge: str, point: str, carry: str, cells: int = CELLS) -> DataFrame:
    """``points`` with ``prev`` and ``next``: the last edge at or before each point and the first one at or after it, as structs of
    the place (``at``) and column ``carry`` (the least of edges at one place); null where there is none.

    Both sides are cut into the same ranges and merged there in order; what a range needs from others is the last edge
    before it and the first one after it, found over one row a range.
    """
    keep = points.columns
    e = edges.select(F.col(edge).cast("double").alias("__at"), F.struct(F.col(edge).alias("at"), F.col(carry).alias(carry)).alias("__edge")).filter("__at is not null")
    e = e.groupBy("__at").agg(F.min("__edge").alias("__edge"))
    p = points.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__row"), F.col(f"`{point}`").cast("double").alias("__at"))
    both = e.select("__at", "__edge", F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), F.lit(False).alias("__is_point"))
    both = both.unionByName(p.filter("__at is not null").select("__at", F.lit(None).cast(e.schema["__edge"].dataType).alias("__edge"), "__row", F.lit(True).alias("__is_point")))
    both = placed(both, "__at", splitters(both, "__at", cells))
    borders = both.filter("not __is_point").groupBy("__cell").agg(F.max(F.struct("__at", "__edge")).alias("last"), F.min(F.struct("__at", "__edge")).alias("first"))
    borders = both.select("__cell").distinct().join(borders, "__cell", "left")  # ``cells`` rows at most
    order = Window.orderBy("__cell")
    carried = borders.select("__cell", F.last("last.__edge", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("first.__edge", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    # Edges at the place of a point are seen from both directions. The next edge is the last one in falling order: a frame that
    # only grows costs a step a row, one that begins at each row and ends with the range costs the square of its rows.
    upward = Window.partitionBy("__cell").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy("__cell").orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, 0)
    prev, nxt = F.last("__edge", True).over(upward), F.last("__edge", True).over(downward)
    met = both.withColumns({"__prev": prev, "__next": nxt}).filter("__is_point").join(F.broadcast(carried), "__cell")  # ``cells`` rows at most
    out = met.select("__row.*", F.coalesce("__prev", "__before").alias("prev"), F.coalesce("__next", "__after").alias("next"))
    nothing = F.lit(None).cast(out.schema["prev"].dataType)
    return out.unionByName(p.filter("__at is null").select("__row.*", nothing.alias("prev"), nothing.alias("next")))
