"""Scalar expressions on names, regions and coordinates, and palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the form of names that carry a region.
REGION = r"^([a-zA-Z0-9_]+)(?::(\d+-\d+))+"


DEFAULT = "Spectral_11"
#: Families of two-sided palettes, and the default one.
DIVERGING = ("BrBG", "PRGn", "PiYG", "PuOr", "RdBu", "RdGy", "RdYlBu", "RdYlGn", "Spectral")
BUILT_IN = {DEFAULT: ("#9e0142", "#d53e4f", "#f46d43", "#fdae61", "#fee08b", "#ffffbf", "#e6f598", "#abdda4", "#66c2a5", "#3288bd", "#5e4fa2")}
MOST_PREFIX_LENGTHS = 64


def region(name: Column) -> Column:
    """``chrom``, ``start``, ``end`` of a name that begins with ``chrom:lo-hi[:lo-hi...]``; the last interval counts. Null otherwise."""
    last = F.element_at(F.regexp_extract_all(name, F.lit(r"(\d+)-(\d+)"), F.lit(0)), -1)
    parts = F.struct(
        F.regexp_extract(name, REGION, 1).alias("chrom"),
        F.split_part(last, F.lit("-"), F.lit(1)).cast("long").alias("start"),
        F.split_part(last, F.lit("-"), F.lit(2)).cast("long").alias("end"),
    )
    return F.when(name.rlike(REGION), parts)


def stem(name: Column) -> Column:
    return F.split_part(name, F.lit(":"), F.lit(1))


def scaled(value: Column, last: Column) -> Column:
    """A coordinate in thousands, millions or billions, by the last coordinate of its axis."""
    return F.when(last < 200_000, value / 1e3).when(last > 200_000_000, value / 1e9).otherwise(value / 1e6)


def unit(longest: Column) -> Column:
    return F.when(longest < 200_000, "Kbp").when(longest < 200_000_000, "Mbp").otherwise("Gbp")


def interval_label(name: Column, low: Column, high: Column, value: Column) -> Column:
    return F.format_string("%s: %d-%d Identity: %.2f", name, low, high, value)


def last_with_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each prefix the last name, by ``ord``, that begins with it."""
    lengths = [r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().limit(MOST_PREFIX_LENGTHS + 1).collect()]
    if len(lengths) > MOST_PREFIX_LENGTHS:
        raise ValueError("too many lengths of prefixes")
    begun = names.select("name", "ord", F.explode(F.array_distinct(F.array(*(F.substring("name", 1, n) for n in sorted(lengths) or [0])))).alias("prefix"))
    return begun.join(prefixes.distinct(), "prefix").groupBy("prefix").agg(F.max_by("name", "ord").alias("name"))


def resolve_palette(name: str = DEFAULT, orientation: str = "+", colors: tuple[str, ...] = (), palettes: dict[str, tuple[str, ...]] | None = None) -> tuple[str, ...]:
    """Hex colours from low to high. ``colors`` given outright win; a diverging palette (a fixed list of names) is turned
    round, so that its warm end is high; an unknown name gives the default palette turned round."""
    if colors:
        return tuple(colors)
    known = BUILT_IN | (palettes or {})
    if name not in known:
        return BUILT_IN[DEFAULT][::-1]
    turned = (orientation == "-") != (name.split("_")[0] in DIVERGING)
    return tuple(known[name][::-1] if turned else known[name])


def gradient(colors: tuple[str, ...]) -> list[tuple[float, str]]:
    """Evenly spaced stops of a colour scale, white first."""
    shades = ["#ffffff", *colors]
    rgb = lambda c: ", ".join(str(int(c.lstrip("#")[i : i + 2], 16)) for i in (0, 2, 4))
    return [(i / (len(shades) - 1), f"rgb({rgb(c)})") for i, c in enumerate(shades)]


def gradient_range(identity: float, low: float | None = None, high: float | None = None) -> tuple[float, float]:
    """Values at the ends of the scale: those of the slider if it rescales, else from the threshold to 100."""
    return (identity, 100.0) if low is None or high is None else (low, high)
