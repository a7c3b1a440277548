"""Parameter derivation: windows, sparsity, pyramid layers, zoom levels, ticks. Plain numbers, no data."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_WINDOW = 10


def power_of_two_sparsity(ratio: int, modimizer: int) -> int:
    """Power of two at or below ``ratio``; at or above it once it exceeds the sketch size."""
    if ratio < 1:
        return 1
    return 1 << (ratio.bit_length() - 1 if ratio <= modimizer else (ratio - 1).bit_length())


def static_columns(n: Column, k: int = 21, modimizer: int = 1000, resolution: int = 1000, window: int | None = None) -> dict[str, Column]:
    """:func:`static_plan` as expressions over a column of lengths; rows whose window is too small have ``fits`` false."""
    bits = lambda x: F.length(F.bin(x))
    power = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e)
    kmers = n - (k - 1)
    w = F.lit(window).cast("long") if window else F.ceil(kmers / resolution)
    m = F.least(F.lit(modimizer), w)
    ratio = F.bround(w / m).cast("long")
    s = F.when(ratio < 1, 1).when(ratio <= m, power(bits(ratio) - 1)).otherwise(power(bits(ratio - 1)))
    return {"window": w, "sparsity": s.cast("long"), "sketch": F.bround(w / s).cast("long"), "windows": F.ceil(kmers / w), "modimizer": m.cast("long"), "fits": (w >= LEAST_WINDOW) & (w >= k)}


@dataclass(frozen=True)
class WindowPlan:
    window: int
    sparsity: int
    sketch: int
    windows: int
    modimizer: int


def static_plan(n: int, k: int = 21, modimizer: int = 1000, resolution: int = 1000, window: int | None = None) -> WindowPlan:
    """Window, sparsity and expected sketch of a sequence of ``n`` bases."""
    kmers = n - k + 1
    w = window if window else math.ceil(kmers / resolution)
    if w < LEAST_WINDOW:
        raise ValueError("the window is below 10; lower the resolution")
    m = min(modimizer, w)
    s = power_of_two_sparsity(round(w / m), m)
    return WindowPlan(w, s, round(w / s), math.ceil(kmers / w), m)


def pyramid_plan(n: int, modimizer: int = 1000, resolution: int = 1000, window: int | None = None, quick: bool = False) -> list[tuple[int, int]]:
    """(window, sparsity) of each layer from the finest on; windows double."""
    largest = math.ceil(n / resolution)
    least = window or (round(n / resolution) if quick else round((n / resolution) / 2))
    if largest < LEAST_WINDOW:
        raise ValueError("the window is below 10; lower the resolution")
    windows = []
    while least <= largest:
        windows.append(least)
        least *= 2
    if not windows:
        return []
    first = 1 if windows[0] < 1000 else power_of_two_sparsity(round(windows[0] / modimizer), modimizer)
    out, s = [], first
    for i, w in enumerate(windows):
        if i:
            s = 2 * s if w > 1000 else 1
        out.append((w, s))
    return out


def halving_ladder(largest: int, layers: int) -> list[int]:
    """Sizes that start at ``largest`` and halve."""
    return [largest // 2**i for i in range(layers)]


def next_power_of_two(x: int) -> int:
    return 1 if x < 1 else 2 ** (x - 1).bit_length()


def zoom_level(width: float, size: int, layers: int) -> int:
    """Layer for a view of ``width`` bases: thresholds ``size / 2**i``; a width on one belongs to the coarser layer."""
    if layers < 2:
        return 0
    level = 0
    while level < layers - 1 and width < size / 2 ** (level + 1):
        level += 1
    return level


def level_window(largest: int, level: int) -> int:
    return largest // 2**level


def ticks(low: float, high: float, least: int = 5, most: int = 9) -> list[float]:
    """Round breaks: multiples of a power of ten times a power of two that give ``least`` to ``most`` steps."""
    spread = high - low
    if spread <= 0:
        return [low]
    decade = 10 ** math.floor(math.log10(spread))
    tenths = spread / decade  # from 1 to below 10
    if math.ceil(tenths) > most:
        twos = math.ceil(math.log2(tenths / most))
    else:  # the least number of halvings after which more than ``least - 1`` steps fit
        twos = -max(0, math.floor(math.log2((least - 1) / tenths)) + 1)
    step = decade * 2**twos if twos >= 0 else decade / 2**-twos
    first = math.floor(low / step)
    out = [(first + i) * step for i in range(math.ceil(spread / step) + 1)]
    return [int(x) if float(x).is_integer() else x for x in out]


def tick_column(low: Column, high: Column, least: int = 5, most: int = 9) -> Column:
    """:func:`ticks` as an expression."""
    spread = (high - low).cast("double")
    decade = F.pow(F.lit(10.0), F.floor(F.log10(spread)))
    tenths = spread / decade
    twos = F.when(F.ceil(tenths) > most, F.ceil(F.log2(tenths / most))).otherwise(-F.greatest(F.lit(0), F.floor(F.log2((least - 1) / tenths)) + 1))
    step = decade * F.pow(F.lit(2.0), twos)
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(spread / step)), lambda i: (F.floor(low / step) + i) * step)
    return F.when(spread > 0, many).when(spread <= 0, F.array(low.cast("double")))


def axis_unit(longest: int) -> str:
    return "Kbp" if longest < 200_000 else "Mbp" if longest < 200_000_000 else "Gbp"


def grid_size(pairs: int) -> int:
    """Number of sequences that have so many pairs."""
    n = (1 + math.isqrt(1 + 8 * pairs)) // 2
    if n * (n - 1) // 2 != pairs or pairs < 1:
        raise ValueError(f"{pairs} is not the number of pairs of a whole number of sequences")
    return n


def grid_complete(singles: int, pairs: int, most: int = 6) -> bool:
    if singles > most:
        raise ValueError(f"a grid of more than {most} sequences is not drawn")
    return singles >= 2 and pairs == singles * (singles - 1) // 2


@dataclass(frozen=True)
class IdentityQuery:
    """All options of a run; names follow the command line's long options."""

    kmer: int = 21
    modimizer: int = 1000
    resolution: int = 1000
    window: int | None = None
    identity: float = 86.0
    delta: float = 0.5
    ambiguous: bool = False
    compare: bool = False
    compare_only: bool = False
    compare_order: str = "sequential"
    region: tuple[str, ...] = ()
    quick: bool = False
    palette: str = "Spectral_11"
    palette_orientation: str = "+"
    colors: tuple[str, ...] = ()
    breakpoints: tuple[float, ...] = ()
    bin_freq: bool = False
    axes_limits: float | None = None
    axes_ticks: tuple[float, ...] = ()
    grid: bool = False
    grid_only: bool = False
    no_bedpe: bool = False
    fasta: tuple[str, ...] = ()
    load: tuple[str, ...] = ()
    bed: str | None = None
    output_dir: str | None = None

    def __post_init__(self):
        if not 0 <= self.delta <= 1:
            raise ValueError("delta lies between 0 and 1")
        if self.identity <= 0 or self.identity > 100:
            raise ValueError("identity lies above 0 and at 100 at most")
        if self.breakpoints and self.breakpoints[0] != self.identity:
            raise ValueError("the first breakpoint must equal the identity threshold")
        if self.compare and self.compare_only:
            raise ValueError("compare and compare_only exclude each other")
        if self.compare_order not in ("sequential", "size"):
            raise ValueError("compare_order is sequential or size")

    def overridden(self, options: dict) -> IdentityQuery:
        """With the recognised keys of a JSON configuration; ``color`` is another name of ``colors``. Keys that only concern drawing are ignored."""
        known = {f: f for f in self.__dataclass_fields__} | {"color": "colors"}
        values = {known[k.replace("-", "_")]: tuple(v) if isinstance(v, list) else v for k, v in options.items() if k.replace("-", "_") in known}
        return replace(self, **values)
