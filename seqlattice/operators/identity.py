"""Containment joins of window sketches and the identity that they imply.

Windows are taken in blocks of ``CHUNK`` consecutive ones. All pairs of windows of
two blocks are counted together, as a *cell*: numpy multiplies the blocks'
incidence matrices (or expands the few common hashes), so a tandem array, whose
hashes lie in every window, costs a matrix product and not a row for each common
hash. A cell has at most ``CHUNK`` windows a side, so what one call holds is
bounded by the options of a run, and cells spread over all tasks.

Which cells there are: within a sequence of up to ``FEW`` blocks all of them;
otherwise those whose blocks have a hash in common, found by joining *postings*
(a hash and the windows of one block that have it, ``CHUNK`` at most) on the hash.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kmers import CHUNK as LETTERS
from ..functions.kmers import M32, ambiguous_hashes, batch_hashes, hash_sets, no_key_twice, placed_keys, sketched, slices, window_sketches

# Executors need not have the library installed: functions are shipped with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Windows of a block.
CHUNK = 128
#: Sequences of up to so many blocks are compared block by block, longer ones through postings.
FEW = 16
#: Columns that hold the bases: whole sequences (``seq``), or pieces that overlap by k - 1 with their place and the sequence's length.
PIECE = ("seq", "piece", "off", "length")
#: Bits of the filter of one side's hashes: a fixed size, whatever the side has.
FILTER_BITS = 1 << 24
#: Pairs that are expanded at once, and hashes of one matrix product; results do not depend on them.
EXPANDED, SLAB = 1 << 21, 4096


def sketches(seqs: DataFrame, window: int, k: int, delta: float = 0.0, sparsity: int = 1, ambiguous: bool = False) -> DataFrame:
    """The columns of ``seqs`` but ``seq``, ``w, h, size``: distinct kept hashes of each (widened) window and how many it has."""
    found = window_sketches(seqs, window, k, delta, sparsity, ambiguous).withColumn("hs", F.concat("core", "rim")).drop("core", "rim")
    return found.withColumns({"size": F.size("hs"), "h": F.explode("hs")}).drop("hs")


def similarity(containment: Column, k: int) -> Column:
    """Identity in 0..1 of a containment."""
    return F.pow(containment, F.lit(1.0 / k))


# Counting in a cell


def common(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], na: int, nb: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Common hashes of each pair of windows of two sides, as two matrices: A's unwidened with B's widened windows, and the reverse.

    A side is given by its entries: window (below ``na`` or ``nb``), hash number (below ``hashes``) and whether the unwidened window has it.
    """
    (aw, ah, ac), (bw, bh, bc) = a, b
    p, q = np.bincount(ah, minlength=hashes), np.bincount(bh, minlength=hashes)
    both = (p > 0) & (q > 0)
    ab, ba = np.zeros((2, na * nb))
    if not both.any():
        return ab.reshape(na, nb), ba.reshape(na, nb)
    number = np.cumsum(both) - 1
    keep = both[ah]
    aw, ah, ac = aw[keep], number[ah[keep]], ac[keep]
    keep = both[bh]
    bw, bh, bc = bw[keep], number[bh[keep]], bc[keep]
    p, q = p[both], q[both]
    pairs = p.astype(np.int64) * q
    if pairs.sum() < min(64 * len(pairs), EXPANDED):  # few windows a hash: every entry of A meets the run of B's with its hash
        order = np.argsort(bh, kind="stable")
        bw, bc, first = bw[order], bc[order], np.cumsum(q) - q
        n = q[ah]
        x = np.repeat(np.arange(len(ah)), n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[ah], n)
        cell = aw[x] * nb + bw[y]
        ab, ba = np.bincount(cell, ac[x], na * nb), np.bincount(cell, bc[y], na * nb)
        return ab.reshape(na, nb), ba.reshape(na, nb)
    ab, ba = np.zeros((2, na, nb), np.float32)  # counts stay below 2**24
    a_order, b_order = np.argsort(ah, kind="stable"), np.argsort(bh, kind="stable")
    a_at, b_at = np.append(0, np.cumsum(p)), np.append(0, np.cumsum(q))
    for low in range(0, len(p), SLAB):
        high = min(low + SLAB, len(p))
        matrices = []
        for w, h, c, order, at, n in ((aw, ah, ac, a_order, a_at, na), (bw, bh, bc, b_order, b_at, nb)):
            own = order[at[low] : at[high]]
            wide, core = np.zeros((2, n, high - low), np.float32)
            wide[w[own], h[own] - low] = 1
            core[w[own], h[own] - low] = c[own]
            matrices += [wide, core]
        ab += matrices[1] @ matrices[2].T
        ba += matrices[0] @ matrices[3].T
    return ab, ba


def _flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All values of lists and the number of the list of each."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return whole.flatten(), np.repeat(np.arange(len(sizes)), sizes)


def _rows(table: pa.Table, keys: list[str], i: np.ndarray, j: np.ndarray, ab: np.ndarray, ba: np.ndarray, a: np.ndarray, b: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> pa.Table:
    """Pairs of windows with common hashes, ``ab`` at least, of which ``keep`` says those that count."""
    x, y = np.nonzero(ab)
    if keep:
        kept = keep(i[x], j[y])
        x, y = x[kept], y[kept]
    same = pa.array(np.zeros(len(x), np.int64))
    columns = {k: table[k].combine_chunks().take(same) for k in keys}
    values = {"i": i[x], "j": j[y], "ab": ab[x, y], "a": a[x], "ba": ba[x, y], "b": b[y]}
    return pa.table(columns | {k: pa.array(v.astype(np.int64)) for k, v in values.items()})


def _counted(cells: DataFrame, keys: list[str], count: Callable[[pa.Table], pa.Table]) -> DataFrame:
    fields = [*(cells.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("i", "j", "ab", "a", "ba", "b"))]
    # Cells cost more than their bytes: they are dealt to as many tasks as shuffles have, and not joined into few.
    dealt = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__a", "__b")
    return dealt.groupBy(*keys, "__a", "__b").applyInArrow(count, T.StructType(fields))


def _from_windows(keys: list[str], diagonal: bool) -> Callable[[pa.Table], pa.Table]:
    """Count a cell of one sequence from its windows' hashes; with ``diagonal`` windows with hashes meet themselves, too."""
    chunk, keep = CHUNK, np.less_equal if diagonal else np.less

    def count(table: pa.Table) -> pa.Table:
        w = table["w"].to_numpy()
        core, core_row = _flat(table["core"])
        rim, rim_row = _flat(table["rim"])
        hashes, h = np.unique(np.concatenate([core.to_numpy(), rim.to_numpy()]), return_inverse=True)
        row, is_core = np.concatenate([core_row, rim_row]), np.repeat([1, 0], [len(core_row), len(rim_row)])
        size, sides = np.bincount(core_row, minlength=len(w)), []
        for block in (table["__a"][0].as_py(), table["__b"][0].as_py()):
            own = np.flatnonzero(w // chunk == block)
            place = np.full(len(w), -1)
            place[own] = np.arange(len(own))
            mine = place[row] >= 0
            sides.append(((place[row[mine]], h[mine], is_core[mine]), own))
        (a, i), (b, j) = sides
        ab, ba = common(a, b, len(i), len(j), len(hashes))
        if diagonal and table["__a"][0] == table["__b"][0]:  # a window without hashes of its own does not, whatever its widened form has
            ab[np.diag_indices(len(i))] = ba[np.diag_indices(len(i))] = size[i]
        return _rows(table, keys, w[i], w[j], ab, ba, size[i], size[j], keep)

    return count


def _from_postings(keys: list[str], order: bool) -> Callable[[pa.Table], pa.Table]:
    """Count a cell from the postings of its hashes: ``xs`` and ``ys`` are windows (``w, core, size``) of the two sides."""

    def count(table: pa.Table) -> pa.Table:
        sides = []
        for name in ("xs", "ys"):
            entries, h = _flat(table[name])
            w, core, size = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("w", "core", "size"))
            windows, first, place = np.unique(w, return_index=True, return_inverse=True)
            sides.append(((place, h, core), windows, size[first]))
        (a, i, na), (b, j, nb) = sides
        ab, ba = common(a, b, len(i), len(j), table.num_rows)
        return _rows(table, keys, i, j, ab, ba, na, nb, np.less if order else None)

    return count


# Whole sequences in one call


def _window_keys(pieces: pa.Array, n: np.ndarray, window: np.ndarray, sparsity: np.ndarray, k: int, delta: float, hashes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the windows of whole sequences, with the windows of all sequences numbered on: window, hash, whether the
    unwidened window has it; and each sequence's first window, with the end."""
    h, row, at = hashes
    keep = h % sparsity[row] == 0
    h, row, at = h[keep], row[keep], at[keep]
    full = np.maximum(0, (n - (2 * window - k + 1)) // window + 1)
    first = np.append(0, np.cumsum(full + 2))
    found = placed_keys(h, at, n[row], window[row], k, delta, first[row])
    return found >> 33, found >> 1 & M32, 1 - (found & 1), first


def _within(layers: int, k: int, identity: float, delta: float, ambiguous: bool, diagonal: bool) -> Callable:
    """Pairs of windows of sequences of one piece, for each of their (window, sparsity), all counted where they are hashed."""
    dropped = np.array([] if ambiguous else ambiguous_hashes(k), np.int32)
    least = (identity / 100.0) ** k * (1 - 1e-9)  # what is far below the threshold stays here; the threshold itself is applied to columns
    names = ["layer", "i", "j", "ab", "a", "ba", "b"]

    def counted(piece: pa.Array, n: np.ndarray, window: np.ndarray, sparsity: np.ndarray, hashes: tuple) -> list[np.ndarray]:
        """``row, i, j, ab, a, ba, b``."""
        w, h, core, first = _window_keys(piece, n, window, sparsity, k, delta, hashes)
        size = np.bincount(w[core == 1], minlength=first[-1])
        row = np.searchsorted(first, w, "right") - 1
        key = row << 32 | h
        order = np.argsort(key, kind="stable")  # by sequence and hash, then by window
        w, core, row, key = w[order], core[order], row[order], key[order]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        end = np.append(np.flatnonzero(new), len(key))[1:][run] if len(key) else run
        later = end - np.arange(len(key)) - 1  # windows with the hash after this one
        pairs = np.bincount(row, later, len(piece))
        dense = pairs > 8 * np.maximum(n, 64)
        later[dense[row]] = 0
        x = np.repeat(np.arange(len(key)), later)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
        parts = []
        if len(x):
            side = np.diff(first)
            base = np.append(0, np.cumsum(np.where(dense | (pairs == 0), 0, side * side)))
            r = row[x]
            cell = base[r] + (w[x] - first[r]) * side[r] + (w[y] - first[r])
            if base[-1] > 4 * len(x) + (1 << 20):
                cells, cell = np.unique(cell, return_inverse=True)
            else:
                cells = np.arange(base[-1])
            ab, ba = np.bincount(cell, core[x], len(cells)), np.bincount(cell, core[y], len(cells))
            met = np.flatnonzero(ab > 0)
            r = np.searchsorted(base, cells[met], "right") - 1
            place = cells[met] - base[r]
            parts.append((r, first[r] + place // side[r], first[r] + place % side[r], ab[met], ba[met]))
        for r in np.flatnonzero(dense):  # hashes that lie in many windows: products of matrices, block by block
            mine = slice(*np.searchsorted(row, [r, r + 1]))
            own, c, h_no = w[mine] - first[r], core[mine], np.cumsum(new[mine]) - 1
            blocks = own // CHUNK
            for a in np.unique(blocks):
                for b in np.unique(blocks[blocks >= a]):
                    sides = [(own[blocks == z] - z * CHUNK, h_no[blocks == z], c[blocks == z]) for z in (a, b)]
                    ab, ba = common(*sides, CHUNK, CHUNK, int(h_no[-1]) + 1)
                    i, j = np.nonzero(ab)
                    i, j, ab, ba = i + a * CHUNK, j + b * CHUNK, ab[i, j], ba[i, j]
                    up = i < j
                    parts.append((np.full(up.sum(), r), first[r] + i[up], first[r] + j[up], ab[up], ba[up]))
        r, i, j, ab, ba = (np.concatenate([np.zeros(0, np.int64), *(p[z] for p in parts)]).astype(np.int64) for z in range(5))
        kept = ab >= least * size[i]
        r, i, j, ab, ba = (z[kept] for z in (r, i, j, ab, ba))
        if diagonal:
            own = np.flatnonzero(size > 0)
            r, i, j, ab, ba = (np.concatenate(z) for z in ((r, np.searchsorted(first, own, "right") - 1), (i, own), (j, own), (ab, size[own]), (ba, size[own])))
        return [r, i - first[r], j - first[r], ab, size[i], ba, size[j]]

    @F.arrow_udf("array<struct<layer:int,i:bigint,j:bigint,ab:bigint,a:bigint,ba:bigint,b:bigint>>")
    def pairs(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo, hi in slices(batch[0]):
                piece, n, sizes = (x.slice(lo, hi - lo) for x in batch)
                n = n.to_numpy(zero_copy_only=False).astype(np.int64)
                h, row, at = batch_hashes(piece, k)
                kept = ~np.isin(h, dropped)
                hashes, flat, found = (h[kept], row[kept], at[kept]), sizes.flatten(), []
                for layer in range(layers):
                    window, sparsity = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64)[layer::layers] for c in ("window", "sparsity"))
                    r, *rest = counted(piece, n, window, sparsity, hashes)
                    found.append((r, np.full(len(r), layer), *rest))
                r, *columns = (np.concatenate(z) for z in zip(*found, strict=True))
                order = np.argsort(r, kind="stable")
                values = [pa.array(c[order], pa.int32() if name == "layer" else pa.int64()) for name, c in zip(names, columns, strict=True)]
                yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(r, minlength=hi - lo))), pa.int32()), pa.StructArray.from_arrays(values, names))

    return pairs


def _placed(layers: int, k: int, delta: float, ambiguous: bool, bits: np.ndarray | None, spark) -> Callable:
    """The windows of sequences of one piece, for each of their (window, sparsity), with ``size`` and, given ``bits``, only the hashes
    that the other side may hold; windows that are left with none are not made."""
    dropped = np.array([] if ambiguous else ambiguous_hashes(k), np.int32)
    shipped = None if bits is None else spark.sparkContext.broadcast(bits)

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values.astype(np.uint32).view(np.int32)))

    def windows(piece: pa.Array, n: np.ndarray, window: np.ndarray, sparsity: np.ndarray, hashes: tuple, layer: int) -> tuple[np.ndarray, pa.Array]:
        """The sequence of each window, and the windows."""
        w, h, core, first = _window_keys(piece, n, window, sparsity, k, delta, hashes)
        size = np.bincount(w[core == 1], minlength=first[-1])
        if shipped is not None:
            keep = held(shipped.value, h)
            w, h, core = w[keep], h[keep], core[keep]
        order = np.argsort(w, kind="stable")
        w, h, core = w[order], h[order], core[order] == 1
        own, total = np.unique(w, return_counts=True)
        cores = np.bincount(w[core], minlength=first[-1])[own]
        row = np.searchsorted(first, own, "right") - 1
        values = [pa.array(np.full(len(own), layer), pa.int32()), pa.array(own - first[row], pa.int64()), lists(h[core], cores), lists(h[~core], total - cores), pa.array(size[own], pa.int32())]
        return row, pa.StructArray.from_arrays(values, ["layer", "w", "core", "rim", "size"])

    @F.arrow_udf("array<struct<layer:int,w:bigint,core:array<int>,rim:array<int>,size:int>>")
    def placed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo, hi in slices(batch[0]):
                piece, n, sizes = (x.slice(lo, hi - lo) for x in batch)
                n = n.to_numpy(zero_copy_only=False).astype(np.int64)
                h, row, at = batch_hashes(piece, k)
                kept = ~np.isin(h, dropped)
                hashes, flat, found = (h[kept], row[kept], at[kept]), sizes.flatten(), []
                for layer in range(layers):
                    window, sparsity = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64)[layer::layers] for c in ("window", "sparsity"))
                    found.append(windows(piece, n, window, sparsity, hashes, layer))
                row, made = np.concatenate([r for r, _ in found]), pa.concat_arrays([x for _, x in found])
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=hi - lo)))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made.take(pa.array(np.argsort(row, kind="stable"))))

    return placed


def _sides(seqs: DataFrame, windows: list[int | str], sparsities: list[int | str], k: int, delta: float, ambiguous: bool) -> Callable[[np.ndarray | None], DataFrame]:
    """Sketches of one side, ``layer, w, core, rim, size`` beside the columns of ``seqs``, by the :func:`bitmap` of the other, if any.

    Hashes of sequences of one piece that the bitmap does not have stay in the task that makes them. Longer sequences, and all
    where keys repeat, are first put together by window.
    """
    as_long = lambda x: (F.col(x) if isinstance(x, str) else F.lit(x)).cast("long")
    sizes = F.array(*(F.struct(as_long(w).alias("window"), as_long(s).alias("sparsity")) for w, s in zip(windows, sparsities, strict=True)))
    keys = [c for c in seqs.columns if c not in PIECE]
    one, rest = _parted(seqs, keys, k, F.lit(True))

    def side(bits: np.ndarray | None) -> DataFrame:
        far = sketched(rest, sizes, k, delta, ambiguous).drop("__n").withColumn("size", F.size("core"))
        far = far if bits is None else _only_held(far, bits)
        if one is None:
            return far
        made = _placed(len(windows), k, delta, ambiguous, bits, seqs.sparkSession)("piece", F.col("__n") - (k - 1), sizes)
        near = one.select(*keys, made.alias("__r")).select(*keys, F.inline("__r"))
        return near.unionByName(far.select(near.columns))

    return side


def _parted(seqs: DataFrame, keys: list[str], k: int, short: Column) -> tuple[DataFrame | None, DataFrame]:
    """Sequences of one piece that are ``short``, a condition on ``__n``, as ``piece`` and ``__n``, and all others as they came. Where
    keys repeat, all are others: sequences with the same keys are one, and must be put together first."""
    if not no_key_twice(seqs, keys):
        return None, seqs
    kept = [c for c in seqs.columns if c not in PIECE]
    if "seq" not in seqs.columns:
        found = seqs.withColumn("__n", F.col("length").cast("long"))
        one = short & (F.col("off") == 0) & (F.octet_length("piece") >= F.col("__n")) & (F.col("__n") >= k)
        return found.filter(one).select(*kept, "piece", "__n"), found.filter(~one).drop("__n")
    # A generator, so that no condition is pushed below it: the expression that makes the bases would be evaluated for each use.
    found = seqs.select(*kept, F.inline(F.array(F.struct(F.col("seq"))))).withColumn("__n", F.octet_length("seq").cast("long"))
    one = short & (F.col("__n") - (k - 1) <= LETTERS)
    return found.filter(one & (F.col("__n") >= k)).select(*kept, F.upper("seq").cast("binary").alias("piece"), "__n"), found.filter(~one).drop("__n")


def _of_layers(seqs: DataFrame, keys: list[str], windows: list[int | str], sparsities: list[int | str], k: int, identity: float, delta: float, ambiguous: bool) -> DataFrame:
    """``keys, layer, i, j, identity`` for every (window, sparsity): numbers or columns of ``seqs``.

    Sequences of one piece and of up to ``FEW`` blocks are hashed and counted in one call, and nothing of them is shuffled.
    """
    as_long = lambda x: (F.col(x) if isinstance(x, str) else F.lit(x)).cast("long")
    sizes = F.array(*(F.struct(as_long(w).alias("window"), as_long(s).alias("sparsity")) for w, s in zip(windows, sparsities, strict=True)))
    most = [_blocks(F.col("__n") - (k - 1), w, k) for w in windows]
    one, rest = _parted(seqs, keys, k, (F.greatest(*most) if len(most) > 1 else most[0]) <= FEW)
    if one is not None:
        made = _within(len(windows), k, identity, delta, ambiguous, not ambiguous)("piece", F.col("__n") - (k - 1), sizes)
        met = one.select(*keys, made.alias("__r")).select(*keys, F.inline("__r"))
        near = _passing(met, k, identity).select(*keys, "layer", "i", "j", "identity")
    found = sketched(rest, sizes, k, delta, ambiguous)
    window = F.get(F.array(*(as_long(w) for w in windows)), F.col("layer"))
    found = found.withColumn("__w", window).withColumn("__blocks", _blocks(F.col("__n") - (k - 1), "__w", k)).drop("__w")
    far = _self_pairs(found, [*keys, "layer"], k, identity, not ambiguous)
    return far if one is None else near.unionByName(far)


# Postings


def _postings(sketched: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys, h``, the block and, as ``name``, the block's windows that have the hash (``CHUNK`` at most): ``w``, ``core`` (1 if the
    unwidened window has it) and ``size`` (of the unwidened window)."""
    mark = lambda c, v: F.transform(c, lambda h: F.struct(h.alias("h"), F.lit(v).alias("core")))
    size = F.col("size") if "size" in sketched.columns else F.size("core")
    df = sketched.select(*keys, "w", size.alias("__size"), F.explode(F.concat(mark("core", 1), mark("rim", 0))).alias("__e"))
    entry = F.struct("w", F.col("__e.core").alias("core"), F.col("__size").alias("size"))
    block = F.floor(F.col("w") / CHUNK).alias("__block")
    return df.groupBy(*keys, F.col("__e.h").alias("h"), block).agg(F.collect_list(entry).alias(name))


def bitmap(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each value of the low bits of column ``h``; the driver receives ``bits / 64`` rows at most."""
    low = F.col("h").cast("long").bitwiseAND(bits - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int"))
    out = np.zeros(bits // 64, np.int64)
    for r in hashes.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        out[r.word] = r.bits
    return out


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the side behind a :func:`bitmap`; all that are in it, and few others."""
    low = h.astype(np.int64) & (len(bits) * 64 - 1)
    return (bits[low >> 6] >> (low & 63)) & 1 == 1


def _only_held(sketched: DataFrame, bits: np.ndarray) -> DataFrame:
    """Sketches with ``size`` and only the hashes that the other side may hold; windows that are left with none go."""
    shipped = sketched.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("array<int>")
    def kept(hs: pa.Array) -> pa.Array:
        values, row = _flat(hs)
        values = values.to_numpy()
        keep = held(shipped.value, values)
        ends = np.append(0, np.cumsum(np.bincount(row[keep], minlength=len(hs))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[keep], pa.int32()))

    out = sketched.withColumns({"core": kept("core"), "rim": kept("rim")})
    return out.filter((F.size("core") > 0) | (F.size("rim") > 0))


# Joins


def self_identity(seqs: DataFrame, window: int | str, k: int = 21, identity: float = 86.0, delta: float = 0.5, sparsity: int | str = 1, ambiguous: bool = False) -> DataFrame:
    """Pairs of windows of each sequence, ``i <= j``, with identity at or above the threshold: the columns of ``seqs`` but
    ``seq``, ``i``, ``j`` and ``identity``.

    ``window`` and ``sparsity`` are numbers or columns of ``seqs``, so sequences of any lengths share one plan. The
    containment of the lower window alone must reach the threshold; the value is that of the greater containment of
    the two directions. Both directions of all pairs of a cell are counted at once.
    """
    keys = [c for c in seqs.columns if c not in PIECE]
    pairs = _of_layers(seqs, keys, [window], [sparsity], k, identity, delta, ambiguous).drop("layer")
    if not ambiguous:
        return pairs
    lengths = seqs.select(*keys, _n_kmers(seqs, k).alias("__n"))  # empty windows count as equal to themselves
    return pairs.unionByName(_diagonal(_every_window(lengths if "seq" in seqs.columns else lengths.distinct(), window, k), keys))


def layered_identity(seqs: DataFrame, layers: list[tuple[int, int]], k: int = 21, identity: float = 86.0, delta: float = 0.5, ambiguous: bool = False) -> DataFrame:
    """:func:`self_identity` for several (window, sparsity) at once, with ``layer`` and ``window``; sequences are hashed once for all of them."""
    own = [c for c in seqs.columns if c not in PIECE]
    keys = [*own, "layer", "window"]
    pairs = _of_layers(seqs, own, [w for w, _ in layers], [s for _, s in layers], k, identity, delta, ambiguous)
    pairs = pairs.withColumn("window", _layer_window(layers)).select(*keys, "i", "j", "identity")
    if not ambiguous:
        return pairs
    numbered = seqs.select(*own, _n_kmers(seqs, k).alias("__n"))
    numbered = (numbered if "seq" in seqs.columns else numbered.distinct()).withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(len(layers) - 1))))
    return pairs.unionByName(_diagonal(_every_window(numbered.withColumn("window", _layer_window(layers)), "window", k), keys))


def _layer_window(layers: list[tuple[int, int]]) -> Column:
    return F.get(F.array(*(F.lit(w) for w, _ in layers)), F.col("layer"))


def _n_kmers(seqs: DataFrame, k: int) -> Column:
    n = F.octet_length("seq").cast("long") if "seq" in seqs.columns else F.col("length")
    return n - (k - 1)


def _diagonal(windows: DataFrame, keys: list[str]) -> DataFrame:
    return windows.select(*keys, F.col("w").alias("i"), F.col("w").alias("j"), F.lit(100.0).alias("identity"))


def _self_pairs(found: DataFrame, keys: list[str], k: int, identity: float, diagonal: bool) -> DataFrame:
    """Pairs ``i < j`` of the windows of sketches that carry ``__blocks``, the number of blocks of their sequence; with ``diagonal``
    also ``i = j`` of windows that have hashes. Short and long sequences part before they are hashed, so each is hashed once.
    """
    few = found.filter(F.col("__blocks") <= FEW).withColumn("__own", F.floor(F.col("w") / CHUNK).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda t: F.struct(F.least(t, "__own").alias("__a"), F.greatest(t, "__own").alias("__b")))
    few = few.select(*keys, "w", "core", "rim", F.inline(cells))
    counted = _counted(few, keys, _from_windows(keys, diagonal))
    # Long sequences: cells of blocks that share a hash. Both sides are the same postings, shuffled by hash once.
    long = found.filter(F.col("__blocks") > FEW)
    side = lambda block, name: _postings(long, keys, "xs").withColumnsRenamed({"__block": block, "xs": name})
    met = side("__a", "xs").join(side("__b", "ys"), [*keys, "h"]).filter("__a <= __b")
    met = met.filter((F.col("__a") < F.col("__b")) | (F.size("xs") > 1))
    counted = counted.unionByName(_counted(met.select(*keys, "__a", "__b", "xs", "ys"), keys, _from_postings(keys, order=True)))
    pairs = _passing(counted, k, identity).select(*keys, "i", "j", "identity")
    return pairs.unionByName(_diagonal(long.filter(F.size("core") > 0), keys)) if diagonal else pairs


def _last_window(n: Column, window: int | str, k: int) -> tuple[Column, Column]:
    """Full windows after the first of a sequence of ``n`` k-mers, and whether a rest follows them; ``window`` may be a column."""
    w = (F.col(window) if isinstance(window, str) else F.lit(window)).cast("long")
    full = F.greatest(F.lit(0).cast("long"), F.floor((n - (2 * w - k + 1)) / w) + 1)
    return full, (w - k + 1) + full * w <= n - 2


def _blocks(n: Column, window: int | str, k: int) -> Column:
    full, rest = _last_window(n, window, k)
    return F.floor((full + rest.cast("long")) / CHUNK).cast("int") + 1


def _every_window(lengths: DataFrame, window: int | str, k: int) -> DataFrame:
    """All unwidened windows of each sequence of ``__n`` k-mers; ``window`` may be a column."""
    full, rest = _last_window(F.col("__n"), window, k)
    return lengths.filter("__n > 0").withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), full + rest.cast("long"))))


def _passing(counted: DataFrame, k: int, identity: float) -> DataFrame:
    ca = F.try_divide(F.col("ab"), F.col("a"))
    cb = F.coalesce(F.try_divide(F.col("ba"), F.col("b")), F.lit(0.0))
    kept = counted.filter((F.col("ab") > 0) & (similarity(ca, k) >= identity / 100.0))
    return kept.withColumn("identity", similarity(F.greatest(ca, cb), k) * 100.0)


def pair_identity(query: DataFrame, reference: DataFrame, window: int | str, k: int = 21, identity: float = 86.0, delta: float = 0.5, sparsity: int | str = 1, ambiguous: bool = False, on: tuple[str, ...] = (), only: Column | None = None, prune: bool = True) -> DataFrame:
    """Pairs of windows of different sequences: ``q_id, i, r_id, j, identity``.

    The containment of the reference's window must reach the threshold. All
    sequences of one side meet all of the other through the hashes they share;
    no pair without a common hash is ever formed. Each side is hashed once, one
    join of postings finds the cells, and both directions are counted in them.
    Columns ``on`` must agree; ``only`` is a further condition on the columns of
    both sides, which are named with ``q_`` and ``r_`` and kept. With ``prune``
    the reference is hashed ahead, while the plan is made, for a bitmap of fixed
    size, and hashes of the query that it cannot hold never leave their task.
    """
    q, r = (_sides(s, [window], [sparsity], k, delta, ambiguous) for s in (query, reference))
    return _pairs_between(q, r, k, identity, on, only, prune)


def layered_pair_identity(query: DataFrame, reference: DataFrame, layers: list[tuple[int, int]], k: int = 21, identity: float = 86.0, delta: float = 0.5, ambiguous: bool = False, prune: bool = True) -> DataFrame:
    """:func:`pair_identity` for several (window, sparsity) at once, with ``layer`` and ``window``; each side is hashed once for all of them."""
    q, r = (_sides(s, [w for w, _ in layers], [p for _, p in layers], k, delta, ambiguous) for s in (query, reference))
    return _pairs_between(q, r, k, identity, ("layer",), None, prune).withColumn("window", _layer_window(layers))


def _pairs_between(query: Callable, reference: Callable, k: int, identity: float, on: tuple[str, ...], only: Column | None, prune: bool) -> DataFrame:
    """Pairs of two :func:`_sides`."""
    r = reference(None)
    q = query(bitmap(r.select(F.explode(F.concat("core", "rim")).alias("h"))) if prune else None)
    if "layer" not in on:
        q, r = q.drop("layer"), r.drop("layer")
    q_names, r_names = ({c: f"{p}_{'id' if c == 'seq_id' else c}" for c in s.columns if c not in ("w", "core", "rim", "size", *on)} for s, p in ((q, "q"), (r, "r")))
    keys = [*on, *q_names.values(), *r_names.values()]
    # A is the reference's window, B the query's.
    a = _postings(r.withColumnsRenamed(r_names), [*on, *r_names.values()], "xs").withColumnRenamed("__block", "__a")
    b = _postings(q.withColumnsRenamed(q_names), [*on, *q_names.values()], "ys").withColumnRenamed("__block", "__b")
    met = a.join(b, ["h", *on])
    met = met if only is None else met.filter(only)
    counted = _counted(met.select(*keys, "__a", "__b", "xs", "ys"), keys, _from_postings(keys, order=False))
    found = _passing(counted, k, identity)
    return found.select(*on, *q_names.values(), F.col("j").alias("i"), *r_names.values(), F.col("i").alias("j"), "identity")


def symmetric_containment(a: Column, b: Column) -> Column:
    """Common hashes of two set columns by the size of the greater; 0 for two empty sets."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def set_containment(a: DataFrame, b: DataFrame, k: int, sparsity: int = 1, prune: bool = True) -> DataFrame:
    """Common hashes of whole sequences: ``a_id, b_id, common, a_size, b_size`` for pairs that share one.

    The sets are made in the function that hashes; with ``prune`` only hashes that side ``b`` may hold are shuffled.
    """
    b_sets = hash_sets(b, k, sparsity)
    shipped = a.sparkSession.sparkContext.broadcast(bitmap(b_sets.select(F.explode("hs").alias("h")))) if prune else None
    a_sets = hash_sets(a, k, sparsity, held=(lambda h: held(shipped.value, h)) if prune else None)
    sides = []
    for name, found in (("a", a_sets), ("b", b_sets)):
        sides.append(found.select(F.col("seq_id").alias(f"{name}_id"), F.col("n").alias(f"{name}_size"), F.explode("hs").alias("h")))
    met = sides[0].join(sides[1], "h")
    return met.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("common"), F.max("a_size").alias("a_size"), F.max("b_size").alias("b_size"))


def bedpe(pairs: DataFrame, window: int | Column, query_name: Column, reference_name: Column, query_offset: int | Column = 1, reference_offset: int | Column = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pair table in genome coordinates: 1-based starts, closed ends, the last window not cut; columns ``keep`` come first."""
    i, j = F.col("i") * window + query_offset, F.col("j") * window + reference_offset
    return pairs.select(
        *keep,
        query_name.alias("query_name"), i.alias("query_start"), (i + (window - 1)).alias("query_end"),
        reference_name.alias("reference_name"), j.alias("reference_start"), (j + (window - 1)).alias("reference_end"),
        F.col("identity").alias("perID_by_events"),
    )


def bins_pixels(pairs: DataFrame, n_x: int, n_y: int, window: int, x_name: str, y_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Contact-map layout: bins (0-based, half-open; once for a self map) and pixels with the identity as value."""
    spark = pairs.sparkSession

    def side(n: int, name: str) -> DataFrame:
        return spark.range(n).select(F.lit(name).alias("chrom"), (F.col("id") * window).alias("start"), ((F.col("id") + 1) * window).alias("end"))

    bins = side(n_x, x_name) if y_name is None else side(n_x, x_name).unionByName(side(n_y, y_name))
    return bins, pixels(pairs, 0 if y_name is None else n_x)


def pixels(pairs: DataFrame, shift: int | Column = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of a contact map; columns of a second sequence follow the first one's ``shift`` bins."""
    return pairs.select(*keep, F.col("i").alias("bin1_id"), (F.col("j") + shift).alias("bin2_id"), F.col("identity").alias("count"))
