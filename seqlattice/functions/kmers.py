"""k-mers of sequences, their canonical hash, and the sketch filters."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors need not have the library installed: functions are shipped with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bases in one piece of a sequence; pieces overlap by k - 1.
CHUNK = 65536
AMBIGUOUS = "RYMKSWHBVDN"
#: Bases that a function hashes at once, or one piece: what a Python worker holds follows from this, not from the rows of a batch.
BASES = 1 << 18

M32 = 0xFFFFFFFF
C1, C2 = 0xCC9E2D51, 0x1B873593
F1, F2 = 0x85EBCA6B, 0xC2B2AE35


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & M32


def _fmix(h: int) -> int:
    h = (h ^ h >> 16) * F1 & M32
    h = (h ^ h >> 13) * F2 & M32
    return h ^ h >> 16


def _unfmix(h: int) -> int:
    h = (h ^ h >> 16) * pow(F2, -1, 1 << 32) & M32
    h = (h ^ h >> 13 ^ h >> 26) * pow(F1, -1, 1 << 32) & M32
    return h ^ h >> 16


def murmur3_int(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit, signed, on the driver."""
    h, n = seed, len(data)
    for i in range(0, n - n % 4, 4):
        h ^= _rotl(int.from_bytes(data[i : i + 4], "little") * C1 & M32, 15) * C2 & M32
        h = (_rotl(h, 13) * 5 + 0xE6546B64) & M32
    if n % 4:
        h ^= _rotl(int.from_bytes(data[n - n % 4 :], "little") * C1 & M32, 15) * C2 & M32
    h = _fmix(h ^ n)
    return h - (1 << 32) if h >> 31 else h


def _zero_seed() -> int:
    """The int that Spark's ``hash`` maps to 0, so that it seeds what follows with 0."""
    h = _unfmix(0) ^ 4  # state after the only block
    h = (h - 0xE6546B64) * pow(5, -1, 1 << 32) & M32
    k = _rotl(h, 19) ^ 42
    k = _rotl(k * pow(C2, -1, 1 << 32) & M32, 17) * pow(C1, -1, 1 << 32) & M32
    return k - (1 << 32) if k >> 31 else k


ZERO_SEED = _zero_seed()


def _mul(a: Column, b: int) -> Column:
    """Product modulo 2**32 of unsigned 32-bit values held as longs, without overflow."""
    return (((a.bitwiseAND(0xFFFF)) * F.lit(b)) + F.shiftleft((F.shiftright(a, 16) * F.lit(b)).bitwiseAND(0xFFFF), 16)).bitwiseAND(M32)


def with_murmur3(df: DataFrame, col: str, k: int, out: str) -> DataFrame:
    """Add the signed MurmurHash3 (x86, 32 bits, seed 0) of a binary column of length ``k``.

    Spark's own ``hash`` is this function on whole 4-byte blocks, with a seed
    that an earlier argument can set. For a rest of 1 to 3 bytes its final mix
    is undone, the rest is mixed in as the specification has it, and the final
    mix is applied again. Everything stays in generated code.
    """
    whole, rest = k - k % 4, k % 4
    if not rest:
        return df.withColumn(out, F.hash(F.lit(ZERO_SEED), F.col(col)))
    unsigned = F.hash(F.lit(ZERO_SEED), F.substring(col, 1, whole)).cast("long").bitwiseAND(M32) if whole else F.lit(_fmix(0)).cast("long")
    t, steps = F.col("__t"), []
    steps.append(unsigned)
    # undo the final mix
    steps.append(_mul(t.bitwiseXOR(F.shiftright(t, 16)), pow(F2, -1, 1 << 32)))
    steps.append(_mul(t.bitwiseXOR(F.shiftright(t, 13)).bitwiseXOR(F.shiftright(t, 26)), pow(F1, -1, 1 << 32)))
    # the rest of the bytes
    tail = sum((F.shiftleft(F.ascii(F.substring(col, whole + i + 1, 1).cast("string")).cast("long"), 8 * i) for i in range(1, rest)), F.ascii(F.substring(col, whole + 1, 1).cast("string")).cast("long"))
    mixed = _mul(tail, C1)
    state = t.bitwiseXOR(F.shiftright(t, 16)).bitwiseXOR(whole)
    df = df.withColumn("__t", steps[0])
    for step in steps[1:]:
        df = df.withColumn("__t", step)
    df = df.withColumns({"__t": state, "__m": mixed})
    m = F.col("__m")
    df = df.withColumn("__m", _mul(F.shiftleft(m, 15).bitwiseOR(F.shiftright(m, 17)).bitwiseAND(M32), C2))
    df = df.withColumn("__t", t.bitwiseXOR(F.col("__m")).bitwiseXOR(k))
    df = df.withColumn("__t", _mul(t.bitwiseXOR(F.shiftright(t, 16)), F1))
    df = df.withColumn("__t", _mul(t.bitwiseXOR(F.shiftright(t, 13)), F2))
    df = df.withColumn("__t", t.bitwiseXOR(F.shiftright(t, 16)))
    return df.withColumn(out, F.when(t > 0x7FFFFFFF, t - (1 << 32)).otherwise(t).cast("int")).drop("__t", "__m")


def reverse_complement(bases: Column) -> Column:
    """Reverse a string of bases and swap A with T and C with G; other characters stay."""
    return F.translate(F.reverse(bases), "ACGT", "TGCA")


def chunked(seqs: DataFrame, k: int, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """Pieces of upper-cased sequences with their offset, so that no long string is cut many times."""
    data = F.upper(F.col(seq)).cast("binary")
    n = F.octet_length("__d").cast("long")
    df = seqs.withColumn("__d", data).withColumn("n", n)
    df = df.withColumn("off", F.explode(F.when(F.col("n") >= k, F.sequence(F.lit(0).cast("long"), F.col("n") - k, F.lit(chunk).cast("long")))))
    piece = F.substring(F.col("__d"), (F.col("off") + 1).cast("int"), F.lit(chunk + k - 1))
    return df.withColumn("piece", piece).drop("__d", seq)


def kmers(seqs: DataFrame, k: int, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """All k-mers: the columns of ``seqs`` but ``seq``, ``n`` (length), ``idx``, ``fwd`` and ``rev`` (binary).

    Reverse complements are cut from the reverse complement of the piece.
    """
    df = chunked(seqs, k, seq, chunk).withColumn("other", reverse_complement(F.col("piece").cast("string")).cast("binary"))
    df = df.withColumn("len", F.octet_length("piece"))
    df = df.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("len") - k)))
    cut = lambda c, start: F.substring(F.col(c), start, F.lit(k))
    return df.withColumns({"idx": F.col("off") + F.col("at"), "fwd": cut("piece", F.col("at") + 1), "rev": cut("other", F.col("len") - F.col("at") - k + 1)}).drop("piece", "other", "len", "at", "off")


def ambiguous_hashes(k: int) -> list[int]:
    """Hashes of the runs of one ambiguity letter."""
    return [murmur3_int(letter.encode() * k) for letter in AMBIGUOUS]


def canonical_hashes(data: bytes, k: int) -> np.ndarray:
    """Signed canonical hash of every k-mer of upper-cased bases, computed for all positions at once."""
    bases = np.frombuffer(data, np.uint8)
    n = len(bases) - k + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    swap = np.arange(256, dtype=np.uint8)
    swap[list(b"ACGT")] = list(b"TGCA")
    return np.minimum(_all_hashes(bases, k, n), _all_hashes(swap[bases[::-1]], k, n)[::-1])


def _all_hashes(bases: np.ndarray, k: int, n: int) -> np.ndarray:
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    wide = bases.astype(np.uint32)
    h = np.zeros(n, np.uint32)
    if k >= 4:
        words = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
        words = turn(words * np.uint32(C1), 15) * np.uint32(C2)
        for i in range(0, k - 3, 4):
            h = turn(h ^ words[i : i + n], 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = k % 4
    if rest:
        tail = np.zeros(n, np.uint32)
        for i in range(rest):
            tail |= wide[k - rest + i : k - rest + i + n] << np.uint32(8 * i)
        h ^= turn(tail * np.uint32(C1), 15) * np.uint32(C2)
    h ^= np.uint32(k)
    h = (h ^ h >> np.uint32(16)) * np.uint32(F1)
    h = (h ^ h >> np.uint32(13)) * np.uint32(F2)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def slices(pieces: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, end) with at most ``BASES`` bytes, of one row at least."""
    ends = np.cumsum(pa.compute.binary_length(pieces).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = done = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, done + BASES, "right")))
        yield at, end
        at, done = end, int(ends[end - 1])


def batch_hashes(pieces: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The canonical hash of every k-mer of every piece, with its row and place; pieces are hashed at once, end to end."""
    sizes = pa.compute.binary_length(pieces).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.maximum(sizes - (k - 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = canonical_hashes(b"".join(p.as_py() or b"" for p in pieces), k)
    return h[at + (np.cumsum(sizes) - sizes)[row]] if len(row) else h[:0], row, at


def _lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """A list for each row, of values in the order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))), pa.int32()), pa.array(values, kind))


def hashed_kmers(seqs: DataFrame, k: int, sparsity: int = 1, ambiguous: bool = False, seq: str = "seq") -> DataFrame:
    """``idx`` and canonical hash ``h`` of every k-mer that the sketch keeps.

    Pieces of sequence are hashed in an Arrow function, ``BASES`` at once: column
    expressions for the same hash need a method beyond what the JVM compiles.
    The modulus and the ambiguity letters are applied before rows are made.
    """
    dropped = np.array([] if ambiguous else ambiguous_hashes(k), np.int32)

    @F.arrow_udf("array<bigint>")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pieces in batches:
            for lo, hi in slices(pieces):
                h, row, at = batch_hashes(pieces.slice(lo, hi - lo), k)
                keep = (h % sparsity == 0) & ~np.isin(h, dropped)
                yield _lists(at[keep] << 32 | h[keep].view(np.uint32).astype(np.int64), row[keep], hi - lo, pa.int64())

    df = chunked(seqs, k, seq).withColumn("__p", F.explode(kept("piece")))
    low = F.col("__p").bitwiseAND(M32)
    h = F.when(low > 0x7FFFFFFF, low - (1 << 32)).otherwise(low).cast("int")
    return df.withColumns({"idx": F.col("off") + F.shiftright("__p", 32), "h": h}).drop("piece", "off", "__p")


def placed_sums(k: int, period: int) -> Callable:
    """For each piece and its offset: number ``m`` of k-mers, the sum of their canonical hashes, and ``placed``, the sum of hash times place modulo ``period``."""

    @F.arrow_udf("struct<m:bigint,hash_sum:bigint,placed:bigint>")
    def sums(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pieces, offs in batches:
            for lo, hi in slices(pieces):
                some = pieces.slice(lo, hi - lo)
                sizes = pa.compute.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
                h = canonical_hashes(b"".join(some.to_pylist()), k).astype(np.int64)
                first, m = np.cumsum(sizes) - sizes, np.maximum(sizes - (k - 1), 0)
                turn = (offs.slice(lo, hi - lo).to_numpy(zero_copy_only=False) - first) % period  # place less position, end to end
                place = (np.arange(len(h), dtype=np.uint32) + np.repeat(turn.astype(np.uint32), sizes)[: len(h)]) % np.uint32(period)
                first, end = np.minimum(first, len(h)), np.minimum(first + m, len(h))
                both = [np.append(0, np.cumsum(x)) for x in (h, h * place)]  # wraps at most, and differences wrap back
                yield pa.StructArray.from_arrays([pa.array(m), *(pa.array(x[end] - x[first]) for x in both)], ["m", "hash_sum", "placed"])

    return sums


def window_bounds(n: int, window: int, k: int, delta: float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`seqlattice.operators.windows.bounds` for window numbers of one sequence of ``n`` k-mers."""
    d, first = window * delta, window - k + 1
    full = np.maximum(0, (n - (2 * window - k + 1)) // window + 1)
    begin = first + (w - 1) * window
    low = np.where(w == 0, 0, np.maximum(np.rint(begin + 1 - d), 0))
    high = np.where(w == 0, np.rint(first + d), np.where(w <= full, np.rint(begin + window + 1 + d), n))
    return low, np.minimum(high, n), (w >= 0) & ((w <= full) | ((w == full + 1) & (begin <= n - 2)))


def _piece_windows(piece: bytes, off: int, n: int, layers: list[tuple[int, int]], k: int, delta: float, dropped: np.ndarray) -> list[np.ndarray]:
    """For each (window, sparsity), distinct ``w << 33 | hash << 1 | outside`` of a piece: ``outside`` is 0 where a place in the
    unwidened window has the hash. The piece is hashed once."""
    h = canonical_hashes(piece, k)
    kept = ~np.isin(h, dropped)
    return [_placed(h, np.flatnonzero((h % sparsity == 0) & kept), off, n, window, k, delta) for window, sparsity in layers]


def _placed(h: np.ndarray, at: np.ndarray, off: int, n: int, window: int, k: int, delta: float) -> np.ndarray:
    return placed_keys(h[at], at + off, n, window, k, delta)


def placed_keys(h: np.ndarray, at: np.ndarray, n: int | np.ndarray, window: int | np.ndarray, k: int, delta: float, first: int | np.ndarray = 0) -> np.ndarray:
    """Distinct ``w << 33 | hash << 1 | outside`` of hashes at places; ``n``, ``window`` and ``first`` (added to ``w``) may differ from hash to hash."""
    low32 = h.view(np.uint32).astype(np.int64) << 1
    centre = (at - (window - k + 2)) // window + 1
    reach, keys = (math.ceil(delta) + 1 if delta else 0), []
    for step in range(-reach, reach + 1):
        w = centre + step
        low, high, real = window_bounds(n, window, k, delta, w)
        inside = real & (at >= low) & (at < high)
        outside = np.ones(len(at), np.int64)
        if not step:
            low, high, real = window_bounds(n, window, k, 0.0, w)
            outside = (~(real & (at >= low) & (at < high))).astype(np.int64)
        keys.append((w + first << 33 | low32 | outside)[inside])
    found = np.sort(np.concatenate(keys))
    return found[np.append(True, found[1:] >> 1 != found[:-1] >> 1)] if len(found) else found


def _window_arrays(found: list[list[np.ndarray]]) -> pa.Array:
    """Lists of ``layer, w, core, rim``, one list a piece."""
    rows, layers, windows, parts = [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], {0: [np.zeros(0, np.int32)], 1: [np.zeros(0, np.int32)]}
    sizes = {0: [np.zeros(0, np.int64)], 1: [np.zeros(0, np.int64)]}
    for piece in found:
        rows.append(rows[-1])
        for layer, keys in enumerate(piece):
            w, place = np.unique(keys >> 33, return_inverse=True)
            rows[-1] += len(w)
            windows.append(w)
            layers.append(np.full(len(w), layer, np.int32))
            h, outside = (keys >> 1 & M32).astype(np.uint32).view(np.int32), keys & 1
            for side in (0, 1):
                parts[side].append(h[outside == side])
                sizes[side].append(np.bincount(place[outside == side], minlength=len(w)))
    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes[side]))), pa.int32()), pa.array(np.concatenate(parts[side]))) for side in (0, 1)]
    columns = [pa.array(np.concatenate(layers)), pa.array(np.concatenate(windows)), *lists]
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(columns, ["layer", "w", "core", "rim"]))


def window_sketches(seqs: DataFrame, window: int | str, k: int, delta: float = 0.0, sparsity: int | str = 1, ambiguous: bool = False, seq: str = "seq", lengths: bool = False) -> DataFrame:
    """The columns of ``seqs`` but ``seq``, and for each window that has any ``w``, ``core`` and ``rim``: the distinct
    kept hashes of the window, and those that only its widened form has.

    Each sequence is hashed once, whatever is made of it. ``window`` and ``sparsity`` are numbers or columns. Rows leave
    the Arrow function as one for each window and piece of a sequence; they are brought together by window, and hold
    as many hashes as a widened window has at most. With ``lengths`` the sequence's length comes as ``__n``.

    Instead of ``seq`` there may be ``piece``, ``off`` and ``length``: pieces that overlap by ``k - 1``.
    """
    value = lambda x: (F.col(x) if isinstance(x, str) else F.lit(x)).cast("long")
    return sketched(seqs, F.array(F.struct(value(window).alias("window"), value(sparsity).alias("sparsity"))), k, delta, ambiguous, seq).drop("layer", *([] if lengths else ["__n"]))


def layered_sketches(seqs: DataFrame, layers: list[tuple[int, int]], k: int, delta: float = 0.0, ambiguous: bool = False, seq: str = "seq") -> DataFrame:
    """:func:`window_sketches` for several (window, sparsity) at once, with ``layer``, the place in the list, and the sequence's length ``__n``. All layers come from one hashing."""
    sizes = F.array(*(F.struct(F.lit(w).cast("long").alias("window"), F.lit(s).cast("long").alias("sparsity")) for w, s in layers))
    return sketched(seqs, sizes, k, delta, ambiguous, seq)


def sketched(seqs: DataFrame, sizes: Column, k: int, delta: float, ambiguous: bool, seq: str = "seq") -> DataFrame:
    """:func:`layered_sketches` for sizes in a column, an array of ``window, sparsity``."""
    dropped = np.array([] if ambiguous else ambiguous_hashes(k), np.int32)

    @F.arrow_udf("array<struct<layer:int,w:bigint,core:array<int>,rim:array<int>>>")
    def placed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo, hi in slices(batch[0]):
                piece, *rest = (x.slice(lo, hi - lo) for x in batch)
                rows = zip(piece, *(x.to_pylist() for x in rest), strict=True)
                yield _window_arrays([_piece_windows(p.as_py(), o, m, [(x["window"], x["sparsity"]) for x in z], k, delta, dropped) for p, o, m, z in rows])

    keys = [c for c in seqs.columns if c != seq]
    if seq in seqs.columns:
        df = chunked(seqs.withColumns({"__n": F.octet_length(seq).cast("long"), "__z": sizes}), k, seq)
    else:  # pieces already
        keys = [c for c in keys if c not in ("piece", "off", "length")]
        df = seqs.withColumns({"__n": F.col("length"), "__z": sizes})
    keys.append("__n")
    made = placed("piece", "off", F.col("__n") - (k - 1), "__z")
    # Exploded at once where that plans; over ready pieces the planner loses a column unless the lists stand in one first.
    lists = df.select(*keys, F.explode(made).alias("__r")) if seq in seqs.columns else df.select(*keys, made.alias("__r")).select(*keys, F.explode("__r").alias("__r"))
    df = lists.select(*keys, "__r.*")
    both = df.groupBy(*keys, "layer", "w").agg(F.collect_list(F.struct("core", "rim")).alias("__p"))
    whole = lambda name: F.when(F.size("__p") == 1, F.get("__p", 0)[name]).otherwise(F.array_distinct(F.flatten(F.transform("__p", lambda p: p[name]))))
    out = both.select(*keys, "layer", "w", whole("core").alias("core"), whole("rim").alias("rim"), (F.size("__p") > 1).alias("__many"))
    return out.withColumn("rim", F.when(F.col("__many"), F.array_except("rim", "core")).otherwise(F.col("rim"))).drop("__many")


def no_key_twice(seqs: DataFrame, keys: list[str]) -> bool:
    """True if no two sequences have the same ``keys``: then what one piece holds of a sequence is all there is, and needs no grouping.

    Only the keys are read where the table's format allows it; of sequences in pieces, the first piece counts.
    """
    first = seqs.filter("off = 0") if "off" in seqs.columns else seqs
    return first.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").isEmpty()


def _pieces(n: Column, k: int) -> Column:
    return F.ceil((n - (k - 1)) / CHUNK)


def _distinct(k: int, sparsity: int, ambiguous: bool, held: Callable[[np.ndarray], np.ndarray] | None = None) -> Callable:
    """For each piece, one row or none: number and sum of places of the kept k-mers, number of distinct hashes, and these hashes; with ``held`` only those that it says."""
    dropped = np.array([] if ambiguous else ambiguous_hashes(k), np.int32)

    @F.arrow_udf("array<struct<kept:bigint,places:bigint,n:bigint,hs:array<int>>>")
    def distinct(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pieces in batches:
            for lo, hi in slices(pieces):
                h, row, at = batch_hashes(pieces.slice(lo, hi - lo), k)
                keep = (h % sparsity == 0) & ~np.isin(h, dropped)
                h, row, at, rows = h[keep], row[keep], at[keep], hi - lo
                found = np.sort(row << 32 | h.view(np.uint32).astype(np.int64))  # numpy's unique hashes first, and is slower
                found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
                n, some = np.bincount(found >> 32, minlength=rows), np.bincount(row, minlength=rows)
                places = np.append(0, np.cumsum(at))[np.append(0, np.cumsum(some))]
                real = some > 0
                hs, of = (found & M32).astype(np.uint32).view(np.int32), found >> 32
                if held is not None:
                    mine = held(hs)
                    hs, of = hs[mine], of[mine]
                lists = _lists(hs, (np.cumsum(real) - 1)[of], int(real.sum()), pa.int32())
                columns = [pa.array(some[real], pa.int64()), pa.array(np.diff(places)[real], pa.int64()), pa.array(n[real], pa.int64()), lists]
                yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(real)), pa.int32()), pa.StructArray.from_arrays(columns, ["kept", "places", "n", "hs"]))

    return distinct


def hash_sets(seqs: DataFrame, k: int, sparsity: int = 1, ambiguous: bool = False, seq: str = "seq", held: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The columns of ``seqs`` but ``seq``, ``hs`` (distinct kept hashes) and ``n`` (how many the sequence has).

    A sequence of one piece is one row. A longer one is several, as many as it has pieces, each with the hashes of one
    residue, so no row holds more than a piece would. ``held`` says of hashes which may stay in ``hs``; sequences of one
    piece leave the others where they were made.
    """
    keys = [c for c in seqs.columns if c != seq]
    made = chunked(seqs.select(*keys, seq, _pieces(F.octet_length(seq).cast("long"), k).alias("__pieces")), k, seq)
    short = made.filter("__pieces = 1").select(*keys, F.inline(_distinct(k, sparsity, ambiguous, held)("piece"))).select(*keys, "hs", "n")
    long = made.filter("__pieces > 1").select(*keys, "__pieces", F.inline(_distinct(k, sparsity, ambiguous)("piece"))).select(*keys, "__pieces", F.explode("hs").alias("h"))
    parts = long.groupBy(*keys, F.pmod("h", "__pieces").alias("__part")).agg(F.collect_set("h").alias("hs"))
    total = parts.groupBy(*keys).agg(F.sum(F.size("hs")).alias("n"))
    return short.unionByName(parts.join(total, keys).select(*keys, "hs", "n"))


def kmer_totals(seqs: DataFrame, k: int, sparsity: int = 1, ambiguous: bool = False, seq: str = "seq") -> DataFrame:
    """The columns of ``seqs`` but ``seq``, ``kept`` k-mers, ``n_hashes`` (distinct) and ``places`` (their sum), of sequences that keep any.

    Where no sequence has the keys of another, those of one piece are counted where they are hashed, and nothing is
    shuffled for them; the hashes of longer ones meet by sequence and hash, as all do where keys repeat.
    """
    keys = [c for c in seqs.columns if c != seq]

    def met(some: DataFrame) -> DataFrame:
        return hashed_kmers(some, k, sparsity, ambiguous, seq).groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("h").alias("n_hashes"), F.sum("idx").alias("places"))

    if not no_key_twice(seqs, keys):
        return met(seqs)
    n = F.octet_length(seq).cast("long")
    short = chunked(seqs.filter(_pieces(n, k) <= 1), k, seq).select(*keys, F.inline(_distinct(k, sparsity, ambiguous)("piece")))
    return short.select(*keys, "kept", F.col("n").alias("n_hashes"), "places").unionByName(met(seqs.filter(_pieces(n, k) > 1)))
