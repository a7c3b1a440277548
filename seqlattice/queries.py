"""Queries over the driver's tables, with their SQL.

The tables hold no sequences, so both engines derive them: letters other than
A-Z are dropped and the alphabet is folded onto the four bases.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.kmers import AMBIGUOUS, ambiguous_hashes, hashed_kmers, kmer_totals, kmers, murmur3_int, placed_sums, slices
from .operators import frames, grid, identity, pyramid, windows
from .plans import params
from .sources import readers, writers
from .streaming import clicks

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
MIXED = "ACGTNACGTRACGTNACGTNACGTYN"
W, K, DELTA, ID = 60, 12, 0.5, 86.0


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark, sf_dir: str, name: str = "documents", id_col: str = "doc_id", bases: str = BASES) -> DataFrame:
    folded = F.translate(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), ALPHABET, bases)
    return table(spark, sf_dir, name).select(F.col(id_col).alias("seq_id"), folded.alias("seq"))


def lengths(spark, sf_dir: str, k: int = K) -> DataFrame:
    return sequences(spark, sf_dir).select("seq_id", (F.octet_length("seq").cast("long") - (k - 1)).alias("n_kmers"))


def pair_table(spark, sf_dir: str) -> DataFrame:
    """A pair table made of all orders."""
    start, other = (F.col("o_orderkey") % 1000) * 100 + 1, (F.col("o_custkey") % 1000) * 100 + 1
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("query_name"), start.alias("query_start"), (start + 99).alias("query_end"),
        F.concat(F.lit("s"), F.col("o_orderkey") % 3).alias("reference_name"), other.alias("reference_start"), (other + 99).alias("reference_end"),
        (F.lit(86.0) + (F.col("o_orderkey") * 37 % 1400) / 100.0).alias("perID_by_events"),
    )


# SQL of the same inputs


def seq_sql(name: str = "documents", id_col: str = "doc_id", bases: str = BASES) -> str:
    return f"SELECT {id_col} AS seq_id, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{bases}') AS seq FROM {name}"


def kmer_sql(k: int, piece: int = 256, **source) -> str:
    """All k-mers; sequences are cut into pieces first, as a substring costs the length of what it is taken from."""
    return (
        f"SELECT seq_id, n, off + i AS idx, substr(part, i + 1, {k}) AS fwd, reverse(translate(substr(part, i + 1, {k}), 'ACGT', 'TGCA')) AS rev "
        f"FROM (SELECT seq_id, n, off, part, unnest(range(length(part) - {k - 1})) AS i FROM (SELECT seq_id, n, off, substr(seq, off + 1, {piece + k - 1}) AS part "
        f"FROM (SELECT seq_id, seq, length(seq) AS n, unnest(range(0, length(seq) - {k - 1}, {piece})) AS off FROM ({seq_sql(**source)}))))"
    )


def murmur_sql(source: str, col: str, k: int, out: str) -> str:
    """``source`` with the signed MurmurHash3 (32 bits, seed 0) of an ASCII column of length ``k``."""
    byte = lambda i: f"ord(substr({col}, {i + 1}, 1))::UBIGINT"
    m = "4294967295::UBIGINT"
    turn = lambda x, r: f"((({x} << {r}) | ({x} >> {32 - r})) & {m})"
    layer = lambda src, **cols: f"SELECT *, {', '.join(f'{v} AS {n}' for n, v in cols.items())} FROM ({src})"
    src, h = source, "0::UBIGINT"
    blocks = [(i, min(4, k - i)) for i in range(0, k, 4)]
    src = layer(src, **{f"_w{i}": "((" + " + ".join(f"{byte(i + b)} * {256**b}::UBIGINT" for b in range(n)) + f") * 3432918353::UBIGINT) & {m}" for i, n in blocks})
    src = layer(src, **{f"_k{i}": f"({turn(f'_w{i}', 15)} * 461845907::UBIGINT) & {m}" for i, _ in blocks})
    for i, n in blocks:
        src = layer(src, **{f"_x{i}": f"xor({h}, _k{i})"})
        h = f"_x{i}"
        if n == 4:
            src = layer(src, **{f"_h{i}": f"({turn(h, 13)} * 5::UBIGINT + 3864292196::UBIGINT) & {m}"})
            h = f"_h{i}"
    src = layer(src, _f0=f"xor({h}, {k}::UBIGINT)")
    src = layer(src, _f1=f"(xor(_f0, _f0 >> 16) * 2246822507::UBIGINT) & {m}")
    src = layer(src, _f2=f"(xor(_f1, _f1 >> 13) * 3266489909::UBIGINT) & {m}")
    src = layer(src, _f3="xor(_f2, _f2 >> 16)")
    return f"SELECT seq_id, n, idx, fwd, rev, {'fh, ' if out == 'rh' else ''}CASE WHEN _f3 > 2147483647 THEN _f3::BIGINT - 4294967296 ELSE _f3::BIGINT END AS {out} FROM ({src})"


def hashed_sql(k: int, sparsity: int = 1, ambiguous: bool = False, **source) -> str:
    both = murmur_sql(murmur_sql(kmer_sql(k, **source), "fwd", k, "fh"), "rev", k, "rh")
    keep = [f"h % {sparsity} = 0"] * (sparsity > 1) + [f"h NOT IN ({', '.join(map(str, ambiguous_hashes(k)))})"] * (not ambiguous)
    return f"SELECT seq_id, n, idx, h FROM (SELECT seq_id, n, idx, least(fh, rh) AS h FROM ({both}))" + (f" WHERE {' AND '.join(keep)}" if keep else "")


def window_sql(w: int, k: int, delta: float, lengths_sql: str) -> str:
    """Windows of each sequence by the rule of the slices."""
    d, first = w * delta, w - k + 1
    c = f"({first} + (w - 1) * {w})::DOUBLE"
    return (
        f"SELECT seq_id, nk, w, CASE WHEN w = 0 THEN 0 ELSE greatest(0, round_even({c} + 1 - {d}, 0)::BIGINT) END AS lo, "
        f"least(nk, CASE WHEN w = 0 THEN round_even({first + d}::DOUBLE, 0)::BIGINT WHEN w <= f THEN round_even({c} + {w} + 1 + {d}, 0)::BIGINT ELSE nk END) AS hi "
        f"FROM (SELECT *, unnest(range(f + 2)) AS w FROM (SELECT seq_id, nk, greatest(0, floor((nk - {2 * w - k + 1}) / {w}::DOUBLE)::BIGINT + 1) AS f FROM ({lengths_sql}) WHERE nk > 0)) "
        f"WHERE w <= f OR (w = f + 1 AND {c} <= nk - 2)"
    )


def len_sql(k: int, **source) -> str:
    return f"SELECT seq_id, length(seq) - {k - 1} AS nk FROM ({seq_sql(**source)})"


def sketch_sql(w: int, k: int, delta: float, km: str, wt: str) -> str:
    """Distinct hashes of each window; candidates by position, then the exact bounds."""
    reach = 1 if delta == 0 else 2
    near = f"SELECT seq_id, h, idx, unnest(range(greatest(0, floor((idx - {w - k + 2}) / {w}::DOUBLE)::BIGINT + 1 - {reach}), floor((idx - {w - k + 2}) / {w}::DOUBLE)::BIGINT + 2 + {reach})) AS w FROM {km}"
    return f"SELECT DISTINCT x.seq_id, x.w, x.h FROM ({near}) x JOIN {wt} t ON t.seq_id = x.seq_id AND t.w = x.w AND x.idx >= t.lo AND x.idx < t.hi"


PAIRS_SQL = """SELECT 's' || (o_custkey % 3) AS query_name, (o_orderkey % 1000) * 100 + 1 AS query_start, (o_orderkey % 1000) * 100 + 100 AS query_end,
 's' || (o_orderkey % 3) AS reference_name, (o_custkey % 1000) * 100 + 1 AS reference_start, (o_custkey % 1000) * 100 + 100 AS reference_end,
 86.0::DOUBLE + (o_orderkey * 37 % 1400) / 100.0::DOUBLE AS perID_by_events FROM orders"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# k-mers


@query(f"SELECT fwd AS kmer, count(*) AS n, sum(idx)::BIGINT AS places FROM ({kmer_sql(5)}) GROUP BY fwd")
def kmer_explode(spark, sf_dir):
    return kmers(sequences(spark, sf_dir), 5).groupBy(F.col("fwd").cast("string").alias("kmer")).agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("places"))


@query(f"SELECT fwd AS kmer, rev AS revcomp, count(*) AS n FROM ({kmer_sql(5, bases=MIXED)}) GROUP BY ALL")
def kmer_revcomp(spark, sf_dir):
    return kmers(sequences(spark, sf_dir, bases=MIXED), 5).groupBy(F.col("fwd").cast("string").alias("kmer"), F.col("rev").cast("string").alias("revcomp")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT h::INTEGER AS h, count(*) AS n FROM ({hashed_sql(8, ambiguous=True)}) GROUP BY h")
def kmer_canonical(spark, sf_dir):
    return hashed_kmers(sequences(spark, sf_dir), 8, ambiguous=True).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT seq_id, count(*) AS n_kmers, sum(h)::BIGINT AS hash_sum, min(h)::INTEGER AS least, max(h)::INTEGER AS greatest FROM ({hashed_sql(21, ambiguous=True)}) GROUP BY seq_id")
def kmer_murmur3(spark, sf_dir):
    return hashed_kmers(sequences(spark, sf_dir), 21, ambiguous=True).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_kmers"), F.sum("h").alias("hash_sum"), F.min("h").alias("least"), F.max("h").alias("greatest"))


@query(f"SELECT h::INTEGER AS h, count(*) AS n FROM ({hashed_sql(3, bases=MIXED)}) GROUP BY h")
def ambiguous_filter(spark, sf_dir):
    return hashed_kmers(sequences(spark, sf_dir, bases=MIXED), 3).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT letter, t.h::INTEGER AS h, count(k.h) AS n FROM (VALUES " + ", ".join(f"('{a}', {murmur3_int(a.encode() * 21)})" for a in AMBIGUOUS) + f") t(letter, h) LEFT JOIN ({hashed_sql(21, ambiguous=True, bases=MIXED)}) k ON k.h = t.h GROUP BY ALL")
def ambiguous_hashes_21(spark, sf_dir):
    """The hashes that the sketch leaves out, and how many k-mers of the documents have each."""
    letters = spark.createDataFrame(list(zip(AMBIGUOUS, ambiguous_hashes(21), strict=True)), "letter string, h int")
    met = hashed_kmers(sequences(spark, sf_dir, bases=MIXED), 21, ambiguous=True).filter(F.col("h").isin(ambiguous_hashes(21))).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return letters.join(met, "h", "left").select("letter", "h", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT seq_id, count(*) AS kept, count(DISTINCT h) AS n_hashes, sum(idx)::BIGINT AS places FROM ({hashed_sql(K, 4)}) GROUP BY seq_id")
def modimizer_filter(spark, sf_dir):
    return kmer_totals(sequences(spark, sf_dir), K, 4)


# windows


def _windows(delta: float, window: int = W):
    def run(spark, sf_dir):
        return windows.window_table(lengths(spark, sf_dir), window, K, delta).select("seq_id", "w", "lo", "hi")

    return run


for _name, _w, _d in (("windows_core", W, 0.0), ("windows_neighbor", W, DELTA), ("windows_ties", 61, DELTA)):
    QUERIES[_name] = _windows(_d, _w)
    ORACLES[_name] = f"SELECT seq_id, w, lo, hi FROM ({window_sql(_w, K, _d, len_sql(K))})"


@query(f"SELECT seq_id, max(w) AS last_window, max_by(hi - lo, w) AS last_size, max(hi) AS covered FROM ({window_sql(W, K, 0.0, len_sql(K))}) GROUP BY seq_id")
def windows_remainder(spark, sf_dir):
    t = windows.window_table(lengths(spark, sf_dir), W, K)
    return t.groupBy("seq_id").agg(F.max("w").alias("last_window"), F.max_by(F.col("hi") - F.col("lo"), "w").alias("last_size"), F.max("hi").alias("covered"))


@query(f"SELECT seq_id, count(*) AS n_kmers, sum((idx - 20) * (1 + h % 7))::BIGINT AS places FROM ({hashed_sql(K)}) WHERE idx BETWEEN 20 AND {200 - K} GROUP BY seq_id")
def region_slice(spark, sf_dir):
    cut = windows.region(hashed_kmers(sequences(spark, sf_dir), K).withColumn("n_kmers", F.col("n") - (K - 1)), 21, 200, K)
    return cut.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_kmers"), F.sum(F.col("idx") * (1 + F.col("h") % 7)).alias("places"))


def _with(k: int = K, s: int = 1, w: int = W, delta: float = DELTA, **source) -> str:
    return (
        f"km AS MATERIALIZED ({hashed_sql(k, s, **source)}), wc AS ({window_sql(w, k, 0.0, len_sql(k, **source))}), wn AS ({window_sql(w, k, delta, len_sql(k, **source))}), "
        f"a AS MATERIALIZED ({sketch_sql(w, k, 0.0, 'km', 'wc')}), b AS MATERIALIZED ({sketch_sql(w, k, delta, 'km', 'wn')}), sz AS (SELECT seq_id, w, count(*) AS size FROM a GROUP BY ALL)"
    )


@query(f"WITH {_with(s=2)} SELECT seq_id, w, size FROM sz")
def window_sketch_size(spark, sf_dir):
    return identity.sketches(sequences(spark, sf_dir), W, K, 0.0, 2).groupBy("seq_id", "w").agg(F.max("size").cast("long").alias("size"))


# identity


def entries_sql(w: int, k: int, delta: float, km: str, length: str) -> str:
    """``seq_id, w, h, core``: distinct hashes of each widened window; ``core`` is 1 where the unwidened window has it."""
    reach, d, first, c = (1 if delta == 0 else 2), w * delta, w - k + 1, f"({w - k + 1} + (w - 1) * {w})"
    # Window numbers near a place, counted from a few windows before the first so that the division never sees a negative number.
    last = f"(idx - {w - k + 2} + {w * (reach + 2)}) // {w} - 1"
    full = f"greatest(0, (nk - {2 * w - k + 1} + {2 * w}) // {w} - 1)"
    near = f"SELECT seq_id, h, idx, nk, {full} AS f, unnest(range(greatest(0, {last} - {2 * reach}), {last} + 1)) AS w FROM (SELECT seq_id, h, idx, {length} AS nk FROM {km})"
    low = f"CASE WHEN w = 0 THEN 0 ELSE greatest(0, round_even({c} + 1 - {d}, 0)) END"
    high = f"least(nk, CASE WHEN w = 0 THEN round_even({first + d}::DOUBLE, 0) WHEN w <= f THEN round_even({c} + {w} + 1 + {d}, 0) ELSE nk END)"
    inner = f"CASE WHEN w = 0 THEN idx < {first} WHEN w <= f THEN idx > {c} AND idx <= {c} + {w} ELSE idx > {c} END"
    return f"SELECT seq_id, w, h, max(({inner})::INTEGER) AS core FROM ({near}) WHERE (w <= f OR (w = f + 1 AND {c} <= nk - 2)) AND idx >= {low} AND idx < {high} GROUP BY ALL"


def _self_sql(w: int, k: int, s: int, delta: float, ident: float, **source) -> str:
    return (
        f"WITH km AS MATERIALIZED ({hashed_sql(k, s, **source)}), e AS MATERIALIZED ({entries_sql(w, k, delta, 'km', f'n - {k - 1}')}), "
        f"sz AS MATERIALIZED (SELECT seq_id, w, sum(core) AS size FROM e GROUP BY ALL HAVING sum(core) > 0), "
        f"x AS (SELECT a.seq_id, a.w AS i, b.w AS j, sum(a.core) AS ab, sum(b.core) AS ba FROM e a JOIN e b ON a.seq_id = b.seq_id AND a.h = b.h AND a.w < b.w GROUP BY ALL), "
        f"v AS (SELECT x.seq_id, i, j, ab / s.size::DOUBLE AS ca, coalesce(ba / t.size::DOUBLE, 0) AS cb FROM x JOIN sz s ON s.seq_id = x.seq_id AND s.w = i LEFT JOIN sz t ON t.seq_id = x.seq_id AND t.w = j WHERE ab > 0) "
        f"SELECT seq_id, i, j, round(pow(greatest(ca, cb), 1.0 / {k}) * 100, 6) AS identity FROM v WHERE pow(ca, 1.0 / {k}) >= {ident} / 100 "
        f"UNION ALL SELECT seq_id, w, w, 100.0 FROM sz"
    )


@query(_self_sql(W, K, 2, DELTA, ID))
def self_identity(spark, sf_dir):
    return identity.self_identity(sequences(spark, sf_dir), W, K, ID, DELTA, 2).withColumn("identity", F.round("identity", 6))


@query(_self_sql(75, 14, 1, 0.0, 90.0))
def self_identity_core(spark, sf_dir):
    return identity.self_identity(sequences(spark, sf_dir), 75, 14, 90.0, 0.0, 1).withColumn("identity", F.round("identity", 6))


def _bench(prefix: str) -> str:
    """The sketches of the benchmark's sequences under other names."""
    out = _with(21, 1, W, DELTA, name="benchmark", id_col="item_id")
    for name in ("km", "wc", "wn", "a", "b", "sz"):
        out = out.replace(f"{name} AS ", f"{prefix}{name} AS ").replace(f"FROM {name} ", f"FROM {prefix}{name} ").replace(f"FROM {name})", f"FROM {prefix}{name})").replace(f"JOIN {name} ", f"JOIN {prefix}{name} ")
    return out


@query(
    f"WITH {_with(21)}, {_bench('r')}, ab AS (SELECT b.seq_id AS q_id, b.w AS i, ra.seq_id AS r_id, ra.w AS j, count(*) AS c FROM ra JOIN b ON ra.h = b.h GROUP BY ALL), "
    f"ba AS (SELECT a.seq_id AS q_id, a.w AS i, rb.seq_id AS r_id, rb.w AS j, count(*) AS c FROM a JOIN rb ON a.h = rb.h GROUP BY ALL), "
    f"v AS (SELECT q_id, i, r_id, j, ab.c / rsz.size::DOUBLE AS ca, coalesce(ba.c / sz.size::DOUBLE, 0) AS cb FROM ab JOIN rsz ON rsz.seq_id = r_id AND rsz.w = j "
    f"LEFT JOIN ba USING (q_id, i, r_id, j) LEFT JOIN sz ON sz.seq_id = q_id AND sz.w = i) "
    f"SELECT q_id, i, r_id, j, round(pow(greatest(ca, cb), 1.0 / 21) * 100, 6) AS identity FROM v WHERE pow(ca, 1.0 / 21) >= {ID} / 100"
)
def pair_identity(spark, sf_dir):
    found = identity.pair_identity(sequences(spark, sf_dir), sequences(spark, sf_dir, "benchmark", "item_id"), W, 21, ID, DELTA)
    return found.withColumn("identity", F.round("identity", 6))


_SETS = (
    f"WITH d AS (SELECT DISTINCT seq_id, h FROM ({hashed_sql(21)})), r AS (SELECT DISTINCT seq_id, h FROM ({hashed_sql(21, name='benchmark', id_col='item_id')})), "
    "dn AS (SELECT seq_id, count(*) AS n FROM d GROUP BY ALL), rn AS (SELECT seq_id, count(*) AS n FROM r GROUP BY ALL), "
    "x AS (SELECT d.seq_id AS doc_id, r.seq_id AS item_id, count(*) AS common FROM d JOIN r USING (h) GROUP BY ALL) "
)


@query(_SETS + "SELECT doc_id, item_id, common, round(common / rn.n::DOUBLE, 6) AS containment, round(common / greatest(dn.n, rn.n)::DOUBLE, 6) AS symmetric FROM x JOIN dn ON dn.seq_id = doc_id JOIN rn ON rn.seq_id = item_id")
def doc_containment(spark, sf_dir):
    met = identity.set_containment(sequences(spark, sf_dir), sequences(spark, sf_dir, "benchmark", "item_id"), 21)
    common = F.col("common")
    return met.select(F.col("a_id").alias("doc_id"), F.col("b_id").alias("item_id"), "common", F.round(common / F.col("b_size"), 6).alias("containment"), F.round(common / F.greatest("a_size", "b_size"), 6).alias("symmetric"))


_BENCH_SETS = f"SELECT seq_id, list(DISTINCT h) AS hs FROM ({hashed_sql(8, name='benchmark', id_col='item_id')}) GROUP BY seq_id"


@query(f"WITH s AS ({_BENCH_SETS}) SELECT a.seq_id AS x, b.seq_id AS y, round(len(list_intersect(a.hs, b.hs)) / greatest(len(a.hs), len(b.hs))::DOUBLE, 6) AS symmetric FROM s a JOIN s b ON a.seq_id < b.seq_id WHERE len(list_intersect(a.hs, b.hs)) > 0")
def symmetric_containment(spark, sf_dir):
    h = hashed_kmers(sequences(spark, sf_dir, "benchmark", "item_id"), 8).select("seq_id", "h").distinct()
    h = h.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("seq_id")))
    met = h.select(F.col("seq_id").alias("x"), "h", F.col("n").alias("a")).join(h.select(F.col("seq_id").alias("y"), "h", F.col("n").alias("b")), "h").filter("x < y")
    return met.groupBy("x", "y").agg(F.round(F.count(F.lit(1)) / F.greatest(F.max("a"), F.max("b")), 6).alias("symmetric"))


_BEDPE = f"SELECT 'd' || seq_id AS query_name, i * {W} + 1 AS query_start, i * {W} + {W} AS query_end, 'd' || seq_id AS reference_name, j * {W} + 1 AS reference_start, j * {W} + {W} AS reference_end, identity AS \"perID_by_events\" FROM ({_self_sql(W, K, 2, DELTA, ID)})"


@query(_BEDPE)
def self_bedpe(spark, sf_dir):
    name = F.concat(F.lit("d"), F.col("seq_id"))
    return identity.bedpe(self_identity(spark, sf_dir), W, name, name)


# pair tables


@query(f"SELECT CASE WHEN query_name = reference_name THEN 'self' ELSE 'pairwise' END AS part, count(*) AS n, round(sum(perID_by_events), 4) AS total FROM ({PAIRS_SQL}) GROUP BY part")
def bedpe_self_split(spark, sf_dir):
    own, other = frames.split_self(pair_table(spark, sf_dir))
    both = own.withColumn("part", F.lit("self")).unionByName(other.withColumn("part", F.lit("pairwise")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("perID_by_events"), 4).alias("total"))


@query(f"SELECT count(DISTINCT query_name) AS query_names, count(DISTINCT reference_name) AS reference_names, count(*) AS n_rows FROM ({PAIRS_SQL})")
def bedpe_contract(spark, sf_dir):
    return frames.names_per_side(pair_table(spark, sf_dir))


_SHORT = f"SELECT query_name AS q, query_start AS q_st, query_end AS q_en, reference_name AS r, reference_start AS r_st, reference_end AS r_en, perID_by_events FROM ({PAIRS_SQL})"


@query(f"WITH t AS ({_SHORT}) SELECT q, q_st, q_en, r, r_st, r_en, perID_by_events AS \"perID_by_events\" FROM t UNION ALL SELECT q, r_st, r_en, r, q_st, q_en, perID_by_events FROM t WHERE q_st <> r_st OR q_en <> r_en")
def mirror_union(spark, sf_dir):
    return frames.mirrored(pair_table(spark, sf_dir))


@query(f"WITH t AS ({_SHORT}), m AS (SELECT max(q_en - q_st) AS w FROM t) SELECT q, r, q_st, r_st, round(q_st / w::DOUBLE, 6) AS first_pos, round(r_st / w::DOUBLE, 6) AS second_pos FROM t, m")
def plot_positions(spark, sf_dir):
    return frames.positions(pair_table(spark, sf_dir)).select("q", "r", "q_st", "r_st", F.round("first_pos", 6).alias("first_pos"), F.round("second_pos", 6).alias("second_pos"))


def _binned(n: int, edge: str) -> str:
    cases = " ".join(f"WHEN v <= {edge.format(i=i)} THEN {i - 1}" for i in range(1, n))
    return f"(CASE {cases} ELSE {n - 1} END)::INTEGER"


@query(f"WITH t AS (SELECT perID_by_events AS v FROM ({PAIRS_SQL})), m AS (SELECT floor(min(v)) AS lo FROM t) SELECT {_binned(11, '(lo + {i} * (100.0::DOUBLE - lo) / 11)')} AS discrete, count(*) AS n, min(v) AS least, max(v) AS greatest FROM t, m GROUP BY discrete")
def bin_equal_width(spark, sf_dir):
    return _bins(frames.discretised(pair_table(spark, sf_dir), 11))


@query(f"WITH t AS (SELECT perID_by_events AS v FROM ({PAIRS_SQL})), m AS (SELECT quantile_cont(v, [{', '.join(f'{i}/7.0::DOUBLE' for i in range(8))}]) AS e FROM t) SELECT {_binned(7, 'e[{i} + 1]')} AS discrete, count(*) AS n, min(v) AS least, max(v) AS greatest FROM t, m GROUP BY discrete")
def bin_equal_freq(spark, sf_dir):
    return _bins(frames.discretised(pair_table(spark, sf_dir), 7, by_frequency=True))


@query(f"WITH t AS (SELECT perID_by_events AS v FROM ({PAIRS_SQL})) SELECT CASE WHEN v BETWEEN 86 AND 90 THEN 0 WHEN v > 90 AND v <= 97 THEN 1 WHEN v > 97 AND v <= 100 THEN 2 END::INTEGER AS discrete, count(*) AS n, min(v) AS least, max(v) AS greatest FROM t GROUP BY discrete")
def bin_custom(spark, sf_dir):
    return _bins(frames.discretised(pair_table(spark, sf_dir), 3, breakpoints=[86, 90, 97, 100]))


def _bins(df: DataFrame) -> DataFrame:
    return df.groupBy("discrete").agg(F.count(F.lit(1)).alias("n"), F.min("perID_by_events").alias("least"), F.max("perID_by_events").alias("greatest"))


@query("SELECT (i - 1)::INTEGER AS pos, round(v[i], 6) AS value FROM (SELECT quantile_cont(l_extendedprice, [0, 0.001, 0.25, 0.5, 0.75, 1]) AS v, unnest(range(1, 7)) AS i FROM lineitem)")
def quantile_edges(spark, sf_dir):
    return frames.quantiles(table(spark, sf_dir, "lineitem"), [0.0, 0.001, 0.25, 0.5, 0.75, 1.0], "l_extendedprice").select("pos", F.round("value", 6).alias("value"))


@query("WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 300)), 299)::INTEGER AS bin, count(*) AS n FROM orders, m GROUP BY bin")
def histogram300(spark, sf_dir):
    return frames.histogram(table(spark, sf_dir, "orders"), value="o_totalprice")


@query(f"WITH t AS ({_SHORT}) SELECT 'square' AS kind, least(min(q_st), min(r_st)) AS axis_min, greatest(max(q_en), max(r_en)) AS axis_max FROM t UNION ALL SELECT 'triangle', greatest(min(q_st), min(r_st)), greatest(max(q_en), max(r_en)) FROM t")
def axis_limits(spark, sf_dir):
    t = pair_table(spark, sf_dir)
    return frames.axis_limits(t).select(F.lit("square").alias("kind"), "axis_min", "axis_max").unionByName(frames.axis_limits(t, True).select(F.lit("triangle").alias("kind"), "axis_min", "axis_max"))


def _beds(spark, sf_dir) -> DataFrame:
    start = F.col("user_id") * 37 % 50000
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), start.alias("start"), (start + F.col("event_id") % 900).alias("end"), F.col("event_id").alias("name"))


_BEDS = "SELECT event_type AS chrom, user_id * 37 % 50000 AS start, user_id * 37 % 50000 + event_id % 900 AS \"end\", event_id AS name FROM events"


@query(f"SELECT chrom, start, \"end\", name FROM ({_BEDS}) WHERE chrom = 'click' AND \"end\" >= 1000 AND start <= 9000")
def interval_filter(spark, sf_dir):
    return frames.overlapping(_beds(spark, sf_dir), "click", 1000, 9000)


@query(f"WITH g AS (SELECT DISTINCT event_type AS chrom, n_nationkey * 2000 AS region_start, n_nationkey * 2000 + 250 AS region_end FROM events, nation) SELECT chrom, region_start, count(*) AS n, min(name) AS first_name FROM ({_BEDS}) b JOIN g USING (chrom) WHERE \"end\" >= region_start AND start <= region_end GROUP BY ALL")
def interval_overlap(spark, sf_dir):
    at = F.col("n_nationkey").cast("long") * 2000
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom")).distinct().agg(F.collect_set("chrom").alias("chroms"))  # a handful of names
    regions = table(spark, sf_dir, "nation").select(at.alias("region_start"), (at + 250).alias("region_end")).join(F.broadcast(kinds)).withColumn("chrom", F.explode("chroms"))  # one row
    met = frames.overlap_join(_beds(spark, sf_dir), regions, 1000)
    return met.groupBy("chrom", "region_start").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


@query(f"WITH t AS ({_SHORT}) SELECT q, r, (q_st + r_st) / 2.0::DOUBLE AS x, (r_st - q_st) / 2.0::DOUBLE AS y, count(*) AS n FROM t GROUP BY ALL")
def triangle_coordinates(spark, sf_dir):
    return frames.triangle(pair_table(spark, sf_dir)).groupBy("q", "r", "x", "y").agg(F.count(F.lit(1)).alias("n"))


# viewer


@query(f"SELECT query_start AS i, reference_start AS j, CASE WHEN perID_by_events BETWEEN 90 AND 95 THEN perID_by_events ELSE 0 END AS identity FROM ({PAIRS_SQL})")
def threshold_mask(spark, sf_dir):
    t = pair_table(spark, sf_dir).select(F.col("query_start").alias("i"), F.col("reference_start").alias("j"), F.col("perID_by_events").alias("identity"))
    return pyramid.masked(t, 90.0, 95.0)


@query(f"SELECT i, j, count(*) AS n, max(v) AS best FROM (SELECT (query_start - 1) // 100 AS i, (reference_start - 1) // 100 AS j, perID_by_events AS v FROM ({PAIRS_SQL})) WHERE i >= 100 AND i < 400 AND j >= 50 AND j < 350 GROUP BY ALL")
def viewport_crop(spark, sf_dir):
    t = pair_table(spark, sf_dir).select(F.floor((F.col("query_start") - 1) / 100).alias("i"), F.floor((F.col("reference_start") - 1) / 100).alias("j"), F.col("perID_by_events").alias("v"))
    return pyramid.crop(t, (50, 350), (100, 300)).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("best"))


@query(f"WITH c AS (SELECT (query_start - 1) // 100 AS a, (reference_start - 1) // 100 AS b, perID_by_events AS v FROM ({PAIRS_SQL})), h AS (SELECT least(a, b) AS i, greatest(a, b) AS j, v FROM c), "
       "m AS (SELECT i, j, v FROM h UNION ALL SELECT j, i, v FROM h WHERE i <> j) SELECT i, j, count(*) AS n, max(v) AS best FROM m WHERE i >= 500 AND i < 900 AND j >= 100 AND j < 500 GROUP BY ALL")
def viewport_crop_self(spark, sf_dir):
    a, b = F.floor((F.col("query_start") - 1) / 100), F.floor((F.col("reference_start") - 1) / 100)
    t = pair_table(spark, sf_dir).select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), F.col("perID_by_events").alias("v"))
    return pyramid.crop(t, (100, 500), (500, 800), own=True).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("best"))


@query(f"WITH c AS (SELECT (query_start - 1) // 100 AS a, (reference_start - 1) // 100 AS b, perID_by_events AS v FROM ({PAIRS_SQL})), h AS (SELECT least(a, b) AS i, greatest(a, b) AS j, v FROM c), "
       "m AS (SELECT i, j, v FROM h UNION ALL SELECT j, i, v FROM h WHERE i <> j), g AS (SELECT a.i, b.j FROM (SELECT unnest(range(400, 700)) AS i) a, (SELECT unnest(range(450, 750)) AS j) b), "
       "d AS (SELECT g.i, g.j, coalesce(max(m.v), 0) AS v FROM g LEFT JOIN m ON m.i = g.i AND m.j = g.j GROUP BY ALL) "
       "SELECT i, count(*) AS n, list_sum(list(v ORDER BY j))::DOUBLE AS total, md5(array_to_string([floor(x * 100 + 0.5)::BIGINT FOR x IN list(v ORDER BY j)], ',')) AS digest FROM d GROUP BY i")
def dense_view(spark, sf_dir):
    """A view of a self map, both halves, as a matrix."""
    a, b = F.floor((F.col("query_start") - 1) / 100), F.floor((F.col("reference_start") - 1) / 100)
    cells = pair_table(spark, sf_dir).select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), F.col("perID_by_events").alias("identity"))
    view = (450, 750), (400, 700)
    rows = pyramid.dense(pyramid.crop(cells, *view, own=True), *view)
    digest = F.md5(F.array_join(F.transform("cells", lambda v: F.floor(v * 100 + 0.5).cast("string")), ","))
    return rows.select("i", F.size("cells").cast("long").alias("n"), F.aggregate("cells", F.lit(0.0), lambda s, v: s + v).alias("total"), digest.alias("digest"))


@query("WITH e AS (SELECT c_custkey * c_custkey * 3 AS edge, c_custkey AS edge_index FROM customer), p AS (SELECT o_orderkey, o_orderkey * 211 - 5000 AS point FROM orders), "
       "l AS (SELECT o_orderkey, point, e.edge AS le, e.edge_index AS li FROM p ASOF LEFT JOIN e ON p.point >= e.edge), b AS (SELECT l.*, e.edge AS ue, e.edge_index AS ui FROM l ASOF LEFT JOIN e ON l.point <= e.edge), "
       "n AS (SELECT o_orderkey, CASE WHEN ue IS NULL OR point - le <= ue - point THEN li ELSE ui END AS nearest FROM b) SELECT o_orderkey, greatest(nearest - 1, 0) AS \"before\", nearest FROM n")
def nearest_uneven(spark, sf_dir):
    """Edges that lie ever further apart, points far outside them included."""
    key = F.col("c_custkey")
    edges = table(spark, sf_dir, "customer").select((key * key * 3).alias("edge"), key.alias("edge_index"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 211 - 5000).alias("point"))
    return pyramid.nearest_edges(edges, points).drop("point")


@query("SELECT min(c_acctbal) AS least FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0")
def least_positive(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("i"), F.col("c_acctbal").alias("identity"))
    return pyramid.least_positive(cells, 3)


@query("SELECT level::INTEGER AS level, count(*) AS n, min(o_totalprice) AS least FROM (SELECT o_totalprice, CASE WHEN o_totalprice >= 200000 THEN 0 WHEN o_totalprice >= 100000 THEN 1 WHEN o_totalprice >= 50000 THEN 2 ELSE 3 END AS level FROM orders) GROUP BY level")
def zoom_level(spark, sf_dir):
    level = pyramid.level_of(F.col("o_totalprice"), F.lit(400000.0), 4)
    return table(spark, sf_dir, "orders").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"))


@query("SELECT lo, hi, count(*) AS n FROM (SELECT least(greatest(o_orderkey - 500, 0), 9000) AS lo, least(greatest(o_orderkey + 500, 0), 9000) AS hi FROM orders) GROUP BY ALL")
def viewport_clamp(spark, sf_dir):
    low, high = pyramid.clamped(F.col("o_orderkey") - 500, F.col("o_orderkey") + 500, F.lit(9000))
    return table(spark, sf_dir, "orders").groupBy(low.alias("lo"), high.alias("hi")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT n_nationkey::BIGINT * 4000 AS edge, n_nationkey AS edge_index FROM nation), p AS (SELECT DISTINCT user_id * 97 % 90000 AS point FROM events) SELECT point, greatest(arg_min(edge_index, abs(edge - point) * 100 + edge_index) - 1, 0)::INTEGER AS \"before\", arg_min(edge_index, abs(edge - point) * 100 + edge_index)::INTEGER AS nearest FROM p, e GROUP BY point")
def nearest_edge(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 4000).alias("edge"), F.col("n_nationkey").cast("int").alias("edge_index"))
    points = table(spark, sf_dir, "events").select((F.col("user_id") * 97 % 90000).alias("point")).distinct()
    return pyramid.nearest_edges(edges, points)


_LAYERS = [(60, 2), (120, 4)]


@query(" UNION ALL ".join(f"(SELECT seq_id, {level} AS level, i, j, identity FROM ({_self_sql(w, K, s, DELTA, ID)}))" for level, (w, s) in enumerate(reversed(_LAYERS))))
def pyramid_levels(spark, sf_dir):
    built = pyramid.build(sequences(spark, sf_dir), _LAYERS, k=K, identity=ID, delta=DELTA)
    return built.select("seq_id", "level", "i", "j", F.round("identity", 6).alias("identity"))


@query(f"SELECT seq_id, i AS bin1_id, j AS bin2_id, identity AS \"count\" FROM ({_self_sql(30, 8, 1, DELTA, ID, name='benchmark', id_col='item_id')})")
def bins_pixels(spark, sf_dir):
    pairs = identity.self_identity(sequences(spark, sf_dir, "benchmark", "item_id"), 30, 8, ID, DELTA)
    return identity.pixels(pairs, keep=("seq_id",)).withColumn("count", F.round("count", 6))


# grids


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("seq_id"), F.col("item_id").alias("seq_ord"))


_PAIRS = "SELECT 'b' || a.item_id AS query, 'b' || b.item_id AS reference, a.item_id AS q_ord, b.item_id AS r_ord FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id"


@query(f"SELECT query, reference, q_ord, r_ord, (row_number() OVER (ORDER BY q_ord, r_ord) - 1)::INTEGER AS upper_order, (row_number() OVER (ORDER BY r_ord, q_ord) - 1)::INTEGER AS lower_order FROM ({_PAIRS})")
def grid_order(spark, sf_dir):
    return grid.lower_order(grid.sequence_pairs(_items(spark, sf_dir)))


@query(f"WITH p AS ({_PAIRS}) SELECT item_id AS grid_row, item_id AS grid_col, 'b' || item_id AS query, 'b' || item_id AS reference, false AS transposed FROM benchmark UNION ALL SELECT r_ord, q_ord, query, reference, false FROM p UNION ALL SELECT q_ord, r_ord, query, reference, true FROM p")
def grid_cells(spark, sf_dir):
    items = _items(spark, sf_dir)
    return grid.cells(items, grid.sequence_pairs(items))


@query(f"WITH p AS ({_PAIRS}) SELECT query, reference, CASE WHEN (q_ord + r_ord) % 2 = 1 THEN reference ELSE query END AS stored_query, CASE WHEN (q_ord + r_ord) % 2 = 1 THEN query ELSE reference END AS stored_reference, (q_ord + r_ord) % 2 = 1 AS transposed FROM p")
def grid_matching(spark, sf_dir):
    pairs = grid.sequence_pairs(_items(spark, sf_dir))
    odd = (F.col("q_ord") + F.col("r_ord")) % 2 == 1
    stored = pairs.select(F.when(odd, F.col("reference")).otherwise(F.col("query")).alias("query"), F.when(odd, F.col("query")).otherwise(F.col("reference")).alias("reference"))
    return grid.matched_pairs(pairs, stored)


@query(f"SELECT seq_id, n_kmers, row_number() OVER (ORDER BY n_kmers DESC, seq_id) - 1 AS place FROM (SELECT seq_id, nk AS n_kmers FROM ({len_sql(K)}))")
def sequence_order(spark, sf_dir):
    seqs = sequences(spark, sf_dir).withColumn("n", F.octet_length("seq").cast("long")).drop("seq")
    return grid.size_places(seqs, K, ["seq_id"]).select("seq_id", "n_kmers", "place")


# scalars


_NAME = "CASE page_id % 4 WHEN 0 THEN 'chr' || page_id || ':' || page_id || '-' || (page_id + 500) WHEN 1 THEN 'c_' || page_id || ':1-9:' || page_id || '-' || (page_id * 3) || 'x' WHEN 2 THEN url ELSE 'chr' || page_id END"


@query(f"SELECT page_id, CASE WHEN ok THEN regexp_extract(name, '^([a-zA-Z0-9_]+)', 1) END AS chrom, CASE WHEN ok THEN split_part(last, '-', 1)::BIGINT ELSE -1 END AS region_start, CASE WHEN ok THEN split_part(last, '-', 2)::BIGINT ELSE -1 END AS region_end, split_part(name, ':', 1) AS stem FROM (SELECT page_id, name, regexp_matches(name, '^([a-zA-Z0-9_]+)(?::(\\d+-\\d+))+') AS ok, regexp_extract_all(name, '\\d+-\\d+')[-1] AS last FROM (SELECT page_id, {_NAME} AS name FROM pages))")
def region_parse(spark, sf_dir):
    page = F.col("page_id")
    name = (
        F.when(page % 4 == 0, F.concat(F.lit("chr"), page, F.lit(":"), page, F.lit("-"), page + 500))
        .when(page % 4 == 1, F.concat(F.lit("c_"), page, F.lit(":1-9:"), page, F.lit("-"), page * 3, F.lit("x")))
        .when(page % 4 == 2, F.col("url")).otherwise(F.concat(F.lit("chr"), page))
    )
    t = table(spark, sf_dir, "pages").select("page_id", name.alias("name")).withColumn("r", tx.region(F.col("name")))
    return t.select("page_id", F.col("r.chrom").alias("chrom"), F.coalesce("r.start", F.lit(-1)).alias("region_start"), F.coalesce("r.end", F.lit(-1)).alias("region_end"), tx.stem(F.col("name")).alias("stem"))


@query("SELECT c_custkey, round(CASE WHEN last < 200000 THEN v / 1e3 WHEN last > 200000000 THEN v / 1e9 ELSE v / 1e6 END, 9) AS scaled, CASE WHEN last < 200000 THEN 'Kbp' WHEN last < 200000000 THEN 'Mbp' ELSE 'Gbp' END AS unit FROM (SELECT c_custkey, c_custkey * 1000 AS last, c_custkey * 250 AS v FROM (SELECT c_custkey * (CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 100000 END) AS c_custkey FROM customer))")
def unit_scale(spark, sf_dir):
    key = F.col("c_custkey") * F.when(F.col("c_custkey") % 3 == 0, 1).when(F.col("c_custkey") % 3 == 1, 1000).otherwise(100000)
    t = table(spark, sf_dir, "customer").select(key.alias("c_custkey")).withColumns({"last": F.col("c_custkey") * 1000, "v": F.col("c_custkey") * 250})
    return t.select("c_custkey", F.round(tx.scaled(F.col("v").cast("double"), F.col("last")), 9).alias("scaled"), tx.unit(F.col("last")).alias("unit"))


@query("SELECT prefix, arg_max(p_name, p_partkey) AS name FROM part JOIN (SELECT DISTINCT substr(n_name, 1, 1) AS prefix FROM nation UNION SELECT DISTINCT lower(substr(n_name, 1, 1)) FROM nation) ON starts_with(p_name, prefix) GROUP BY prefix")
def palette_prefix(spark, sf_dir):
    letter = F.substring("n_name", 1, 1)
    nations = table(spark, sf_dir, "nation")
    prefixes = nations.select(letter.alias("prefix")).unionByName(nations.select(F.lower(letter).alias("prefix"))).distinct()
    return tx.last_with_prefix(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")), prefixes)


@query("SELECT event_id, format('{}: {:d}-{:d} Identity: {:.2f}', event_type, user_id, user_id + event_id, 86.0::DOUBLE + event_id % 1400 / 100.0::DOUBLE) AS label FROM events")
def interval_labels(spark, sf_dir):
    label = tx.interval_label(F.col("event_type"), F.col("user_id"), F.col("user_id") + F.col("event_id"), F.lit(86.0) + F.col("event_id") % 1400 / 100.0)
    return table(spark, sf_dir, "events").select("event_id", label.alias("label"))


@query("SELECT o_orderkey, CASE WHEN n > 1000000 THEN format('{:,d}k', round_even(n / 1000.0::DOUBLE, 0)::BIGINT) ELSE n::VARCHAR END AS label FROM (SELECT o_orderkey, o_orderkey * 3001 AS n FROM orders)")
def row_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.row_label(F.col("o_orderkey") * 3001).alias("label"))


@query(
    "WITH g AS (SELECT stop::INTEGER AS stop, round(stop / 11.0::DOUBLE, 9) AS place, 'rgb(' || r || ', ' || g || ', ' || b || ')' AS color FROM (VALUES (0, 255, 255, 255), (1, 94, 79, 162), (2, 50, 136, 189), (3, 102, 194, 165), (4, 171, 221, 164), (5, 230, 245, 152), (6, 255, 255, 191), (7, 254, 224, 139), (8, 253, 174, 97), (9, 244, 109, 67), (10, 213, 62, 79), (11, 158, 1, 66)) t(stop, r, g, b)) "
    f"SELECT stop, place, color, count(*) AS n, max(v) AS greatest FROM (SELECT perID_by_events AS v, floor((perID_by_events - 86) / 14 * 11)::INTEGER AS stop FROM ({PAIRS_SQL})) JOIN g USING (stop) GROUP BY ALL"
)
def palette_gradient(spark, sf_dir):
    """Pairs by the stop of the gradient below their identity."""
    stops = F.array(*(F.struct(F.lit(round(place, 9)).alias("place"), F.lit(color).alias("color")) for place, color in tx.gradient(tx.resolve_palette())))
    t = pair_table(spark, sf_dir).withColumn("stop", F.floor((F.col("perID_by_events") - 86) / 14 * 11).cast("int"))
    t = t.groupBy("stop").agg(F.count(F.lit(1)).alias("n"), F.max("perID_by_events").alias("greatest")).withColumn("s", F.get(stops, "stop"))
    return t.select("stop", F.col("s.place").alias("place"), F.col("s.color").alias("color"), "n", "greatest")


# parameters


@query(
    "WITH a AS (SELECT doc_id, n_chars * 977 AS n FROM documents WHERE n_chars >= 30), b AS (SELECT *, ceil((n - 20) / 1000.0::DOUBLE)::BIGINT AS w FROM a), c AS (SELECT *, least(1000, w) AS m FROM b), "
    "d AS (SELECT *, round_even(w / m::DOUBLE, 0)::BIGINT AS ratio FROM c), e AS (SELECT *, CASE WHEN ratio < 1 THEN 1 WHEN ratio <= m THEN 1::BIGINT << (length(bin(ratio)) - 1) ELSE 1::BIGINT << length(bin(ratio - 1)) END::BIGINT AS s FROM d) "
    "SELECT doc_id, n, w AS \"window\", s AS sparsity, round_even(w / s::DOUBLE, 0)::BIGINT AS sketch, ceil((n - 20) / w::DOUBLE)::BIGINT AS windows, m AS modimizer, w >= 21 AS fits FROM e"
)
def static_parameters(spark, sf_dir):
    t = table(spark, sf_dir, "documents").filter("n_chars >= 30").select("doc_id", (F.col("n_chars") * 977).alias("n"))
    return t.select("*", *(c.alias(name) for name, c in params.static_columns(F.col("n")).items()))


@query(
    "WITH r AS (SELECT o_custkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey HAVING max(o_orderkey) > min(o_orderkey)), d AS (SELECT *, pow(10, floor(log10(hi - lo))) AS decade FROM r), "
    "t AS (SELECT *, (hi - lo) / decade AS tenths FROM d), s AS (SELECT *, decade * (CASE WHEN ceil(tenths) > 9 THEN 2 WHEN tenths > 4 THEN 1 WHEN tenths > 2 THEN 0.5 WHEN tenths > 1 THEN 0.25 ELSE 0.125 END)::DOUBLE AS step FROM t) "
    "SELECT o_custkey, ceil((hi - lo) / step)::BIGINT + 1 AS n, floor(lo / step) * step AS first, (floor(lo / step) + ceil((hi - lo) / step)) * step AS last FROM s"
)
def axis_ticks(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).filter("hi > lo")
    t = ends.withColumn("t", params.tick_column(F.col("lo"), F.col("hi")))
    return t.select("o_custkey", F.size("t").cast("long").alias("n"), F.get("t", 0).alias("first"), F.element_at("t", -1).alias("last"))


# sources and sinks


def _folder(spark, name: str) -> str:
    """A folder that all executors share; one of this machine where executors are threads."""
    root = dict(spark.sparkContext.getConf().getAll()).get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="seqlattice-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT seq_id, length(seq) AS n, md5(seq) AS digest FROM ({seq_sql(bases=MIXED)}) UNION ALL SELECT seq_id, length(seq), md5(seq) FROM ({seq_sql(name='benchmark', id_col='item_id')})")
def fasta_round_trip(spark, sf_dir):
    """Sequences written as FASTA with lines of 60 lower-case bases, once plain and once compressed, and read back."""
    folder = _folder(spark, "fasta")
    for seqs, part, codec in ((sequences(spark, sf_dir, bases=MIXED), "a", "none"), (sequences(spark, sf_dir, "benchmark", "item_id"), "b", "gzip")):
        lines = F.concat(F.lit(">"), F.col("seq_id"), F.lit(" made of text\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n"))
        seqs.select(lines).write.option("compression", codec).text(f"{folder}/{part}")
    found = readers.fasta(spark, [f"{folder}/a", f"{folder}/b"])
    return found.select(F.col("seq_id").cast("long").alias("seq_id"), "n", F.md5("seq").alias("digest"))


def _as_fasta(spark, sf_dir: str) -> str:
    """Documents as FASTA, the bases of :func:`sequences` in lines of 60 and lower case; folded as bytes, which costs a part of what the expressions do."""
    folder = _folder(spark, "fasta")
    letters = (ALPHABET + ALPHABET.upper()).encode()
    fold, others = bytes.maketrans(letters, BASES.lower().encode() * 2), bytes(set(range(256)) - set(letters))

    @F.arrow_udf("string")
    def wrapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for lo, hi in slices(texts):
                bases = [t.translate(fold, others).decode() for t in texts.slice(lo, hi - lo).cast(pa.large_binary()).fill_null(b"").to_pylist()]
                yield pa.array(["\n".join(b[i : i + 60] for i in range(0, len(b), 60)) for b in bases], pa.string())

    table(spark, sf_dir, "documents").select(F.concat(F.lit(">"), F.col("doc_id"), F.lit(" made of text\n"), wrapped("text"))).write.text(folder)
    return folder


@query(f"SELECT seq_id, any_value(n) AS n, count(*) AS n_kmers, count(DISTINCT idx) AS n_places, sum(h)::BIGINT AS hash_sum, sum(h * (idx % 1000))::BIGINT AS placed FROM ({hashed_sql(8, ambiguous=True)}) GROUP BY seq_id")
def fasta_pieces(spark, sf_dir):
    """Records read in pieces: every k-mer once and in its place, however files are cut into byte ranges."""
    found = readers.fasta_pieces(spark, _as_fasta(spark, sf_dir), 8, 512)
    made = found.select(F.col("seq_id").cast("long").alias("seq_id"), "length", "off", placed_sums(8, 1000)("piece", "off").alias("s"))
    # A row for each piece leaves a task, none for each k-mer; the places of a record are the union of its pieces' ranges.
    parts = made.select("seq_id", "length", "off", "s.*").groupBy("seq_id", "off", "m").agg(F.max("length").alias("n"), F.sum("m").alias("c"), F.sum("hash_sum").alias("hash_sum"), F.sum("placed").alias("placed"))
    before = F.max(F.col("off") + F.col("m")).over(Window.partitionBy("seq_id").orderBy("off", "m").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("fresh", F.greatest(F.lit(0).cast("long"), F.col("off") + F.col("m") - F.greatest(F.col("off"), F.coalesce(before, F.lit(0)))))
    return parts.groupBy("seq_id").agg(F.max("n").alias("n"), F.sum("c").alias("n_kmers"), F.sum("fresh").alias("n_places"), F.sum("hash_sum").alias("hash_sum"), F.sum("placed").alias("placed"))


@query(_self_sql(W, K, 2, DELTA, ID))
def fasta_identity(spark, sf_dir):
    """Identity of sequences read from FASTA in pieces."""
    found = readers.fasta_pieces(spark, _as_fasta(spark, sf_dir), K).select(F.col("seq_id").cast("long").alias("seq_id"), "off", "piece", "length")
    return identity.self_identity(found, W, K, ID, DELTA, 2).withColumn("identity", F.round("identity", 6))


@query("SELECT doc_id AS seq_id, row_number() OVER (ORDER BY coalesce(length(text), 0) DESC, doc_id) - 1 AS place FROM documents")
def size_order(spark, sf_dir):
    seqs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    return grid.size_places(seqs, 1, ["seq_id"]).select("seq_id", "place")


@query(f"SELECT query_name || '_' || reference_name AS title, count(*) AS n, sum(query_start)::BIGINT AS query_sum, max(reference_end) AS reference_last, round(sum(perID_by_events), 4) AS total FROM ({PAIRS_SQL}) GROUP BY ALL")
def bedpe_round_trip(spark, sf_dir):
    folder = _folder(spark, "pairs")
    writers.bedpe_by_title(pair_table(spark, sf_dir).withColumn("title", F.concat_ws("_", "query_name", "reference_name")), folder)
    found = readers.bedpe(spark, folder)
    return found.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.sum("query_start").alias("query_sum"), F.max("reference_end").alias("reference_last"), F.round(F.sum("perID_by_events"), 4).alias("total"))


@query(f"SELECT title, level::INTEGER AS level, i, j, v AS identity, x_size FROM (SELECT 's' || (o_custkey % 3) AS title, o_orderkey % 2 AS level, (o_orderkey % 1000)::BIGINT AS i, (o_custkey % 1000)::BIGINT AS j, 86.0::DOUBLE + (o_orderkey * 37 % 1400) / 100.0::DOUBLE AS v, 100000 * (1 + o_custkey % 3) AS x_size FROM orders WHERE o_custkey % 3 < 2)")
def pyramid_round_trip(spark, sf_dir):
    """Layers and metadata written and read back, joined by title; the third title has no metadata."""
    cells = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("title"), (F.col("o_orderkey") % 2).alias("level"), (F.col("o_orderkey") % 1000).alias("i"), (F.col("o_custkey") % 1000).alias("j"),
        (F.lit(86.0) + (F.col("o_orderkey") * 37 % 1400) / 100.0).alias("identity"),
    )
    folder = _folder(spark, "pyramid")
    writers.pyramid(cells, spark.createDataFrame([(f"s{i}", 100_000 * (1 + i)) for i in (0, 1)], "title string, x_size long"), folder)
    return readers.pyramid_with_metadata(spark, folder).select("title", F.col("level").cast("int").alias("level"), "i", "j", "identity", "x_size")


@query(f"WITH t AS (SELECT perID_by_events AS v FROM ({PAIRS_SQL})), m AS (SELECT min(v) AS lo, max(v) AS hi FROM t) SELECT least(floor((v - lo) / ((hi - lo) / 300)), 299)::INTEGER AS bin, CASE WHEN v <= 90 THEN 0 WHEN v <= 97 THEN 1 ELSE 2 END::INTEGER AS discrete, count(*) AS n FROM t, m GROUP BY ALL")
def histogram_by_color(spark, sf_dir):
    return frames.histogram(frames.discretised(pair_table(spark, sf_dir), 3, breakpoints=[86, 90, 97, 100]), by=("discrete",))


@query("SELECT ts AS \"at\", 'x' || event_type AS x_name, user_id // 250 * 250 + 1 AS x_start, user_id // 250 * 250 + 250 AS x_end, 'y' AS y_name, event_id // 250 * 250 + 1 AS y_start, event_id // 250 * 250 + 250 AS y_end, value AS identity FROM events")
def click_intervals(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("user_id").alias("x"), F.col("event_id").alias("y"), F.lit(250).cast("long").alias("window"), F.concat(F.lit("x"), "event_type").alias("x_name"), F.lit("y").alias("y_name"), F.col("value").alias("identity"))
    return clicks.intervals(made)


@query(f"SELECT seq_id, max(hi) AS covered, any_value(nk) AS n_kmers FROM ({window_sql(W, K, 0.0, len_sql(K))}) GROUP BY seq_id HAVING max(hi) < any_value(nk)")
def windows_uncovered(spark, sf_dir):
    return windows.uncovered(windows.window_table(lengths(spark, sf_dir), W, K)).select("seq_id", "covered", "n_kmers")


@query(f"SELECT fwd AS kmer, count(*) AS n FROM ({kmer_sql(4)}) GROUP BY fwd")
def case_fold(spark, sf_dir):
    return kmers(sequences(spark, sf_dir).withColumn("seq", F.lower("seq")), 4).groupBy(F.col("fwd").cast("string").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def _clicks(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("v"), F.col("user_id") % 500).alias("viewer"), F.col("event_id").alias("click_id"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("x"), F.col("event_id").alias("y"),
        F.lit(250).cast("long").alias("window"), F.concat(F.lit("x"), "event_type").alias("x_name"), F.lit("y").alias("y_name"), F.col("value").alias("identity"),
    )


@query("SELECT viewer, row_number() OVER (PARTITION BY viewer ORDER BY ts DESC, event_id DESC)::INTEGER AS place, event_id AS click_id, ts AS \"at\", user_id // 250 * 250 + 1 AS x_start, event_id // 250 * 250 + 250 AS y_end, value AS identity FROM (SELECT *, 'v' || (user_id % 500) AS viewer FROM events) QUALIFY place <= 7")
def click_history(spark, sf_dir):
    """The newest seven clicks of each viewer, kept by a stream over all events and read from what it wrote."""
    folder = _folder(spark, "clicks")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name a file
    clicks.keep_history(_clicks(events), f"{folder}/history", f"{folder}/checkpoint", most=7, late="3650 days").awaitTermination()
    return clicks.history(spark, f"{folder}/history").select("viewer", "place", "click_id", F.col("at").cast("timestamp_ntz").alias("at"), "x_start", "y_end", "identity")


@query(f"SELECT CASE WHEN query_start % 97 = 5 THEN 'rejected' ELSE 'good' END AS kind, count(*) AS n, sum(query_end)::BIGINT AS ends FROM ({PAIRS_SQL}) GROUP BY kind")
def bedpe_rejects(spark, sf_dir):
    """Pair tables of which some rows have a start that is no number."""
    folder = _folder(spark, "rejects")
    start = F.when(F.col("query_start") % 97 == 5, F.concat("query_start", F.lit("x"))).otherwise(F.col("query_start").cast("string"))
    pair_table(spark, sf_dir).withColumn("query_start", start).withColumnRenamed("query_name", "#query_name").write.option("comment", "\x01").csv(f"{folder}/pairs", sep="\t", header=True)
    good, bad = readers.bedpe_checked(spark, f"{folder}/pairs")
    ends = F.split("text", "\t")
    both = good.select(F.lit("good").alias("kind"), "query_end").unionByName(bad.filter("line > 1").select(F.lit("rejected").alias("kind"), F.get(ends, 2).cast("long").alias("query_end")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("query_end").alias("ends"))


@query(f"SELECT query_name, reference_name, count(*) AS n, sum(query_start)::BIGINT AS starts, CASE WHEN query_name = reference_name THEN query_name || '/' || query_name || '.bedpe' ELSE query_name || '_' || reference_name || '/' || query_name || '_' || reference_name || '_COMPARE.bedpe' END AS file FROM ({PAIRS_SQL}) GROUP BY ALL")
def bedpe_files(spark, sf_dir):
    """One named file for each pair of names, read back."""
    folder = _folder(spark, "files")
    writers.bedpe_files(pair_table(spark, sf_dir), folder)
    found = readers.bedpe(spark, f"{folder}/*/*.bedpe").withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+/[^/]+)$", 1))
    return found.groupBy("query_name", "reference_name", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("query_start").alias("starts"))


@query(f"WITH q AS ({_self_sql(W, K, 2, DELTA, ID)}), n AS (SELECT seq_id, max(w) + 1 AS n FROM ({window_sql(W, K, 0.0, len_sql(K))}) GROUP BY seq_id) SELECT seq_id, i AS bin1_id, j + n AS bin2_id, identity AS \"count\" FROM q JOIN n USING (seq_id)")
def contact_pixels(spark, sf_dir):
    """Pixels of a map of two sequences: the columns' bins follow those of the rows."""
    pairs = identity.self_identity(sequences(spark, sf_dir), W, K, ID, DELTA, 2)
    bins = windows.window_table(lengths(spark, sf_dir), W, K).groupBy("seq_id").agg((F.max("w") + 1).alias("n"))
    return identity.pixels(pairs.join(bins, "seq_id"), F.col("n"), ("seq_id",)).withColumn("count", F.round("count", 6))
