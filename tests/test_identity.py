import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import naive
from seqlattice.functions import kmers as km
from seqlattice.operators import identity, pyramid, windows


def sequence(seed, unit=170, copies=5, gap=260):
    rng = random.Random(seed)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    block = bases(unit)
    spoil = lambda s: "".join(rng.choice("ACGT") if rng.random() < 0.015 else c for c in s)
    return bases(130) + "".join(spoil(block) for _ in range(copies)) + "N" * gap + bases(77).lower() + spoil(block)


def test_murmur_goldens():
    assert [km.murmur3_int(x) for x in (b"", b"foo", b"ACGTACGTACGTACGTACGTA", b"TACGTACGTACGTACGTACGT")] == [0, -156908512, -235213791, -1308480102]
    assert [km.murmur3_int(x * 21) for x in (b"A", b"T", b"N", b"R")] == [923730355, -2113366936, -1878081945, 872482202]


@pytest.mark.parametrize("k", [3, 8, 13, 21])
def test_hash_forms_agree(spark, k):
    rng = random.Random(k)
    words = ["".join(rng.choice("ACGTN") for _ in range(k)) for _ in range(40)]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("b", F.col("w").cast("binary"))
    assert all(r.h == km.murmur3_int(r.w.encode()) for r in km.with_murmur3(df, "b", k, "h").collect())
    seq = "".join(words)
    assert km.canonical_hashes(seq.encode(), k).tolist() == naive.hashes(seq, k)


def test_chunks_lose_and_repeat_nothing(spark):
    seqs = [("a", sequence(1)), ("short", "ACG"), ("empty", ""), ("null", None)]
    df = spark.createDataFrame(seqs, "seq_id string, seq string")
    rows = km.kmers(df, 21, chunk=64).filter("seq_id = 'a'").orderBy("idx").collect()
    up = seqs[0][1].upper()
    assert [r.idx for r in rows] == list(range(len(up) - 20))
    assert all(r.fwd.decode() == up[r.idx : r.idx + 21] for r in rows)
    assert all(r.rev.decode() == r.fwd.decode()[::-1].translate(naive.SWAP) for r in rows)
    assert {r.seq_id for r in km.kmers(df, 21).select("seq_id").collect()} == {"a"}


@pytest.mark.parametrize("n,w,k,delta", [(80, 20, 5, 0), (80, 20, 5, 0.5), (80, 21, 5, 0.5), (79, 20, 5, 0.5), (400, 57, 21, 1.0), (333, 30, 21, 0.5), (18, 20, 5, 0.25), (1, 20, 5, 0.5)])
def test_windows(spark, n, w, k, delta):
    t = windows.window_table(spark.createDataFrame([(1, n)], "seq_id int, n_kmers long"), w, k, delta).orderBy("w").collect()
    expected = naive.ranges(n, w, k, delta)
    assert [(r.lo, r.hi) for r in t] == expected
    placed = windows.assign(spark.range(n).select(F.col("id").alias("idx"), F.lit(n).cast("long").alias("n_kmers")), w, k, delta)
    got = {}
    for r in placed.collect():
        got.setdefault(r.w, []).append(r.idx)
    assert {i: list(range(lo, hi)) for i, (lo, hi) in enumerate(expected) if hi > lo} == {i: sorted(x) for i, x in got.items()}


def test_window_goldens():
    assert naive.ranges(80, 20, 5, 0) == [(0, 16), (17, 37), (37, 57), (57, 77), (77, 80)]
    assert naive.ranges(80, 21, 5, 0.5) == [(0, 28), (8, 50), (28, 70), (50, 80)]


@pytest.mark.parametrize("w,k,delta,ident,s,amb", [(100, 21, 0.5, 86, 1, False), (57, 21, 0.5, 80, 2, False), (128, 8, 0.25, 90, 4, True), (100, 21, 0.0, 86, 1, False), (150, 21, 1.0, 86, 1, False)])
def test_self_identity(spark, w, k, delta, ident, s, amb):
    seqs = {"x": sequence(3), "y": sequence(4, 90, 8)}
    df = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    got = {}
    for r in identity.self_identity(df, w, k, ident, delta, s, amb).collect():
        assert (r.seq_id, r.i, r.j) not in got
        got[r.seq_id, r.i, r.j] = round(r.identity, 6)
    assert got == {(n, *key): v for n, seq in seqs.items() for key, v in naive.self_pairs(seq, w, k, ident, delta, s, amb).items()}


def test_hot_hashes_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(identity, "CHUNK", 3)
    seq = sequence(3, 100, 12)
    found = identity.self_identity(spark.createDataFrame([("x", seq)], "seq_id string, seq string"), 50, 21, 80, 0.5).collect()
    assert {(r.i, r.j): round(r.identity, 6) for r in found} == naive.self_pairs(seq, 50, 21, 80, 0.5) and len(found) > 30


@pytest.mark.parametrize("w,delta,ident,s", [(100, 0.5, 86, 1), (101, 0.5, 86, 2), (140, 0.0, 80, 2)])
def test_pair_identity(spark, w, delta, ident, s):
    a, b = sequence(5), sequence(5)[200:] + sequence(6)
    one = lambda n, x: spark.createDataFrame([(n, x)], "seq_id string, seq string")
    found = identity.pair_identity(one("a", a), one("b", b), w, 21, ident, delta, s).collect()
    assert {(r.i, r.j): round(r.identity, 6) for r in found} == naive.cross_pairs(a, b, w, 21, ident, delta, s)
    assert found


@pytest.mark.parametrize("expanded", [1, 1 << 21])
def test_long_sequences_go_by_postings(spark, monkeypatch, expanded):
    monkeypatch.setattr(identity, "CHUNK", 3)
    monkeypatch.setattr(identity, "FEW", 0)
    monkeypatch.setattr(identity, "EXPANDED", expanded)
    seqs = {"x": sequence(3, 100, 12), "y": sequence(7), "tiny": "ACGT"}
    df = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    for ambiguous in (False, True):
        found = identity.self_identity(df, 50, 21, 80, 0.5, 1, ambiguous).collect()
        assert {(r.seq_id, r.i, r.j): round(r.identity, 6) for r in found} == {(n, *key): v for n, s in seqs.items() if len(s) > 20 for key, v in naive.self_pairs(s, 50, 21, 80, 0.5, 1, ambiguous).items()}


def test_rows_of_a_hash_in_all_windows(spark):
    one = F.array(F.lit(7))
    found = spark.range(100_000).select(F.lit("s").alias("seq_id"), F.col("id").alias("w"), one.alias("core"), F.array().cast("array<int>").alias("rim"))
    rows = identity._postings(found, ["seq_id"], "xs").select(F.size("xs").alias("n")).collect()
    assert sum(r.n for r in rows) == 100_000 and max(r.n for r in rows) == identity.CHUNK
    pairs = identity._self_pairs(found.filter("w < 2600").withColumn("__blocks", F.lit(21)), ["seq_id"], 21, 86.0, False)  # 21 blocks: through postings
    assert pairs.count() == 2600 * 2599 // 2 and pairs.filter("identity <> 100").isEmpty()


def test_counting_forms_agree():
    rng = np.random.default_rng(1)
    for density in (0.02, 0.6):
        sides = []
        for n in (9, 12):
            w, h = np.nonzero(rng.random((n, 40)) < density)
            sides.append((w, h, (rng.random(len(w)) < 0.5).astype(int)))
        (aw, ah, ac), (bw, bh, bc) = sides
        wide_a, core_a, wide_b, core_b = np.zeros((2, 9, 40)), None, np.zeros((2, 12, 40)), None
        wide_a[0][aw, ah], wide_a[1][aw, ah] = 1, ac
        wide_b[0][bw, bh], wide_b[1][bw, bh] = 1, bc
        want = wide_a[1] @ wide_b[0].T, wide_a[0] @ wide_b[1].T
        for expanded in (1, 1 << 21):
            identity.EXPANDED, before = expanded, identity.EXPANDED
            got = identity.common(*sides, 9, 12, 40)
            identity.EXPANDED = before
            assert all((np.asarray(x) == y).all() for x, y in zip(got, want))


def test_pruned_pairs_are_the_same(spark):
    a = spark.createDataFrame([("a", sequence(5)), ("far", sequence(50))], "seq_id string, seq string")
    b = spark.createDataFrame([("b", sequence(5)[200:])], "seq_id string, seq string")
    rows = lambda prune: sorted(map(tuple, identity.pair_identity(a, b, 100, 21, 80, prune=prune).collect()))
    assert rows(True) == rows(False) != []
    bits = identity.bitmap(spark.createDataFrame([(-5,), (7,), (2**31 - 1,), (-(2**31),)], "h int"), 1 << 10)
    h = np.array([-5, 7, 2**31 - 1, -(2**31), 8], np.int32)
    assert identity.held(bits, h).tolist() == [True, True, True, True, False]


@pytest.mark.parametrize("prune", [True, False])
def test_sets_of_whole_sequences(spark, monkeypatch, prune):
    monkeypatch.setattr(km, "CHUNK", 200)
    seqs = {"x": sequence(5), "y": sequence(5)[400:], "z": sequence(60), "short": "ACG", "null": None}
    df = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    sets = {n: set(naive.hashes(s, 21)) - {km.murmur3_int(c.encode() * 21) for c in km.AMBIGUOUS} for n, s in seqs.items() if s and len(s) > 20}
    found = km.hash_sets(df, 21)
    assert found.filter("size(hs) > 400").isEmpty()
    assert {r.seq_id: (r.k, r.n) for r in found.groupBy("seq_id").agg(F.sum(F.size("hs")).alias("k"), F.max("n").alias("n")).collect()} == {n: (len(s), len(s)) for n, s in sets.items()}
    got = {(r.a_id, r.b_id): (r.common, r.a_size, r.b_size) for r in identity.set_containment(df, df, 21, prune=prune).collect()}
    assert got == {(p, q): (len(a & b), len(a), len(b)) for p, a in sets.items() for q, b in sets.items() if a & b}


def test_layers_come_from_one_hashing(spark):
    seqs = {"x": sequence(3), "y": sequence(4, 90, 8)}
    df = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    layers = [(50, 1), (100, 2), (200, 4)]
    for ambiguous in (False, True):
        built = pyramid.build(df, layers, k=21, identity=80.0, ambiguous=ambiguous)
        got = {(r.seq_id, r.level, r.window, r.i, r.j): round(r.identity, 6) for r in built.collect()}
        assert got == {(n, 2 - at, w, *key): v for n, s in seqs.items() for at, (w, sparsity) in enumerate(layers) for key, v in naive.self_pairs(s, w, 21, 80, 0.5, sparsity, ambiguous).items()}
    built = pyramid.build(df, layers, k=21, identity=80.0)
    built.collect()
    plan = built._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert 1 <= final.count("ArrowEvalPython") <= 2  # one for short sequences, one for long ones
    one = lambda n, x: spark.createDataFrame([(n, x)], "seq_id string, seq string")
    a, b = sequence(5), sequence(5)[200:] + sequence(6)
    both = pyramid.build(one("a", a), layers, one("b", b), k=21, identity=80.0)
    got = {(r.level, r.i, r.j): round(r.identity, 6) for r in both.collect()}
    assert got == {(2 - at, *key): v for at, (w, sparsity) in enumerate(layers) for key, v in naive.cross_pairs(a, b, w, 21, 80, 0.5, sparsity).items()}


def test_region(spark):
    seq = sequence(9)
    df = km.hashed_kmers(spark.createDataFrame([("a", seq)], "seq_id string, seq string"), 21, ambiguous=True).withColumn("n_kmers", F.col("n") - 20)
    rows = windows.region(df, 51, 300, 21).orderBy("idx").collect()
    assert [r.h for r in rows] == naive.hashes(seq[50:300], 21) and rows[0].n_kmers == 230


def test_bad_windows():
    with pytest.raises(ValueError):
        windows.check(10, 21, 0.5)
    with pytest.raises(ValueError):
        windows.check(30, 21, 1.5)


def test_hashing_takes_bases_not_rows(spark, monkeypatch):
    """What is hashed at once has a bound in bases; results do not depend on it, nor on sequences that share a key."""
    pieces = pa.array([b"ACGT" * n for n in (3, 0, 50, 1, 1, 1)])
    seqs = [(i, sequence(i, n)) for i, n in enumerate((0, 11, 12, 90, 4000, km.CHUNK + 500))]
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    expected = {}
    for i, s in seqs:
        h = [(p, v) for p, v in enumerate(km.canonical_hashes(s.upper().encode(), 12).tolist()) if v % 4 == 0]
        if h:
            expected[i] = (len(h), len({v for _, v in h}), sum(p for p, _ in h))
    for bases in (1, 40, km.BASES):
        monkeypatch.setattr(km, "BASES", bases)
        found = list(km.slices(pieces))
        assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == 6
        assert all(b - a == 1 or sum(len(p) for p in pieces.to_pylist()[a:b]) <= bases for a, b in found)
        got = {r.seq_id: (r.kept, r.n_hashes, r.places) for r in km.kmer_totals(df, 12, 4, ambiguous=True).collect()}
        assert got == expected
    twice = {r.seq_id: (r.kept, r.n_hashes) for r in km.kmer_totals(df.unionByName(df.filter("seq_id = 4")), 12, 4, ambiguous=True).collect()}
    assert twice[4] == (2 * expected[4][0], expected[4][1]) and twice[5] == expected[5][:2]
    plan = km.kmer_totals(df.filter("seq_id < 5"), 12, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in plan


def test_short_sequences_are_counted_where_they_are_hashed(spark):
    """Sequences of one piece make no group of their own; those that share a key are still put together."""
    seqs = {"x": sequence(3), "y": sequence(4, 90, 8), "array": "ACGTTGCAAC" * 150, "short": "ACG", "none": None}
    df = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    expected = {(n, *key): v for n, s in seqs.items() if s and len(s) > 20 for key, v in naive.self_pairs(s, 50, 12, 86, 0.5, 2, False).items()}
    found = identity.self_identity(df, 50, 12, 86.0, 0.5, 2)
    assert {(r.seq_id, r.i, r.j): round(r.identity, 6) for r in found.collect()} == expected
    one, rest = identity._parted(df, ["seq_id"], 12, F.lit(True))
    assert {r.seq_id for r in one.collect()} == {"x", "y", "array"} and {r.seq_id for r in rest.collect()} <= {"short", "none"}
    assert identity._parted(df.unionByName(df), ["seq_id"], 12, F.lit(True))[0] is None
    twice = identity.self_identity(df.unionByName(df), 50, 12, 86.0, 0.5, 2)
    assert {(r.seq_id, r.i, r.j): round(r.identity, 6) for r in twice.collect()} == expected and twice.count() == len(expected)


def test_only_held_hashes_leave_their_task(spark):
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    item = letters(400)
    query = spark.createDataFrame([(i, letters(20_000) + (item if i == 3 else "")) for i in range(8)] + [(8, letters(70_000) + item)], "seq_id long, seq string")
    reference = spark.createDataFrame([(1, item), (2, letters(50))], "seq_id long, seq string")
    bits = identity.bitmap(identity._sides(reference, [200], [1], 21, 0.5, False)(None).select(F.explode(F.concat("core", "rim")).alias("h")))
    near = identity._sides(query, [200], [1], 21, 0.5, False)(bits)
    assert {r.seq_id for r in near.filter("size(core) > 9").collect()} == {3, 8} and near.agg(F.sum(F.size("core") + F.size("rim"))).first()[0] < 2_000
    plan = near.filter("seq_id < 8")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Aggregate") == 1  # of the longer sequences only
    got, want = (sorted(map(tuple, identity.pair_identity(query, reference, 200, 21, 80.0, 0.5, prune=p).collect())) for p in (True, False))
    assert got == want and {r[0] for r in got} == {3, 8}
