import pytest

from seqlattice.plans import params as p


@pytest.mark.parametrize("n,w,s,sketch", [(250_000, 250, 1, 250), (1_000_000, 1000, 1, 1000), (1_500_000, 1500, 2, 750), (3_000_000, 3000, 2, 1500), (4_000_000, 4000, 4, 1000), (128_000_000, 128_000, 128, 1000)])
def test_static(n, w, s, sketch):
    plan = p.static_plan(n)
    assert (plan.window, plan.sparsity, plan.sketch, plan.windows) == (w, s, sketch, 1000)


def test_window_floor():
    with pytest.raises(ValueError):
        p.static_plan(5000)


@pytest.mark.parametrize("n,quick,windows", [(4_000_000, False, [2000, 4000]), (4_000_000, True, [4000]), (3_000_000, False, [1500, 3000]), (3_003_000, False, [1502]), (3_001_500, False, [1501, 3002])])
def test_pyramid(n, quick, windows):
    assert [w for w, _ in p.pyramid_plan(n, quick=quick)] == windows


def test_zoom():
    size = 4_000_000
    assert [p.zoom_level(x, size, 2) for x in (4_000_001, 2_000_000, 1_999_999)] == [0, 0, 1]
    assert [p.zoom_level(x, size, 3) for x in (1_000_000, 999_999)] == [1, 2]
    assert p.zoom_level(5, size, 1) == 0


def test_ticks():
    assert p.ticks(1, 4_000_000) == list(range(0, 4_000_001, 500_000))
    assert p.ticks(1, 250_000) == list(range(0, 250_001, 50_000))


def test_query_checks():
    for bad in ({"delta": 2}, {"identity": 0}, {"breakpoints": (80.0, 90.0)}, {"compare": True, "compare_only": True}):
        with pytest.raises(ValueError):
            p.IdentityQuery(**bad)
    assert p.IdentityQuery().overridden({"identity": 90, "color": ["#fff"], "other": 1}).colors == ("#fff",)


def test_grid():
    assert [p.grid_size(x) for x in (1, 3, 6, 10, 15)] == [2, 3, 4, 5, 6]
    assert p.grid_complete(3, 3) and not p.grid_complete(3, 2)
    with pytest.raises(ValueError):
        p.grid_size(4)
    with pytest.raises(ValueError):
        p.grid_complete(7, 21)


def test_columns_equal_the_plain_forms(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    sizes = [int(10 ** rng.uniform(4.1, 9)) for _ in range(300)] + [250_000, 1_500_000, 3_000_000]
    for m, r in ((1000, 1000), (50, 1000), (3, 700)):
        rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", *(c.alias(k) for k, c in p.static_columns(F.col("n"), 21, m, r).items())).collect()
        for row in rows:
            if row.fits:
                plan = p.static_plan(row.n, 21, m, r)
                assert (row.window, row.sparsity, row.sketch, row.windows, row.modimizer) == (plan.window, plan.sparsity, plan.sketch, plan.windows, plan.modimizer)
    got = spark.createDataFrame([(1, n) for n in sizes] + [(5, 5), (900, 1000)], "a long, b long").withColumn("t", p.tick_column(F.col("a"), F.col("b"))).collect()
    assert all(r.t == pytest.approx([float(x) for x in p.ticks(r.a, r.b)]) and (r.a == r.b or 5 <= len(r.t) - 1 <= 9) for r in got)
