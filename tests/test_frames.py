import gzip
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlattice.functions import text
from seqlattice.operators import frames, grid, identity, pyramid, ranges
from seqlattice.plans.params import IdentityQuery
from seqlattice.sources import readers, writers
from seqlattice.streaming import clicks

ROWS = [("a", 1, 100, "a", 1, 100, 100.0), ("a", 1, 100, "a", 101, 200, 91.5), ("a", 101, 200, "a", 201, 300, 86.25), ("a", 101, 200, "a", 101, 200, 100.0)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, readers.BEDPE)


def test_bins_are_right_closed(spark, table):
    edges = frames.equal_width_edges(table, 7).first().edges
    assert edges[0] == 86.0 and edges[-1] == 100.0
    got = [r.discrete for r in frames.discretised(table, 7).orderBy("perID_by_events").collect()]
    expected = pd.cut(sorted(r[-1] for r in ROWS), edges, labels=False, include_lowest=True)
    assert got == list(expected)
    values = [86.0, 88.0, 88.1, 90.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.discrete for r in frames.discretised(df, 7, value="v").orderBy("v").collect()] == list(pd.cut(values, frames.equal_width_edges(df, 7, "v").first().edges, labels=False, include_lowest=True))
    freq = frames.equal_frequency_edges(df, 4, "v").first().edges
    assert freq == list(np.unique(np.quantile(values, [0, 0.25, 0.5, 0.75, 1])))


def test_bins_of_one_value(spark):
    df = spark.createDataFrame([(100.0,)] * 3, "perID_by_events double")
    assert {r.discrete for r in frames.discretised(df, 5).collect()} == {4}
    assert {r.discrete for r in frames.discretised(df, 5, True).collect()} == {0}
    with pytest.raises(ValueError):
        frames.discretised(df, 12)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], readers.BEDPE)
    assert frames.discretised(empty, 7).count() == frames.mirrored(empty).count() == frames.histogram(empty).count() == frames.positions(empty).count() == 0
    assert frames.axis_limits(empty).first().axis_min is None


def test_mirror_positions_limits(table):
    assert frames.mirrored(table).count() == 6
    assert {round(r.first_pos, 4) for r in frames.positions(table).collect()} == {round(1 / 99, 4), round(101 / 99, 4)}
    assert tuple(frames.axis_limits(table).first()) == (1, 300)
    assert {r.bin: r.n for r in frames.histogram(table).collect()} == {0: 1, 114: 1, 299: 2}
    frames.check_contract(table)
    with pytest.raises(ValueError):
        frames.check_contract(table.limit(1))


def test_overlap_join(spark):
    rng = np.random.default_rng(1)
    beds = [(f"c{i % 3}", int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 5000, 200), rng.integers(0, 900, 200), strict=True))]
    regions = [(f"c{i % 3}", int(s), int(s + 120)) for i, s in enumerate(rng.integers(0, 5000, 30))]
    got = frames.overlap_join(spark.createDataFrame(beds, "chrom string, start long, end long"), spark.createDataFrame(regions, "chrom string, region_start long, region_end long"), 250).collect()
    expected = sorted((c, s, e, a, b) for c, s, e in beds for d, a, b in regions if c == d and e >= a and s <= b)
    assert sorted((r.chrom, r.start, r["end"], r.region_start, r.region_end) for r in got) == expected


def test_regions_and_labels(spark):
    names = {"chrY:50-3000": ("chrY", 50, 3000), "HG002_chr13_MATERNAL:1-4000000:1000000-3000000": ("HG002_chr13_MATERNAL", 1000000, 3000000), "chr1": None, "chr1.2:5-9": None, "c-1:5-9": None, "chr1:5-9junk": ("chr1", 5, 9)}
    for r in spark.createDataFrame([(n,) for n in names], "n string").withColumn("r", text.region(F.col("n"))).collect():
        assert (tuple(r.r) if r.r else None) == names[r.n]
    assert text.gradient(("#010203", "#040506")) == [(0.0, "rgb(255, 255, 255)"), (0.5, "rgb(1, 2, 3)"), (1.0, "rgb(4, 5, 6)")]
    spectral = text.BUILT_IN["Spectral_11"]
    assert text.resolve_palette() == text.resolve_palette("none", "+") == spectral[::-1] and text.resolve_palette(orientation="-") == spectral
    own = {"Blues_3": ("#a", "#b", "#c")}
    assert text.resolve_palette("Blues_3", "+", palettes=own) == own["Blues_3"] and text.resolve_palette("Blues_3", "-", palettes=own) == own["Blues_3"][::-1]
    assert text.resolve_palette(colors=("#1", "#2")) == ("#1", "#2") and text.gradient_range(86.0) == (86.0, 100.0) and text.gradient_range(86.0, 90, 95) == (90, 95)


def test_viewer(spark):
    df = spark.createDataFrame([(0, 0, 100.0), (0, 1, 88.0), (1, 3, 92.0)], "i int, j int, identity double")
    assert sorted(r.identity for r in pyramid.masked(df, 90, 95).collect()) == [0.0, 0.0, 92.0]
    assert pyramid.crop(df, (0, 2), (0, 1)).count() == 2 and pyramid.crop(df, (0, 1), (0, 1)).count() == 1
    assert [(r.i, r.j) for r in pyramid.crop(df, (1, 2), (3, 4), own=True).collect()] == [(3, 1)]
    assert pyramid.axis_edges(10, 4) == [0, 2.5, 5, 7.5, 10] and pyramid.axis_edges(10, 4, loaded=True) == [0, 2, 4, 6, 10]
    assert pyramid.is_blank(df.filter("false")) and not pyramid.is_blank(df)
    assert pyramid.least_positive(df).first().least == 88.0
    assert [r.n for r in spark.range(1).select(pyramid.level_of(F.lit(2000000), F.lit(4000000), 2).alias("n")).collect()] == [0]
    edges = spark.createDataFrame([(i, i * 10) for i in range(6)], "edge_index int, edge long")
    near = {r.point: (r.before, r.nearest) for r in pyramid.nearest_edges(edges, spark.createDataFrame([(0,), (15,), (16,), (49,)], "point long")).collect()}
    assert near == {0: (0, 0), 15: (0, 1), 16: (1, 2), 49: (4, 5)}


def test_grid(spark):
    seqs = spark.createDataFrame([("a", 0, 500), ("b", 1, 900), ("c", 2, 500)], "seq_id string, seq_ord int, n long")
    assert [r.seq_id for r in grid.by_size(seqs, 21).collect()] == ["b", "a", "c"]
    pairs = grid.sequence_pairs(seqs)
    assert pairs.count() == 3 and grid.cells(seqs, pairs).count() == 9
    order = {(r["query"], r.reference): (r.upper_order, r.lower_order) for r in grid.lower_order(pairs).collect()}
    assert order == {("a", "b"): (0, 0), ("a", "c"): (1, 1), ("b", "c"): (2, 2)}


def test_fasta(spark, tmp_path):
    content = ">chr1 some > text\nACGT\nacgt\n\n>chr2:5-9\r\nNNNN\r\n>empty\n"
    (tmp_path / "a.fa").write_text(content)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nTT\nGG")
    rows = {r.seq_id: (r.seq, r.n) for r in readers.fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")]).collect()}
    assert rows == {"chr1": ("ACGTACGT", 8), "chr2:5-9": ("NNNN", 4), "empty": ("", 0), "z": ("TTGG", 4)}
    assert readers.check_fasta(spark, str(tmp_path / "a.fa"))


def test_round_trips(spark, table, tmp_path):
    writers.bedpe(table, str(tmp_path / "t"), single=True)
    text_file = next((tmp_path / "t").glob("*.csv")).read_text()
    assert text_file.startswith("#query_name\tquery_start") and text_file.count("\n") == 5
    assert sorted(map(tuple, readers.bedpe(spark, str(tmp_path / "t")).collect())) == sorted(ROWS)
    (tmp_path / "x.bed").write_text("# note\nchr1\t5\t9\tcen\n")
    assert [tuple(r) for r in readers.bed(spark, str(tmp_path / "x.bed"), 4).collect()] == [("chr1", 5, 9, "cen")]
    layers = spark.createDataFrame([("t", 0, 0, 1, 90.0), ("t", 1, 0, 1, 91.0)], "title string, level int, i int, j int, identity double")
    writers.pyramid(layers, spark.createDataFrame([("t", 100)], "title string, x_size long"), str(tmp_path / "p"))
    got, meta = readers.pyramid(spark, str(tmp_path / "p"))
    assert got.filter("level = 1").first().identity == 91.0 and meta.first().x_size == 100
    assert pyramid.shown(got, "t", 0).count() == 1 and [(r.level, r.x_size) for r in readers.pyramid_with_metadata(spark, str(tmp_path / "p")).collect()] == [(0, 100), (1, 100)]
    writers.view(pyramid.crop(pyramid.shown(got, "t", 0), (0, 2), (0, 1)), 50, "x", "y", str(tmp_path / "view"))
    assert [tuple(r) for r in readers.bedpe(spark, str(tmp_path / "view")).collect()] == [("y", 1, 50, "x", 51, 100, 90.0)]
    bins, pixels = identity.bins_pixels(layers.filter("level = 0"), 2, 3, 50, "x", "y")
    assert bins.count() == 5 and tuple(pixels.first()) == (0, 3, 90.0)
    (tmp_path / "c.json").write_text(json.dumps({"identity": 90, "breakpoints": [90, 95]}))
    assert readers.config(str(tmp_path / "c.json")).breakpoints == (90, 95)
    assert readers.config(str(tmp_path / "c.json"), IdentityQuery(kmer=8)).kmer == 8


def test_click_stream(spark, tmp_path):
    schema = "at timestamp, x double, y double, window long, x_name string, y_name string, identity double"
    spark.sql("SELECT timestamp'2024-01-01' AS at, 250.0D AS x, 30.0D AS y, 100L AS window, 'a' AS x_name, 'b' AS y_name, 91.0D AS identity").write.parquet(str(tmp_path / "in"))
    q = clicks.append(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r.x_start, r.x_end, r.y_start, r.y_end) == (201, 300, 1, 100)


def test_quantiles_do_not_depend_on_the_spread(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.arange(1, 20001), [1e15, 1e15, -3.5], rng.integers(0, 50, 5000), np.full(9000, 7.0)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    df = df.unionByName(spark.createDataFrame([(None,), (float("nan"),)], "v double"))
    at = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 0.99999, 1.0]
    got = {r.pos: r.value for r in frames.quantiles(df, at, "v").collect()}
    assert [got[i] for i in range(len(at))] == pytest.approx(list(np.quantile(values, at)), rel=1e-12)
    cells = ranges.placed(df.filter("v is not null and not isnan(v)"), "v", ranges.splitters(df, "v", 64)).groupBy("__cell").count().collect()
    ties = max(sum(values == 7), sum(values == 1e15))
    assert len(cells) > 40 and max(r["count"] for r in cells) <= ties + 2 * len(values) / 64


def test_quantiles_of_infinities_and_nothing(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (-inf, 1.0, 2.0, inf)], "v double")
    got = {r.pos: r.value for r in frames.quantiles(df, [0, 0.25, 0.5, 1], "v").collect()}
    assert (got[0], got[1], got[2], got[3]) == (-inf, -inf, 1.5, inf)
    assert frames.quantiles(df.filter("false"), [0.5], "v").count() == 0
    assert {r.discrete for r in frames.discretised(df.filter("false"), 5, value="v").collect()} == set()


def nearest(edges, point):
    index = min(range(len(edges)), key=lambda i: (abs(edges[i] - point), i))
    return max(index - 1, 0), index


def test_nearest_edge_of_every_point(spark):
    edges, points = [0, 100, 200], [50, 5000, -900, 150, 100, 99, 51, 50]
    rng = np.random.default_rng(2)
    for e, p in ((edges, points), (sorted(rng.choice(100000, 300, replace=False).tolist()), rng.integers(-500, 120000, 2000).tolist())):
        e_df = spark.createDataFrame(list(enumerate(e)), "edge_index int, edge long")
        p_df = spark.createDataFrame(list(enumerate(p)), "k long, point long")
        got = {r.k: (r.before, r.nearest) for r in pyramid.nearest_edges(e_df, p_df).collect()}
        assert got == {k: nearest(e, x) for k, x in enumerate(p)}
    odd = pyramid.nearest_edges(e_df, spark.createDataFrame([(None,), (3,)], "point long")).collect()
    assert len(odd) == 2 and [r.nearest for r in odd if r.point is None] == [None]
    assert [r.nearest for r in pyramid.nearest_edges(e_df.filter("false"), p_df).limit(2).collect()] == [None, None]


def test_as_of_within_few_ranges(spark):
    e = spark.createDataFrame([(10, "a"), (10, "b"), (30, "c")], "at long, name string")
    p = spark.createDataFrame([(x,) for x in (5, 10, 11, 30, 31)], "x long")
    got = {r.x: (r.prev and r.prev.name, r.next and r.next.name) for r in ranges.as_of(e, p, "at", "x", "name", cells=3).collect()}
    assert got == {5: (None, "a"), 10: ("a", "a"), 11: ("a", "c"), 30: ("c", "c"), 31: ("c", None)}


def test_dense_view(spark):
    df = spark.createDataFrame([(3, 4, 9.0), (3, 4, 8.0), (5, 6, 1.0), (9, 9, 2.0)], "i long, j long, identity double")
    got = {r.i: r.cells for r in pyramid.dense(df, (4, 7), (3, 6)).collect()}
    assert got == {3: [9.0, 0.0, 0.0], 4: [0.0] * 3, 5: [0.0, 0.0, 1.0]}
    assert {tuple(r.cells) for r in pyramid.dense(df.filter("false"), (0, 2), (0, 3)).collect()} == {(0.0, 0.0)}
    assert pyramid.dense(df, (4, 7), (3, 3)).count() == 0


def test_as_of_takes_a_step_a_row(spark):
    """No frame of a row ends with its range: such frames cost the square of a range's rows."""
    e = spark.range(300).selectExpr("id * id * 3 AS at", "id AS name")
    p = spark.range(2000).selectExpr("id * 211 - 5000 AS x")
    met = ranges.as_of(e, p, "at", "x", "name", cells=1)
    plan = met._jdf.queryExecution().analyzed().toString()
    assert "RangeFrame, currentrow$(), unboundedfollowing$()" not in plan
    edges = [3 * i * i for i in range(300)]
    before, after = {x: [i for i, v in enumerate(edges) if v <= x] for x in range(-5000, 417000, 211)}, {x: [i for i, v in enumerate(edges) if v >= x] for x in range(-5000, 417000, 211)}
    for r in met.collect():
        assert (r.prev and r.prev.name) == (before[r.x][-1] if before[r.x] else None) and (r.next and r.next.name) == (after[r.x][0] if after[r.x] else None)
