import pytest

import naive
from seqlattice import __main__ as cli
from seqlattice.plans.params import IdentityQuery
from seqlattice.plans.run import interactive, load, plot_frames, save, static
from seqlattice.sources import readers, writers
from test_identity import sequence


@pytest.fixture
def seqs(spark, tmp_path):
    (tmp_path / "s.fa").write_text(f">one\n{sequence(3)}\n>two:101-2000\n{sequence(3)[150:]}\n")
    return readers.fasta(spark, str(tmp_path / "s.fa"))


def test_static(seqs):
    query = IdentityQuery(window=100, compare=True)
    rows = static(seqs, query).collect()
    one, two = sequence(3), sequence(3)[150:]
    own = {((r.query_start - 1) // 100, (r.reference_start - 1) // 100): round(r.perID_by_events, 6) for r in rows if r.query_name == r.reference_name == "one"}
    assert own == naive.self_pairs(one, 100, 21, 86, 0.5)
    cross = {((r.query_start - 1) // 100, (r.reference_start - 101) // 100): round(r.perID_by_events, 6) for r in rows if r.query_name != r.reference_name}
    assert cross == naive.cross_pairs(one, two, 100, 21, 86, 0.5) and cross
    assert all(r.query_end - r.query_start == 99 for r in rows)


def test_region(seqs):
    rows = static(seqs, IdentityQuery(window=50, region=("one:201-900", "two:1-999999"))).filter("query_name = 'one'").collect()
    got = {((r.query_start - 201) // 50, (r.reference_start - 201) // 50): round(r.perID_by_events, 6) for r in rows}
    assert got == naive.self_pairs(sequence(3)[200:900], 50, 21, 86, 0.5)
    named = static(seqs, IdentityQuery(window=50, region=("two:151-450",))).filter("title like 'two%'").collect()
    assert {((r.query_start - 151) // 50, (r.reference_start - 151) // 50): round(r.perID_by_events, 6) for r in named} == naive.self_pairs(sequence(3)[200:500], 50, 21, 86, 0.5)


def test_interactive(seqs):
    layers, meta = interactive(seqs, IdentityQuery(resolution=10, compare=True))
    titles = {r.title: (r.x_size >= r.y_size, list(r.sparsities)) for r in meta.collect()}
    assert len(titles) == 3 and all(ok for ok, _ in titles.values())
    assert {r.level for r in layers.select("level").distinct().collect()} == set(range(len(next(iter(titles.values()))[1])))


def test_compare_only_needs_two(seqs):
    with pytest.raises(ValueError):
        static(seqs.filter("seq_id = 'one'"), IdentityQuery(compare_only=True, window=50))


def test_input_order(spark, tmp_path):
    sizes = {"small": 1, "big": 900, "mid": 30}
    for name, n in sizes.items():
        (tmp_path / f"{name} +.fa").write_text(f">{name}\n" + "ACGTTGCA\n" * n + f">again\n{'A' * n}\n")
    seqs = readers.fasta(spark, [str(tmp_path / f"{name} +.fa") for name in sizes])
    rows = seqs.orderBy("seq_ord").select("seq_id", "n").collect()
    assert [r.seq_id for r in rows] == ["small", "again", "big", "again", "mid", "again"] and [r.n for r in rows][1::2] == [1, 900, 30]
    assert [r.seq_id for r in readers.fasta_headers(spark, str(tmp_path)).orderBy("seq_ord").collect()] == ["big", "again", "mid", "again", "small", "again"]


def test_sequences_of_one_name_stay_apart(spark, tmp_path):
    a, b = sequence(3), sequence(8)
    (tmp_path / "s.fa").write_text(f">x\n{a}\n>x\n{b}\n>tiny\nACGTACGTACGTACGTACGTACGTA\n")
    rows = static(readers.fasta(spark, str(tmp_path / "s.fa")), IdentityQuery(resolution=10)).collect()
    windows = [-(-(len(x) - 20) // 10) for x in (a, b)]
    expected = sum(len(naive.self_pairs(x, w, 21, 86, 0.5)) for x, w in zip((a, b), windows))
    assert len(rows) == expected and {r.query_name for r in rows} == {"x"}
    with pytest.raises(ValueError):
        static(readers.fasta(spark, str(tmp_path / "s.fa")).filter("seq_id = 'tiny'"), IdentityQuery(resolution=10))


def test_saved_run(spark, seqs, tmp_path):
    query = IdentityQuery(window=100, compare=True, grid=True, breakpoints=(86.0, 90.0, 95.0, 100.0), colors=("#111111", "#222222", "#333333"), output_dir=str(tmp_path / "out"))
    table = static(seqs, query)
    save(table, query)
    read = lambda name: spark.read.parquet(f"{query.output_dir}/{name}")
    n, own = table.count(), table.filter("query_name = reference_name")
    both = own.filter("query_start <> reference_start").count()
    assert read("tiles").count() == n + both and read("grid").count() == 1
    assert {r.color for r in read("tiles").collect()} <= set(query.colors)
    assert sum(r.n for r in read("histogram").collect()) == n
    axes = {r.title: r for r in read("axes").collect()}
    assert set(axes) == {"one", "two:101-2000", "one_two:101-2000"} and all(5 <= len(r.ticks) - 1 <= 9 for r in axes.values())
    one = f"{query.output_dir}/pairs/title=one"
    loaded = load(spark, one)
    assert sorted(map(tuple, loaded.collect())) == sorted((*r[1:], r[0]) for r in own.filter("title = 'one'").collect())
    assert set(plot_frames(loaded, IdentityQuery(bin_freq=True))) == {"tiles", "triangle", "histogram", "axes"}
    writers.bedpe(table.drop("title"), str(tmp_path / "mixed"), single=True)
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "mixed"))


def test_command_line(spark, tmp_path):
    (tmp_path / "s.fa").write_text(f">one\n{sequence(3)}\n>two\n{sequence(3)[150:]}\n")
    (tmp_path / "a.bed").write_text("one\t5\t90\tcen\none\t999999\t1000000\tfar\nother\t5\t9\tx\n")
    (tmp_path / "c.json").write_text('{"window": 100, "identity": 80, "dpi": 300}')
    out = str(tmp_path / "out")
    args = ["static", "--fasta", str(tmp_path / "s.fa"), "--compare", "--bed", str(tmp_path / "a.bed"), "--output-dir", out, "-c", str(tmp_path / "c.json")]
    which, options = cli.query(args)
    assert which == "static" and (options.window, options.identity, options.compare, options.kmer) == (100, 80, True, 21)
    cli.main(args)
    assert [r.name for r in spark.read.parquet(f"{out}/annotation").collect()] == ["cen"]
    rows = spark.read.parquet(f"{out}/triangle").filter("q = 'one'").collect()
    assert len(rows) == len(naive.self_pairs(sequence(3), 100, 21, 80, 0.5))
    cli.main(["interactive", "--fasta", str(tmp_path / "s.fa"), "--resolution", "10", "--output-dir", out])
    assert {r.title for r in readers.pyramid_with_metadata(spark, f"{out}/pyramid").select("title").collect()} == {"one", "two"}
    cli.main(["static", "--load", f"{out}/pairs/title=one", "--output-dir", str(tmp_path / "again")])
    assert spark.read.parquet(str(tmp_path / "again" / "axes")).count() == 1
