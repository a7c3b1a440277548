"""FASTA in byte ranges: records in pieces, whatever the ranges are."""

import random

import pytest

import naive
from seqlattice.operators import identity
from seqlattice.sources import readers
from test_identity import sequence


@pytest.fixture
def ranges(spark):
    """Cuts files into ranges of so many bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}

    def set_to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield set_to
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(k)
    for k, v in before.items():
        spark.conf.set(k, v)


def records(seed):
    rng = random.Random(seed)
    bases = lambda n: "".join(rng.choice("ACGTacgtN") for _ in range(n))
    return [(f"r{i}", bases(rng.choice([0, 1, 3, 4, 7, 20, 21, 64, 300, 900]))) for i in range(25)]


def written(path, found, width, rng):
    lines = ["; no record"] if rng.random() < 0.3 else []
    for name, seq in found:
        lines.append(f">{name} described > so")
        lines += [seq[i : i + width] + rng.choice(["", " ", "\r"]) for i in range(0, len(seq), width)] + [""] * rng.randrange(2)
    path.write_text("\n".join(lines) + "\n", newline="")


@pytest.mark.parametrize(("k", "size", "width", "cut"), [(5, 16, 7, 40), (21, 64, 60, 100), (5, 50, 13, 10**6), (12, 10, 1, 30), (2, 3, 5, 64)])
def test_pieces(spark, tmp_path, ranges, k, size, width, cut):
    rng, files = random.Random(k), {}
    for name in ("b.fa", "a.fa"):
        files[name] = records(len(files) + k)
        written(tmp_path / name, files[name], width, rng)
    ranges(cut)
    rows = readers.fasta_pieces(spark, [str(tmp_path / n) for n in files], k, size).orderBy("seq_ord", "off").collect()
    got = {}
    for r in rows:
        assert len(r.piece) <= size + k - 1
        kmers = got.setdefault((r.file.rsplit("/", 1)[1], r.seq_id), {})
        text = bytes(r.piece).decode()
        for i in range(len(text) - k + 1):
            assert r.off + i not in kmers, "a k-mer is in two pieces"
            kmers[r.off + i] = text[i : i + k]
    lengths = {(r.file.rsplit("/", 1)[1], r.seq_id): r.length for r in rows}
    expected = {(n, record): {i: seq.upper()[i : i + k] for i in range(len(seq) - k + 1)} for n, found in files.items() for record, seq in found if len(seq) >= k}
    assert got == expected and lengths == {key: len(dict(files[key[0]])[key[1]]) for key in expected}
    order = list(dict.fromkeys((r.file.rsplit("/", 1)[1], r.seq_id) for r in rows))
    assert order == [(n, record) for n, found in files.items() for record, seq in found if len(seq) >= k]


def test_identity_of_pieces(spark, tmp_path, ranges):
    seqs = {"x": sequence(3), "y": sequence(4, 90, 8)}
    (tmp_path / "s.fa").write_text("".join(f">{n}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in seqs.items()))
    ranges(200)
    pieces = readers.fasta_pieces(spark, str(tmp_path / "s.fa"), 21, 128).select("seq_id", "off", "piece", "length")
    assert pieces.rdd.getNumPartitions() > 3
    for ambiguous in (False, True):
        got = {(r.seq_id, r.i, r.j): round(r.identity, 6) for r in identity.self_identity(pieces, 100, 21, 86, 0.5, 1, ambiguous).collect()}
        assert got == {(n, *key): v for n, s in seqs.items() for key, v in naive.self_pairs(s, 100, 21, 86, 0.5, 1, ambiguous).items()}


def test_pieces_of_little(spark, tmp_path):
    (tmp_path / "none.fa").write_text("ACGT\n")
    (tmp_path / "short.fa").write_text(">a\nAC\n>\nACGTACGT\n>b")
    assert readers.fasta_pieces(spark, str(tmp_path / "none.fa"), 3).count() == 0
    assert readers.fasta_pieces(spark, str(tmp_path / "short.fa"), 3).count() == 0
    assert [r.seq_id for r in readers.fasta_pieces(spark, str(tmp_path / "short.fa"), 2).collect()] == ["a"]


def test_compressed_pieces(spark, tmp_path):
    import gzip

    seq = sequence(5)
    with gzip.open(tmp_path / "s.fa.gz", "wt") as f:
        f.write(f">z\n{seq}\n")
    rows = readers.fasta_pieces(spark, str(tmp_path / "s.fa.gz"), 21, 100).orderBy("off").collect()
    assert "".join(bytes(r.piece).decode()[:100] for r in rows) == seq.upper() and {r.length for r in rows} == {len(seq)}


def test_rows_of_kmers_stay_in_their_task(spark):
    """The query's groups are pieces: no distinct places, so no row for each k-mer, are shuffled."""
    from seqlattice.queries import fasta_pieces

    plan = fasta_pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and "Expand" not in plan and "[seq_id#" in plan and "off#" in plan.split("Aggregate [", 2)[2].split("]")[0]


@pytest.mark.parametrize(("k", "size", "width", "cut"), [(5, 16, 7, 300), (21, 64, 60, 10**6), (12, 10, 1, 30)])
def test_records_that_do_not_wait(spark, tmp_path, ranges, monkeypatch, k, size, width, cut):
    """Records beyond what waits for their end are put together by the table, also those within a range."""
    monkeypatch.setattr(readers, "HELD", 1)
    test_pieces(spark, tmp_path, ranges, k, size, width, cut)


def test_kmers_of_pieces_are_no_rows(spark):
    """Hashes are added up where a piece is; a file is read for the table of ranges and for the pieces, by no further scan."""
    from seqlattice.queries import fasta_pieces

    plan = fasta_pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan and plan.count("MapInArrow") == 2


def test_query_of_odd_texts(spark, tmp_path):
    from seqlattice.functions.kmers import murmur3_int
    from seqlattice.queries import ALPHABET, BASES, fasta_pieces

    rng = random.Random(1)
    texts = [None, "", "Été > 12\n>x", *("".join(rng.choice(ALPHABET + ALPHABET.upper() + " \n>ß漢") for _ in range(n)) for n in (6, 12, 60, 640, 660, 3000))]
    rows = [*enumerate(texts), (8, texts[8])]  # one of them twice
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    expected = {}
    for key, text in rows:
        seq = "".join(BASES[ALPHABET.index(c.lower())] for c in text or "" if c.isascii() and c.isalpha())
        words = [seq[i : i + 8] for i in range(len(seq) - 7)]
        h = [min(murmur3_int(w.encode()), murmur3_int(w[::-1].translate(str.maketrans("ACGT", "TGCA")).encode())) for w in words]
        if h:
            _, c, _, total, placed = expected.get(key, (0, 0, 0, 0, 0))
            expected[key] = (len(seq), c + len(h), len(h), total + sum(h), placed + sum(x * (i % 1000) for i, x in enumerate(h)))
    assert {r.seq_id: tuple(r)[1:] for r in fasta_pieces(spark, str(tmp_path)).collect()} == expected
