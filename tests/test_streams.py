"""The click history survives a restart; rejected rows are reported; files have their names."""

import random

import pytest
from pyspark.sql import functions as F

from seqlattice.operators import pyramid
from seqlattice.sources import readers, writers
from seqlattice.streaming import clicks

SCHEMA = "viewer string, click_id long, at timestamp, x long, y long, window long, x_name string, y_name string, identity double"


def made(seed, n, start):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), start + i, f"2024-01-01 00:{rng.randrange(60):02d}:{rng.randrange(60):02d}", rng.randrange(9000), rng.randrange(9000), 250, "p", "q", rng.random()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))


def test_history_goes_on_after_a_restart(spark, tmp_path):
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: clicks.keep_history(stream(), str(tmp_path / "out"), str(tmp_path / "state"), most=5, late="2 hours").awaitTermination()
    seen = []
    for part in range(3):
        rows = made(part, 40, 100 * part)
        seen += rows
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part == 1:  # a batch that dies after it has written a part of its rows
            calls = []

            def dies(batch, number):
                calls.append(number)
                batch.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
                raise RuntimeError("lost")

            with pytest.raises(Exception):  # noqa: B017
                clicks.newest(stream(), 5, "2 hours").writeStream.outputMode("update").foreachBatch(dies).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
            assert calls
        run()
        got = {}
        for r in clicks.history(spark, str(tmp_path / "out")).collect():
            got.setdefault(r.viewer, {})[r.place] = (r.click_id, str(r.at))
        want = {}
        for viewer in {r[0] for r in seen}:
            best = sorted((r for r in seen if r[0] == viewer), key=lambda r: (r[2], r[1]), reverse=True)[:5]
            want[viewer] = {i: (r[1], r[2]) for i, r in enumerate(best, 1)}
        assert got == want


def test_late_clicks_and_idle_viewers(spark, tmp_path):
    day = lambda d, k: ("a", k, f"2024-01-{d:02d} 00:00:00", 1, 1, 250, "p", "q", 1.0)
    run = lambda: clicks.keep_history(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), late="1 hour").awaitTermination()
    for rows in ([day(5, 1)], [day(1, 2), day(6, 3)]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert [r.click_id for r in clicks.history(spark, str(tmp_path / "out")).orderBy("place").collect()] == [3, 1]


def test_rejected_rows(spark, tmp_path):
    text = ["#query_name\tx", "a\t1\t100\ta\t1\t100\t99.5", "a\t12x\t100\ta\t1\t100\t99.5", "", "a\t1\t100", "a\t101\t200\ta\t1\t100\t90", "a\t1\t100\ta\t\t100\t90", "a\t1\t100\ta\t1\t100\t90\tmore"]
    (tmp_path / "p.bedpe").write_text("\n".join(text) + "\n")
    good, bad = readers.bedpe_checked(spark, str(tmp_path / "p.bedpe"))
    assert sorted(r.query_start for r in good.collect()) == [1, 101] and good.columns == readers.BEDPE.names
    assert {(r.line, r.text) for r in bad.collect()} == {(i + 1, text[i]) for i in (2, 4, 6, 7)} and all(r.file.endswith("p.bedpe") for r in bad.collect())
    (tmp_path / "a.bed").write_text("# c\nchr1\t5\t9\tn\nchr1\tx\t9\tn\nchr1\t\t9\tn\n")
    good, bad = readers.bed_checked(spark, str(tmp_path / "a.bed"), 4)
    assert [(r.start, r.end) for r in good.collect()] == [(5, 9)] and sorted(r.line for r in bad.collect()) == [3, 4]
    for read in (lambda: readers.bedpe(spark, str(tmp_path / "p.bedpe")), lambda: readers.bed(spark, str(tmp_path / "a.bed"), 4)):
        with pytest.raises(Exception):  # noqa: B017
            read().collect()


def test_lines_of_rejects_in_many_ranges(spark, tmp_path):
    rows = [f"s\t{i}{'x' if i % 37 == 0 else ''}\t{i + 1}\ts\t1\t2\t90" for i in range(400)]
    (tmp_path / "p.bedpe").write_text("\n".join(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        _, bad = readers.bedpe_checked(spark, str(tmp_path / "p.bedpe"))
        assert sorted(r.line for r in bad.collect()) == [i + 1 for i in range(0, 400, 37)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_named_files(spark, tmp_path):
    rows = [(a, i, i + 9, b, j, j + 9, 90.0) for a, b in (("x", "x"), ("x", "y/z"), ("é b", "é b")) for i in (21, 1, 11) for j in (31, 1)]
    df = spark.createDataFrame(rows, readers.BEDPE)
    for layout in (df.repartition(5), df.coalesce(1)):  # a second run replaces the first
        writers.bedpe_files(layout, str(tmp_path / "out"))
        files = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.bedpe")}
        assert set(files) == {"x/x.bedpe", "x_y_z/x_y_z_COMPARE.bedpe", "é b/é b.bedpe"} and not list((tmp_path / "out").glob(".tmp*"))
        want = [f"x\t{i}\t{i + 9}\tx\t{j}\t{j + 9}\t90.0" for i in (1, 11, 21) for j in (1, 31)]
        assert files["x/x.bedpe"].splitlines() == ["\t".join(["#query_name", *readers.BEDPE.names[1:]]), *want]


def test_tiles_of_a_view(spark, tmp_path):
    import pyarrow.parquet as pq

    side = 600
    cells = spark.range(side * side).select(F.lit("t").alias("title"), F.lit(0).alias("level"), F.floor(F.col("id") / side).alias("i"), (F.col("id") % side).alias("j"), (F.col("id") % 97 + 1.0).alias("identity"))
    writers.pyramid(cells.repartition(7), spark.createDataFrame([("t", side)], "title string, x_size long"), str(tmp_path), tile=16, row_group=1 << 15, rows_per_file=100_000)
    layers, _ = readers.pyramid(spark, str(tmp_path))
    view = pyramid.crop(pyramid.shown(layers, "t", 0), (100, 160), (300, 360))
    assert view.count() == 3600
    touched = total = 0
    files = list((tmp_path / "layers").rglob("*.parquet"))
    for path in files:
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            total += group.total_byte_size
            i, j = stats["i"], stats["j"]
            touched += group.total_byte_size * (i.max >= 300 and i.min < 360 and j.max >= 100 and j.min < 160)
    assert len(files) > 3 and touched < 0.05 * total
    assert "PushedFilters: [IsNotNull(i), IsNotNull(j), GreaterThanOrEqual(i,300)" in view._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_curve_keeps_every_cell_apart(spark):
    df = spark.range(64 * 64).select(F.floor(F.col("id") / 64).alias("i"), (F.col("id") % 64).alias("j"))
    z = [r.z for r in df.select(pyramid.z_order(F.col("i"), F.col("j")).alias("z")).collect()]
    assert sorted(z) == list(range(64 * 64))
    assert spark.range(1).select(pyramid.z_order(F.lit(2**31 - 1), F.lit(0))).first()[0] == int("10" * 31, 2)
