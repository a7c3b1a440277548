"""Whole runs: from sequences or saved tables and options to pair tables, pyramids and plot frames.

A run is one plan however many sequences it has: windows and sparsities are
columns that follow from each sequence's length, and pairs of sequences come
from a join. The driver receives no names; only a viewer's run, which shows two
sequences at most, looks at their lengths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import frames, identity, pyramid
from ..sources import readers, writers
from .params import IdentityQuery, pyramid_plan, static_columns, tick_column

#: The viewer shows two sequences at most.
VIEWED = 2


def parts(seqs: DataFrame, query: IdentityQuery) -> DataFrame:
    """What to compare: ``ord`` (sorts in input order, or longest first), ``seq_id, seq, n`` and ``start`` (of the first base in the output).

    A region is asked for by the sequence's name, in places of the sequence, or by the name's chromosome where the
    name itself carries a region, in places of that chromosome. Every region inside its sequence gives one part; a
    sequence without one is whole.
    """
    own = text.region(F.col("seq_id"))
    df = seqs.withColumns({"__own": own, "__first": F.coalesce(own["start"], F.lit(1).cast("long"))})
    cut = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    if query.region:
        asked = F.array(*(text.region(F.lit(r)) for r in query.region))

        def place(r: Column) -> Column:
            shift = F.col("__first") - 1
            inside = F.when(r["chrom"] == F.col("seq_id"), cut(r["start"], r["end"])).when(r["chrom"] == F.col("__own.chrom"), cut(r["start"] - shift, r["end"] - shift))
            return F.when((inside["lo"] >= 1) & (inside["lo"] <= inside["hi"]) & (inside["hi"] <= F.col("n")), inside)

        cuts = F.array_compact(F.transform(asked, place))
        cuts = F.when(F.size(cuts) > 0, cuts).otherwise(F.array(cut(F.lit(1).cast("long"), F.col("n"))))
    else:
        cuts = F.array(cut(F.lit(1).cast("long"), F.col("n")))
    df = df.select("seq_ord", "seq_id", "seq", "__first", F.posexplode(cuts).alias("__part", "__cut"))
    n = F.col("__cut.hi") - F.col("__cut.lo") + 1
    rank = -n if query.compare_order == "size" else F.lit(0).cast("long")
    return df.select(
        F.struct(rank.alias("rank"), "seq_ord", F.col("__part").alias("part")).alias("ord"), "seq_id",
        F.substring("seq", F.col("__cut.lo").cast("int"), n.cast("int")).alias("seq"), n.alias("n"), (F.col("__first") + F.col("__cut.lo") - 1).alias("start"),
    )


def _options(query: IdentityQuery) -> dict:
    return {"k": query.kmer, "identity": query.identity, "delta": query.delta, "ambiguous": query.ambiguous}


def planned(found: DataFrame, query: IdentityQuery) -> DataFrame:
    """Parts with ``window`` and ``sparsity``; those too short for a window of the least size are left out."""
    plan = static_columns(F.col("n"), query.kmer, query.modimizer, query.resolution, query.window)
    return found.withColumns({c: plan[c] for c in ("window", "sparsity", "fits")}).filter("fits").drop("fits")


def static(seqs: DataFrame, query: IdentityQuery) -> DataFrame:
    """Pair table of every sequence with itself and, if asked for, of every pair: the format's columns and ``title``.

    A pair's window comes from its second sequence. Sequences too short for a window of the least size are left out;
    if all are, or a comparison has less than two, the run fails.
    """
    ready = planned(parts(seqs, query), query)
    least = 2 if query.compare_only else 1
    if len(ready.select(F.lit(1)).limit(least).collect()) < least:
        raise ValueError("a comparison needs two sequences" if query.compare_only else "no sequence is long enough for a window; lower the resolution")
    tables = []
    if not query.compare_only:
        pairs = identity.self_identity(ready, "window", sparsity="sparsity", **_options(query))
        name = F.col("seq_id")
        tables.append(identity.bedpe(pairs.withColumn("title", name), F.col("window"), name, name, F.col("start"), F.col("start"), ("title",)))
    if query.compare or query.compare_only:
        # Each sequence as a query is windowed once for every window that a later sequence has.
        sizes = ready.groupBy("window", "sparsity").agg(F.max("ord").alias("latest")).agg(F.collect_list(F.struct("latest", "window", "sparsity")).alias("__ws"))
        found = parts(seqs, query).join(F.broadcast(sizes))  # one row, an entry for each size of window
        mine = found.withColumn("__w", F.explode(F.filter("__ws", lambda x: x["latest"] > F.col("ord")))).select("ord", "seq_id", "seq", "n", "start", "__w.window", "__w.sparsity")
        pairs = identity.pair_identity(mine, ready, "window", sparsity="sparsity", on=("window", "sparsity"), only=F.col("q_ord") < F.col("r_ord"), prune=False, **_options(query))
        title = F.concat_ws("_", "q_id", "r_id")
        tables.append(identity.bedpe(pairs.withColumn("title", title), F.col("window"), F.col("q_id"), F.col("r_id"), F.col("q_start"), F.col("r_start"), ("title",)))
    return reduce(DataFrame.unionByName, tables)


def _titled(table: DataFrame) -> DataFrame:
    same = F.col("query_name") == F.col("reference_name")
    return table.withColumn("title", F.when(same, F.col("query_name")).otherwise(F.concat_ws("_", "query_name", "reference_name")))


def load(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Saved pair tables as those of :func:`static`; every file must hold one query and one reference and more than one row."""
    table = readers.bedpe(spark, paths)
    named = table.groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("query_name").alias("q"), F.countDistinct("reference_name").alias("r"), F.count(F.lit(1)).alias("n"))
    wrong = named.filter("q <> 1 or r <> 1 or n < 2").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0].file} does not hold more than one row of one query and one reference")
    return _titled(table)


def plot_frames(pairs: DataFrame, query: IdentityQuery) -> dict[str, DataFrame]:
    """Frames to draw from a table of :func:`static` or :func:`load`: ``tiles`` (both halves of self maps, with colours),
    ``triangle``, ``histogram`` (by title and colour), ``axes`` (limits and ticks by title) and, with ``bed``, ``annotation``
    (rows that touch what a plot of their chromosome shows)."""
    colors = text.resolve_palette(query.palette, query.palette_orientation, query.colors)
    shades = F.array(*(F.lit(c) for c in colors))
    colored = frames.discretised(pairs, len(colors), query.bin_freq, list(query.breakpoints) or None).withColumn("color", F.get(shades, "discrete"))
    own = F.col("query_name") == F.col("reference_name")
    tiles = frames.mirrored(colored.filter(own)).unionByName(frames.renamed(colored.filter(~own)))
    limits = frames.renamed(pairs).groupBy("title").agg(F.least(F.min("q_st"), F.min("r_st")).alias("axis_min"), F.greatest(F.max("q_en"), F.max("r_en")).alias("axis_max"))
    if query.axes_limits:
        limits = limits.withColumn("axis_max", F.lit(query.axes_limits).cast("long"))
    if query.axes_ticks:
        steps = F.array(*(F.lit(float(t)) for t in query.axes_ticks))
    else:
        steps = tick_column(F.col("axis_min"), F.col("axis_max"))
    limits = limits.withColumns({"ticks": steps, "unit": text.unit(F.col("axis_max"))})
    made = {
        "tiles": tiles, "triangle": frames.triangle(colored.filter(own)),
        "histogram": frames.histogram(colored, by=("title", "discrete")), "axes": limits,
    }
    if query.bed:
        seen = limits.select(text.stem(F.col("title")).alias("chrom"), F.col("axis_min").alias("region_start"), F.col("axis_max").alias("region_end")).distinct()
        made["annotation"] = frames.overlap_join(readers.bed(pairs.sparkSession, query.bed), seen)
    return made


def save(pairs: DataFrame, query: IdentityQuery) -> None:
    """Pair tables and plot frames under the run's ``output_dir``; with ``grid_only`` those of pairs of sequences only."""
    if not query.output_dir:
        raise ValueError("a run that is saved needs output_dir")
    if query.grid_only:
        pairs = pairs.filter(F.col("query_name") != F.col("reference_name"))
    saved = pairs
    if not query.no_bedpe:  # frames are made from the table as saved, so that pairs are computed once
        writers.bedpe_by_title(pairs, f"{query.output_dir}/pairs")
        saved = _titled(readers.bedpe(pairs.sparkSession, f"{query.output_dir}/pairs"))
    made = plot_frames(saved, query)
    if query.grid or query.grid_only:
        names = saved.filter(F.col("query_name") != F.col("reference_name")).select(F.col("query_name").alias("query"), F.col("reference_name").alias("reference"))
        made["grid"] = names.distinct()
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{query.output_dir}/{name}")


def interactive(seqs: DataFrame, query: IdentityQuery) -> tuple[DataFrame, DataFrame]:
    """Pyramid layers and metadata of the first two sequences, and of the pair (longer as x) if asked for; saved under ``output_dir`` if that is set."""
    spark = seqs.sparkSession
    found = parts(seqs, query)
    rows = found.select("ord", "seq_id", "n").orderBy("ord").limit(VIEWED).collect()
    if not rows:
        raise ValueError("no sequences")
    if query.compare_only and len(rows) < 2:
        raise ValueError("a comparison needs two sequences")
    layers = pyramid_plan(max(r.n for r in rows), query.modimizer, query.resolution, query.window, query.quick)
    if not layers:
        raise ValueError("the least window exceeds the largest; raise the resolution")
    titles = [r.seq_id for r in rows] if len({r.seq_id for r in rows}) == len(rows) else [f"{r.seq_id}_{i + 1}" for i, r in enumerate(rows)]
    named = found.join(F.broadcast(spark.createDataFrame([(r.ord, t) for r, t in zip(rows, titles)], found.select("ord").schema.add("title", "string"))), "ord")  # two rows
    viewed = named.select("title", "seq_id", "seq")
    tables, meta = [], []

    def add(title: str, x, y, own: bool) -> None:
        meta.append((x.seq_id, y.seq_id, x.n, y.n, own, layers[0][0], layers[-1][0], query.resolution, query.kmer, title, [s for _, s in layers]))

    def of(title: str) -> DataFrame:
        return viewed.filter(F.col("title") == title).drop("title")

    if not query.compare_only:
        tables.append(pyramid.build(viewed, layers, **_options(query)).select("title", "level", "window", "i", "j", "identity"))
        for r, t in zip(rows, titles):
            add(t, r, r, True)
    if (query.compare or query.compare_only) and len(rows) == VIEWED:
        x, y = (0, 1) if rows[0].n > rows[1].n else (1, 0)
        title = f"{titles[x]}_{titles[y]}"
        built = pyramid.build(of(titles[y]), layers, of(titles[x]), **_options(query))
        tables.append(built.select(F.lit(title).alias("title"), "level", "window", "i", "j", "identity"))
        add(title, rows[x], rows[y], False)
    schema = "x_name string, y_name string, x_size long, y_size long, self boolean, min_window_size int, max_window_size int, resolution int, kmer_length int, title string, sparsities array<int>"
    out, metadata = reduce(DataFrame.unionByName, tables), spark.createDataFrame(meta, schema)
    if query.output_dir:
        writers.pyramid(out, metadata, f"{query.output_dir}/pyramid")
        return readers.pyramid(spark, f"{query.output_dir}/pyramid")
    return out, metadata


def execute(spark: SparkSession, query: IdentityQuery, viewer: bool = False) -> None:
    """A whole run: from ``fasta`` or ``load`` to everything under ``output_dir``."""
    if query.load:
        if viewer:
            raise ValueError("a saved pyramid is read by sources.readers.pyramid")
        save(load(spark, list(query.load)), query)
        return
    if not query.fasta or not query.output_dir:
        raise ValueError("a run needs fasta or load, and output_dir")
    seqs = readers.fasta(spark, list(query.fasta))
    if viewer:
        interactive(seqs, query)
    else:
        save(static(seqs, query), query)
