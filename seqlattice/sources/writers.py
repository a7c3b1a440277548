"""Writers: pair tables, contact maps, pyramids, click logs."""

from __future__ import annotations

import re
import urllib.parse
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identity
from ..operators.pyramid import z_order


def bedpe(df: DataFrame, path: str, single: bool = False) -> None:
    """Tab-separated rows in row-major order under the format's header.

    Ordered by range over all partitions; ``single`` makes one file of them.
    """
    out = df.withColumnRenamed("query_name", "#query_name")
    out = out.coalesce(1).sortWithinPartitions("query_start", "reference_start") if single else out.orderBy("query_start", "reference_start")
    out.write.mode("overwrite").option("comment", "\x01").csv(path, sep="\t", header=True)  # else "#" would be quoted


def bedpe_by_title(df: DataFrame, path: str) -> None:
    """One folder of tab-separated files for each title, each file in row-major order under the format's header. Large titles have several files."""
    out = df.withColumnRenamed("query_name", "#query_name")
    out = out.repartitionByRange("title", "query_start", "reference_start").sortWithinPartitions("title", "query_start", "reference_start")
    out.write.mode("overwrite").partitionBy("title").option("comment", "\x01").csv(path, sep="\t", header=True)


def bedpe_files(pairs: DataFrame, path: str) -> None:
    """One named file for each pair of names: ``<name>/<name>.bedpe``, or ``<a>_<b>/<a>_<b>_COMPARE.bedpe``, rows in row-major order under the header.

    A file is a whole, so one task sorts (on disk if need be) and writes each pair of names; different ones are written
    by different tasks. Files get their names by renaming once everything is written, so a task that fails or runs twice
    leaves nothing behind, and a file of an earlier run is replaced in one step.
    """
    spark, temporary = pairs.sparkSession, f"{path}/.tmp-{uuid.uuid4().hex}"
    key = ["query_name", "reference_name"]
    out = pairs.withColumns({"__a": F.col(key[0]), "__b": F.col(key[1])}).repartition("__a", "__b")
    out = out.sortWithinPartitions("__a", "__b", "query_start", "reference_start").withColumnRenamed("query_name", "#query_name")
    out.write.partitionBy("__a", "__b").option("comment", "\x01").option("maxRecordsPerFile", 0).csv(temporary, sep="\t", header=True)
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(temporary)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    context = hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf())
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    named = lambda p: urllib.parse.unquote(p.getName().split("=", 1)[1])
    for parent in (s.getPath() for s in fs.listStatus(top) if s.isDirectory()):
        for folder in (s.getPath() for s in fs.listStatus(parent) if s.isDirectory()):
            a, b = named(parent), named(folder)
            title = _safe(a) if a == b else f"{_safe(a)}_{_safe(b)}"
            (part,) = (s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
            fs.mkdirs(hadoop.Path(f"{path}/{title}"))
            context.rename(part, hadoop.Path(f"{path}/{title}/{title}{'' if a == b else '_COMPARE'}.bedpe"), overwrite)
    fs.delete(top, True)


def _safe(name: str) -> str:
    """A name as part of a path."""
    return re.sub(r"[/\\:]", "_", name)


def view(layer: DataFrame, window: int, x_name: str, y_name: str, path: str, x_offset: int = 1, y_offset: int = 1) -> None:
    """A layer, or what a view shows of it, as a pair table: rows are y, columns x, cells without a value are left out."""
    pairs = layer.filter(F.col("identity") > 0)
    bedpe(identity.bedpe(pairs, window, F.lit(y_name), F.lit(x_name), y_offset, x_offset), path)


def contact_map(bins: DataFrame, pixels: DataFrame, path: str) -> None:
    bins.write.mode("overwrite").parquet(f"{path}/bins")
    pixels.write.mode("overwrite").parquet(f"{path}/pixels")


def pyramid(layers: DataFrame, metadata: DataFrame, folder: str, tile: int = 64, row_group: int = 1 << 18, rows_per_file: int = 4_000_000) -> None:
    """Layers by title and level, in square tiles along a space-filling curve, so that a view finds its cells in few row groups.

    Ranges of the curve are spread over tasks, so a large level is written by many and has several files, of
    ``rows_per_file`` at most; ``row_group`` is in bytes.
    """
    place = z_order(F.floor(F.col("i") / tile), F.floor(F.col("j") / tile))
    ordered = layers.withColumn("__z", place).repartitionByRange("title", "level", "__z").sortWithinPartitions("title", "level", "__z", "i", "j").drop("__z")
    out = ordered.write.mode("overwrite").partitionBy("title", "level").option("parquet.block.size", row_group).option("maxRecordsPerFile", rows_per_file)
    out.parquet(f"{folder}/layers")
    metadata.write.mode("overwrite").parquet(f"{folder}/metadata")


def click_log(clicks: DataFrame, path: str, most: int = 100) -> None:
    """The newest clicks as comma-separated text."""
    clicks.orderBy(F.desc("at")).limit(most).coalesce(1).write.mode("overwrite").csv(path, header=True)
