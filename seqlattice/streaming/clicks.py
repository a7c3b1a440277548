"""Viewer clicks as a stream: interval rows, and each viewer's newest ones kept as state."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Executors need not have the library installed: functions are shipped with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Clicks of a viewer that are kept.
NEWEST = 100
KEPT = "click_id long, micros long, x_name string, x_start long, x_end long, y_name string, y_start long, y_end long, identity double"


def intervals(clicks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each click (x, y, window, names, identity) as a row of both intervals; works on streams and tables. Columns ``keep`` come first."""
    span = lambda c: F.floor(F.col(c) / F.col("window")) * F.col("window")
    return clicks.select(*keep, "at", F.col("x_name"), (span("x") + 1).alias("x_start"), (span("x") + F.col("window")).alias("x_end"), F.col("y_name"), (span("y") + 1).alias("y_start"), (span("y") + F.col("window")).alias("y_end"), "identity")


def append(clicks: DataFrame, path: str, checkpoint: str):
    """Append a click stream's interval rows to a Parquet log; exactly once through the checkpoint."""
    return intervals(clicks).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(clicks: DataFrame, most: int = NEWEST, late: str = "1 hour", idle: int | None = None) -> DataFrame:
    """Of a stream of clicks with ``viewer`` and ``click_id``, the ``most`` newest interval rows of each viewer that a batch has
    touched, with their ``place`` (1 is the newest; equal times go to the greater id).

    The rows are the viewer's state: ``most`` of them at most, in the state store of the checkpoint, so a query that
    starts again goes on where it was. Clicks later than the watermark (``late``) are left out; a viewer without clicks
    for ``idle`` seconds of event time is forgotten (never, by default). A null viewer is one of its own.
    """
    fields = [c.split() for c in KEPT.split(", ")]
    names, state = [c for c, _ in fields], ", ".join(f"{c} array<{t}>" for c, t in fields)

    def update(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        rows: list[tuple[Any, ...]] = list(zip(*kept.get, strict=True)) if kept.exists else []
        for batch in batches:
            rows += list(batch[names].itertuples(index=False, name=None))
            rows = sorted(rows, key=lambda r: (-r[1], -r[0]))[:most]
        columns = list(zip(*rows, strict=True))
        kept.update(tuple([None if v != v else v for v in c] for c in columns))
        if idle is not None:
            kept.setTimeoutTimestamp(max(rows[0][1] // 1000 + 1000 * idle, kept.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(dict(zip(names, columns, strict=True)))
        yield out.assign(viewer=key[0], place=range(1, len(out) + 1))[["viewer", "place", *names]]

    rows = intervals(clicks.withWatermark("at", late), ("viewer", "click_id")).withColumn("micros", F.unix_micros("at"))
    found = rows.groupBy("viewer").applyInPandasWithState(update, f"viewer string, place int, {KEPT}", state, "update", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("at", F.timestamp_micros("micros")).drop("micros")


def keep_history(clicks: DataFrame, path: str, checkpoint: str, most: int = NEWEST, late: str = "1 hour", idle: int | None = None):
    """Write each viewer's newest clicks as they change. A batch that is run again replaces its own folder, so a restart repeats nothing."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = newest(clicks, most, late, idle).writeStream.outputMode("update")
    return stream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, path: str) -> DataFrame:
    """The newest clicks of every viewer: the rows of the last batch that touched it."""
    found = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = F.max("batch").over(Window.partitionBy("viewer"))
    return found.withColumn("__last", last).filter(F.col("batch") == F.col("__last")).drop("batch", "__last")
