"""Shared helpers: durable intermediate tables, the held-out split, word rules."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java/DuckDB regex class body.
SPACE = r"\x20\x09-\x0D"
#: The same characters, for ``trim``.
SPACE_CHARS = " \t\n\x0b\f\r"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where unset and executors are threads (tests).

    On a cluster an unset folder is an error: a folder of one machine would not be shared.
    """
    root = dict(spark.sparkContext.getConf().getAll()).get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seqlattice-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/seqlattice/{label}-{uuid.uuid4().hex}"


#: Deletes a query's shuffle files when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITERS = threading.Lock(), {}


@contextmanager
def _short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that made them ends; the session's setting returns once no thread is inside."""
    with _LOCK:
        n, before = _WRITERS.get(spark, (0, None))
        _WRITERS[spark] = n + 1, before if n else spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITERS.pop(spark)
            if n > 1:
                _WRITERS[spark] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor, and
    is smaller on disk than a checkpoint of rows. The shuffle files of the write are
    not needed once it ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    with _short_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqlattice_path = path
    for scope in _SCOPES.get():
        scope.append(out)
    return out


#: Tables made inside the scopes that are open in this thread.
_SCOPES: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables of :func:`persisted` made inside, but those given to what it yields."""
    made, kept = [], []
    outer = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _SCOPES.reset(outer)
        discard(*(df for df in made if not any(df is k for k in kept)))


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames from :func:`persisted`; nothing may read them afterwards."""
    for df in frames:
        path = getattr(df, "_seqlattice_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def held_out(doc_id: Column) -> Column:
    """True for the rows that learning must not see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def words(text: Column) -> Column:
    """Maximal runs of non-separator characters; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
