"""Deterministic sharded WARC writer and reader.

Records are ranged by page id into shards of about ``SHARD_BYTES`` of payload.
The ranges come from an exact histogram of payload bytes over at most ``CELLS``
equal intervals of the id, so they depend on the data only, not on sampling. A
cell larger than a shard (a hot or null id) is split further by the hashes of
payload and address. A shard is one task, however many there are. Inside a shard
records are sorted by (id, digest, url) and written as one gzip member each, after
one that describes the file; a file is closed once it holds ``FILE_BYTES``
compressed bytes. Headers, lengths and digests are made anew. Files are written under a
temporary name that holds the attempt, renamed when complete, and listed with
size and digest in the shard's manifest, itself renamed last: a shard without a
manifest does not exist, as readers go by manifests (``listed``). A file that has
its name is never removed or written again: an attempt that finds one compares it
with its own and deletes its own, so there is no moment at which a manifest names
a file that is gone. Bytes that differ (another run's archive in the same folder)
are an error. Temporary files lie in one folder, which goes once all is written.

Of records with equal payloads of ``LEAST_DUPLICATE`` bytes or more, that with
the largest id is the response and the others are revisits of it. This is
decided on (id, digest, length) alone; page bodies are shuffled once, to their
shard, and decisions join them there as rows that sort just before their record.
Record ids follow from (id, digest, url) and a number among rows equal in these, so
they are unique, and a revisit can name the record it refers to, wherever that is.
Memory is bounded by one record. Archives are read by about as many tasks as there
are files, ``READ_FILES`` a task at most.

Edge cases: a null payload is empty; a null id sorts first, is written as an
empty id, and is a response only if its whole group has none; rows that share
the largest id are all responses, and revisits refer to that with the greatest
address; repeated rows give repeated records (rows equal in id, address and
payload stay in one shard); an empty table gives no files; other columns of
``pages`` are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, discard, persisted, shared_path

SHARD_BYTES = 64 << 20
FILE_BYTES = 16 << 20
#: Parts of a hot cell that records of one payload may go to.
SPREAD = 64
READ_FILES = 8
MOST_TASKS = 100_000
CELLS = 65536
BLOCK = 256
LEAST_DUPLICATE = 1000
LEVEL = 6
#: Folder of files that are being written; Spark's readers skip it.
TEMPORARY = "_temporary"
#: Records carry no clock time, so that equal input gives equal bytes.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6f0d6a3e-3d0c-4f3e-9d53-0b6f6d2b7c11")


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; a plain path is local."""
    return pafs.FileSystem.from_uri(uri if re.match(r"^[a-z0-9]+:", uri) else f"file://{uri}")


def record_id(page_id: int | None, digest: str, url: str | None, number: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{digest}|{number}|{url}')}>"


def _join(lines: list[str], body: bytes) -> bytes:
    lines = [*lines, f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}", f"Content-Length: {len(body)}"]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def file_info(name: str) -> bytes:
    """The record that opens a file."""
    lines = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _join(lines, b"format: WARC File Format 1.1\r\n")


def _line(url: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, number: int = 0, original: tuple[int, str | None] | None = None) -> bytes:
    """One record, uncompressed; a revisit if the page and address of the ``original`` are given. A revisit has the headers of the full payload and no body."""
    lines = [
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, url, number)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if original:
        page, address = original
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(page, digest, address)}", f"WARC-Refers-To-Target-URI: {_line(address)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {page}",
        ]
    return _join(lines, b"" if original else payload)


def decisions(pages: DataFrame) -> DataFrame:
    """``page_id, digest, keeper, address`` for the distinct (id, digest) that are revisits of the keeper's record."""
    big = pages.filter(F.col("n") >= LEAST_DUPLICATE)
    groups = big.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("k"), F.count(F.lit(1)).alias("c")).filter("c > 1 AND k.page_id IS NOT NULL")
    found = big.select("page_id", "digest").distinct().join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("k.page_id")))
    return found.select("page_id", "digest", F.col("k.page_id").alias("keeper"), F.col("k.url").alias("address"))


def ranges(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, dict]:
    """``cell, shard, parts`` for every cell with rows, and the grid of cells."""
    ends = pages.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    grid = {"lo": lo, "width": max(1, -(-(hi - lo + 1) // CELLS))}
    sizes = pages.groupBy(_cell(grid).alias("cell")).agg(F.sum(F.col("n") + 512).alias("bytes"))
    # Running sums in two steps: over runs of BLOCK cells, and over the totals of the runs.
    sizes = sizes.withColumn("block", F.floor(F.col("cell") / BLOCK))
    past = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sizes.groupBy("block").agg(F.sum("bytes").alias("bytes"))
    totals = totals.select("block", past(Window.orderBy("block")).alias("base"))  # at most CELLS / BLOCK + 2 rows
    sizes = sizes.withColumn("within", past(Window.partitionBy("block").orderBy("cell"))).join(F.broadcast(totals), "block")
    shard = F.floor((F.col("base") + F.col("within")) / shard_bytes).cast("long")
    return sizes.select("cell", shard.alias("shard"), F.greatest(F.ceil(F.col("bytes") / shard_bytes), F.lit(1)).cast("int").alias("parts")), grid


def _cell(grid: dict):
    """Interval of the id; -1 for null ids."""
    return F.coalesce(F.floor((F.col("page_id") - F.lit(grid["lo"])) / F.lit(grid["width"])).cast("long"), F.lit(-1).cast("long"))


def _put(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Rename, unless an earlier attempt's file has the name already: that one stays, and must hold the same bytes."""
    if fs.get_file_info(target).type == pafs.FileType.NotFound:
        try:
            return fs.move(source, target)
        except OSError:
            if fs.get_file_info(target).type == pafs.FileType.NotFound:
                raise
    if not _same(fs, source, target):
        raise FileExistsError(f"{target} belongs to another run")
    fs.delete_file(source)


def _same(fs: pafs.FileSystem, one: str, other: str) -> bool:
    if len({info.size for info in fs.get_file_info([one, other])}) > 1:
        return False
    with fs.open_input_stream(one, compression=None) as a, fs.open_input_stream(other, compression=None) as b:
        while True:
            x, y = a.read(1 << 20), b.read(1 << 20)
            if x != y:
                return False
            if not x:
                return True


class _Shard:
    """Writer of one shard's files and manifest."""

    def __init__(self, folder: str, name: str, file_bytes: int, attempt: str):
        self.fs, self.folder = _files(folder)
        self.name, self.file_bytes, self.attempt, self.done, self.out = name, file_bytes, attempt, [], None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.folder}/{TEMPORARY}/{self.attempt}-{self.name}-{len(self.done):05d}"
            self.out, self.sha, self.size, self.records = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, 0
            self.final = f"{self.name}-{len(self.done):05d}.warc.gz"
            self._member(file_info(self.final))
        self._member(data)
        self.records += 1
        if self.size >= self.file_bytes:
            self.roll()

    def _member(self, data: bytes) -> None:
        member = gzip.compress(data, LEVEL, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def roll(self) -> None:
        if self.out is not None:
            self.out.close()
            _put(self.fs, self.temp, f"{self.folder}/{self.final}")
            self.done.append({"file": self.final, "bytes": self.size, "records": self.records, "sha256": self.sha.hexdigest()})
            self.out = None

    def close(self) -> list[dict]:
        self.roll()
        temp = f"{self.folder}/{TEMPORARY}/{self.attempt}-{self.name}.json"
        with self.fs.open_output_stream(temp) as f:
            f.write(json.dumps({"shard": self.name, "files": self.done}, sort_keys=True).encode())
        _put(self.fs, temp, f"{self.folder}/{self.name}.manifest.json")
        return self.done


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) to ``folder``; returns the files, ``shard, file, bytes, records, sha256``."""
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    wide = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("payload"))
    wide = wide.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    narrow = persisted(wide.select("page_id", "digest", "n", "url"), "pages")
    table, grid = ranges(narrow, shard_bytes)
    table = persisted(table, "ranges")
    tasks = min(table.agg(F.max(F.col("shard") + F.col("parts"))).first()[0] or 1, MOST_TASKS)
    fs, path = _files(folder)
    fs.create_dir(f"{path}/{TEMPORARY}", recursive=True)

    def placed(df: DataFrame, sub: Column) -> DataFrame:
        """``sub``: which of its digest's parts a row of a hot cell goes to."""
        df = df.withColumn("cell", _cell(grid)).join(F.broadcast(table), "cell").withColumn("sub", sub)  # at most CELLS + 1 rows
        return df.withColumn("part", F.pmod(F.xxhash64("digest") + F.col("sub"), F.col("parts")).cast("int"))

    spread = F.least(F.col("parts"), F.lit(SPREAD))
    none = lambda kind: F.lit(None).cast(kind)
    rows = placed(wide, F.pmod(F.xxhash64("url"), spread)).withColumns({"kind": F.lit(1), "keeper": none("long"), "address": none("string")})
    marks = placed(decisions(narrow), F.explode(F.sequence(F.lit(0).cast("long"), spread.cast("long") - 1))).withColumns({"kind": F.lit(0), "url": none("string"), "payload": none("binary"), "n": none("long")})
    cols = ["shard", "part", "page_id", "digest", "kind", "url", "payload", "n", "keeper", "address"]
    both = rows.select(*cols).unionByName(marks.select(*cols)).repartitionById(tasks, F.pmod(F.col("shard") + F.col("part"), F.lit(tasks)).cast("int"))
    sorted_rows = both.sortWithinPartitions("shard", "part", F.col("page_id").asc_nulls_first(), "digest", "kind", F.col("url").asc_nulls_first())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        attempt = f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}" if context else uuid.uuid4().hex
        writer, at, mark, last, number, files = None, None, None, None, 0, []

        def finish() -> None:
            if writer is not None:
                files.extend((writer.name, x["file"], x["bytes"], x["records"], x["sha256"]) for x in writer.close())

        for frame in frames:
            for shard, part, page, digest, kind, url, payload, n, keeper, address in zip(*(frame[c].array for c in cols), strict=True):
                page, url = None if pd.isna(page) else int(page), url if isinstance(url, str) else None
                if (shard, part) != at:
                    finish()
                    at, writer, mark, last = (shard, part), _Shard(folder, f"shard-{shard:08d}-{part:04d}", file_bytes, attempt), None, None
                if kind == 0:
                    mark = (page, digest), (int(keeper), address if isinstance(address, str) else None)
                    continue
                number = number + 1 if (page, digest, url) == last else 0
                last = page, digest, url
                writer.add(record(page, url, payload, digest, int(n), number, mark[1] if mark and mark[0] == (page, digest) else None))
        finish()
        yield pd.DataFrame(files, columns=["shard", "file", "bytes", "records", "sha256"])

    files = persisted(sorted_rows.mapInPandas(run, "shard string, file string, bytes long, records long, sha256 string"), "files")
    discard(narrow, table)
    fs.delete_dir(f"{path}/{TEMPORARY}")
    return files


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The files that the manifests in ``folder`` name, ``shard, file, bytes, records, sha256``."""
    schema = "shard string, files array<struct<file:string,bytes:long,records:long,sha256:string>>"
    found = spark.read.schema(schema).json(folder, pathGlobFilter="*.manifest.json", mode="FAILFAST")
    return found.select("shard", F.inline("files"))


def members(stream) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream, one at a time."""
    left, gz, out = b"", zlib.decompressobj(31), io.BytesIO()
    while True:
        if not left:
            left = stream.read(1 << 20)
            if not left:
                break
        out.write(gz.decompress(left))
        left = b""
        if gz.eof:
            yield out.getvalue()
            left, gz, out = gz.unused_data, zlib.decompressobj(31), io.BytesIO()
    if out.tell():
        raise EOFError("archive ends inside a record")


def parse(data: bytes) -> dict:
    """Headers (lower-case names) and payload of a record, its digests verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {name.lower(): value for name, value in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])}
    body = rest[: int(headers["content-length"])]
    if len(body) != int(headers["content-length"]) or headers["warc-block-digest"] != f"sha1:{hashlib.sha1(body).hexdigest()}":
        raise ValueError(f"record {headers.get('warc-record-id')} is damaged")
    return headers | {"payload": body}


def read(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """All pages' records of the listed files: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload, record_id, refers_to_record."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "record_id", "refers_to_record"]
        fs, path = _files(folder)
        for frame in frames:
            for name in frame["file"]:
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        r = parse(data)
                        if r["warc-type"] == "warcinfo":
                            continue
                        refers = r.get("x-refers-to-page")
                        revisit = r["warc-type"] == "revisit"
                        digest = r["warc-payload-digest"].partition(":")[2]
                        n = int(r["x-payload-length"])
                        if not revisit and (n != len(r["payload"]) or digest != hashlib.sha1(r["payload"]).hexdigest()):
                            raise ValueError(f"payload of {r['warc-record-id']} is damaged")
                        rows.append((int(r["x-page-id"]) if r["x-page-id"] else None, r["warc-target-uri"], r["warc-type"], digest, n, int(refers) if refers else None, r["payload"], r["warc-record-id"], r.get("warc-refers-to")))
                        size += len(data)
                        if size > 8 << 20:
                            yield _frame(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, record_id string, refers_to_record string"
    n = files.count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // READ_FILES))))
    return files.select("file").repartitionByRange(tasks, "file").mapInPandas(run, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    found = persisted(read(spark, listed(spark, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    discard(files)
    delete(spark, folder)
    return found


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM r
"""
