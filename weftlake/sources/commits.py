"""Tables of whole commits: a write is visible in full or not at all, and a stream reads one commit after the other.

Registered as the format ``commits`` (:func:`register`), for batch writes, stream
writes and stream reads; ``path`` is a folder that driver and workers share.

Tasks write Parquet files below ``data``. Only when all are done the driver puts a
manifest, ``_commits/<number>.json``, that names the files and their rows; readers
look at manifests alone. A write that fails leaves no manifest, and its files are
deleted or never read. Numbers are gapless; there is one writer at a time
(:class:`weftlake.sources.blobs.Lease` where there may be more), on a file system
whose renames are whole. A batch that runs again after a failure finds its own
number (``writer`` and ``batch``) among the manifests and commits nothing twice.

A stream has the manifest's number as its offset. With the option ``consumer`` a
finished batch is acknowledged below ``_acks/<consumer>`` when Spark plans the next
one (the last of a run by :func:`weftlake.streaming.jobs.consume`), and a stream without a
checkpoint goes on after the last acknowledged commit: nothing is lost, and what
wasn't acknowledged comes again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class CommittedFile(InputPartition):
    """A file of a commit, read by one task."""

    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as the workers see it, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _numbers(fs: pafs.FileSystem, folder: str) -> list[int]:
    """The numbers that name the files of a folder, ascending; none where it isn't there."""
    found = (f.base_name.split(".")[0] for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)))
    return sorted(int(n) for n in found if n.isdigit())


def _manifest(fs: pafs.FileSystem, root: str, number: int) -> dict:
    with fs.open_input_stream(f"{root}/_commits/{number}.json") as f:
        return json.loads(f.read())


def _put(fs: pafs.FileSystem, root: str, name: str, body: str) -> None:
    """A small file that is there as a whole or not at all."""
    draft = f"{root}/_drafts/{uuid.uuid4().hex}"
    for folder in ("_drafts", name.rsplit("/", 1)[0]):
        fs.create_dir(f"{root}/{folder}", recursive=True)
    with fs.open_output_stream(draft) as f:
        f.write(body.encode())
    fs.move(draft, f"{root}/{name}")


class _Writer:
    """What batch and stream writers share: a file for each task, a manifest for all."""

    def __init__(self, path: str, schema: StructType, writer: str, batch: int = -1):
        self.path, self.schema, self.writer, self.number = path, schema.json(), writer, batch

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        name, out, rows = f"data/{uuid.uuid4().hex}.parquet", None, 0
        for b in batches:
            out = out or pq.ParquetWriter(f"{root}/{name}", b.schema, filesystem=fs)
            out.write_batch(b)
            rows += b.num_rows
        if out:
            out.close()
        return Written(name if out else "", rows)

    def publish(self, messages: list, batch: int) -> None:
        fs, root = _open(self.path)
        numbers = _numbers(fs, f"{root}/_commits")
        if batch >= 0:  # batches of a writer ascend, so that its latest commit tells
            own = (m["batch"] for m in (_manifest(fs, root, n) for n in reversed(numbers)) if m["writer"] == self.writer)
            if next(own, -1) >= batch:
                self.discard(messages)
                return
        files = [{"file": m.file, "rows": m.rows} for m in messages if m and m.file]
        told = {"writer": self.writer, "batch": batch, "rows": sum(f["rows"] for f in files), "schema": self.schema, "files": files}
        _put(fs, root, f"_commits/{numbers[-1] + 1 if numbers else 0}.json", json.dumps(told))

    def discard(self, messages: list) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{root}/{m.file}")


class CommitsWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.publish(messages, self.number)

    def abort(self, messages: list) -> None:
        self.discard(messages)


class CommitsStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.discard(messages)


def acknowledge(path: str, consumer: str, number: int) -> None:
    """Note that a consumer is done with all commits up to a number."""
    fs, root = _open(path)
    if number >= 0:
        _put(fs, root, f"_acks/{consumer}/{number}", "")


class CommitsStreamReader(DataSourceStreamReader):
    """Commits in the order of their numbers; an offset is the number of the last one read."""

    def __init__(self, path: str, consumer: str | None):
        self.path, self.consumer = path, consumer

    def initialOffset(self) -> dict:
        fs, root = _open(self.path)
        return {"commit": max(_numbers(fs, f"{root}/_acks/{self.consumer}"), default=-1) if self.consumer else -1}

    def latestOffset(self) -> dict:
        fs, root = _open(self.path)
        return {"commit": max(_numbers(fs, f"{root}/_commits"), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[CommittedFile]:
        fs, root = _open(self.path)
        return [CommittedFile(f["file"]) for n in range(start["commit"] + 1, end["commit"] + 1) for f in _manifest(fs, root, n)["files"]]

    def read(self, partition: CommittedFile) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            yield from pq.ParquetFile(f).iter_batches()

    def commit(self, end: dict) -> None:
        """Acknowledge all commits up to an offset, once their batch is done."""
        if self.consumer:
            acknowledge(self.path, self.consumer, end["commit"])


class Commits(DataSource):
    """The format ``commits``; options ``path``, and ``consumer`` of a stream read or ``writer`` and ``batch`` of a write."""

    @classmethod
    def name(cls) -> str:
        return "commits"

    def schema(self) -> StructType:
        fs, root = _open(self.options["path"])
        numbers = _numbers(fs, f"{root}/_commits")
        if not numbers:
            raise ValueError(f"no commit in {root} yet: give a schema")
        return StructType.fromJson(json.loads(_manifest(fs, root, numbers[-1])["schema"]))

    def writer(self, schema: StructType, overwrite: bool) -> CommitsWriter:
        if overwrite:
            raise ValueError("commits are appended, never overwritten")
        return CommitsWriter(self.options["path"], schema, self.options.get("writer", ""), int(self.options.get("batch", -1)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> CommitsStreamWriter:
        return CommitsStreamWriter(self.options["path"], schema, self.options.get("writer", ""))

    def streamReader(self, schema: StructType) -> CommitsStreamReader:
        return CommitsStreamReader(self.options["path"], self.options.get("consumer"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Commits)


def write_commit(df: DataFrame, path: str, writer: str = "", batch: int = -1) -> None:
    """Append ``df`` as one commit; with a ``batch`` it is left out if ``writer`` has committed that batch, or a later one."""
    register(df.sparkSession)
    df.write.format("commits").mode("append").option("path", path).option("writer", writer).option("batch", batch).save()


def read_commits(spark: SparkSession, path: str, since: int = -1) -> DataFrame:
    """The rows of all commits after number ``since``, as a Parquet scan of the files that manifests name."""
    fs, root = _open(path)
    told = [_manifest(fs, root, n) for n in _numbers(fs, f"{root}/_commits") if n > since]
    if not told:
        raise ValueError(f"no commit in {path} after {since}")
    schema = StructType.fromJson(json.loads(told[-1]["schema"]))
    files = [f"{path}/{f['file']}" for m in told for f in m["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def stream_commits(spark: SparkSession, path: str, consumer: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """The commits as a stream, from the last that ``consumer`` acknowledged; a schema is needed only before the first commit."""
    register(spark)
    r = spark.readStream.format("commits").option("path", path)
    r = r.option("consumer", consumer) if consumer else r
    return (r.schema(schema) if schema else r).load()
