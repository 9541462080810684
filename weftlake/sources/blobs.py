"""Files as DataFrames: listing, size caps, extraction, batch files and sinks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlake.functions.batches import slices
from weftlake.sources.extract import TYPES, ExtractionError, Options, UnsupportedType, extract, members

MAX_FILE = 100 << 20
#: How files of some types begin, as hexadecimal digits.
MAGIC = {"25504446": "application/pdf", "504b0304": "application/zip", "1f8b": "application/gzip", "d0cf11e0": "application/x-ole-storage", "7b5c727466": "application/rtf"}
BATCH = "id string, text string, payload string"


def read_files(spark: SparkSession, folder: str, pattern: str = "*", cap: int = MAX_FILE) -> DataFrame:
    """(path, length, content) of the files below a folder that aren't above the cap; larger ones are never read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return f.filter(F.col("length") <= cap)


def list_files(spark: SparkSession, folder: str, after: str | None, size: int) -> DataFrame:
    """A page of (path, length, modificationTime) in path order, one more than asked."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")
    return (f.filter(F.col("path") > after) if after else f).orderBy("path").limit(size + 1)


def type_of(path: Column) -> Column:
    """MIME type by a file name's extension."""
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, v: k == F.lower(F.element_at(F.split(path, r"\."), -1)))), 0), F.lit("application/octet-stream"))


def sniff(content: Column) -> Column:
    """MIME type by the first bytes; null if they tell nothing."""
    head = F.lower(F.hex(F.substring(content, 1, 8192)))
    out = F.lit(None).cast("string")
    for magic, mime in MAGIC.items():
        out = F.when(head.startswith(magic), mime).otherwise(out)
    return out


def extract_column(mime: Column, content: Column, options: Options = Options()) -> Column:
    """struct(text, metadata as JSON, error) of files; a file that fails carries its error and fails no other."""

    kinds = pa.struct([(name, pa.string()) for name in ("text", "metadata", "error")])

    def one(kind: str | None, data: bytes | None) -> dict:
        try:
            e = extract(kind or "", data or b"", options)
        except (ExtractionError, UnsupportedType) as e:
            return {"error": str(e)}
        return {"text": e.text, "metadata": json.dumps(e.metadata, ensure_ascii=False) if e.metadata else None}

    @F.arrow_udf("text string, metadata string, error string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for m, c in slices(batches):
            yield pa.array([one(*x) for x in zip(m.to_pylist(), c.to_pylist())], kinds)

    return run(mime, content)


def extract_files(files: DataFrame, options: Options = Options()) -> DataFrame:
    """(path, mime, text, metadata, error) of files (path, content)."""
    typed = files.withColumn("mime", type_of(F.col("path")))
    return typed.select("path", "mime", extract_column(F.col("mime"), F.col("content"), options).alias("x")).select("path", "mime", "x.*")


@F.udtf(returnType=T.StructType().add("path", T.StringType()).add("text", T.StringType()).add("error", T.StringType()))
class ArchiveMembers:
    """Table function: the files of an archive (content, zip or tar)."""

    def eval(self, content, kind):
        if content is not None:
            yield from members(bytes(content), kind)


def write_batches(chunks: DataFrame, path: str) -> None:
    """Chunk rows (batch_no, id, text, payload) as JSON files, a folder for each batch."""
    chunks.write.partitionBy("batch_no").mode("append").json(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{BATCH}, batch_no long").json(path)


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file, or a folder with all below it; False if there was none."""
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def is_empty(spark: SparkSession, folder: str) -> bool:
    """Whether no file lies below a folder; the listing stops at the first."""
    fs, p = _fs(spark, folder)
    return not fs.exists(p) or not fs.listFiles(p, True).hasNext()


def copy_below(spark: SparkSession, folder: str, to: str) -> int:
    """Copy all files below a folder, each by its relative path; the number of files."""
    fs, p = _fs(spark, folder)
    out, _ = _fs(spark, to)
    jvm, root, n = spark.sparkContext._jvm, fs.makeQualified(p).toUri(), 0
    files = fs.listFiles(p, True) if fs.exists(p) else None
    while files and files.hasNext():
        f = files.next().getPath()
        there = jvm.org.apache.hadoop.fs.Path(to, root.relativize(f.toUri()).getPath())
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, f, out, there, False, True, spark.sparkContext._jsc.hadoopConfiguration())
        n += 1
    return n


#: Hash buckets of a merged table that is made without a number of its own.
BUCKETS = 16
#: Rows of a bucket beyond which it is split.
BUCKET_ROWS = 1_000_000


def _bits(key: str) -> Column:
    """The 64 bits of a second hash of a key, as text: buckets are split by them, one after the other."""
    return F.lpad(F.bin(F.xxhash64(F.col(key), F.lit("split"))), 64, "0")


def _place(rows: DataFrame, key: str, buckets: int, split: list[str]) -> DataFrame:
    """``rows`` with ``_bucket``, the leaf of each key; ``split`` names the buckets that were split."""
    base = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").cast("string")
    rows = rows.withColumn("_bucket", base)
    for depth in range(max((len(b.partition("_")[2]) for b in split), default=-1) + 1):
        here = [(b,) for b in split if len(b.partition("_")[2]) == depth]
        inner = F.broadcast(rows.sparkSession.createDataFrame(here, "_inner string"))  # one short name for each split bucket
        deeper = F.concat(base, F.lit("_"), F.substring(_bits(key), 1, depth + 1))
        rows = rows.join(inner, F.col("_bucket") == F.col("_inner"), "left").withColumn("_bucket", F.when(F.col("_inner").isNotNull(), deeper).otherwise(F.col("_bucket"))).drop("_inner")
    return rows


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def finish_merge(spark: SparkSession, path: str) -> None:
    """Bring a merge that was cut off to its end, or take it back if its rows weren't all written."""
    fs, following = _fs(spark, f"{path}/_next")
    if not fs.exists(following):
        return
    if exists(spark, f"{path}/_next/_READY"):
        for name in _names(spark, f"{path}/_next/_SPLIT"):  # its rows lie in deeper buckets now
            delete(spark, f"{path}/_bucket={name}")
            fs.mkdirs(_fs(spark, f"{path}/_split/{name}")[1])
        for f in fs.listStatus(following):
            name = f.getPath().getName()
            if name.startswith("_bucket="):
                delete(spark, f"{path}/{name}")
                if not fs.rename(f.getPath(), _fs(spark, f"{path}/{name}")[1]):
                    raise OSError(f"can't move {name} into {path}")
    delete(spark, f"{path}/_next")


def merge_into(spark: SparkSession, new: DataFrame, path: str, key: str, seq: str, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS) -> None:
    """Upsert into a Parquet table by key: the row with the largest ``seq`` stays.

    Rows lie in folders by a hash of their key, and only the folders that the new
    rows touch are written, beside the table. Once all are there a mark is set and
    they are moved in; a merge that is cut off before the mark changes nothing,
    one cut off after it is finished by the next merge or :func:`finish_merge`.
    One writer at a time, on a file system whose renames are whole.

    The table starts with ``buckets`` buckets. One that holds more than
    ``bucket_rows`` rows after a merge is split by further bits of its keys' hash,
    so that a bucket stays small as the table grows, and a merge writes at most a
    bucket for each new row. Null keys are one key.
    """
    from weftlake.operators.search import latest_points
    from weftlake.session import drop_stash, stash

    finish_merge(spark, path)
    marks, folder = _fs(spark, f"{path}/_buckets")
    if marks.exists(folder):
        buckets = int(marks.listStatus(folder)[0].getPath().getName())
    else:
        marks.mkdirs(_fs(spark, f"{path}/_buckets/{buckets}")[1])
    split = _names(spark, f"{path}/_split")
    rows = stash(_place(new, key, buckets, split), "merge")
    touched = [f"{path}/_bucket={r[0]}" for r in rows.select("_bucket").distinct().collect()]  # at most one row a bucket
    old = [t for t in touched if exists(spark, t)]
    if touched:
        kept = rows
        if old:
            was = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*old)
            kept = rows.unionByName(was.withColumn("_bucket", F.col("_bucket").cast("string")), allowMissingColumns=True)
        merged = stash(latest_points(kept, key, seq), "merged")
        full = [r[0] for r in merged.groupBy("_bucket").count().filter(F.col("count") > bucket_rows).select("_bucket").collect()]  # at most one row a touched bucket
        gone = list(full)
        while full:  # one more bit until all parts are small; equal hashes can't be parted
            split, full = split + full, []
            placed = _place(merged.drop("_bucket"), key, buckets, split)
            sizes = placed.groupBy("_bucket").agg(F.count("*").alias("n"), F.count_distinct(_bits(key)).alias("keys"))
            full = [r[0] for r in sizes.filter((F.col("n") > bucket_rows) & (F.col("keys") > 1)).select("_bucket").collect()]
            gone += full
        out = _place(merged.drop("_bucket"), key, buckets, split) if gone else merged
        out.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/_next")
        drop_stash(merged)
        fs, ready = _fs(spark, f"{path}/_next/_READY")
        for name in gone:
            fs.mkdirs(_fs(spark, f"{path}/_next/_SPLIT/{name}")[1])
        fs, ready = _fs(spark, f"{path}/_next/_READY")
        fs.create(ready, True).close()
        finish_merge(spark, path)
    drop_stash(rows)


def create_collection(spark: SparkSession, path: str, dim: int, buckets: int = BUCKETS) -> bool:
    """Make the folder of a collection of vectors of ``dim`` numbers, compared by cosine; False if it is there with the same number."""
    if not 1 <= dim <= 65536:
        raise ValueError("dimension must be 1 to 65536")
    fs, folder = _fs(spark, f"{path}/_dimension")
    if fs.exists(folder):
        was = int(fs.listStatus(folder)[0].getPath().getName())
        if was != dim:
            raise ValueError(f"the collection has dimension {was}, not {dim}")
        return False
    for name in (f"_buckets/{buckets}", f"_dimension/{dim}"):
        fs.mkdirs(_fs(spark, f"{path}/{name}")[1])
    return True


def save_indexed(df: DataFrame, path: str, prune: list[str], sort: list[str], partitions: int | None = None) -> None:
    """Parquet laid out for the predicates asked of it: folders by ``prune``, and within them files dealt and sorted by ``sort``.

    Folders are pruned by equality, row groups by the least and largest value of ``sort``: what indexes do for a table of rows.
    """
    keys = [*prune, *sort]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    w = dealt.sortWithinPartitions(*keys).write.mode("overwrite")
    (w.partitionBy(*prune) if prune else w).parquet(path)


class Lease:
    """A lock that lapses, as files below a folder that all contenders share.

    Each generation is a file that is made only if it isn't there, so that of many
    contenders one gets it; it holds for ``seconds`` after the file was made, unless
    it is released. Clocks may differ by less than ``seconds``.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 300.0, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.seconds, self.clock = spark, folder, seconds, clock
        self.generation = 0

    def _make(self, name: str) -> bool:
        fs, p = _fs(self.spark, f"{self.folder}/{name}")
        try:
            fs.create(p, False).close()
        except Exception:
            if fs.exists(p):
                return False
            raise
        return True

    def acquire(self) -> bool:
        """True if the lease is ours now; False while another's hasn't lapsed or been released."""
        fs, p = _fs(self.spark, self.folder)
        made = {f.getPath().getName(): f.getModificationTime() / 1000 for f in fs.listStatus(p)} if fs.exists(p) else {}
        newest = max((int(n) for n in made if n.isdigit()), default=0)
        if newest and f"{newest}.released" not in made and made[str(newest)] + self.seconds > self.clock():
            return False
        if not self._make(str(newest + 1)):
            return False
        self.generation = newest + 1
        return True

    def release(self) -> None:
        """Give the lease back before it lapses."""
        if self.generation:
            self._make(f"{self.generation}.released")
            self.generation = 0
