"""Chunkers that Catalyst can express, and numbering, overlap and batching of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.functions.ids import chunk_id
from weftlake.functions.text import trim_ws


def fixed_size(text: Column, size: int, trim: bool = True) -> Column:
    """Array of windows of ``size`` code points; trimmed ones that are empty are dropped."""
    if size < 1:
        raise ValueError("size must be positive")
    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one pass over the text
    return F.filter(F.transform(whole, trim_ws), lambda x: x != "") if trim else whole


def explode_chunks(df: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    """One row for each chunk: the keys, chunk_index (from 0), total_chunks and content.

    The array is named once and made once for a row: its size and its elements
    both read that name. Rows without chunks give none.
    """
    name = "chunks"
    while name in keys:
        name += "_"
    made = df.select(*keys, chunks.alias(name)).filter(F.size(name) > 0)
    return made.select(*keys, F.size(name).cast("long").alias("total_chunks"), F.posexplode(name).alias("chunk_index", "content"))


def with_overlap(chunks: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Every chunk but a document's first begins with the last ``n`` code points of the chunk before, as that was."""
    if n < 1:
        return chunks
    before = F.lag("content").over(Window.partitionBy(key).orderBy("chunk_index"))
    return chunks.withColumn("content", F.concat(F.coalesce(F.right(before, F.lit(n)), F.lit("")), F.col("content")))


def with_sizes(chunks: DataFrame) -> DataFrame:
    """Add chunk_size, the UTF-8 bytes of the content."""
    return chunks.withColumn("chunk_size", F.octet_length("content").cast("long"))


def with_ids(chunks: DataFrame, dataset: int, key: str = "doc_id") -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.lit(dataset), F.col(key), F.col("chunk_index")))


def split_empty(df: DataFrame, chunks: str) -> tuple[DataFrame, DataFrame]:
    """(rows with chunks, rows without any, with an error): a text without chunks is a failure."""
    return df.filter(F.size(chunks) > 0), df.filter(F.size(chunks) <= 0).withColumn("error", F.lit("no chunks"))
