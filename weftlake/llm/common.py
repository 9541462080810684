"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as characters and as a pattern.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names, one for each base, that ``df`` doesn't have (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name, k = f"_{base}", 0
        while name.lower() in taken:
            k += 1
            name = f"_{base}{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def need(df: DataFrame, *names: str) -> None:
    """Raise if a column that the operator reads is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")



@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python at most ``rows`` rows at once: for wide rows, whose batches take memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
