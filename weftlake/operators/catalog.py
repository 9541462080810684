"""Listings: pages with totals, search, sorting, joins of details, and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with total_count on each row.

    The total is one aggregated row that is joined to the page, so that no
    window gathers the table in one task; the page itself is a bounded top-k.
    """
    total = df.agg(F.count("*").alias("total_count"))
    rows = df.orderBy(*order).limit(offset + limit)
    rows = rows.offset(offset) if offset else rows
    return rows.crossJoin(F.broadcast(total))  # one row


def clamp_page(number: int, size: int, total: int) -> tuple[int, int, bool]:
    """Page number from 0, size 1 to 100, and whether more rows follow."""
    number, size = max(number, 0), min(max(size, 1), 100)
    return number, size, (number + 1) * size < total


def search(df: DataFrame, text: str, *columns: str, tags: str | None = None) -> DataFrame:
    """Rows of which a column holds the text, case aside, or whose tags have it."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    if tags:
        hit = hit | F.coalesce(F.array_contains(tags, text), F.lit(False))
    return df.filter(hit)


def sort_by(field: str, direction: str, allowed: dict[str, str], default: str, tie: str) -> list[Column]:
    """Order of a whitelisted field; anything else falls back to the default, newest first; ties by id."""
    if field not in allowed:
        return [F.desc(default), F.asc(tie)]
    c = F.col(allowed[field])
    return [c.asc() if direction.lower() == "asc" else c.desc(), F.asc(tie)]


def keyset_page(df: DataFrame, key: str, after: str | int | None, size: int) -> DataFrame:
    """The rows after a cursor in key order, one more than asked to tell whether others follow."""
    rows = df.filter(F.col(key) > F.lit(after)) if after is not None else df
    return rows.orderBy(key).limit(size + 1)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows without those that a new one replaces, and the new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns that a change sets; a null change leaves the old value."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    out = rows.join(c, key, "left")
    return out.withColumns({x: F.coalesce(f"_{x}", x) for x in columns}).drop(*[f"_{x}" for x in columns])


def grab(row: DataFrame, owner: str, id_col: str = "id", title: str = "title") -> DataFrame:
    """A public row as another owner's, its title marked."""
    return row.withColumn(title, F.concat(title, F.lit("-grabbed"))).withColumn("owner", F.lit(owner)).drop(id_col)


def valid_title(c: Column) -> Column:
    return (F.char_length(F.trim(c)) > 0) & (F.char_length(c) <= 256)


def valid_tags(c: Column) -> Column:
    return (F.size(c) <= 20) & F.forall(c, lambda t: F.char_length(t) <= 64)


def valid_key(c: Column) -> Column:
    """Object keys: not empty, relative, without parent steps or control characters."""
    return (F.length(c) > 0) & ~c.startswith("/") & ~c.rlike(r"(^|/)\.\.(/|$)") & ~c.rlike(r"[\x00-\x1f\\]")
