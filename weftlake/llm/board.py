"""Change feed of leaderboards: a tournament tree for each group, kept as stream state.

The leaves of a group's tree are buckets of its items with their running values; a
node keeps the ten best of what its children hold, and the root's ten are the
board. The leaves are the keyed state of a streaming query, (group, leaf) by
(group, leaf), so that a large group is many keys. A day's updates reach their
leaves; a leaf whose ten change tells its parent which items came, changed or left,
with their values. The nodes above hold a share of that, some hundred items each;
every batch climbs them level by level as ordinary jobs over the level's table of
the batch before, until the root's ten are compared with those of the day before.
Only what the changes lead to is recomputed. Tables are named by batch, so that a
batch that is run again writes the same ones.

Before they are shuffled to the leaves, updates are summed by group, item and day
within each task, so that a hot item arrives as a row for each day and task. All
that a leaf or node receives in a batch is bounded by its items times the days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import need
from weftlake.session import shared_path, stash

#: Places of a board, items in a leaf, children of a node.
PLACES = 10
LEAF_ITEMS = 4096
FAN = 64
#: Days that a leaf lays side by side at once, and rows that a task sums before it hands them on.
DAYS_AT_ONCE = 64
SUMMED_ROWS = 1 << 19

_UPDATES = "grp int, node long, day int, item long, value long"
_TOLD = "grp int, node long, day int, item long, value long, held boolean"
_CHANGES = "grp int, day int, item long, old_rank int, new_rank int, value long"
#: What a node holds (day is null), and what it tells its parent or, as the root, the feed.
_LEVEL = "grp int, node long, day int, item long, value long, held boolean, old_rank int, new_rank int"
_STATE = "items binary, sums binary"

#: Items and their values, best first.
Best = tuple[np.ndarray, np.ndarray]


def best_of(items: np.ndarray, values: np.ndarray) -> Best:
    """The ten highest positive values, ties to the smaller item."""
    at = np.flatnonzero(values > 0)
    if len(at) > PLACES:
        v = values[at]
        at = at[v >= np.partition(v, len(v) - PLACES)[len(v) - PLACES]]
    at = at[np.lexsort((items[at], -values[at]))[:PLACES]]
    return items[at], values[at]


def _told(day: int, was: Best, now: Best, value_of: Callable[[int], int]) -> list[tuple]:
    """(day, item, value, held) of items that came into a node's ten, changed there or left them."""
    before, after = dict(zip(was[0].tolist(), was[1].tolist())), dict(zip(now[0].tolist(), now[1].tolist()))
    out = [(day, i, v, True) for i, v in after.items() if before.get(i) != v]
    return out + [(day, i, value_of(i), False) for i in before if i not in after]


def _moved(day: int, was: Best, now: Best, value_of: Callable[[int], int]) -> list[tuple]:
    """(day, item, old rank, new rank, value) of items whose place on the board isn't the one before; 0 is off the board."""
    before, after = ({i: k for k, i in enumerate(x[0].tolist(), 1)} for x in (was, now))
    both = sorted(before.keys() | after.keys())
    return [(day, i, before.get(i, 0), after.get(i, 0), value_of(i)) for i in both if before.get(i) != after.get(i)]


def _opened(state) -> Best:
    if not state.exists:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    items, values = state.get
    return np.frombuffer(items, np.int64), np.frombuffer(values, np.int64)


def _leaf(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Adds a batch's updates to the items of a leaf and tells day by day how its ten change."""
    got = [(f["day"].to_numpy(), f["item"].to_numpy(), f["value"].to_numpy()) for f in frames]
    day, item, value = (np.concatenate(x) for x in zip(*got))
    had, sums = _opened(state)
    items = np.union1d(had, item)
    total = np.zeros(len(items), np.int64)
    total[np.searchsorted(items, had)] = sums
    days, row = np.unique(day, return_inverse=True)
    column = np.searchsorted(items, item)
    best, out = best_of(items, total), []
    for first in range(0, len(days), DAYS_AT_ONCE):
        here = (row >= first) & (row < first + DAYS_AT_ONCE)
        after = np.zeros((min(DAYS_AT_ONCE, len(days) - first), len(items)), np.int64)
        np.add.at(after, (row[here] - first, column[here]), value[here])
        after[0] += total
        after = np.cumsum(after, axis=0)
        for k, held in enumerate(after):
            now = best_of(items, held)
            if not all(map(np.array_equal, now, best)):
                out += _told(int(days[first + k]), best, now, lambda i, held=held: int(held[np.searchsorted(items, i)]))
                best = now
        total = after[-1]
    state.update((items.tobytes(), total.tobytes()))
    if out:
        f = pd.DataFrame(out, columns=["day", "item", "value", "held"])
        f.insert(0, "grp", key[0])
        f.insert(1, "node", key[1])
        yield f


def _node(top: bool):
    """Takes over what the children of a node tell, day by day, and tells how its own ten change."""

    def run(key: tuple, told: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        holds = dict(zip(held["item"].tolist(), held["value"].tolist()))
        best, out = best_of(held["item"].to_numpy(), held["value"].to_numpy()), []
        for day, f in told.groupby("day", sort=True):
            gone: dict[int, int] = {}
            for i, v, kept in zip(f["item"].tolist(), f["value"].tolist(), f["held"].tolist()):
                if kept:
                    holds[i] = v
                else:
                    holds.pop(i, None)
                    gone[i] = v
            now = best_of(*(np.fromiter(x, np.int64, len(holds)) for x in (holds.keys(), holds.values())))
            at = lambda i, gone=gone: gone[i] if i in gone else holds[i]
            if top:
                out += [(day, i, v, True, was, is_) for day, i, was, is_, v in _moved(int(day), best, now, at)]
            else:
                out += [(*x, 0, 0) for x in _told(int(day), best, now, at)]
            best = now
        out += [(None, i, v, True, 0, 0) for i, v in holds.items()]
        f = pd.DataFrame(out, columns=["day", "item", "value", "held", "old_rank", "new_rank"]).astype({"day": "Int32"})
        f.insert(0, "grp", key[0])
        f.insert(1, "node", key[1])
        return f

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Updates summed by node, day and item within a task, of so many rows at once that memory stays bounded."""
    by = ["grp", "node", "day", "item"]

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by(by).aggregate([("value", "sum")]).rename_columns([*by, "value"])
        yield from t.combine_chunks().to_batches(max_chunksize=1 << 16)

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= SUMMED_ROWS:
            yield from flush(held)
            held, rows = [], 0
    if rows:
        yield from flush(held)


def leaf_changes(updates: DataFrame, leaves: int) -> DataFrame:
    """(grp, node, day, item, value, held) of every item that comes into the ten of its leaf, changes there or leaves them.

    ``updates`` is a stream of (grp int, item long, day int, value long): a batch
    holds whole days, and days later than all batches before. Values of an item
    add up. ``leaves`` is the number of a tree's buckets and stays the same for a
    checkpoint. Rows with a null group, item, day or value are ignored; other
    columns are not read.
    """
    need(updates, "grp", "item", "day", "value")
    node = F.pmod(F.xxhash64(F.col("item")), F.lit(leaves))
    rows = updates.filter("grp is not null and item is not null and day is not null and value is not null")
    rows = rows.select(F.col("grp").cast("int").alias("grp"), node.alias("node"), F.col("day").cast("int").alias("day"), F.col("item").cast("long").alias("item"), F.col("value").cast("long").alias("value"))
    return rows.mapInArrow(_summed, _UPDATES).groupBy("grp", "node").applyInPandasWithState(_leaf, _TOLD, _STATE, "append", "NoTimeout")


def climb(told: DataFrame, batch: int, leaves: int, path: str) -> None:
    """Carry what the leaves tell in one batch up to the roots; their changes are the rows of ``path``/changes/``batch``.

    Each level joins what its children tell with what its nodes hold, the rows of
    the level's table of the batch before, and writes both anew for this batch.
    """
    spark, n, level = told.sparkSession, leaves, 0
    while True:
        n, level = -(-n // FAN), level + 1
        top = n <= 1
        told = told.withColumn("node", F.expr(f"node div {FAN}")).select("grp", "node", "day", "item", "value", "held")
        at = f"{path}/level-{level}"
        before = spark.read.schema(_LEVEL).parquet(f"{at}/{batch - 1}").filter("day is null") if batch else spark.createDataFrame([], _LEVEL)
        made = told.groupBy("grp", "node").cogroup(before.groupBy("grp", "node")).applyInPandas(_node(top), _LEVEL)
        made.write.mode("overwrite").parquet(f"{at}/{batch}")
        told = spark.read.schema(_LEVEL).parquet(f"{at}/{batch}").filter("day is not null")
        if top:
            ranks = (F.nullif(F.col(c), F.lit(0)).alias(c) for c in ("old_rank", "new_rank"))
            told.select("grp", "day", "item", *ranks, "value").write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
            return


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder of the shared storage; False if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(old)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.rename(p, jvm.org.apache.hadoop.fs.Path(new)))


def feed_batches(updates: DataFrame, batches: int, leaves: int, grace: int) -> DataFrame:
    """(grp, day, item, old_rank, new_rank, value) of every item whose place on its group's board changes on a day.

    A board is the ten highest positive sums after a day, ties to the smaller item;
    a rank that is null is off the board. ``updates`` has (grp, item, day, value,
    batch, seen): ``batch`` is 1 to ``batches`` and ``seen`` a day. The batches are
    written to a new folder of the shared storage; each in turn is moved into the
    folder that the stream reads, and the stream is started anew for it on one
    checkpoint. A row is dropped if ``seen + grace`` lies below the largest ``seen``
    of all batches before its own, ignored rows included; that is one number a
    batch, observed while the batches are written. A batch without rows has no start.
    """
    spark = updates.sparkSession
    path = shared_path(spark, "board")
    cut, feed = f"{path}/cut", f"{path}/feed"
    seen = Observation("seen")
    most = [F.max(F.when(F.col("batch") == k, F.col("seen"))).alias(f"b{k}") for k in range(1, batches + 1)]
    rows = updates.select("grp", "item", "day", "value", "seen", "batch")
    rows.observe(seen, *most).write.partitionBy("batch").parquet(cut)
    spark.createDataFrame([], rows.drop("batch").schema).write.parquet(feed)
    stream = spark.readStream.schema(rows.drop("batch").schema).option("recursiveFileLookup", "true").parquet(feed)
    bar = None
    for k in range(1, batches + 1):
        if move(spark, f"{cut}/batch={k}", f"{feed}/batch-{k}"):
            fresh_rows = stream if bar is None else stream.filter(F.col("seen") + grace >= bar)
            feeder = leaf_changes(fresh_rows, leaves).writeStream.foreachBatch(lambda told, batch: climb(told, batch, leaves, path))
            feeder.option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        if (m := seen.get[f"b{k}"]) is not None:
            bar = m if bar is None else max(bar, m)
    if bar is None:
        return spark.createDataFrame([], _CHANGES)
    return spark.read.schema(_CHANGES).parquet(f"{path}/changes").drop("batch")


#: Fixed values of the shop's calendar: its first day, its days, and the days a line may lag behind.
FIRST_DAY = (date(2024, 1, 1) - date(1970, 1, 1)).days
CALENDAR = 180
BATCHES = 10
GRACE = 3


def batch_of(day: Column) -> Column:
    """The batch of an arrival day; days before the calendar are in the first one."""
    return F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((day - FIRST_DAY) * BATCHES / CALENDAR))).cast("int")


def line_updates(lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """(grp, item, day, value, batch, seen) of every sale line: its vendor's nation, cents by arrival day, and shipping day.

    Both joins are plain exchanges of written tables, so that AQE splits a hot
    vendor or item. Of repeated vendors the smallest nation counts, of repeated
    items the largest price. Item is null where there is no row of items.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = F.crc32(F.concat_ws(",", text("sale_id"), text("item_id"), text("vendor_id"), text("line_no")))
    cents = lambda c: F.floor(100 * c.cast("double") + 0.5)
    seen = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")), (FIRST_DAY + F.col("h") % 150).cast("int"))
    day = F.col("seen") + (F.col("h") % 7).cast("int") + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    sign = F.when(F.col("flag") == "returned", -1).otherwise(1)
    lines = lines.withColumn("h", h).withColumn("seen", seen)
    lines = lines.select("vendor_id", "item_id", "seen", day.alias("day"), (cents(F.col("amount")) * sign).alias("cents"), F.when(F.col("amount").isNull(), F.col("quantity") * sign).alias("pieces"))
    nation = stash(vendors.filter("vendor_id is not null").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("grp")), "nations")
    price = stash(items.filter("item_id is not null").groupBy("item_id").agg(F.max("price").alias("price")).withColumn("item", F.col("item_id")), "prices")
    lines = lines.join(nation.hint("merge"), "vendor_id", "left").drop("vendor_id").join(price.hint("merge"), "item_id", "left")
    value = F.coalesce("cents", (F.col("pieces") * cents(F.col("price"))).cast("long"), F.lit(0).cast("long"))
    return lines.select("grp", F.col("item").cast("long").alias("item"), "day", value.alias("value"), "seen", batch_of(F.col("day")).alias("batch"))


def board_report(lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """(nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue) of every change of a nation's board.

    An empty table of lines gives no rows. Null keys, broken and repeated rows
    follow the rules of :func:`line_updates`.
    """
    leaves = max(1, -(-items.count() // LEAF_ITEMS))
    found = feed_batches(line_updates(lines, vendors, items), BATCHES, leaves, GRACE)
    change = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    return found.select(
        F.col("grp").alias("nation_id"), F.col("day").cast("long").alias("arrival_day"), F.col("item").alias("item_id"), batch_of(F.col("day")).alias("batch"), change.alias("change"), "old_rank", "new_rank", F.col("value").alias("revenue")
    )




#: The same rows: every item's running revenue on every day that its nation has lines, ranked.
REPORT_SQL = """
    WITH steps AS (
        SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
    ), keyed AS (
        SELECT l.*, coalesce(l.sale_id::VARCHAR, '') || ',' || coalesce(l.item_id::VARCHAR, '') || ',' || coalesce(l.vendor_id::VARCHAR, '') || ',' || coalesce(l.line_no::VARCHAR, '') AS k FROM sale_lines l
    ), hashed AS (
        SELECT keyed.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM keyed, steps
    ), shipped AS (
        SELECT *, coalesce(shipped_at::DATE - DATE '1970-01-01', 19723 + h % 150) AS s FROM hashed
    ), arrived AS (
        SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM shipped
    ), dealt AS (
        SELECT *, greatest(1, least(10, 1 + floor((a - 19723) * 10 / 180)))::INTEGER AS b FROM arrived
    ), most AS (
        SELECT b, max(max(s)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar FROM dealt GROUP BY b
    ), daily AS (
        SELECT v.nation_id AS n, a, i.item_id AS item,
               sum((CASE WHEN flag = 'returned' THEN -1 ELSE 1 END) * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * i.price + 0.5), 0)::BIGINT)::BIGINT AS c
        FROM dealt d JOIN most USING (b) JOIN vendors v USING (vendor_id) JOIN items i ON i.item_id = d.item_id
        WHERE v.nation_id IS NOT NULL AND (bar IS NULL OR s + 3 >= bar) GROUP BY ALL
    ), days AS (
        SELECT n, a, row_number() OVER (PARTITION BY n ORDER BY a) AS k FROM (SELECT DISTINCT n, a FROM daily)
    ), running AS (
        SELECT n, k, a, item, sum(coalesce(c, 0)) OVER (PARTITION BY n, item ORDER BY k)::BIGINT AS revenue
        FROM (SELECT DISTINCT n, item FROM daily) JOIN days USING (n) LEFT JOIN daily USING (n, a, item)
    ), board AS (
        SELECT n, k, item, row_number() OVER (PARTITION BY n, k ORDER BY revenue DESC, item)::INTEGER AS r FROM running WHERE revenue > 0 QUALIFY r <= 10
    ), moved AS (
        SELECT n, k, item, x.r AS old_rank, y.r AS new_rank
        FROM (SELECT n, k + 1 AS k, item, r FROM board) x FULL JOIN board y USING (n, k, item) WHERE x.r IS DISTINCT FROM y.r
    )
    SELECT n AS nation_id, a::BIGINT AS arrival_day, item AS item_id, greatest(1, least(10, 1 + floor((a - 19723) * 10 / 180)))::INTEGER AS batch,
           CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank, new_rank, revenue
    FROM moved JOIN running USING (n, k, item)"""
