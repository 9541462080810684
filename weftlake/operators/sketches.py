"""Roll-ups of mergeable sketches, and exact quantiles that use one to look at few rows.

Distinct counts (HyperLogLog) and quantiles (KLL) are kept by time bucket and group
and merged for any range of buckets, so that a report over a year reads the
roll-up and no event. All of it runs in the JVM with partial aggregation; a sketch
has a size of its own that doesn't grow with its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.session import stash

#: HyperLogLog registers as a power of two (a standard error of 0.6 %), and KLL's k (a rank error of some 0.3 %).
LG_REGISTERS = 15
KLL_K = 1024
#: Share of the ranks on either side of a quantile that the exact one looks at first.
ASIDE = 0.01


def sketch_rollup(events: DataFrame, keys: list[str], distinct: str, value: str, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """(bucket, *keys, n, distincts, quantiles): counts and sketches of each bucket and group.

    Null values are in ``n`` but in no sketch; rows without a time have no bucket
    and are left out; null keys are a group.
    """
    rows = events.filter(F.col(ts).isNotNull()).withColumn("_bucket", F.window(F.col(ts).cast("timestamp"), width)["start"])
    g = rows.groupBy("_bucket", *keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(distinct), F.lit(LG_REGISTERS)).alias("distincts"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("quantiles"),
    )
    return g.withColumnRenamed("_bucket", "bucket")


def merged_rollup(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """The roll-up of any of its rows by fewer keys: counts add up, sketches are united."""
    return rollup.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distincts").alias("distincts"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def read_rollup(rollup: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Sketches as numbers: ``users`` for the distinct count and a column for each quantile."""
    some = F.kll_sketch_get_n_double("quantiles") > 0
    named = {f"p{q * 100:g}": F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q)))) for q in quantiles}
    return rollup.withColumn("users", F.hll_sketch_estimate("distincts")).withColumns(named).drop("distincts", "quantiles")


def _value_at(quantiles: tuple[float, ...], side: float) -> Column:
    """The value that the sketch ``s`` names ``side`` ranks beside quantile number ``k``; a rank has to be a constant."""
    each = [F.when(F.col("k") == k, F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, q + side))))) for k, q in enumerate(quantiles)]
    return F.coalesce(*each)


def exact_quantiles(rows: DataFrame, key: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(key, p50, ...): interpolated quantiles of each group, exact, without a group in one buffer.

    A sketch names, for each quantile, two values between which it lies. A second
    pass counts what is below them and the equal values in between, a few hundredths
    of the rows, and finds the quantile by its rank there. Where the counts show that
    it lies elsewhere the two values move apart and the pass is repeated. Nulls and
    NaN are ignored; a group of these alone has null quantiles; a null key is a group.
    """
    v = F.col(value).cast("double")
    rows = rows.select(F.col(key).alias("key"), F.when(~F.isnan(v), v).alias("v"))
    base = stash(rows.groupBy("key").agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", F.lit(KLL_K)).alias("s")), "quantiles")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q")) for k, q in enumerate(quantiles)]))
    open_, found, aside = base.filter("n > 0").select("key", "n", "s", each.alias("x")).select("key", "n", "s", "x.k", "x.q"), None, ASIDE
    at = F.col("q") * (F.col("n") - 1)
    while True:
        whole = aside >= 1
        lo, hi = (F.lit(float("-inf")), F.lit(float("inf"))) if whole else (_value_at(quantiles, side) for side in (-aside, aside))
        limits = open_.select(F.col("key").alias("of"), "k", "q", F.floor(at).alias("first"), F.ceil(at).alias("last"), (at - F.floor(at)).alias("part"), lo.alias("lo"), hi.alias("hi"))
        near = rows.join(stash(limits, "limits"), F.col("key").eqNullSafe(F.col("of"))).filter(F.col("v") <= F.col("hi"))
        counted = near.groupBy("key", "k", "q", "first", "last", "part", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
        w = Window.partitionBy("key", "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counted.withColumn("upto", F.sum("c").over(w))
        one = lambda r: F.max(F.when((F.col("upto") > F.col(r)) & (F.col("upto") - F.col("c") <= F.col(r)), F.col("v")))
        got = stash(ranked.groupBy("key", "k", "q", "part").agg(one("first").alias("a"), one("last").alias("b")), "quantiles")
        done = got.filter("a IS NOT NULL AND b IS NOT NULL").select("key", "k", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("v"))
        found = done if found is None else found.unionByName(done)
        left = got.filter("a IS NULL OR b IS NULL").select(F.col("key").alias("of"), "k", "q")
        if whole or left.isEmpty():
            break
        open_ = base.join(left, F.col("key").eqNullSafe(F.col("of"))).select("key", "n", "s", "k", "q")
        aside *= 8
    names = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"p{q * 100:g}") for k, q in enumerate(quantiles)]
    none = base.filter("n = 0").select("key", F.lit(0).alias("k"), F.lit(None).cast("double").alias("v"))
    return found.unionByName(none).groupBy(F.col("key").alias(key)).agg(*names)
