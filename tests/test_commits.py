"""All-or-nothing commits and a stream of them with acknowledgements."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftlake.sources.commits import read_commits, register, stream_commits, write_commit
from weftlake.streaming import jobs


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_failed_task_leaves_nothing_to_see(spark, tmp_path):
    path = str(tmp_path / "t")
    write_commit(spark.range(0, 10, 1, 3), path)
    broken = spark.range(10, 20, 1, 4).select(F.when(F.col("id") == 19, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_commit(broken, path)
    assert ids(read_commits(spark, path)) == list(range(10)) and len(list((tmp_path / "t" / "_commits").iterdir())) == 1
    write_commit(spark.range(20, 22), path)
    assert ids(read_commits(spark, path, since=0)) == [20, 21]
    write_commit(spark.range(0), path)
    assert ids(read_commits(spark, path)) == [*range(10), 20, 21]
    with pytest.raises(Exception, match="overwritten"):
        spark.range(1).write.format("commits").mode("overwrite").option("path", path).save()
    with pytest.raises(ValueError):
        read_commits(spark, str(tmp_path / "none"))


def test_a_batch_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in (0, 1, 1, 0):
        write_commit(spark.range(batch, batch + 1), path, "w", batch)
    write_commit(spark.range(7, 8), path, "other", 0)
    assert ids(read_commits(spark, path)) == [0, 1, 7]


def test_a_consumer_loses_and_doubles_nothing(spark, tmp_path):
    queue, out = str(tmp_path / "q"), str(tmp_path / "out")
    write_commit(spark.range(0, 5), queue)

    def die(df, epoch):
        raise RuntimeError("killed")

    q = stream_commits(spark, queue, "c").writeStream.option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).foreachBatch(die).start()
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination()
    jobs.consume(spark, queue, f"{out}/0", "c")  # a new run without the checkpoint: nothing was acknowledged
    write_commit(spark.range(5, 9), queue)
    jobs.consume(spark, queue, f"{out}/1", "c")
    assert ids(spark.read.parquet(f"{out}/0")) == [0, 1, 2, 3, 4] and ids(spark.read.parquet(f"{out}/1")) == [5, 6, 7, 8]


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    queue, path = str(tmp_path / "q"), str(tmp_path / "t")
    register(spark)

    def run():
        w = stream_commits(spark, queue).writeStream.format("commits").option("path", path).option("checkpointLocation", str(tmp_path / "k"))
        w.trigger(availableNow=True).start().awaitTermination()

    write_commit(spark.range(0, 3), queue)
    run()
    for f in (tmp_path / "k" / "commits").iterdir():  # as if the engine had died before it noted that the batch is done
        f.unlink()
    run()
    assert ids(read_commits(spark, path)) == [0, 1, 2]


def test_results_become_items_failures_and_triggers(spark, tmp_path):
    rows = [(1, 2, None, 1), (2, 0, None, 1), (3, 1, "bad", 1), (None, 1, None, 1), (1, 5, None, 2), (4, None, None, 1)]
    spark.createDataFrame(rows, "item_id long, chunks long, error string, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    jobs.collect_results(spark.readStream.schema("item_id long, chunks long, error string, seq long").parquet(str(tmp_path / "in")), path)
    assert [(r.item_id, r.chunks) for r in spark.read.parquet(f"{path}/items").collect()] == [(1, 5)]
    assert {(r.item_id, r.error) for r in spark.read.parquet(f"{path}/failures").collect()} == {(2, "no chunks"), (3, "bad"), (None, "no item"), (4, "no chunks")}
    assert [tuple(r) for r in read_commits(spark, f"{path}/triggers").collect()] == [(0, 2, 4)]


@pytest.mark.parametrize("name", ["collection_results", "stream_commits"])
def test_queries_match_their_sql(spark, name):
    from weftlake.plans import streams  # noqa: F401
    from weftlake.plans.registry import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    out = QUERIES[name](spark, folder)
    cols = sorted(out.columns)
    want = sorted((tuple(r) for r in db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()), key=repr)
    assert sorted((tuple(r) for r in out.select(cols).collect()), key=repr) == want and want
