"""Merges that are cut off, leases, redelivery, caches, events and the layout of tables."""

import pytest
from pyspark.sql import functions as F

from weftlake.operators import embed as e
from weftlake.operators.chat import token_events
from weftlake.operators.ledger import redeliveries
from weftlake.operators.search import check_push, latest_points, parse_point_id
from weftlake.session import shared_path
from weftlake.sources import blobs
from weftlake.streaming import jobs


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, v int, seq int")


def content(spark, path):
    return {(r.id, r.v) for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("after", [0, 1, 3])
def test_a_merge_that_is_cut_off_loses_nothing(spark, tmp_path, monkeypatch, after):
    path = str(tmp_path / "t")
    first = [(str(i), 1, 1) for i in range(40)]
    blobs.merge_into(spark, frame(spark, *first), path, "id", "seq", buckets=4)
    real, calls = blobs.delete, []

    def cut(s, p):
        if "_bucket=" in p:
            calls.append(p)
            if len(calls) > after:
                raise KeyboardInterrupt
        return real(s, p)

    monkeypatch.setattr(blobs, "delete", cut)
    with pytest.raises(KeyboardInterrupt):
        blobs.merge_into(spark, frame(spark, *[(str(i), 2, 2) for i in range(40, 60)], ("0", 2, 2)), path, "id", "seq")
    monkeypatch.setattr(blobs, "delete", real)
    blobs.finish_merge(spark, path)
    assert content(spark, path) == {(str(i), 1) for i in range(1, 40)} | {("0", 2)} | {(str(i), 2) for i in range(40, 60)}
    assert not blobs.exists(spark, f"{path}/_next")


def test_a_merge_cut_off_before_its_mark_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    blobs.merge_into(spark, frame(spark, ("a", 1, 1)), path, "id", "seq")
    frame(spark, ("a", 9, 9)).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{path}/_next")
    blobs.merge_into(spark, frame(spark, (None, 1, 1), ("b", 1, 1)), path, "id", "seq")
    assert content(spark, path) == {("a", 1), ("b", 1), (None, 1)}


def test_a_merge_writes_only_what_it_touches(spark, tmp_path):
    path = tmp_path / "t"
    blobs.merge_into(spark, frame(spark, *[(str(i), 1, 1) for i in range(100)]), str(path), "id", "seq", buckets=8)
    was = {f: f.stat().st_mtime_ns for f in path.glob("_bucket=*/*.parquet")}
    blobs.merge_into(spark, frame(spark, ("7", 2, 2)), str(path), "id", "seq")
    now = {f: f.stat().st_mtime_ns for f in path.glob("_bucket=*/*.parquet")}
    assert len({f.parent for f in was if now.get(f) != was[f]}) == 1 and len(content(spark, str(path))) == 100
    blobs.merge_into(spark, frame(spark, ("7", 2, 2)).limit(0), str(path), "id", "seq")
    assert ("7", 2) in content(spark, str(path))


def test_buckets_split_as_a_table_grows(spark, tmp_path):
    path = tmp_path / "t"
    merge = lambda rows: blobs.merge_into(spark, frame(spark, *rows), str(path), "id", "seq", buckets=2, bucket_rows=50)
    want = {}
    for k, n in enumerate((40, 400, 1200)):
        rows = [(str(i), k, k) for i in range(n // 4, n)] + ([(None, k, k)] if k else [])
        merge(rows)
        want |= {i: v for i, v, _ in rows}
    assert content(spark, str(path)) == {(i, v) for i, v in want.items()}
    sizes = {r["_bucket"]: r["count"] for r in spark.read.parquet(str(path)).groupBy("_bucket").count().collect()}
    assert max(sizes.values()) <= 50 and len(sizes) > 24
    # A merge of one row writes one bucket, however large the table.
    was = {f: f.stat().st_mtime_ns for f in path.glob("_bucket=*/*.parquet")}
    merge([("7", 9, 9)])
    fresh = [f for f in path.glob("_bucket=*/*.parquet") if was.get(f) != f.stat().st_mtime_ns]
    assert len({f.parent for f in fresh}) == 1 and content(spark, str(path)) == {(i, v) for i, v in (want | {"7": 9}).items()}


def test_a_split_that_is_cut_off_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    blobs.merge_into(spark, frame(spark, *[(str(i), 1, 1) for i in range(40)]), path, "id", "seq", buckets=1, bucket_rows=50)
    deleted = blobs.delete

    def die(s, p):
        deleted(s, p)
        if "_bucket=" in p:
            raise RuntimeError("killed")

    monkeypatch.setattr(blobs, "delete", die)
    with pytest.raises(RuntimeError, match="killed"):
        blobs.merge_into(spark, frame(spark, *[(str(i), 2, 2) for i in range(30, 90)]), path, "id", "seq", bucket_rows=50)
    monkeypatch.setattr(blobs, "delete", deleted)
    blobs.finish_merge(spark, path)
    assert content(spark, path) == {(str(i), 1 if i < 30 else 2) for i in range(90)}


def test_equal_sequences_have_one_survivor(spark):
    rows = [("a", i, 1) for i in range(50)]
    one = latest_points(frame(spark, *rows).repartition(7)).collect()
    assert one == latest_points(frame(spark, *rows[::-1]).repartition(3)).collect() and len(one) == 1


def test_files_are_copied_and_deleted_by_prefix(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    a, b = str(tmp_path / "in"), str(tmp_path / "out")
    assert blobs.is_empty(spark, a) and blobs.is_empty(spark, b) and blobs.copy_below(spark, b, a) == 0
    (tmp_path / "in" / "x").write_text("1")
    (tmp_path / "in" / "deep" / "y z").write_text("2")
    assert blobs.copy_below(spark, a, b) == 2 and (tmp_path / "out" / "deep" / "y z").read_text() == "2"
    assert blobs.exists(spark, f"{b}/x") and blobs.delete(spark, f"{b}/x") and not blobs.exists(spark, f"{b}/x") and not blobs.delete(spark, f"{b}/x")
    assert blobs.delete(spark, a) and blobs.is_empty(spark, a) and not blobs.is_empty(spark, b)


def test_collections_keep_their_dimension(spark, tmp_path):
    path = str(tmp_path / "c")
    assert blobs.create_collection(spark, path, 8, buckets=2) and not blobs.create_collection(spark, path, 8)
    with pytest.raises(ValueError):
        blobs.create_collection(spark, path, 9)
    blobs.merge_into(spark, frame(spark, ("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), path, "id", "seq")
    assert len(content(spark, path)) == 3 and len(list((tmp_path / "c").glob("_bucket=*"))) <= 2


def test_a_lease_is_held_by_one_and_lapses(spark, tmp_path):
    import time

    ahead = [0.0]
    one, two = (blobs.Lease(spark, str(tmp_path / "lease"), 300, lambda: time.time() + ahead[0]) for _ in range(2))
    assert one.acquire() and not two.acquire()
    one.release()
    assert two.acquire() and not one.acquire()
    ahead[0] = 301.0
    assert one.acquire()
    ahead[0] = 0.0
    assert not two.acquire()


def test_indexed_tables_prune_folders(spark, tmp_path):
    path = str(tmp_path / "i")
    blobs.save_indexed(spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("owner")), path, ["owner"], ["id"], 4)
    q = spark.read.parquet(path).filter("owner = 1 AND id = 4")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(owner" in plan and "EqualTo(id,4)" in plan and q.count() == 1


def test_failed_messages_wait_longer_and_then_are_dead(spark):
    rows = [("a", f"2024-01-01 00:00:0{i}", i, f"e{i}") for i in range(5)] + [("b", "2024-01-01 00:00:00", 1, "x"), ("b", "2024-01-01 00:00:00", 2, None)]
    f = spark.createDataFrame(rows, "message_id string, ts string, seq int, error string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.message_id: (r.attempts, r.last_error, r.dead, r.d) for r in redeliveries(f).withColumn("d", F.date_format("due_at", "HH:mm:ss")).collect()}
    assert got == {"a": (5, "e4", True, None), "b": (2, None, False, "00:01:00")}
    assert redeliveries(f.limit(0)).count() == 0


def test_delivery_splits_good_from_failed(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, 1, "ok"), (2, 1, "bad"), (2, 2, "bad"), (3, 1, "bad"), (3, 2, "ok")]
    spark.createDataFrame(rows, "message_id long, seq long, body string").write.parquet(src)
    stream = spark.readStream.schema("message_id long, seq long, body string").parquet(src)
    path = shared_path(spark, "deliver")
    jobs.deliver(stream, lambda d: d.withColumn("error", F.when(F.col("body") == "bad", F.lit("broken"))), path)
    assert {r.message_id for r in spark.read.parquet(f"{path}/done").collect()} == {1, 3}
    assert sorted((r.message_id, r.seq) for r in spark.read.parquet(f"{path}/failed").collect()) == [(2, 1), (2, 2), (3, 1)]


def test_statuses_go_to_their_subject(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("o 1", 5, "done"), ("p.q", 6, "run")], "owner string, id long, status string").write.parquet(src)
    s = spark.readStream.schema("owner string, id long, status string").parquet(src)
    jobs.fan_out_statuses(s.select(jobs.subject(F.col("owner"), F.lit("dataset"), F.col("id")).alias("subject"), "status"), out)
    assert {(r.subject, r.status) for r in spark.read.json(out).collect()} == {("status.dataset.o_1.5", "done"), ("status.dataset.p_q.6", "run")}


def test_point_ids(spark):
    u = "0123456789abcdef0123456789abcdef"
    h = "01234567-89ab-cdef-0123-456789abcdef"
    want = {u: (h, None), h.upper(): (h, None), "{" + h + "}": (h, None), "urn:uuid:" + h: (h, None), "0": (None, 0), "+7": (None, 7), "-7": (None, None), "": (None, None)}
    want |= {"18446744073709551615": (None, 2**64 - 1), "18446744073709551616": (None, None), "000" + "9" * 19: (None, 10**19 - 1), "x": (None, None), h + "0": (None, None), None: (None, None)}
    rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", parse_point_id(F.col("s")).alias("p")).collect()
    assert {r.s: (r.p.uuid, None if r.p.num is None else int(r.p.num)) for r in rows} == want


def test_pushes_and_batches_are_bounded():
    check_push(1000, True)
    for n, standalone in ((0, True), (1001, True), (5, False)):
        with pytest.raises(ValueError):
            check_push(n, standalone)
    p = e.HashingProvider(4)
    assert e.embed_batch(p, []) == {"embeddings": [], "model": "", "count": 0, "dimensions": 0}
    got = e.embed_batch(p, ["a", "b"], "m", most=2)
    assert (got["count"], got["dimensions"], got["model"]) == (2, 4, "m")
    with pytest.raises(ValueError):
        e.embed_batch(p, ["a", "b", "c"], most=2)


def test_cached_values_lapse():
    now, made = [0.0], []
    cache = e.TtlCache(10, 2, lambda: now[0])

    def make():
        made.append(1)
        return len(made)

    assert [cache.get("a", make), cache.get("a", make)] == [1, 1]
    now[0] = 10.0
    assert cache.get("a", make) == 2
    cache.get("b", make)
    cache.get("a", make)
    cache.get("c", make)
    assert cache.get("a", make) == 2 and cache.get("b", make) == 5
    cache.forget("a")
    assert cache.get("a", make) == 6


def test_token_events():
    ended = []
    out = list(token_events(3, [{"id": 1}], iter(["a", "b"]), lambda *x: ended.append(x)))
    assert [x.split("\n")[0] for x in out] == ["event: " + n for n in ("connected", "retrieval_complete", "content", "content", "complete")]
    assert out[1] == 'event: retrieval_complete\ndata: {"message_id":3,"documents":[{"id":1}]}\n\n' and ended == [("ab", "complete")]

    def broken():
        yield "a"
        raise RuntimeError("x")

    assert list(token_events(3, [], broken(), lambda *x: ended.append(x)))[-1] == 'event: error\ndata: {"error":"x"}\n\n' and ended[-1] == ("a", "error")
    g = token_events(3, [], iter("abc"), lambda *x: ended.append(x))
    [next(g) for _ in range(3)]
    g.close()
    assert ended[-1] == ("a", "incomplete")


def test_nearest_points_follow_brute_force(spark, monkeypatch):
    """Equal vectors, zero and null ones, other dimensions, blocks of queries and of products."""
    import random

    from weftlake.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rng = random.Random(5)
    vectors = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(30)]
    points = [(d, i, v) for i in range(160) for d, v in [(i % 3, vectors[rng.randrange(30)])]] + [(0, 900, [0.0] * 6), (1, 901, None), (2, 902, [1.0, 2.0]), (7, 903, vectors[0])]
    queries = [(i, vectors[i]) for i in range(9)] + [(90, [0.0] * 6), (91, [3.0, 1.0]), (92, None)]

    def cosine(a, b):
        if a is None or len(a) != len(b):
            return 0.0
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = set()
    for qid, q in queries:
        for d in (0, 1, 2, 7) if q else ():
            found = sorted((-round(cosine(v, q), 9), i) for e, i, v in points if e == d and round(cosine(v, q), 9) >= 0)
            want |= {(qid, d, i, r) for r, (_, i) in enumerate(found[:4], 1)}
    p = spark.createDataFrame(points, "dataset int, id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, qv array<double>")
    got = search.fan_out(p, q, 4).collect()
    assert {(r.query_id, r.dataset, r.id, r["rank"]) for r in got} == want and len(got) == len(want)
    assert search.fan_out(p.limit(0), q, 4).count() == 0 and search.fan_out(p, q.limit(0), 4).count() == 0
