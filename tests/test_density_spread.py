"""Density clusters over many cells equal those of all pairs of points."""

import numpy as np
import pandas as pd
import pytest

from weftlake.operators import density


def brute(xy, least, k):
    """Labels by all pairs, points in the order of (x, y), edges by (reach, distance, places)."""
    places, at = np.unique(xy, axis=0, return_inverse=True)
    at = at.reshape(-1)
    n = len(xy)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, k - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    a, b = np.triu_indices(n, 1)
    i, j = np.minimum(at[a], at[b]), np.maximum(at[a], at[b])
    order = np.lexsort((j, i, d[a, b], w[a, b]))
    root, node, kids, size = list(range(n)), list(range(n)), {}, [1] * n
    for e in order:
        p, q = int(a[e]), int(b[e])
        p, q = density.find(root, p), density.find(root, q)
        if p != q:
            root[q] = p
            kids[len(size)] = (node[p], node[q], w[a[e], b[e]])
            size.append(size[node[p]] + size[node[q]])
            node[p] = len(size) - 1

    def leaves(v):
        out, todo = [], [v]
        while todo:
            u = todo.pop()
            if u < n:
                out.append(u)
            else:
                todo += kids[u][:2]
        return out

    def cluster(v, born):
        """(worth, chosen nodes) of the cluster that begins at node v."""
        gain, u = 0.0, v
        while True:
            if u < n:
                return gain, [v]
            p, q, h = kids[u]
            lam = 1 / h if h > 0 else density.TOP
            big = [x for x in (p, q) if size[x] >= least]
            gain += sum(size[x] for x in (p, q) if size[x] < least or len(big) == 2) * (lam - born)
            if len(big) == 2:
                under = [cluster(x, lam) for x in big]
                inner = sum(g for g, _ in under)
                return (gain, [v]) if gain >= inner and born > 0 else (inner, [c for _, cs in under for c in cs])
            if not big:
                return gain, [v] if born > 0 else []
            u = big[0]

    labels = np.full(n, -1)
    groups = sorted((leaves(c) for c in cluster(len(size) - 1, 0.0)[1]), key=lambda m: min(at[x] for x in m))
    for c, m in enumerate(groups):
        labels[m] = c
    return labels


def spread(spark, xy, **kw):
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1], "cell": "other"}))
    out = density.density_clusters(frame, **kw).toPandas().sort_values("id")
    assert len(out) == len(xy)
    return out["cluster"].to_numpy()


def shapes():
    r = np.random.default_rng(3)
    blobs = np.concatenate([r.normal(c, s, (m, 2)) for c, s, m in (((0, 0), 0.2, 300), ((3, 0), 0.5, 250), ((0, 4), 0.1, 120), ((3.4, 1), 0.05, 40), ((50, 50), 1, 20))] + [r.uniform(-5, 8, (90, 2))])
    hot = np.concatenate([blobs[:400], np.repeat([[1.0, 1.0]], 200, axis=0), np.repeat([[9.0, 9.0]], 7, axis=0), np.repeat(r.normal((6, 6), 0.3, (30, 2)), 3, axis=0)])
    return {"blobs": blobs, "hot": hot, "line": np.column_stack([np.zeros(300), np.sort(r.exponential(1, 300)).cumsum()])}


@pytest.mark.parametrize("shape", ["blobs", "hot", "line"])
def test_cells_give_the_labels_of_all_pairs(spark, shape):
    xy = shapes()[shape]
    want = brute(xy, 15, 5)
    assert np.array_equal(spread(spark, xy, cell=64), want)
    assert np.array_equal(spread(spark, xy), want)


def test_ties_of_a_lattice_do_not_depend_on_cells(spark):
    g = np.stack(np.meshgrid(np.arange(14.0), np.arange(9.0)), axis=-1).reshape(-1, 2)
    xy = np.concatenate([g, g * 0.5 + 40, g[:40] * 0.25 + (0, 60)])
    want = brute(xy, 12, 4)
    assert np.array_equal(spread(spark, xy, min_cluster_size=12, min_samples=4, cell=32), want)


def test_bands_of_edges_do_not_change_labels(spark, monkeypatch):
    xy = shapes()["blobs"]
    monkeypatch.setattr(density, "BAND", 300)
    monkeypatch.setattr(density, "VISITORS", 20)
    assert np.array_equal(spread(spark, xy, cell=100), brute(xy, 15, 5))


def test_points_without_place_and_few_points_are_noise(spark):
    rows = [(1, None, 1.0), (2, float("nan"), 0.0), (3, float("inf"), 0.0), (3, 1.0, 1.0), (4, 1.0, -0.0), (4, 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "id int, x double, y double")
    assert sorted(r.cluster for r in density.density_clusters(frame).collect()) == [-1] * 6
    assert density.density_clusters(frame.limit(0)).collect() == []
    same = spark.createDataFrame([(k, 2.0, 2.0) for k in range(40)], "id int, x double, y double")
    assert {r.cluster for r in density.density_clusters(same).collect()} == {-1}
    two = spark.createDataFrame([(k, 2.0 * (k % 2), -0.0 if k % 4 else 0.0) for k in range(80)] + [(99, None, None)], "id int, x double, y double")
    assert {(r.id % 2, r.cluster) for r in density.density_clusters(two).collect() if r.id < 99} == {(0, 0), (1, 1)}


def test_one_mark_of_another_cell_is_enough(spark, monkeypatch):
    monkeypatch.setattr(density, "MARKS", 1)
    xy = shapes()["blobs"]
    assert np.array_equal(spread(spark, xy, cell=64), brute(xy, 15, 5))


def test_a_cell_looks_for_visits_once_and_finds_all():
    r = np.random.default_rng(5)
    xy = r.normal(size=(600, 2))
    g = pd.DataFrame({"cell": np.int32(7), "loc": np.arange(600), "x": xy[:, 0], "y": xy[:, 1], "bound": r.exponential(0.05, 600), "comp": np.arange(600) % 3})
    low = r.uniform(-3, 3, (200, 2))
    boxes = pd.DataFrame({"cell": np.arange(200, dtype=np.int32), "a": low[:, 0], "b": low[:, 1], "c": low[:, 0] + 0.1, "d": low[:, 1] + 0.1, "only": np.arange(200) % 4 - 1})
    got = density._visits(g, boxes, ["loc", "comp"])
    want = {(k, b.cell) for b in boxes.itertuples() for k in np.flatnonzero((density._far(xy[:, 0], xy[:, 1], (b.a, b.b, b.c, b.d)) <= g["bound"]) & (g["comp"] != b.only)) if b.cell != 7}
    assert want and sorted(zip(got["loc"], got["cell"])) == sorted(want)
    assert list(density._visits(g.assign(bound=0.0), boxes.iloc[7:8], ["loc", "comp"]).columns) == ["loc", "comp", "cell"]


def test_cells_are_dealt_to_tasks_by_number_not_by_bytes(spark):
    cells = spark.range(64).selectExpr("cast(id AS int) AS cell")
    assert density.by_cell(cells, 32).groupBy("cell").count().rdd.getNumPartitions() == 32


def test_a_length_is_summed_once_for_a_vector(spark):
    from pyspark.sql import functions as F

    from weftlake.functions.vectors import unit

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(unit(F.col("v")).alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
