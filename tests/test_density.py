"""Density clusters span all points, however many."""

import numpy as np
import pandas as pd

from weftlake.operators import density


def many():
    """50,100 points: two wide groups and 200 of fifteen points each, the least that a cluster needs."""
    r = np.random.default_rng(9)
    small = [r.normal((50 + 5 * (k % 20), 5 * (k // 20)), 0.01, (15, 2)) for k in range(200)]
    return np.concatenate([r.normal((0, 0), 0.3, (23_500, 2)), r.normal((10, 0), 0.3, (23_600, 2)), *small])


def test_small_clusters_stay_among_many_points(spark):
    xy = many()
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))
    out = density.density_clusters(frame).toPandas().sort_values("id")["cluster"].to_numpy()
    small = out[-3000:].reshape(200, 15)
    assert len(out) == len(xy) and (small >= 0).all() and (small == small[:, :1]).all() and len(set(small[:, 0])) == 200
