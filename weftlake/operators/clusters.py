"""Clustering: sampling, reduction, labels and the point map; density clusters come from :mod:`weftlake.operators.density`."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.operators.density import NOISE

UNLABELLED = "Unlabelled"
MAX_POINTS = 100_000_000


def sample_points(points: DataFrame, most: int = MAX_POINTS, seed: int = 42, key: str = "id") -> DataFrame:
    """At most ``most`` points, drawn without replacement: those whose keys have the smallest hashes, equal ones by key.

    The count says which hashes are surely in and which may be; only the latter,
    some thousandths of the points, are sorted.
    """
    rows = points.count()
    if rows <= most:
        return points
    h = F.xxhash64(key, F.lit(seed))
    aside = 8 * (most + 1) ** 0.5
    low, high = (min(int(max(x, 0) / rows * (1 << 64)) - (1 << 63), (1 << 63) - 1) for x in (most - aside, most + aside))
    sure = points.filter(h < low)
    n = sure.count()
    rest = points.filter((h >= low) & (h <= high))
    if n > most or n + rest.count() < most:  # many equal keys
        return points.orderBy(h, key).limit(most)
    return sure.unionByName(rest.orderBy(h, key).limit(most - n))


def reduce_2d(points: DataFrame, vector: str = "embedding") -> DataFrame:
    """Points with x and y: the two principal components of their unit vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from weftlake.functions.vectors import unit

    v = points.withColumn("_v", array_to_vector(unit(F.col(vector))))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("_p", vector_to_array("_p"))
    return out.withColumn("x", F.col("_p")[0]).withColumn("y", F.col("_p")[1]).drop("_v", "_p")


def cluster_stats(labelled: DataFrame, label: str = "label") -> DataFrame:
    """One row: points, clusters (labels from 0 on) and noise points."""
    return labelled.agg(F.count("*").alias("points"), F.countDistinct(F.when(F.col(label) >= 0, F.col(label))).alias("clusters"), F.count(F.when(F.col(label) == NOISE, 1)).alias("noise"))


def cluster_samples(labelled: DataFrame, n: int = 5, label: str = "label", key: str = "id", text: str = "text") -> DataFrame:
    """(label, samples): the first ``n`` texts of each cluster that aren't empty, in the order of their ids."""
    w = Window.partitionBy(label).orderBy(key)
    rows = labelled.filter((F.col(label) >= 0) & (F.coalesce(F.col(text), F.lit("")) != "")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return rows.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))), lambda s: s["t"]), "\n").alias("samples"))


def topic_prompt(template: str, samples: str) -> str:
    """The naming prompt; a template without its mark is replaced by the built-in one."""
    built_in = "Name the common topic of these texts in at most five words:\n\n{{samples}}"
    return (template if "{{samples}}" in template else built_in).replace("{{samples}}", samples)


def name_clusters(samples: DataFrame, namer: Callable[[str], str], label: str = "label") -> dict[int, str]:
    """Names by cluster; a namer that fails leaves ``Cluster k`` for that one. One row a cluster comes to the driver."""
    out = {}
    for r in samples.collect():
        try:
            out[r[label]] = namer(r["samples"]).strip() or f"Cluster {r[label]}"
        except Exception:
            out[r[label]] = f"Cluster {r[label]}"
    return out


def frequent_words_namer(samples: str, n: int = 3) -> str:
    """A namer without a model: the most frequent long words."""
    from collections import Counter

    words = Counter(w for w in samples.lower().split() if len(w) > 3 and w.isalpha())
    return " ".join(w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:n])


def point_labels(labelled: DataFrame, names: DataFrame, noise: str = UNLABELLED, label: str = "label") -> DataFrame:
    """Add label_name: the noise label for -1, else the cluster's name or ``Cluster k``."""
    out = labelled.join(names.select(F.col("cluster").alias(label), F.col("name").alias("_name")), label, "left")
    return out.withColumn("label_name", F.when(F.col(label) == NOISE, noise).otherwise(F.coalesce("_name", F.concat(F.lit("Cluster "), F.col(label).cast("string"))))).drop("_name")


def plot_html(points: pd.DataFrame, title: str = "Clusters") -> str:
    """A self-contained page with one dot for each point (x, y, label_name, hover)."""
    import html
    import json

    data = json.dumps(points[["x", "y", "label_name", "hover"]].to_dict("records"))
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><canvas id=c width=900 height=700></canvas><pre id=t></pre><script>const d={data.replace('</', '<\\/')};"
        "const c=document.getElementById('c'),g=c.getContext('2d'),xs=d.map(p=>p.x),ys=d.map(p=>p.y),a=Math.min(...xs),b=Math.max(...xs),e=Math.min(...ys),f=Math.max(...ys);"
        "const n=[...new Set(d.map(p=>p.label_name))];d.forEach(p=>{p.u=10+880*(p.x-a)/(b-a||1);p.v=690-680*(p.y-e)/(f-e||1);g.fillStyle=`hsl(${360*n.indexOf(p.label_name)/n.length} 70% 45%)`;g.fillRect(p.u-2,p.v-2,4,4)});"
        "c.onmousemove=m=>{const h=d.find(p=>Math.hypot(p.u-m.offsetX,p.v-m.offsetY)<5);document.getElementById('t').textContent=h?h.label_name+'\\n'+h.hover:''}</script>"
    )
