"""Density clusters over many tasks: mutual reachability, its minimum spanning tree, the most stable branches.

Equal points become one location with a weight. A k-d tree, fitted to a bounded
sample, deals the locations to cells. A cell finds core distances alone, and only
locations whose ball leaves the cell visit the cells that it meets. Cells make
their own spanning trees; then every component (at first what a cell can link
safely by itself) looks for its least edge to another one, in its own cells, and
beyond in cells nearer than the best edge known. All edges so found hold the
minimum spanning tree. They are merged in ascending order, in bands of
``BAND`` edges: a component carries its size and four numbers, so a band needs the
state of what it touches, and stability is summed on the way up.

Edges are ordered by (reach, distance, locations), which makes tree and labels
independent of cells and partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.session import drop_stash, stash

NOISE = -1
#: Locations that a cell should hold, and the most cells; beyond their product cells grow.
CELL, MAX_CELLS = 2048, 4096
#: Sampled locations for each cell: at most 64 * 4,096 rows come to the driver.
SAMPLE = 64
#: Rows of a block of distances, visitors of a cell in one task, edges in a band.
BLOCK, VISITORS, BAND = 256, 32_768, 500_000
#: Most tasks over cells, and marks of other cells that a cell looks at for a bound.
TASKS, MARKS = 1024, 256
#: Inverse of the distance zero.
TOP = 1e12

EDGE = "w double, d double, i long, j long"
PLACE = "cell int, loc long, x double, y double, m long"


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in an order without ties; counts by partition are all that the driver sees."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    r = stash(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), low.alias("_k")), "numbered")
    before, rows = 0, []
    for x in r.groupBy("_p").count().orderBy("_p").collect():
        rows.append((x["_p"], before))
        before += x["count"]
    start = df.sparkSession.createDataFrame(rows, "_p int, _before long")
    return r.join(F.broadcast(start), "_p").withColumn(name, F.col("_k") + F.col("_before")).drop("_p", "_k", "_before")


class Cells:
    """A k-d tree over sampled points: halves by the median of the wider side."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cuts: dict[int, tuple[int, float]] = {}
        self.leaves: dict[int, tuple[float, float, float, float]] = {}
        depth = max(int(np.ceil(np.log2(max(cells, 1)))), 0)
        todo = [(1, sample, (-np.inf, -np.inf, np.inf, np.inf))]
        while todo:
            node, pts, box = todo.pop()
            span = np.ptp(pts, axis=0) if len(pts) else np.zeros(2)
            axis = int(np.argmax(span))
            if node.bit_length() > depth or not span[axis] > 0:
                self.leaves[node] = box
                continue
            at = float(np.median(pts[:, axis]))
            if not (pts[:, axis] < at).any():
                at = float(pts[pts[:, axis] > at, axis].min())
            self.cuts[node] = (axis, at)
            left, right = list(box), list(box)
            left[2 + axis] = right[axis] = at
            low = pts[:, axis] < at
            todo += [(2 * node, pts[low], tuple(left)), (2 * node + 1, pts[~low], tuple(right))]

    def of(self, xy: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(xy), np.int32), [(1, np.arange(len(xy)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaves:
                out[rows] = node
            elif len(rows):
                axis, at = self.cuts[node]
                low = xy[rows, axis] < at
                todo += [(2 * node, rows[low]), (2 * node + 1, rows[~low])]
        return out

    def inside(self, cell: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distance of points of a cell to what isn't the cell."""
        a, b, c, d = self.leaves[cell]
        return np.minimum(np.minimum(x - a, c - x), np.minimum(y - b, d - y))


def by_cell(df: DataFrame, cells: int, *keys: str) -> DataFrame:
    """``df`` dealt by cell: Spark makes tasks by bytes, and the costly work of many cells would be one task's."""
    return df.repartition(min(cells, TASKS), "cell", *keys)


def _far(x: np.ndarray, y: np.ndarray, box) -> np.ndarray:
    """Distance of points to a box."""
    dx = np.maximum(np.maximum(box[0] - x, x - box[2]), 0)
    dy = np.maximum(np.maximum(box[1] - y, y - box[3]), 0)
    return np.sqrt(dx * dx + dy * dy)


def _distances(x, y, x2, y2) -> np.ndarray:
    return np.sqrt((x[:, None] - x2[None]) ** 2 + (y[:, None] - y2[None]) ** 2)


def _nearest(loc, x, y, x2, y2, m2, k: int) -> Iterator[pd.DataFrame]:
    """(loc, d, m): the ``k`` nearest locations of each with their weights."""
    k = min(k, len(x2))
    for a in range(0, len(x), BLOCK):
        d = _distances(x[a : a + BLOCK], y[a : a + BLOCK], x2, y2)
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        yield pd.DataFrame({"loc": np.repeat(loc[a : a + BLOCK], k), "d": np.take_along_axis(d, at, 1).reshape(-1), "m": m2[at].reshape(-1)})


def _own_nearest(g: pd.DataFrame, cells: Cells, k: int) -> pd.DataFrame:
    """(loc, cell, x, y, bound, d, m): the nearest in the cell; bound, in one row of a location, is a core distance that suffices, null where the ball stays inside."""
    x, y, m, loc = (g[c].to_numpy() for c in ("x", "y", "m", "loc"))
    near = pd.concat(list(_nearest(loc, x, y, x, y, m, k))).sort_values(["loc", "d"])
    near["held"] = near.groupby("loc")["m"].cumsum()
    first = ~near["loc"].duplicated().to_numpy()
    core = near[near["held"] >= k].groupby("loc")["d"].first().reindex(loc).fillna(np.inf).to_numpy()
    cell = int(g["cell"].iloc[0])
    bound = pd.Series(np.where(core <= cells.inside(cell, x, y), np.nan, core), index=loc)
    at = g.set_index("loc")
    who = near["loc"].to_numpy()
    return pd.DataFrame({"loc": who, "cell": cell, "x": at["x"].loc[who].to_numpy(), "y": at["y"].loc[who].to_numpy(), "bound": np.where(first, bound.loc[who].to_numpy(), np.nan), "d": near["d"].to_numpy(), "m": near["m"].to_numpy()})


def _visits(g: pd.DataFrame, boxes: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """Rows of a cell for each other cell within their bound; ``boxes`` are (cell, a, b, c, d, the only component or -1)."""
    x, y, reach, cell = g["x"].to_numpy(), g["y"].to_numpy(), g["bound"].to_numpy(), g["cell"].iloc[0]
    comp = g["comp"].to_numpy() if "comp" in g else None
    dx = np.maximum(np.maximum(boxes["a"] - x.max(), x.min() - boxes["c"]), 0)
    dy = np.maximum(np.maximum(boxes["b"] - y.max(), y.min() - boxes["d"]), 0)
    near = (np.sqrt(dx * dx + dy * dy) <= reach.max()) & (boxes["cell"] != cell)
    if comp is not None and (comp == comp[0]).all():
        near &= boxes["only"] != comp[0]
    out = [g.iloc[:0][columns].assign(cell=cell)]
    for other, *box, only in boxes[near].itertuples(index=False):
        hit = _far(x, y, box) <= reach
        if comp is not None and only >= 0:
            hit &= comp != only
        if hit.any():
            out.append(g.loc[hit, columns].assign(cell=np.int32(other)))
    return pd.concat(out)


def _hosted(visits: DataFrame, places: DataFrame, cells: int, run, schema: str) -> DataFrame:
    """``run(visitors, residents)`` for each cell; a cell with many visitors is copied for each part of them."""
    n = visits.groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    parts = F.broadcast(stash(n, "parts"))  # a row a cell, at most MAX_CELLS
    v = visits.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("loc"), "parts").cast("int")).drop("parts")
    p = places.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    v, p = (by_cell(df, cells, "part").groupBy("cell", "part") for df in (v, p))
    return v.cogroup(p).applyInPandas(run, schema)


def _host_nearest(v: pd.DataFrame, p: pd.DataFrame, k: int) -> pd.DataFrame:
    if v.empty or p.empty:
        return pd.DataFrame({"loc": [], "d": [], "m": []})
    return pd.concat(list(_nearest(*(v[c].to_numpy() for c in ("loc", "x", "y")), *(p[c].to_numpy() for c in ("x", "y", "m")), k)))


def _boxes(places: DataFrame, comp: bool) -> pd.DataFrame:
    """Tight boxes of the cells, at most MAX_CELLS."""
    only = F.when(F.min("comp") == F.max("comp"), F.min("comp")).otherwise(-1) if comp else F.lit(-1)
    return places.groupBy("cell").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"), only.cast("long").alias("only")).toPandas()


def core_distances(places: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``places`` with ``core``: the distance to the k-th nearest point, a point itself included; infinite where there are fewer."""
    tasks = len(cells.leaves)
    own = stash(by_cell(places, tasks).groupBy("cell").applyInPandas(lambda g: _own_nearest(g, cells, k), "loc long, cell int, x double, y double, bound double, d double, m long"), "near")
    boxes = _boxes(places, False)
    columns = ["loc", "x", "y"]
    open_ = by_cell(own.filter("bound IS NOT NULL").select("cell", "loc", "x", "y", "bound"), tasks)
    near = own.select("loc", "d", "m")
    if len(boxes) > 1:
        visits = stash(open_.groupBy("cell").applyInPandas(lambda g: _visits(g, boxes, columns), "loc long, x double, y double, cell int"), "visits")
        near = near.unionByName(_hosted(visits, places, tasks, lambda v, p: _host_nearest(v, p, k), "loc long, d double, m long"))
    held = F.sum("m").over(Window.partitionBy("loc").orderBy("d"))
    core = near.withColumn("held", held).filter(F.col("held") >= k).groupBy("loc").agg(F.min("d").alias("core"))
    return places.join(core, "loc", "left").withColumn("core", F.coalesce("core", F.lit(float("inf"))))


def spanning(loc: np.ndarray, x: np.ndarray, y: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, ...]:
    """(w, d, i, j) of the minimum spanning tree of some locations, as rows in the order of growth."""
    n = len(loc)
    w, d = np.full(n, np.inf), np.full(n, np.inf)
    lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    left, at, out = np.arange(n) > 0, 0, []
    for _ in range(n - 1):
        dd = np.sqrt((x - x[at]) ** 2 + (y - y[at]) ** 2)
        ww = np.maximum(np.maximum(dd, core), core[at])
        less = left & ((ww < w) | ((ww == w) & (dd <= d)))
        rows = np.flatnonzero(less)
        l2, h2 = np.minimum(loc[rows], loc[at]), np.maximum(loc[rows], loc[at])
        same = (ww[rows] == w[rows]) & (dd[rows] == d[rows])
        keep = ~same | (l2 < lo[rows]) | ((l2 == lo[rows]) & (h2 < hi[rows]))
        rows, l2, h2 = rows[keep], l2[keep], h2[keep]
        w[rows], d[rows], lo[rows], hi[rows] = ww[rows], dd[rows], l2, h2
        live = np.flatnonzero(left)
        best = live[w[live] == w[live].min()]
        if len(best) > 1:
            best = best[np.lexsort((hi[best], lo[best], d[best]))[:1]]
        at = int(best[0])
        left[at] = False
        out.append((w[at], d[at], lo[at], hi[at]))
    e = np.array(out, dtype=[("w", "f8"), ("d", "f8"), ("i", "i8"), ("j", "i8")]) if out else np.zeros(0, [("w", "f8"), ("d", "f8"), ("i", "i8"), ("j", "i8")])
    return e["w"], e["d"], e["i"], e["j"]


def find(root: dict, k):
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def _grown(g: pd.DataFrame, cells: Cells) -> pd.DataFrame:
    """A cell's tree, and in rows with i = j the component (w) of location i.

    An edge is safe where one of its sides, as far as joined, has no place nearer
    to the outside than the edge is long.
    """
    g = g.sort_values("loc")
    loc, x, y, core = (g[c].to_numpy() for c in ("loc", "x", "y", "core"))
    tree = pd.DataFrame(dict(zip("wdij", spanning(loc, x, y, core)))).sort_values(["w", "d", "i", "j"])
    out = dict(zip(loc.tolist(), np.maximum(core, cells.inside(int(g["cell"].iloc[0]), x, y)).tolist()))
    root = {k: k for k in out}
    for w, i, j in zip(tree["w"].tolist(), tree["i"].tolist(), tree["j"].tolist()):
        a, b = sorted((find(root, i), find(root, j)))
        if w < max(out[a], out[b]):
            root[b], out[a] = a, min(out[a], out[b])
    comp = [find(root, k) for k in loc.tolist()]
    tree["comp"] = -1
    return pd.concat([tree, pd.DataFrame({"w": 0.0, "d": 0.0, "i": loc, "j": loc, "comp": comp})])


LINK = f"comp long, {EDGE}, other long"


def _least(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The least edge of each component of ``a`` to another component in ``b``."""
    found = []
    ax, ay, ac, al, ak = (a[c].to_numpy() for c in ("x", "y", "core", "loc", "comp"))
    bx, by, bc, bl, bk = (b[c].to_numpy() for c in ("x", "y", "core", "loc", "comp"))
    for s in range(0, len(a) if len(b) else 0, BLOCK):
        e = slice(s, s + BLOCK)
        d = _distances(ax[e], ay[e], bx, by)
        w = np.maximum(np.maximum(d, bc[None]), ac[e, None])
        w[ak[e, None] == bk[None]] = np.inf
        low = w.min(axis=1, keepdims=True)
        d[(w != low) | ~np.isfinite(w)] = np.inf
        r, c = np.nonzero((d == d.min(axis=1, keepdims=True)) & np.isfinite(d))
        found.append(pd.DataFrame({"comp": ak[e][r], "w": w[r, c], "d": d[r, c], "i": np.minimum(al[e][r], bl[c]), "j": np.maximum(al[e][r], bl[c]), "other": bk[c]}))
        found[-1] = found[-1].sort_values(["w", "d", "i", "j"]).drop_duplicates("comp")
    out = pd.concat(found) if found else pd.DataFrame(columns=["comp", "w", "d", "i", "j", "other"])
    return out.sort_values(["w", "d", "i", "j"]).drop_duplicates("comp")


def _inner(marks: pd.DataFrame):
    """The least edges inside a cell, and to the nearest marks of other cells as a bound.

    A component that is alone in all its cells has a mark of another one there to
    look at, and any other one has another one in a cell of its own.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        alone = g["comp"].nunique() == 1
        m = marks[(marks["cell"] != g["cell"].iloc[0]) & ~(alone & (marks["comp"] == g["comp"].iloc[0]))]
        gap = _far(m["x"].to_numpy(), m["y"].to_numpy(), (g["x"].min(), g["y"].min(), g["x"].max(), g["y"].max()))
        m = m.iloc[np.argsort(gap, kind="stable")[:MARKS]]
        return _least(g, m if alone else pd.concat([g, m]))

    return run


def _host_least(v: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    return _least(v, p)


def _first(links: DataFrame) -> DataFrame:
    """The least edge of each component."""
    return links.groupBy("comp").agg(F.min(F.struct("w", "d", "i", "j", "other")).alias("e")).select("comp", "e.*")


def merged(least: DataFrame) -> DataFrame:
    """(comp, into) after each component joined the one that its least edge leads to."""
    back = least.select(F.col("comp").alias("other"), F.col("other").alias("again"))
    up = least.join(back, "other", "left").select("comp", F.when((F.col("again") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("into"))
    up = stash(up, "up")

    def doubled(df: DataFrame) -> DataFrame:
        return df.join(df.select(F.col("comp").alias("into"), F.col("into").alias("far")), "into").select("comp", F.col("far").alias("into"), (F.col("far") != F.col("into")).alias("moved"))

    while True:
        nxt = stash(doubled(doubled(up).drop("moved")), "up")
        done = nxt.filter("moved").isEmpty()
        drop_stash(up)
        up = nxt.drop("moved")
        if done:
            return up


def tree_edges(places: DataFrame, cells: Cells) -> DataFrame:
    """(w, d, i, j), i < j: edges that hold the minimum spanning tree, a few for each location."""
    tasks = len(cells.leaves)
    grown = stash(by_cell(places, tasks).groupBy("cell").applyInPandas(lambda g: _grown(g, cells), f"{EDGE}, comp long"), "grown")
    edges = grown.filter("i < j").select("w", "d", "i", "j")
    now = stash(places.join(grown.filter("i = j").select(F.col("i").alias("loc"), "comp"), "loc"), "comps")
    while True:
        boxes = _boxes(now, True)
        if boxes.empty or boxes["only"].nunique() == 1 and boxes["only"].iloc[0] >= 0:
            return edges
        mark = now.groupBy("cell").agg(F.min(F.struct("loc", "x", "y", "core", "comp")).alias("a"), F.max(F.struct("comp", "loc", "x", "y", "core")).alias("b"))
        marks = mark.select("cell", F.explode(F.array("a", F.struct("b.loc", "b.x", "b.y", "b.core", "b.comp"))).alias("r")).select("cell", "r.*").toPandas()  # two a cell
        inner = _first(by_cell(now, tasks).groupBy("cell").applyInPandas(_inner(marks), LINK))
        inner = stash(inner, "inner")
        least = inner
        if len(boxes) > 1:
            far = now.join(inner.select("comp", F.col("w").alias("bound")), "comp").filter("core <= bound")
            far = by_cell(far.select("cell", "loc", "x", "y", "core", "comp", "bound"), tasks)
            visits = far.groupBy("cell").applyInPandas(lambda g: _visits(g, boxes, ["loc", "x", "y", "core", "comp"]), "loc long, x double, y double, core double, comp long, cell int")
            visits = stash(visits, "visits")
            least = stash(_first(inner.unionByName(_hosted(visits, now, tasks, _host_least, LINK))), "least")
            drop_stash(visits)
        edges = edges.unionByName(least.select("w", "d", "i", "j"))
        into = merged(least)
        new = stash(now.join(into, "comp").withColumn("comp", F.col("into")).drop("into"), "comps")
        drop_stash(now)
        now = new


NEWS = "kind string, a long, b long, chosen boolean, state struct<comp:bigint,size:bigint,s:double,inner:double,cluster:bigint,members:array<bigint>>"
_L = pa.int64()
_STATE = pa.struct([("comp", _L), ("size", _L), ("s", pa.float64()), ("inner", pa.float64()), ("cluster", _L), ("members", pa.list_(_L))])
NEWS_ARROW = pa.schema([("kind", pa.string()), ("a", _L), ("b", _L), ("chosen", pa.bool_()), ("state", _STATE)])


def climb(rows, band: int, least: int) -> Iterator[tuple]:
    """News of merging the edges (w, state of one side, state of the other), which ascend.

    ``base``: location a falls out of cluster b, or is of it to its end;
    ``cluster``: a is within b and chosen over what it holds; ``into``: component
    a is b now; ``state``: of a component as it is after the band.
    """
    root, state, count = {}, {}, 0
    for w, p, q in rows:
        for r in (p, q):
            if r["comp"] not in root:
                root[r["comp"]] = r["comp"]
                state[r["comp"]] = (r["size"], r["s"], r["inner"], r["cluster"], list(r["members"]) if r["members"] is not None else [])
        a, b = sorted((find(root, p["comp"]), find(root, q["comp"])))
        if a == b:
            continue
        lam = 1 / w if w > 0 else TOP
        one, two = state[a], state.pop(b)
        if (one[0] or 0) < (two[0] or 0):
            one, two = two, one
        size = one[0] + two[0]
        if two[0] >= least:  # two clusters end, one begins
            count += 1
            c, inner = (band + 1) << 32 | count, 0.0
            for n, s, held, k, _ in (one, two):
                gain = s - n * lam
                inner += max(gain, held)
                yield "cluster", k, c, bool(gain >= held), None
            new = (size, size * lam, inner, c, [])
        elif one[0] >= least:
            for k in two[4]:
                yield "base", k, one[3], None, None
            new = (size, one[1] + two[0] * lam, one[2], one[3], [])
        elif size >= least:
            count += 1
            c = (band + 1) << 32 | count
            for k in one[4] + two[4]:
                yield "base", k, c, None, None
            new = (size, size * lam, 0.0, c, [])
        else:
            new = (size, 0.0, 0.0, None, one[4] + two[4])
        root[b], state[a] = a, new
    for k in root:
        yield "into", k, find(root, k), None, None
    for k, v in state.items():
        yield "state", k, None, None, dict(zip(("comp", "size", "s", "inner", "cluster", "members"), (k, *v)))


def _climbed(batches: Iterator[pa.RecordBatch], band: int, least: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches))  # a band
    t = t.sort_by([("w", "ascending"), ("d", "ascending"), ("i", "ascending"), ("j", "ascending")])
    news = climb(zip(t["w"].to_pylist(), t["p"].to_pylist(), t["q"].to_pylist()), band, least)
    yield from pa.Table.from_pylist([dict(zip(NEWS_ARROW.names, r)) for r in news], schema=NEWS_ARROW).to_batches(max_chunksize=20_000)


def stable(edges: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """(loc, cluster): the most stable cluster that holds a location, for those that have one."""
    spark = edges.sparkSession
    lam = F.when(F.col("core") > 0, 1 / F.col("core")).otherwise(F.lit(TOP))
    heavy = F.col("m") >= least
    state = places.select(
        F.col("loc").alias("comp"), F.col("m").alias("size"), F.when(heavy, F.col("m") * lam).otherwise(0.0).alias("s"), F.lit(0.0).alias("inner"), F.when(heavy, -1 - F.col("loc")).alias("cluster"), F.when(~heavy, F.array("loc")).alias("members")
    )
    state = stash(state, "state")
    edges = stash(edges.distinct(), "edges")
    bands = max(-(-edges.count() // BAND), 1)
    order = ["w", "d", "i", "j"]
    if bands > 1:
        edges = stash(edges.repartitionByRange(bands, *order).withColumn("band", F.spark_partition_id()), "bands")
    else:
        edges = edges.withColumn("band", F.lit(0))
    left = edges.withColumns({"ci": F.col("i"), "cj": F.col("j")})
    base = places.filter(heavy).select("loc", (-1 - F.col("loc")).alias("cluster"))
    tree = None
    for k in range(bands):
        s = F.struct(*state.columns)
        here = left.filter(F.col("band") == k)
        here = here.join(state.select(F.col("comp").alias("ci"), s.alias("p")), "ci").join(state.select(F.col("comp").alias("cj"), s.alias("q")), "cj").select(*order, "p", "q")
        news = stash(here.repartition(1).mapInArrow(partial(_climbed, band=k, least=least), NEWS), "news")
        base = base.unionByName(news.filter("kind = 'base'").select(F.col("a").alias("loc"), F.col("b").alias("cluster")))
        found = news.filter("kind = 'cluster'").select(F.col("a").alias("cluster"), F.col("b").alias("parent"), "chosen")
        tree = found if tree is None else tree.unionByName(found)
        if k + 1 < bands:
            into = news.filter("kind = 'into'").select("a", "b")
            gone = into.select(F.col("a").alias("comp"))
            state = stash(state.join(gone, "comp", "left_anti").unionByName(news.filter("kind = 'state'").select("state.*")), "state")
            rest = left.filter(F.col("band") > k)
            for c in ("ci", "cj"):
                rest = rest.join(into.withColumnsRenamed({"a": c, "b": "_n"}), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
            left = stash(rest.filter("ci != cj"), "left")
    # The uppermost chosen cluster above each: links that double.
    top = stash(tree.select("cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("top")), "top")
    while not top.filter("up IS NOT NULL").isEmpty():
        above = top.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        new = stash(top.join(above, "up", "left").select("cluster", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")), "top")
        drop_stash(top)
        top = new
    return base.join(top.filter("top IS NOT NULL").select("cluster", "top"), "cluster").select("loc", F.col("top").alias("cluster"))


def density_clusters(points: DataFrame, min_cluster_size: int = 15, min_samples: int = 5, cell: int = CELL) -> DataFrame:
    """(id, x, y, cluster) of all points with x and y, nothing left to one task but bands of edges.

    Clusters are numbered by their least location in the order of (x, y); -1 is
    noise. Equal points share their cluster. Points with a null, infinite or
    undefined coordinate are noise; fewer points than ``min_cluster_size`` or
    ``min_samples`` are noise all; ids may repeat; an empty table gives no rows.
    Other columns of ``points`` are ignored.
    """
    least = max(min_cluster_size, 2)
    every = stash(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    usable = F.coalesce(F.abs("x") < float("inf"), F.lit(False)) & F.coalesce(F.abs("y") < float("inf"), F.lit(False))
    sums = every.filter(usable).groupBy(*(F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c) for c in ("x", "y"))).agg(F.count("*").alias("m"))
    locs = stash(numbered(sums, "loc", "x", "y"), "locations")
    total, n = locs.agg(F.sum("m"), F.count("*")).first()
    if (total or 0) < max(least, min_samples) or n < 2:
        return every.withColumn("cluster", F.lit(NOISE))
    parts = min(max(-(-n // cell), 1), MAX_CELLS)
    share = parts * SAMPLE / n
    drawn = locs.filter(F.pmod(F.xxhash64("loc"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1) if share < 1 else locs
    sample = drawn.select("x", "y").toPandas().to_numpy() if parts > 1 else np.zeros((0, 2))  # SAMPLE rows a cell
    cells = Cells(sample, parts)

    def dealt(it):
        for pdf in it:
            yield pdf.assign(cell=cells.of(pdf[["x", "y"]].to_numpy()))[["cell", "loc", "x", "y", "m"]]

    places = stash(locs.mapInPandas(dealt, PLACE), "places")
    cored = stash(core_distances(places, cells, max(min_samples, 1)).select("cell", "loc", "x", "y", "m", "core"), "cores")
    found = stash(stable(tree_edges(cored, cells), cored, least), "stable")
    number = numbered(found.groupBy("cluster").agg(F.min("loc").alias("first")), "number", "first")
    label = found.join(number, "cluster").select("loc", F.col("number").cast("int").alias("cluster"))
    label = label.join(locs, "loc").select(F.col("x").alias("_x"), F.col("y").alias("_y"), "cluster")
    at = (F.when(F.col("x") == 0, 0.0).otherwise(F.col("x")) == F.col("_x")) & (F.when(F.col("y") == 0, 0.0).otherwise(F.col("y")) == F.col("_y"))
    return every.join(label, at, "left").select("id", "x", "y", F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"))
