"""Indexes against brute force: nearest vectors, BM25, odd rows, empty tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftlake.operators import ann, textindex
from weftlake.plans.registry import Tables
from weftlake.session import shared_path

DIM = 12


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    centers = r.normal(size=(30, DIM))
    v = centers[r.integers(0, 30, 3000)] + r.normal(scale=0.4, size=(3000, DIM))
    v[::50] = v[1]  # copies
    return v.astype(np.float32)


@pytest.fixture(scope="module")
def points(spark, vectors):
    rows = [(i, "even" if i % 2 == 0 else "odd", v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    rows += [(5000, "even", None, "x", 1), (5001, "even", [0.0] * DIM, "x", 1), (5002, "even", [1.0, 2.0], "x", 1), (None, "even", vectors[0].tolist(), "x", 1)]
    return spark.createDataFrame(rows, "id long, kind string, embedding array<float>, `_p` string, score int").repartition(5)


@pytest.fixture(scope="module")
def index(spark, points):
    path = shared_path(spark, "ann-test")
    ann.build_index(points, path, DIM)
    return path


def asked(spark, vectors):
    rows = [(i, [float(x) for x in vectors[i]]) for i in range(0, 3000, 100)] + [(-1, None), (-2, [1.0])]
    return spark.createDataFrame(rows, "query_id long, qv array<double>")


def true_nearest(vectors, q, k, keep=lambda i: True):
    u = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    s = (u * u[q]).sum(axis=1)
    ids = sorted((i for i in range(len(s)) if keep(i)), key=lambda i: (-round(s[i], 9), i))[:k]
    return ids, [s[i] for i in ids]


def test_all_lists_give_the_exact_answer(spark, points, vectors, index):
    for exact in (False, True):
        rows = ann.search_index(spark, index, asked(spark, vectors), 8, DIM, probes=10_000, ef=4000, exact=exact, where=F.col("kind") == "even").collect()
        by = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["rank"]):
            by[r.query_id].append(r)
        assert set(by) == set(range(0, 3000, 100))
        for q, got in by.items():
            ids, scores = true_nearest(vectors, q, 8, lambda i: i % 2 == 0)
            assert np.allclose([r.score for r in got], scores) and [r["rank"] for r in got] == list(range(1, 9))
            if len(set(np.round(scores, 6))) == 8:
                assert [r.id for r in got] == ids


def test_recall_with_few_lists(spark, points, vectors, index):
    """A sixth of the lists, codes of a sixteenth of the floats' size: nine of ten are found."""
    found = ann.search_index(spark, index, asked(spark, vectors), 10, DIM, probes=24, ef=100)
    true = spark.createDataFrame([(q, i) for q in range(0, 3000, 100) for i in true_nearest(vectors, q, 10)[0]], "query_id long, id long")
    r = ann.recall(found, true).agg(F.avg("recall")).first()[0]
    lists = spark.read.parquet(f"{index}/centroids").count()
    assert lists > 100 and r >= 0.9
    assert spark.read.parquet(f"{index}/entries").filter(F.length("code") * 16 > DIM * 4 + 15).count() == 0


def test_rows_without_direction_stay(spark, points, vectors, index):
    kept = {r.id: r.list for r in spark.read.parquet(f"{index}/entries").filter("id >= 5000").collect()}
    assert kept == {5000: ann.NO_LIST, 5001: ann.NO_LIST, 5002: ann.NO_LIST}
    assert spark.read.parquet(f"{index}/entries").count() == 3003
    last = ann.search_index(spark, index, asked(spark, vectors).limit(1), 3003, DIM, probes=10_000, ef=3003).filter("id >= 5000").collect()
    assert {(r.id, r.score) for r in last} == {(5000, 0.0), (5001, 0.0), (5002, 0.0)}


def test_empty_index(spark, points, vectors):
    path = shared_path(spark, "ann-empty")
    ann.build_index(points.limit(0), path, DIM)
    assert ann.search_index(spark, path, asked(spark, vectors), 3, DIM).count() == 0


def bm25(texts, query, k):
    terms = {i: Counter(w.lower() for w in re.findall(r"[^\W_]+", t or "")) for i, t in texts.items()}
    n = {i: sum(c.values()) for i, c in terms.items()}
    mean, score = sum(n.values()) / len(n), defaultdict(float)
    for w in {w.lower() for w in re.findall(r"[^\W_]+", query or "")}:
        df = sum(w in c for c in terms.values())
        for i, c in terms.items():
            if c[w]:
                score[i] += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n[i] / mean))
    return sorted(((i, s) for i, s in score.items()), key=lambda x: (-round(x[1], 9), x[0]))[:k]


def test_ranked_text(spark, monkeypatch):
    """A frequent word over many blocks, ties, repeated words, nulls, a long text: the pruned search is exact."""
    monkeypatch.setattr(textindex, "BLOCK", 7)
    r = random.Random(2)
    texts = {i: " ".join(r.choice(["the"] * 5 + ["Straße", "été", "x1", "rare" if i % 97 == 0 else "of"] + [f"w{k}" for k in range(40)]) for _ in range(r.randrange(1, 30))) for i in range(600)}
    texts |= {600: None, 601: "", 602: "...", 603: "rare " * 5000, 604: texts[3], 605: texts[3]}
    path = shared_path(spark, "text-test")
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "rare", "x")], "id long, text string, term string").repartition(6)
    textindex.build_text_index(docs, path)
    asked = {1: "the rare", 2: "THE the of", 3: "w1 w2 w3 straße", 4: "unknownword", 5: None, 6: texts[3]}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = defaultdict(list)
    for row in sorted(textindex.search_text(spark, path, queries, 12).collect(), key=lambda x: x["rank"]):
        got[row.query_id].append((row.id, row.score))
    for q, text in asked.items():
        want = bm25(texts, text, 12)
        assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want])
    chosen = spark.createDataFrame([(i,) for i in (3, 603, 97, 97)], "id long")
    rows = {r.id: r.score for r in textindex.score_candidates(spark, path, queries.filter("query_id = 1"), chosen).collect()}
    want = {i: s for i, s in bm25(texts, asked[1], 1000) if i in (3, 603, 97)}
    assert rows.keys() == want.keys() and all(math.isclose(rows[i], want[i]) for i in rows)
    assert textindex.postings(spark, path).filter("term = 'rare'").count() == sum("rare" in (t or "").split() for t in texts.values())


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Documents and twelve benchmark items, of which one has an id divisible by 100 and one has none."""
    folder = tmp_path_factory.mktemp("small")
    docs = {i: " ".join(f"w{(i * j) % 17}" for j in range(1, 2 + i % 9)) for i in range(60)}
    items = {i: f"w{i % 17} W{(i + 3) % 17}" for i in (3, 7, 10, 55, 99, 100, 101, 150, 199, 250, 399)}
    pq.write_table(pa.table({"doc_id": list(docs), "text": list(docs.values())}), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": [*items, None], "text": [*items.values(), "w1"]}, pa.schema({"item_id": pa.int64(), "text": pa.string()})), folder / "benchmark.parquet")
    return str(folder), docs, items


def test_every_item_is_ranked(spark, small):
    """list_ranked answers every item of the benchmark, not only those whose id is divisible by 100."""
    from weftlake.plans.index import list_ranked

    folder, docs, items = small
    got = defaultdict(list)
    for r in list_ranked(Tables(spark, folder)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    assert set(got) == set(items)
    for q, text in items.items():
        want = bm25(docs, text, 10)
        assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-6)


def test_every_item_scores_every_document(spark, small):
    """rerank_bm25 gives the scores of every item of the benchmark with every document that holds one of its words."""
    from weftlake.plans.index import rerank_bm25

    folder, docs, items = small
    rows = rerank_bm25(Tables(spark, folder)).collect()
    got = {(r.query_id, r.id): r.score for r in rows}
    want = {(q, i): s for q, text in items.items() for i, s in bm25(docs, text, len(docs))}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=1e-6) for p in got)


def test_empty_text_index(spark):
    path = shared_path(spark, "text-empty")
    textindex.build_text_index(spark.createDataFrame([], "id long, text string"), path)
    assert textindex.search_text(spark, path, spark.createDataFrame([(1, "a")], "query_id long, text string"), 3).count() == 0


def test_groups_and_parts_are_exact(spark, monkeypatch):
    """More queries than a group has and more documents than a part: ranks are those of all pairs; ids may be texts."""
    for name, n in (("QUERIES", 7), ("PART_DOCS", 40), ("BLOCK", 5)):
        monkeypatch.setattr(textindex, name, n)
    r = random.Random(4)
    texts = {f"d{i}": " ".join(f"w{min(int(r.expovariate(0.15)), 50)}" for _ in range(r.randrange(0, 25))) for i in range(300)}
    texts |= {f"copy{i}": texts["d1"] for i in range(40)}
    asked = {f"q{i}": " ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(1, 9))) for i in range(30)} | {"qc": texts["d1"]}
    path = shared_path(spark, "groups")
    textindex.build_text_index(spark.createDataFrame(list(texts.items()), "id string, text string").repartition(5), path)
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    found, chosen = textindex.search_text(spark, path, queries, 6), [i for n, i in enumerate(texts) if n % 3] + ["absent"]
    scores = textindex.score_candidates(spark, path, queries, spark.createDataFrame([(i,) for i in [*chosen, *chosen, None]], "id string"))
    got, every = defaultdict(list), defaultdict(dict)
    for row in found.orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.id, row.score))
    rows = scores.collect()
    for row in rows:
        every[row.query_id][row.id] = row.score
    assert len(rows) == sum(map(len, every.values()))
    for q, text in asked.items():
        want = bm25(texts, text, len(texts))
        assert [i for i, _ in got[q]] == [i for i, _ in want[:6]] and np.allclose([s for _, s in got[q]], [s for _, s in want[:6]])
        want = {i: s for i, s in want if i in set(chosen)}
        assert every[q].keys() == want.keys() and all(math.isclose(every[q][i], want[i]) for i in want)


def test_best_of_a_part():
    """What can be among the best by its rounded score stays; of equal scores only the first rows."""
    r = np.random.default_rng(6)
    s = r.integers(0, 5, (50, 8)).astype(float)
    s[:, 3] = 0
    s[:, 4] = 2.0
    got = set(zip(*(x.tolist() for x in textindex._best(s, 4))))
    want = {(d, q) for q in range(8) for d in sorted(np.flatnonzero(s[:, q] > 0).tolist(), key=lambda d: (-s[d, q], d))[:4]}
    assert want <= got and all(sum(y == q for _, y in got) <= 4 * 5 for q in range(8)) and [d for d, q in sorted(got) if q == 4] == [0, 1, 2, 3]


def test_texts_are_counted_in_parts():
    """What a task holds at once is bounded by its parts, not by the Arrow batch; together the parts hold every posting."""
    n = 2 * textindex.LIST_ROWS + 5
    batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "words": ["a b a" if i % 3 else "" for i in range(n)]})
    parts = [x.to_pydict() for x in textindex._lists([batch])]
    assert len(parts) == 3 and max(sum(map(len, p["ids"])) for p in parts) <= 2 * textindex.LIST_ROWS
    got = sorted((t, i, tf, k) for p in parts for t, ids, tfs, ns in zip(p["term"], p["ids"], p["tfs"], p["ns"]) for i, tf, k in zip(ids, tfs, ns))
    assert got == sorted((t, i, tf, 3) for i in range(n) if i % 3 for t, tf in (("a", 2), ("b", 1)))
    assert sum(sum(p["total"]) for p in parts) == 3 * sum(i % 3 > 0 for i in range(n))


def test_texts_are_taken_apart_once(spark):
    """One pass over the texts builds the index, and its terms are those of a query."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        seen.add(1)
        return x

    texts = ["\u0391\u03a3'\u0391\u03a3, \u03a3\u0391\u03a3.\u0392 \u0130x a--b .\u03a3. ", "", None, " . ", "\u00e9\u00bd \u2167a_b\u0663 \U00010400\u03a3!", "Plain words, plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    assert docs.filter(textindex.words_of(F.col("text")) != F.array_join(textindex.terms_of(F.col("text")), " ")).count() == 0
    path = shared_path(spark, "once")
    textindex.build_text_index(docs.withColumn("text", told("text")), path)
    assert seen.value == len(texts)
    size = docs.agg(F.count("*"), F.sum(F.size(textindex.terms_of(F.col("text"))))).first()
    assert tuple(spark.read.parquet(f"{path}/corpus").first()) == (len(texts), size[1] / len(texts))


def test_best_of_a_batch():
    """The best of each row with equal scores in their order; what earlier batches surpass is left out."""
    r = np.random.default_rng(3)
    s = r.integers(0, 6, (9, 40)).astype(float)
    s[2] = -np.inf
    s[3, :36] = -np.inf
    least = np.full(9, -np.inf)
    least[4] = 5.0
    want = {(q, c) for q in range(9) for c in sorted(range(40), key=lambda c: (-s[q, c], c))[:7] if s[q, c] > -np.inf and s[q, c] >= least[q]}
    assert set(zip(*(x.tolist() for x in ann._first(s, 7, least)))) == want
    assert least[4] == 5.0 and least[2] == -np.inf and least[0] == sorted(s[0])[-7]


def test_copies_are_found_by_id(spark):
    """More equal vectors than a search scores again: the smallest ids stay, and a task hands on only so many of a batch."""
    v = [float(x) for x in np.random.default_rng(2).normal(size=DIM)]
    points = spark.createDataFrame([((i * 7919) % 3001, v) for i in range(1, 3001)], "id long, embedding array<float>").repartition(3)
    path = shared_path(spark, "copies")
    ann.build_index(points, path, DIM)
    found = ann.search_index(spark, path, spark.createDataFrame([(0, v)], "query_id long, qv array<double>"), 10, DIM, ef=20)
    assert [r.id for r in found.orderBy("rank").collect()] == list(range(1, 11))
