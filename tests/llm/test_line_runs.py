"""Repeated runs of lines, wherever they start, against brute force."""

import hashlib
from collections import Counter

import pytest

from tests.llm.conftest import make


def brute(rows):
    """{(id, text): (kept lines, removed lines, stretches)}: all lines of two that stand before, without overlap."""
    first, out = {}, {}
    for known, i, t in sorted({(i is not None, i or 0, t) for i, t, *_ in rows if t is not None}):
        ls, gone = t.split("\n"), set()
        for k in range(len(ls) - 1):
            pair = f"{ls[k]}\n{ls[k + 1]}"
            if pair.encode().split():
                d, at = first.setdefault(pair, ((known, i, t), k))
                if d != (known, i, t) or k > at + 1:
                    gone |= {k, k + 1}
        out[i if known else None, t] = [x for k, x in enumerate(ls) if k not in gone], len(gone), sum(k - 1 not in gone for k in gone)
    return out


def test_runs_against_brute_force(docs, rows, empty):
    from weftlake.llm.line_dedup import line_report

    known = brute(rows)
    assert sum(n for _, n, _ in known.values()) > 50
    want = Counter()
    for i, t, *_ in rows:
        kept, n, m = ([], 0, 0) if t is None else known[i, t]
        want[i, 0 if t is None else len(t.split("\n")), n, m, None if t is None else hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    out = line_report(docs, runs=True).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed_lines, r.n_removed_chunks, r.kept_sha256) for r in out) == want
    assert line_report(empty, runs=True).count() == 0


@pytest.fixture(scope="module")
def shared():
    """Forty documents with one passage of two lines, each between lines of its own."""
    return [(i, "\n".join([f"a {i}", f"b {i}", "first line of it", "second line of it", f"c {i}", f"d {i}"]), "en", "s") for i in range(40)]


def test_query_and_stage_find_every_short_passage(spark, shared, tmp_path):
    import __spark_entry__
    import corpus_pipeline

    docs = make(spark, shared)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = __spark_entry__.queries()["op7_line_chunks"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.n_removed_lines, r.n_removed_chunks) for r in out} == {(i, 2 * (i > 0), int(i > 0)) for i in range(40)}
    texts = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, None).collect()}
    assert texts == {i: t if i == 0 else f"a {i}\nb {i}\nc {i}\nd {i}" for i, t, *_ in shared}


def test_blank_lines_stay(spark):
    """Chunks of white space alone are left, with runs and without."""
    from weftlake.llm.line_dedup import line_chunk_dedup

    texts = ["\n" * 6, "\t\n\x0c\n \t \n\r"]
    rows = [(2 * k + j, t, "en", "s") for k, t in enumerate(texts) for j in range(2)]
    for runs in (False, True):
        kept = {r.doc_id: r.text for r in line_chunk_dedup(make(spark, rows), runs=runs).collect()}
        assert kept == {i: t for i, t, *_ in rows}


def test_texts_behind_one_hash_pair_are_told_apart(spark, docs, rows, monkeypatch):
    """With hashes that many texts share the result is that of the bytes."""
    from weftlake.llm import line_dedup as d

    right = {runs: sorted(map(str, d.line_report(docs, runs=runs).collect())) for runs in (False, True)}
    monkeypatch.setattr(d, "HASHES", ("CAST(length(s) AS bigint)", "CAST(length(s) % 7 AS bigint)"))
    for runs in (False, True):
        assert sorted(map(str, d.line_report(docs, runs=runs).collect())) == right[runs]


def test_runs_add_to_chunks(docs):
    """The first step removes no more than both."""
    from weftlake.llm.line_dedup import line_report

    some, more = ({(r.doc_id, r.kept_sha256): r.n_removed_lines for r in line_report(docs, runs=x).collect()} for x in (False, True))
    assert 0 < sum(some.values()) < sum(more.values())


def test_a_document_of_very_many_lines(spark):
    """Time is linear in the lines: 100,000 of them, the copy of another document, in under a minute."""
    import random
    import time

    from weftlake.llm.line_dedup import line_report

    r = random.Random(4)
    text = "\n".join(f"line {r.random()}" for _ in range(100_000))
    start = time.time()
    out = {x.doc_id: x for x in line_report(make(spark, [(1, text, "en", "a"), (2, text + "\nown", "en", "a")]), runs=True).collect()}
    assert time.time() - start < 60
    assert out[1].n_removed_lines == 0 and out[2].n_removed_lines == 100_000 and out[2].kept_sha256 == hashlib.sha256(b"own").hexdigest()
