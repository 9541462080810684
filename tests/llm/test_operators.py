"""Each operator against a brute-force version, on texts with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash


def words(t):
    return (t or "").encode().split()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_sharding(docs, rows, empty):
    from weftlake.llm.sharding import shard_by_bytes

    out = shard_by_bytes(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        by[r.shard].append(r)
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    total, largest = sum(r.size for r in out), max(Counter({t: 0 for _, t, *_ in rows} | Counter()).values(), default=0)
    groups = Counter()
    for _, t, *_ in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    assert max(sum(r.size for r in s) for s in by.values()) <= total / 16 + max(groups.values()) + largest
    where = defaultdict(set)
    text = {i: t or "" for i, t, *_ in rows}
    for r in out:
        if r.doc_id is not None and groups[text[r.doc_id]] <= total / 16:
            where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert shard_by_bytes(empty).count() == 0


def test_a_group_beyond_a_share_is_split(spark):
    from tests.llm.conftest import make
    from weftlake.llm.sharding import shard_by_bytes

    out = shard_by_bytes(make(spark, [(i, "same text", None, None) for i in range(800)] + [(1000 + i, f"text {i}", None, None) for i in range(800)])).groupBy("shard").agg({"size": "sum"}).collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 16 and max(sizes) < 1.3 * min(sizes)


def test_groups_beside_a_hot_text_stay_whole(spark):
    """Pairs of equal texts share a shard, whatever range they fall into; identical rows are sampled and dealt one by one."""
    from tests.llm.conftest import make
    from weftlake.llm.sharding import shard_by_bytes

    rows = [(i, "the hot text of all", None, None) for i in range(3000)] + [(10_000 + i, f"pair {i // 2}", None, None) for i in range(3000)] + [(7, "one row", None, None)] * 500
    out = shard_by_bytes(make(spark, rows)).collect()
    assert len(out) == len(rows)
    where = defaultdict(set)
    for r in out:
        where[r.text_crc32].add(r.shard)
    hot = zlib.crc32(b"the hot text of all")
    assert len(where[hot]) > 1 and all(len(s) == 1 for k, s in where.items() if k != hot)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = Counter()
    for r in out:
        size[r.shard] += r.size
    assert max(size.values()) < 1.2 * min(size.values())


def test_exact(docs, rows, empty):
    from weftlake.llm.exact_dedup import exact_duplicates

    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[sha((t or "").encode())].append(i)
    for bits in (16, 1):  # a filter that is nearly full gives the same result
        out = exact_duplicates(docs, bits_per_row=bits, max_bits=1 << 16).collect()
        assert len(out) == len(rows)
        for r in out:
            ids = groups[r.text_sha256]
            known = [i for i in ids if i is not None]
            assert (r.keep_id, r.group_size) == (max(known, default=None), len(ids))
        kept = Counter(r.text_sha256 for r in out if r.kept)
        assert set(kept.values()) == {1} and set(kept) == set(groups)
        assert all(r.doc_id == r.keep_id for r in out if r.kept)
    assert exact_duplicates(empty).count() == 0


def quality(t):
    w = words(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, rows, empty):
    from weftlake.llm.quality import filter_quality, quality_report

    out = quality_report(docs).collect()
    want = Counter()
    hosts = defaultdict(lambda: [0, 0])
    for i, t, _, s in rows:
        q = quality(t)
        failed = q[0] < 50 or 100 * q[4] > 50 * q[0]
        want[(i, *q, failed)] += 1
        if s is not None:
            hosts[s][0] += 1
            hosts[s][1] += failed
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    rates = [b / n for n, b in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / (len(rates) - 1)
    s = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v else 1e6
    bad = {h for h, (n, b) in hosts.items() if (b + m * s) / (n + s) > 0.5}
    kept = Counter(i for i, t, _, h in rows if not (quality(t)[0] < 50 or 100 * quality(t)[4] > 50 * quality(t)[0]) and h not in bad)
    assert Counter(r.doc_id for r in out if r.kept) == kept
    f = filter_quality(docs)
    assert f.columns == docs.columns and Counter(r.doc_id for r in f.collect()) == kept
    assert quality_report(empty).count() == 0 and filter_quality(empty).count() == 0


def test_clean_documents_of_clean_hosts_stay(spark, monkeypatch):
    from tests.llm.conftest import make
    from weftlake.llm.quality import quality_report

    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good + str(i), "en", f"h{i % 5}") for i in range(40)] + [(100 + i, "short", "en", "junk") for i in range(60)] + [(200, good, "en", "junk"), (201, good, "en", None)]
    kept = {r.doc_id for r in quality_report(make(spark, rows)).filter("kept").collect()}
    assert kept == {*range(40), 201}
    from weftlake.llm import quality

    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)  # by a shuffle, as for many hosts
    assert {r.doc_id for r in quality_report(make(spark, rows)).filter("kept").collect()} == kept


def lines_of(t):
    ls = t.split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ls]
    out, start = [], 0
    for i in range(len(ls)):
        s = 42
        for q in ([h[i - 1]] if i else []) + [h[i]]:
            s = xxhash.xxh64_intdigest(struct.pack("<Q", q), s)
        if (s - (1 << 64) if s >> 63 else s) % 4 == 0 or i == len(ls) - 1:
            out.append((start, ls[start : i + 1]))
            start = i + 1
    return out


def test_line_chunks(docs, rows, empty):
    from weftlake.llm.line_dedup import line_chunk_dedup, line_report

    count, first = Counter(), {}
    order = sorted(set((i is not None, i or 0, t) for i, t, *_ in rows if t is not None))
    places = Counter((i, t) for i, t, *_ in rows)
    for known, i, t in order:
        for start, c in lines_of(t):
            if len(c) > 1 and "\n".join(c).encode().split():
                count["\n".join(c)] += places[i if known else None, t]
                first.setdefault("\n".join(c), (i if known else None, t, start))
    want = Counter()
    for i, t, *_ in rows:
        if t is None:
            want[i, 0, 0, 0, None] += 1
            continue
        kept, n, m = [], 0, 0
        for start, c in lines_of(t):
            k = "\n".join(c)
            if count[k] > 1 and first[k] != (i, t, start):
                n, m = n + len(c), m + 1
            else:
                kept += c
        want[i, len(t.split("\n")), n, m, sha("\n".join(kept).encode())] += 1
    out = line_report(docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed_lines, r.n_removed_chunks, r.kept_sha256) for r in out) == want
    assert sum(k[3] * v for k, v in want.items()) > 3
    d = line_chunk_dedup(docs)
    assert d.columns == docs.columns
    assert Counter((r.doc_id, None if r.text is None else sha(r.text.encode())) for r in d.collect()) == Counter((r.doc_id, r.kept_sha256) for r in out)
    assert line_report(empty).count() == 0


def simhash(t):
    w = (t or "").encode().lower().split()
    sh = [] if not w else [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    from weftlake.llm.simhash import drop_near_duplicates, simhash_report

    fp = [(i, simhash(t)) for i, t, *_ in rows]
    nodes = sorted({f for _, f in fp})
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in fp:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    want = Counter((i, f"{f:016x}", least.get(find(f))) for i, f in fp)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_report(docs).collect()) == want
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({find(f) for f in nodes}) and set(ids) == {least.get(find(f)) for f in nodes}
    assert simhash_report(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_fingerprints_at_three_bits_link_and_at_four_do_not(spark):
    from weftlake.llm.simhash import linked

    base = 0x0123456789ABCDEF
    flip = lambda *bits: base ^ sum(1 << b for b in bits)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = [base, flip(1, 2, 40), flip(1, 2, 40, 50, 51, 52), flip(63, 62, 61)]
    far = [base ^ 0xFFFF0000FFFF, base ^ 0xFFFF0000FFFF ^ 0b1111]
    out = {r.fp: r.c for r in linked(spark.createDataFrame([(signed(x),) for x in near + far], "fp long")).collect()}
    assert len({out[signed(x)] for x in near}) == 1
    assert len({out[signed(x)] for x in [base, *far]}) == 3


def test_components_of_a_long_chain(spark):
    from weftlake.llm.graph import components

    n = 300
    out = components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n + 5, n + 6), (7, 7)], "u long, v long")).collect()
    assert {(r.node, r.component) for r in out} == {(i, 0) for i in range(n + 1)} | {(n + 5, n + 5), (n + 6, n + 5)}


def test_repeats(docs, rows, empty):
    from weftlake.llm.recompression import remove_repeats, repeat_report

    all_words = [(i, words(t)) for i, t, *_ in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in all_words for k in range(len(w) - 34))
    want = Counter()
    for i, w in all_words:
        gone = {k + d for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for d in range(35)}
        want[i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    out = repeat_report(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert sum(k[2] for k in want) > 100
    assert remove_repeats(empty).count() == 0


def test_symbols_are_fixed_by_their_interval():
    """Equal words in a symbol's interval give the same symbol, whatever stands around."""
    import random

    import numpy as np

    from weftlake.llm.recompression import Symbols, pair_round, run_round

    r = random.Random(5)
    names: dict = {}

    def parse(x, rounds=4):
        at = np.arange(len(x))
        s = Symbols(np.array(x), at, at + 1, at, at + 1)
        out = [s]
        for k in range(rounds):
            for step in (run_round, lambda q, k=k: pair_round(q, k)):
                made = step(s)
                s = made.made
                s.name = s.name.copy()
                for i in np.flatnonzero(made.new):
                    s.name[i] = names.setdefault((step is run_round, int(made.x[i]), int(made.y[i])), len(names) + 10)
                out.append(s)
        return out

    longest = 0
    for _ in range(200):
        mid = [r.choice([1, 2, 3]) for _ in range(30)]
        found = []
        for _ in range(2):
            left, right = ([r.choice([1, 2, 4]) for _ in range(r.randint(0, 6))] for _ in range(2))
            levels = []
            for s in parse(left + mid + right):
                inside = {(int(n), int(a) - len(left), int(b) - len(left)) for n, a, b, lo, hi in zip(s.name, s.first, s.last, s.lo, s.hi) if lo >= len(left) and hi <= len(left) + 30}
                levels.append((inside, {(int(n), int(a) - len(left), int(b) - len(left)) for n, a, b in zip(s.name, s.first, s.last)}))
                longest = max([longest, *(b - a for _, a, b in inside)])
            found.append(levels)
        for (mine, _), (_, others) in zip(*found):
            assert mine <= others
        for (_, others), (mine, _) in zip(*found):
            assert mine <= others
    assert longest > 8


def test_names_are_global_and_shared(spark):
    """Equal words and pairs have one name in all partitions; what occurs once has none."""
    import pyarrow as pa

    from weftlake.llm import recompression as r
    from weftlake.session import shared_path

    rows = [("a b c",), ("b c d",), ("zz a",)]
    root = shared_path(spark, "t")
    sent = spark.createDataFrame(rows, "text string").repartition(3).mapInArrow(r.partial(r._count_words, shards=5), r.SENT_WORDS)
    names = r._named(sent, root, "word", 5, r.partial(r._write_words, root=root), 0)
    got = names.words(pa.array([b"a", b"b", b"c", b"d", b"zz", b"new"]))
    assert sorted(got[:3]) == [1, 2, 3] and not got[3:].any()


def test_windows_with_one_hash_are_told_apart():
    """With a hash of few values the words still decide."""
    import numpy as np

    from weftlake.llm import recompression as r

    x = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9])
    group = np.zeros(4, int)
    at = np.array([0, 3, 6, 3])
    assert r._classes(4, group, lambda k: x[at[k][:, None] + np.arange(3)]).tolist() == [0, 1, 0, 1]
    k = np.zeros(4, np.uint64)
    a, b = np.array([5, 6, 5, 5], np.uint64), np.array([1, 1, 1, 2], np.uint64)
    assert [c.tolist() for c in r.distinct_pairs(k, a, b, np.ones(4, int))] == [[0, 0, 0], [5, 5, 6], [1, 2, 1], [2, 1, 1]]


def test_language(docs, rows, empty):
    from weftlake.llm.langid import Profiles, language_report, ngrams, train_profiles

    out = language_report(docs).collect()
    assert Counter((r.doc_id, r.held_out) for r in out) == Counter((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, *_ in rows)
    langs = {la for _, _, la, _ in rows if la}
    text = {i: t for i, t, *_ in rows}
    for r in out:
        assert 0 <= r.score <= 1 and r.lang_pred in langs | {"und"}
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
    assert language_report(empty).count() == 0

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        s = " " + " ".join(t) + " " if t else ""
        return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != " "]

    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    for t in ("Où est-il? Straße 12", "a", "", "..", "A  b\n\nc"):
        assert Counter(ngrams(t).tolist()) == Counter(map(code, grams(t)))
    learn = docs.filter("lang IS NOT NULL").select("lang", "text")
    made = train_profiles(learn)
    for la in langs:
        c = Counter(code(g) for _, t, k, _ in rows if k == la for g in grams(t or ""))
        assert made[la].tolist() == [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:300]]
    p = Profiles(made)
    for r in out:  # the report's predictions are those of profiles learned from the rows that aren't held out
        assert r.held_out in (True, False)
    learned = Profiles(train_profiles(docs.filter("lang IS NOT NULL AND crc32(coalesce(CAST(doc_id AS string), '')) % 5 != 0").select("lang", "text")))
    want = Counter((i, *learned.predict(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.lang_pred, r.score) for r in out) == want

    t = "Straße où élan"
    mine = [g for g, _ in sorted(Counter(map(code, grams(t))).items(), key=lambda x: (-x[1], x[0]))[:300]]
    off = {la: sum(abs(k - made[la].tolist().index(g)) if g in made[la] else 300 for k, g in enumerate(mine)) for la in langs}
    best = min(sorted(langs), key=off.get)
    assert p.predict(t) == (best, pytest.approx(1 - off[best] / (300 * len(mine))))


def test_language_model(docs, rows, empty):
    from weftlake.llm.lm import discounts, score_report

    tok = [(i, [*(w for w in (t or "").encode().lower().split()), b"</s>"]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c, pairs = Counter(), Counter()
    for i, w in tok:
        if not held(i):
            c.update(w)
            pairs.update(zip([b"<s>", *w], w))
    n, v = sum(c.values()), len(c)
    of = lambda x: [sum(y == k for y in x.values()) for k in (1, 2, 3, 4)]
    cont = Counter(w for _, w in pairs)
    d, e = (0, *discounts(of(pairs))), (0, *discounts(of(cont)))
    back = sum(e[min(x, 3)] for x in cont.values()) / len(pairs)
    total, free = Counter(), Counter()
    for (a, _), k in pairs.items():
        total[a] += k
        free[a] += d[min(k, 3)]
    low = lambda w: max(cont[w] - e[min(cont[w], 3)], 0) / len(pairs) + back / (v + 1)
    p = lambda a, w: (max(pairs[a, w] - d[min(pairs[a, w], 3)], 0) + free[a] * low(w)) / total[a] if total[a] else low(w)
    assert sum(p(b"the", w) for w in c) + p(b"the", b"never seen") == pytest.approx(1)
    want = defaultdict(list)
    for i, w in tok:
        want[i].append((held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip([b"<s>", *w], w))))
    out = score_report(docs).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert set(got) == set(want)
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    assert score_report(empty).count() == 0


def test_counts_of_64_bits():
    """Counts beyond 32 bits are kept whole."""
    import numpy as np

    from weftlake.llm.lm import WORD, merged, sums_by

    many = np.full(3, (1 << 32) - 1, np.uint32)
    k, v, w, n = merged(np.array([7, 7, 7], np.uint64), np.array([9, 9, 8], np.uint64), many)
    assert sorted(n.tolist()) == [(1 << 32) - 1, 2 * ((1 << 32) - 1)]
    assert sums_by(np.zeros(3, int), np.array([1 << 62, 1 << 60, 3], np.uint64), 1).tolist() == [(1 << 62) + (1 << 60) + 3]
    assert all(WORD[c] == np.dtype("<u8") for c in WORD.names)


def raked(cells, targets, rounds=3000):
    """Weights by plain iterative proportional fitting over a dict of cells."""
    w = {c: 1.0 for c in cells}
    for _ in range(rounds):
        for d in range(3):
            mass = Counter()
            for c, n in cells.items():
                mass[c[d]] += n * w[c]
            for c in cells:
                w[c] *= targets[d].get(c[d], 0.0) / mass[c[d]] if mass[c[d]] else 0.0
    return w


def test_mixing(docs, rows, empty):
    from weftlake.llm.mixing import PATTERNS, mix_report, mix_sample
    from weftlake.llm.topics import fit_topics

    model = fit_topics(docs)
    for topics in (PATTERNS, model):
        cells = Counter()
        for r in mix_report(docs, topics=topics).collect():
            cells[r.source or "\x00none", r.lang or "\x00none", r.topic] += r.n_tokens
        total = sum(cells.values())
        goal = [Counter(), Counter(), Counter()]  # those of some weighting, so that they can be met
        for k, (c, n) in enumerate(sorted(cells.items())):
            for d in range(3):
                goal[d][c[d]] += n * (1 + k % 3)
        goal = [{v: x / sum(g.values()) for v, x in g.items()} for g in goal]
        out = mix_report(docs, targets=dict(zip(("source", "lang", "topic"), goal)), topics=topics).collect()
        assert Counter((r.doc_id, r.source, r.lang, r.n_tokens) for r in out) == Counter((i, s, la, len(words(t))) for i, t, la, s in rows)
        w = raked(cells, goal)
        for r in out:
            c = r.source or "\x00none", r.lang or "\x00none", r.topic
            assert not cells[c] or topics is model or r.weight == pytest.approx(w[c] * total, rel=1e-3, abs=1e-3)
            assert cells[c] * abs(r.weight / total - w[c]) < 1e-5
            assert r.residual < 1e-5 and 0 <= r.probability <= 1 <= r.repeats
            assert r.probability == 1 or r.repeats == 1
        ratio = [r.probability * r.repeats / r.weight for r in out if r.weight]
        assert ratio == pytest.approx([ratio[0]] * len(ratio)) and max(r.probability for r in out) == 1
        text = Counter((i, t) for i, t, *_ in rows)
        draw = {(i, t): (xxhash_row(i, t) >> 11) / 2**53 for i, t in text}
        kept = Counter(i for (i, t), m in text.items() for _ in range(m) if draw[i, t] < next(r.probability for r in out if r.doc_id == i and r.n_tokens == len(words(t))))
        assert Counter(r.doc_id for r in out if r.kept and r.doc_id is not None) == Counter({i: m for i, m in kept.items() if i is not None})
        d = mix_sample(docs, targets=dict(zip(("source", "lang", "topic"), goal)), topics=topics)
        assert d.columns == docs.columns and Counter(r.doc_id for r in d.collect()) == Counter(r.doc_id for r in out if r.kept)
    # Default targets, which the cells with fitted topics may not be able to meet.
    sums = [Counter(), Counter(), Counter()]
    for c, n in cells.items():
        for d in range(3):
            sums[d][c[d]] += n
    powers = [{v: x**0.9 for v, x in by.items()} for by in sums]
    w = raked(cells, [{v: x / sum(p.values()) for v, x in p.items()} for p in powers])
    for r in mix_report(docs, topics=model).collect():
        c = r.source or "\x00none", r.lang or "\x00none", r.topic
        assert cells[c] * abs(r.weight / total - w[c]) < 1e-4
    assert len({r.topic for r in out}) > 3 and all(r.topic == "none" for r in out if not r.n_tokens)
    by_lang = mix_report(docs, topic_col="lang").collect()
    assert all(r.topic == (r.lang if r.lang is not None else "\x00none") for r in by_lang)
    assert mix_report(empty).count() == 0 and mix_sample(empty).count() == 0


def xxhash_row(doc_id, text):
    """Spark's xxhash64 of (id, xxhash64 of the text, 9)."""
    seed = 42
    if doc_id is not None:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed)
    seed = xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest((text or "").encode(), 42)), seed)
    return xxhash.xxh64_intdigest(struct.pack("<i", 9), seed)


def test_topics_depend_neither_on_partitions_nor_on_order(spark, docs):
    from weftlake.llm.topics import fit_topics

    a, b = fit_topics(docs), fit_topics(docs.orderBy("text").repartition(7))
    assert (a.weight == b.weight).all() and (a.centres == b.centres).all()


def test_raking_meets_targets_both_ways(spark):
    from weftlake.llm import mixing

    cells = spark.createDataFrame([(s, la, t, (k * 7) % 11 + 1) for k, (s, la, t) in enumerate((s, la, t) for s in "abc" for la in ("x", "y") for t in ("p", "q"))], "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.25, "y": 0.75}, "topic": {"p": 0.6, "q": 0.4}}
    found = []
    for rake in (mixing.rake_few, mixing.rake_pairs, mixing.rake_cells):
        flat, gap = rake(cells, goal, 0.9)
        w = flat.collect()
        assert gap < 1e-6
        for dim, want in goal.items():
            for k, share in want.items():
                assert sum(r.tokens * r.weight for r in w if r[dim] == k) == pytest.approx(share, abs=1e-4)
        found.append({(r.source, r.lang, r.topic): r.weight for r in w})
    assert found[0] == pytest.approx(found[1], rel=1e-4) and found[1] == pytest.approx(found[2], rel=1e-4)
    # Targets that no weighting meets: the gap is told.
    apart = spark.createDataFrame([("a", "x", "p", 5), ("b", "y", "q", 5)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="gap"):
        w = mixing.rake(apart, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}).collect()
    assert w[0].residual > 0.1


def test_targets_that_only_a_weight_of_zero_meets(spark):
    from weftlake.llm.mixing import TOLERANCE, rake

    cells = [("s0", "l0", "p", 100), ("s0", "l1", "p", 100), ("s1", "l0", "p", 100)]
    half = {"source": {"s0": 0.5, "s1": 0.5}, "lang": {"l0": 0.5, "l1": 0.5}}
    w = {(r.source, r.lang): r for r in rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), half).collect()}
    assert all(r.residual < TOLERANCE for r in w.values())
    assert w["s0", "l0"].weight < 1e-4 and w["s0", "l1"].weight == pytest.approx(1.5, abs=1e-4)


def test_a_rare_cell_does_not_set_the_share_of_all(spark):
    from weftlake.llm.mixing import rake

    cells = [(f"s{k}", "x", "p", 100_000 + 1000 * k) for k in range(20)] + [("s0", "rare", "p", 5)]
    w = rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), {"lang": {"x": 0.99, "rare": 0.01}}).collect()
    common = [r for r in w if r.lang == "x"]
    assert min(r.probability for r in common) > 0.5
    assert next(r for r in w if r.lang == "rare").repeats > 100
