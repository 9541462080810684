"""The change feed of boards against sorting all items after every day."""

import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, grp int, node long, day int, item long, value long, h long, seen int, price double"


def shop(n=3000, items=700, vendors=9, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        item = r.choice([None, items + 5, 3]) if r.random() < 0.04 else 3 if r.random() < 0.3 else r.randrange(items)
        at = None if r.random() < 0.02 else datetime(2024, 1, 1) + timedelta(days=i * 150 // n + r.randrange(6), hours=r.randrange(24))
        amount = None if r.random() < 0.05 else r.randrange(1, 9000) / 8
        rows.append((None if r.random() < 0.01 else i, r.randrange(4), item, None if r.random() < 0.01 else r.randrange(vendors + 1), None if r.random() < 0.3 else r.randrange(9), amount, 0.0, r.choice(["kept", "returned", None, "swapped"]), at))
    rows += [rows[5]] * 3
    places = [(v, None if v == 4 else v % 3) for v in range(vendors)]
    prices = [(i, None if i % 50 == 7 else i / 4) for i in range(items)]
    return rows, places, prices


def brute(rows, places, prices):
    nation, price = dict(places), dict(prices)
    lines = []
    for sale, no, item, vendor, quantity, amount, _, flag, at in rows:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, no)).encode())
        s = 19723 + h % 150 if at is None else (at - datetime(1970, 1, 1)).days
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        cents = math.floor(100 * amount + 0.5) if amount is not None else 0
        if amount is None and quantity is not None and price.get(item) is not None:
            cents = quantity * math.floor(100 * price[item] + 0.5)
        lines.append((min(10, 1 + (a - 19723) * 10 // 180), a, s, nation.get(vendor), item if item in price else None, -cents if flag == "returned" else cents))
    most = defaultdict(int)
    for b, _, s, *_ in lines:
        most[b] = max(most[b], s)
    days = defaultdict(lambda: defaultdict(list))
    for b, a, s, n, i, c in lines:
        if n is not None and i is not None and s + 3 >= max((m for k, m in most.items() if k < b), default=0):
            days[a][n].append((i, c))
    revenue, old, out = defaultdict(lambda: defaultdict(int)), defaultdict(list), []
    for a in sorted(days):
        for n, changed in days[a].items():
            for i, c in changed:
                revenue[n][i] += c
            new = sorted((i for i, v in revenue[n].items() if v > 0), key=lambda i: (-revenue[n][i], i))[:10]
            rank = lambda board, i: board.index(i) + 1 if i in board else None
            for i in {*old[n], *new}:
                was, now = rank(old[n], i), rank(new, i)
                if was != now:
                    out.append((n, a, i, min(10, 1 + (a - 19723) * 10 // 180), "enter" if was is None else "exit" if now is None else "move", was, now, revenue[n][i]))
            old[n] = new
    return sorted(out, key=str)


def test_feed(spark, monkeypatch):
    """With small leaves and a small fan the trees have three levels; a hot item, nulls, ties, repeats and clashing columns."""
    from weftlake.llm import board

    monkeypatch.setattr(board, "LEAF_ITEMS", 60)
    monkeypatch.setattr(board, "FAN", 4)
    monkeypatch.setattr(board, "DAYS_AT_ONCE", 4)
    rows, places, prices = shop()
    lines = spark.createDataFrame([x + (1, 2, 3, 4, 5, 6, 7, 1.5) for x in rows], LINES)
    vendors = spark.createDataFrame([(v, n, "x") for v, n in places] + [(None, 1, "x")], "vendor_id long, nation_id int, grp string")
    items = spark.createDataFrame([(i, p, 1) for i, p in prices] + [(None, 3.0, 1)], "item_id long, price double, item int")
    got = board.board_report(lines, vendors, items).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, places, prices)
    assert len(got) > 200 and {r.change for r in got} == {"enter", "exit", "move"}
    assert board.board_report(lines.limit(0), vendors, items).count() == 0


def test_best_breaks_ties_by_item():
    import numpy as np

    from weftlake.llm.board import best_of

    items = np.arange(40)[::-1].copy()
    got = best_of(items, np.where(items % 2 == 0, 5, -1))
    assert got[0].tolist() == list(range(0, 20, 2)) and set(got[1].tolist()) == {5}
    assert [len(x) for x in best_of(items[:0], items[:0])] == [0, 0]
