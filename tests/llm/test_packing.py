import random
from bisect import bisect_left, insort

import pytest

from lociflow.llm.packing import best_fit, pack, pack_all


def plain(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        i = bisect_left(room, x)
        free = room.pop(i) if i < len(room) else capacity
        insort(room, free - x)
    return len(room)


def test_plan_equals_best_fit_piece_by_piece():
    rng = random.Random(1)
    for _ in range(100):
        c = rng.choice([7, 30, 512])
        lengths = [rng.randint(1, c) for _ in range(rng.randint(0, 200))] + [rng.randint(1, c)] * rng.choice([0, 90])
        h = {x: lengths.count(x) for x in set(lengths)}
        plan, made = best_fit(h, c)
        assert made == plain(lengths, c)
        fill = [0] * made
        for x, n in h.items():
            rows = [p for p in plan if p[0] == x]
            for k in range(n):
                _, r, f, e = [p for p in rows if p[1] <= k][-1]
                fill[f + (k - r) // e] += x
        assert all(0 < v <= c for v in fill)


def test_nothing_is_lost_and_only_long_texts_are_split(spark):
    rng = random.Random(2)
    n = {i: rng.choice([0, 1, 5, 9, 10, 11, 35, 40]) for i in range(3000)}
    out = pack(spark.createDataFrame(list(n.items()), "doc_id bigint, n_tokens bigint"), 10).collect()
    docs, fill = {}, {}
    for r in out:
        docs.setdefault(r.doc_id, []).append(r)
        if r.container is None:
            assert n[r.doc_id] == 0
        else:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    for i, k in n.items():
        assert sum(r.n_tokens for r in docs[i]) == k and len(docs[i]) == max(1, -(-k // 10))
    assert max(fill.values()) <= 10 and sorted(fill) == list(range(len(fill)))
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 1)], "doc_id bigint, n_tokens bigint"), 0)


def test_texts(spark):
    rows = [(1, "two words", "x"), (2, "", "x"), (3, None, "x"), (4, "word " * 3000, "x"), (5, "two words", "x"), (6, "a" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    out = pack_all(docs, {"small": 16, "large": 4096}).collect()
    assert {r.doc_id for r in out if r.container is None} == {2, 3}
    for name in ("small", "large"):
        assert sum(r.n_tokens for r in out if r.size_name == name and r.doc_id == 4) >= 3000
    assert pack_all(docs.limit(0), {"small": 16}).count() == 0
