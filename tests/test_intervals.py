"""Dyadic covers and interval joins against plain versions."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import relational


def test_cover(spark):
    spans = [(1, 1), (0, 0), (1, 64), (5, 4), (-7, 9), (3, 10_000_003), (123, 123 + 10_000_000 - 1), (-(1 << 40), 1 << 40), (2, 3)]
    rows = spark.createDataFrame(spans, "s long, e long").select("s", "e", relational.cover(F.col("s"), F.col("e")).alias("nodes")).collect()
    for r in rows:
        pieces = sorted((n.node << n.level, ((n.node + 1) << n.level) - 1) for n in r.nodes)
        assert len(pieces) < 50 or r.e - r.s > 10_000_003
        if r.e < r.s:
            assert not pieces
            continue
        assert pieces[0][0] == r.s and pieces[-1][1] == r.e
        assert all(a[1] + 1 == b[0] for a, b in zip(pieces, pieces[1:]))


def some(rng, n, longest):
    out = []
    for i in range(n):
        s = rng.randrange(1, 400)
        out.append((rng.choice("ab"), s, s + rng.choice([0, 1, 5, longest]) - (i % 17 == 0), i))
    return out


def test_joins(spark):
    rng = random.Random(5)
    left, right = some(rng, 80, 60), some(rng, 90, 200)
    frame = lambda rows, s, e, i: spark.createDataFrame(rows, f"k string, {s} long, {e} long, {i} long")
    got = relational.overlapping(frame(left, "start", "end", "l"), frame(right, "r_start", "r_end", "r"), ["k"]).collect()
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and a[2] >= b[1])
    assert sorted((r.l, r.r) for r in got) == want
    points = [p for p in left if p[1] <= p[2]]
    found = {r.l: r.span_id for r in relational.enclosing(frame(points, "start", "end", "l"), frame(right, "start", "end", "span_id"), ["k"]).collect()}
    best = {}
    for k, s, e, i in points:
        around = [(b[2] - b[1], b[1], b[3]) for b in right if b[0] == k and b[1] <= s and b[2] >= e]
        if around:
            best[i] = min(around)[2]
    assert found == best
    assert relational.enclosing(frame(points, "start", "end", "l"), frame([], "start", "end", "span_id"), ["k"]).count() == 0
