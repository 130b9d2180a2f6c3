"""Graph operators against plain versions."""

import random

import pytest

from corpusloom.operators import graph


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_boundary_expansion(spark):
    files = ("a/x.ts", "a/b/y.ts", "a/b/c/z.ts", "ab/q.ts", "b/a/r.ts", "top.ts")
    got = lambda *dirty: {r.path for r in graph.boundary_expansion(paths(spark, *dirty), paths(spark, *files), r"^package\.json$").collect()}
    assert got("a/package.json") == {"a/package.json", "a/x.ts", "a/b/y.ts", "a/b/c/z.ts"}
    assert got("a/b/package.json", "ab/q.ts") == {"a/b/package.json", "ab/q.ts", "a/b/y.ts", "a/b/c/z.ts"}
    assert got("package.json") == {"package.json", *files}
    assert got("a/x.ts") == {"a/x.ts"}
    assert got("a/package.json", "a/b/package.json", "zz/package.json") == {"a/package.json", "a/b/package.json", "zz/package.json", "a/x.ts", "a/b/y.ts", "a/b/c/z.ts"}


def plain_closure(pairs, start):
    """What is reached from the start along (from, to)."""
    out, todo = set(start), list(start)
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    while todo:
        for n in ahead.get(todo.pop(), ()):
            if n not in out:
                out.add(n)
                todo.append(n)
    return out


def closed(spark, pairs, start, reverse=False, log=None):
    edges = spark.createDataFrame([(b, a) if reverse else (a, b) for a, b in pairs], "source long, target long")
    got = [r.node for r in graph.closure(edges, spark.createDataFrame([(n,) for n in start], "node long"), reverse=reverse, log=log).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_closure(pairs, start)


@pytest.mark.parametrize("reverse", [False, True])
def test_closure(spark, reverse):
    import random

    rng = random.Random(3)
    for n, m in ((60, 50), (60, 90), (40, 200)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        closed(spark, [*pairs, *pairs[:5]], rng.sample(range(n), 3), reverse)
    circle = [(i, (i + 1) % 7) for i in range(7)]
    closed(spark, [*circle, (3, 20), (20, 21), (30, 31)], [30], reverse)  # a circle that nothing leads into
    closed(spark, [*circle, (3, 20), (30, 2)], [30, 99], reverse)
    closed(spark, [], [1], reverse)
    closed(spark, circle, [], reverse)


def test_closure_of_a_chain_takes_few_rounds(spark):
    log = []
    chain = [(i, i + 1) for i in range(10_000)]
    closed(spark, [*chain, (5_000, 20_000), (9_000, 20_000), (20_000, 20_001)], [0], log=log)
    assert len(log) <= 20


def test_reach_by_blocks_of_bits(spark, monkeypatch):
    """Where all reach nearly all, no level joins origins with edges one by one; the rows are those of plain search."""
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(2400)] + [(None, 3), (5, None), (900, 901), (901, 902)]
    origins = [*range(0, 300, 2), 900, 950]
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    wanted = set()
    for o in origins:
        seen, now = {o}, {o}
        for d in (1, 2, 3):
            now = {b for a in now if a is not None for b in after.get(a, ())} - seen
            seen |= now
            wanted |= {(o, n, d) for n in now if n is not None}
    e = spark.createDataFrame(edges, "source long, target long")
    s = spark.createDataFrame([(o,) for o in origins], "source long")
    rows = lambda **more: sorted(tuple(r) for r in graph.reach(e, s, 3, **more).filter("node is not null").collect())
    monkeypatch.setattr(graph, "ORIGINS", 64)
    monkeypatch.setattr(graph, "TASK_EDGES", 1000)
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keys of one block have to meet in any number of partitions
    levels = []
    keep = graph._level_by_blocks
    monkeypatch.setattr(graph, "_level_by_blocks", lambda *a: levels.append(a[4]) or keep(*a))
    try:
        assert rows() == sorted(wanted) and levels == [3]
        assert rows(block_factor=0) == sorted(wanted) and levels == [3, 2, 3]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
