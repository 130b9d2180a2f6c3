"""Greedy matching against the plain loop, with more ties than there once were rounds."""

import random
from collections import Counter

import pytest

from corpusloom.operators import evaluation
from corpusloom.operators.matching import greedy_matching


def plain(pairs):
    lefts, rights, out = set(), set(), []
    for a, b, s in sorted(set(pairs), key=lambda p: (-p[2], p[0], p[1])):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            out.append((a, b, s))
    return sorted(out)


def check(spark, pairs, rounds=None):
    log = []
    found = greedy_matching(spark.createDataFrame(pairs, "left long, right long, score long"), log)
    assert sorted(tuple(r) for r in found.collect()) == plain(pairs)
    assert rounds is None or len(log) <= rounds


@pytest.mark.parametrize("n", [60, 5])
def test_greedy(spark, n):
    pairs = [(a, b, 1) for a in range(n) for b in range(n)]
    pairs += [(1000 + i, 1000 + i + k, 2 * i + k) for i in range(n // 2) for k in (0, 1)] + [(7000, 7000, 3)] * 2
    check(spark, pairs)


def test_full_tie_takes_a_round(spark):
    check(spark, [(a, b, 1) for a in range(1000) for b in range(1000)], rounds=1)
    check(spark, [(a, b, 1) for a in range(300) for b in range(100)] + [(a, 500 + a, 2) for a in range(0, 300, 7)], rounds=4)


@pytest.mark.parametrize("seed", range(6))
def test_random_ties(spark, seed):
    rng = random.Random(seed)
    n, scores = rng.choice([(12, 1), (25, 2), (40, 3), (30, 30)])
    check(spark, [(rng.randrange(n), rng.randrange(n), rng.randrange(scores)) for _ in range(n * rng.choice([2, 6, 12]))])


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "left long, right long, score long")
    assert greedy_matching(empty).collect() == []
    odd = spark.createDataFrame([(None, 1, 5), (None, 2, 4), (1, None, 3), (2, 2, None)], "left long, right long, score long")
    assert sorted(((r.left, r.right) for r in greedy_matching(odd).collect()), key=str) == [(1, None), (None, 1)]


def test_few_rights_keep_few_pairs(spark):
    """Many lefts and few rights: only a right's first pairs, as many as there are rights, are looked at."""
    rng = random.Random(3)
    pairs = [(a, b, rng.randrange(40)) for a in range(400) for b in range(6)]
    log = []
    found = greedy_matching(spark.createDataFrame(pairs, "left long, right long, score long"), log)
    assert sorted(tuple(r) for r in found.collect()) == plain(pairs)
    assert max(log) <= 36


def test_shared_steps_without_pairs_of_rows(spark, monkeypatch):
    rng = random.Random(5)
    gold = {(g, f"s{rng.randrange(40)}") for g in range(90) for _ in range(25)} | {(200, "alone"), (201, None)}
    actual = {(x, f"s{rng.randrange(40)}") for x in range(300) for _ in range(20)} | {(400, "other"), (401, None), (None, "s1"), (None, "s2")}
    monkeypatch.setattr(evaluation, "FLOW_ROWS", 500)
    found = evaluation._shared_steps(spark.createDataFrame(list(gold), "gold_id long, step string"), spark.createDataFrame(list(actual), "actual_id long, step string"))
    have = {}
    for x, s in actual:
        have.setdefault(s, []).append(x)
    wanted = Counter((g, x) for g, s in gold if s is not None for x in have.get(s, ()))
    assert {(r.gold_id, r.actual_id): r.overlap for r in found.collect()} == wanted
    assert "SortMergeJoin [step" not in (plan := found._jdf.queryExecution().toString()) and "MapInArrow" in plan


@pytest.mark.parametrize("few", [0, 100])
def test_rounds_before_the_plain_loop(spark, few):
    rng = random.Random(few)
    pairs = [(rng.randrange(25), rng.randrange(25), rng.randrange(3)) for _ in range(250)]
    found = greedy_matching(spark.createDataFrame(pairs, "left long, right long, score long"), few=few)
    assert sorted(tuple(r) for r in found.collect()) == plain(pairs)
