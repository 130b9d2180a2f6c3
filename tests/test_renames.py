"""Renames against the greedy rule: new paths in order, each the most alike old path left, ties by path."""

from difflib import SequenceMatcher

import numpy as np
import pytest

from corpusloom.operators.relational import numbered
from corpusloom.operators.renames import renames


def greedy(rows):
    out, old = {}, {}
    for path, change, key in rows:
        if change == "deleted" and key is not None:
            old.setdefault(key, []).append(path)
    for path, change, key in sorted(r for r in rows if r[1] == "added"):
        if left := sorted(old.get(key, [])):
            matcher = SequenceMatcher(None, "", path)

            def ratio(o, matcher=matcher):
                matcher.set_seq1(o)
                return matcher.ratio()

            best = max(left, key=ratio)  # the first of equals, and paths are sorted
            out[path] = best
            old[key].remove(best)
    return out


def paths(rng, n, words, depth=4):
    found = set()
    while len(found) < n:
        found.add("/".join(f"{words[i]}{rng.integers(0, 9)}" for i in rng.integers(0, len(words), rng.integers(1, depth))) + f"/{rng.integers(0, 2 * n)}.py")
    return sorted(found)


def check(spark, rows, **limits):
    df = spark.createDataFrame(rows, "path string, change string, hash string").repartition(5)
    assert {r.path: r.old_path for r in renames(df, **limits).collect()} == greedy(rows)


@pytest.mark.parametrize("limits", [{}, {"chunk": 16, "block": 10, "kept": 3}, {"chunk": 5, "block": 1000, "kept": 1}])
def test_greedy(spark, limits):
    rng = np.random.default_rng(4)
    words = ["src", "lib", "app", "é", "test_utils"]
    new, old = paths(rng, 90, words), ["o/" + p for p in paths(rng, 80, words)]
    rows = [(p, "added", f"h{i % 7 if i % 3 else 0}") for i, p in enumerate(new)] + [(p, "deleted", f"h{i % 9 if i % 4 else 0}") for i, p in enumerate(old)]
    rows += [("x", "added", None), ("y", "deleted", None), ("same", "unchanged", "h0"), ("one.py", "added", "single"), ("two.py", "deleted", "single")]
    check(spark, rows, **limits)
    assert renames(spark.createDataFrame([], "path string, change string, hash string")).count() == 0


def test_ties_take_the_first_path(spark):
    rows = [(f"n{i:02d}", "added", "h") for i in range(30)] + [(f"o{chr(97 + i)}x", "deleted", "h") for i in range(20)]
    check(spark, rows, chunk=8, block=6, kept=2)


def test_long_paths_have_popular_characters(spark):
    rng = np.random.default_rng(2)
    rows = [("".join(rng.choice(list("abc/"), 260)), kind, "h") for kind in ("added", "deleted") for _ in range(12)]
    check(spark, rows, kept=2)


@pytest.mark.parametrize("added,deleted", [(4800, 200), (15, 4985)])
def test_many_copies(spark, added, deleted):
    rng = np.random.default_rng(added)
    words = ["pkg", "core", "util", "web"]
    check(spark, [(p, "added", "h") for p in paths(rng, added, words)] + [("old/" + p, "deleted", "h") for p in paths(rng, deleted, words)])


def test_numbered(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(x)) for k, n in (("a", 500), ("b", 3), (None, 40)) for x in rng.permutation(n)]
    got = numbered(spark.createDataFrame(rows, "k string, x long").repartition(7), ["k"], ["x"], "nth").collect()
    assert sorted((str(r.k), r.x, r.nth) for r in got) == sorted((str(k), x, x + 1) for k, x in rows)
