"""Product codes and whitening against plain versions, on odd rows and on the smallest input."""

import math
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import codes, queries, whitening
from corpusloom.llm._vectors import usable

SCHEMA = "vec_id long, embedding array<double>, label int, row string, code string, error string, vector int"
NAN, INF = float("nan"), float("inf")


def table(spark, vectors, ids=None, labels=None):
    ids, labels = ids or range(len(vectors)), labels or [i % 3 or None for i in range(len(vectors))]
    return spark.createDataFrame([(i, v, x, "r", "c", None, 7) for i, v, x in zip(ids, vectors, labels, strict=True)], SCHEMA)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds on (id, vector) by comparing every part with every entry."""
    xs = [[math.floor(4096 * c) for c in v] for _, v in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    cuts = [p * len(xs[0]) // parts for p in range(parts + 1)]
    chosen, errors, books = [[] for _ in xs], [0] * len(xs), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        book = [xs[i][a:b] for i in first]
        near = lambda x, book: min((sum((s - t) ** 2 for s, t in zip(x, y, strict=True)), e) for e, y in enumerate(book))
        for _ in range(rounds):
            own = [near(x[a:b], book)[1] for x in xs]
            for e in range(len(book)):
                if members := [x[a:b] for x, o in zip(xs, own, strict=True) if o == e]:
                    book[e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        for i, x in enumerate(xs):
            d, e = near(x[a:b], book)
            chosen[i].append(e)
            errors[i] += d
        books += [str(c) for y in book for c in y]
    return ["".join(f"{e:02x}" for e in c) for c in chosen], errors, ",".join(books)


def found_codes(df, **more):
    coded, books = codes.compress(df, carry=["vec_id", "label", "row"], **more)
    return codes.with_label_errors(coded).collect(), books


@pytest.mark.parametrize("kind", ["spread", "close", "ties", "few", "uneven", "one", "large"])
def test_codes(spark, kind):
    rng = np.random.default_rng(len(kind))
    size = {"uneven": 11, "one": 3}.get(kind, 16)
    n = {"few": 5, "one": 1}.get(kind, 120)
    centres = rng.normal(size=(6, size))
    v = rng.normal(size=(n, size)) if kind != "close" else centres[rng.integers(0, 6, n)] + rng.normal(size=(n, size)) * 0.01
    if kind == "ties":
        v = rng.integers(-1, 2, (n, size)) / 4096
    if kind == "large":
        v *= 1e4
    ids = [*range(n - n // 4), *range(n // 4)]  # some ids twice
    ids[-1] = None if n > 1 else 0
    rows = list(zip(ids, v.tolist(), strict=True))
    got, books = found_codes(table(spark, v.tolist(), ids).repartition(3, "label"))
    want_codes, want_errors, want_books = plain_codes(rows)
    labels = [i % 3 or None for i in range(n)]
    assert sorted((str(r.row.vec_id), r.code, r.error) for r in got) == sorted((str(i), c, e) for i, c, e in zip(ids, want_codes, want_errors, strict=True))
    assert books.text() == want_books
    assert {r.row.label: r.label_error for r in got} == {x: sum(e for e, y in zip(want_errors, labels, strict=True) if y == x) for x in set(labels)}


def test_codes_odd_rows(spark):
    good = np.random.default_rng(5).normal(size=(30, 8)).tolist()
    odd = [None, [], [None, *good[0][1:]], [NAN, *good[0][1:]], [-INF, *good[0][1:]], good[0][:4]]
    got, books = found_codes(table(spark, [*odd, *good, *good[:2]]))
    rows = list(zip(range(6, 38), [*good, *good[:2]], strict=True))
    want = plain_codes(rows)
    assert {r.row.vec_id: (r.code, r.error) for r in got} == {i: (c, e) for (i, _), c, e in zip(rows, *want[:2], strict=True)}
    assert books.text() == want[2]
    coded, none = codes.compress(table(spark, odd[:5]).filter("vec_id <> 2 and vec_id <> 3 and vec_id <> 4"))
    assert none is None and coded.count() == 0 and coded.columns == ["row", "code", "error"]
    assert codes.compress(table(spark, []))[0].count() == 0
    with pytest.raises(Exception, match="beyond exact whole numbers"):
        codes.compress(table(spark, [[1e300] * 8, [1.0] * 8]))


def test_only_violated_parts_are_compared(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(16, 64))[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 64)) * 0.02
    log = []
    got, _ = found_codes(table(spark, v.tolist()), log=log)
    assert log[0] == 3000 * 8 and all(x < 3000 * 8 for x in log[1:]) and log[-1] < 3000 * 4
    assert len(got) == 3000


def test_heaps_keep_exact_assignments():
    """Entries that wander anyhow: after each move the heaps hold the nearest entries, ties to the lower index."""
    rng = np.random.default_rng(9)
    parts, book = rng.integers(-300, 300, (500, 3)), rng.integers(-300, 300, (7, 3))
    heaps, drift, compared = codes.Heaps(np.zeros(500, np.uint8), [[] for _ in range(7)], new=True), np.zeros(7), []
    for _ in range(30):
        compared.append(heaps.advance(parts, book, drift)[2])
        heaps.new = False
        assert (heaps.assigned == codes.squared(parts, book).argmin(1)).all()
        assert sorted(i for h in heaps.heaps for _, i in h) == list(range(500))
        new = book + rng.integers(-2, 3, book.shape)
        drift, book = drift + codes._drifts(new - book), new
    assert sum(compared) < 500 * 15


def plain_whitening(vectors, k=8):
    xs = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(xs), len(xs[0])
    sums = [sum(c) for c in zip(*xs, strict=True)]
    centred = [[Fraction(n * a - s, n) for a, s in zip(x, sums, strict=True)] for x in xs]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    values, comps = np.linalg.eigh(cov)
    values, comps = values[::-1][:k], comps[:, ::-1][:, :k]
    w = np.array([[float(c) for c in row] for row in centred]) @ comps / np.sqrt(np.maximum(values, 1e-300))
    return n, [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs], w, values / np.trace(cov)


def check_whitening(df, vectors, ids):
    got = {(r.row.vec_id, r.component): r for r in whitening.whiten(df, carry=["vec_id", "row"]).collect()}
    n, deviations, w, explained = plain_whitening(vectors)
    k = min(8, len(vectors[0]))
    assert set(got) == {(i, c + 1) for i in ids for c in range(k)}
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ w[:, c])
        assert np.allclose(mine, sign * w[:, c], rtol=1e-6, atol=1e-6)
        assert got[ids[0], c + 1].explained == pytest.approx(explained[c], rel=1e-9)
    assert all(int(got[i, 1].deviation) == x for i, x in zip(ids, deviations, strict=True))
    assert {r.n for r in got.values()} == {n}
    errors = {r.identity_error for r in got.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9


@pytest.mark.parametrize("size,scale,shift", [(12, 1.0, 0.0), (3, 1.0, -500.0), (9, 1e9, 1e10)])
def test_whitening(spark, size, scale, shift):
    rng = np.random.default_rng(size)
    v = ((rng.normal(size=(60, size)) * np.arange(1, size + 1)) * scale + shift).tolist()
    odd = [None, [], [None] * size, [NAN] * size, [INF] * size, [1.0] * (size + 1)]
    check_whitening(table(spark, [*v, *odd]).repartition(3), v, list(range(60)))


def test_whitening_without_variance(spark):
    for vectors in ([[1.0, 2.0, 3.0]], [[0.5, 0.25]] * 4):
        got = whitening.whiten(table(spark, vectors)).collect()
        assert len(got) == len(vectors) * len(vectors[0])
        assert {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in got} == {(0.0, 0.0, 0.0, 0)}
    flat = [[float(i), 2.0 * i, 0.0] for i in range(9)]
    got = whitening.whiten(table(spark, flat)).collect()
    assert {r.component for r in got if r.whitened} == {1} and got[0].identity_error < 1e-9
    assert whitening.whiten(table(spark, [])).count() == 0
    with pytest.raises(Exception, match="beyond exact whole numbers"):
        whitening.whiten(table(spark, [[1e300], [1.0]]))


def test_digit_products():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 19, 1 << 21, 1 << 52):
        x = rng.integers(-most, most + 1, (200, 4))
        big = x.astype(object)
        assert (whitening.products(x) == big.T @ big).all()
    edge = np.full((whitening.ROWS, 2), (1 << 20) - 1)  # the largest digit in all rows
    assert whitening.products(edge)[0, 1] == whitening.ROWS * ((1 << 20) - 1) ** 2


def test_whitening_query(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    n, deviations, w, _ = plain_whitening([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in queries.op13_whitening(spark, sf_dir).collect()}
    assert len(got) == 8 * n
    for i, r in enumerate(rows):
        assert got[r.vec_id, 1].deviation == deviations[i]
        assert all(abs(abs(got[r.vec_id, c].whitened) - abs(w[i, c - 1])) < 1e-6 for c in range(1, 9))
    assert got[rows[0].vec_id, 1].identity_error <= 1e-4


def test_usable_lengths(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [3.0, 4.0]), (4, [5.0])], "vec_id long, embedding array<float>")
    rows, length = usable(df, "embedding", ["vec_id"])
    assert length == 2 and sorted(r.row.vec_id for r in rows.collect()) == [2, 3]
