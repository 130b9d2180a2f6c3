"""Operators that SQL doesn't cover wholly, against plain versions: folds, matching, retrieval, renames, rules, embeddings."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators import chunks as ch
from corpusloom.operators import admission, folds, graph, learning, ledger, mapping, resolution, retrieval, snapshot
from corpusloom.operators.evaluation import matched_flows
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.plans import learning as learning_plans
from corpusloom.plans import search
from corpusloom.sources.tables import Tables


def test_clamped_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b"]), i // 2, i, rng.choice([300, -250, 90, -700])) for i in range(900)]
    events = spark.createDataFrame(rows, "k string, s long, i long, d long").select("k", F.timestamp_seconds("s").alias("ts"), "i", "d")
    want = {}
    for k, s, i, d in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k] = min(max(want.get(k, 500) + d, 0), 1000)
    for ranges, size in ((1, 1000), (3, 1000), (3, 20), (40, 7)):
        got = folds.clamped_sums(events, ["k"], ["ts", "i"], {"x": ("d", 500, 0, 1000)}, ranges, size)
        assert {r.k: r.x for r in got.collect()} == want
    assert Counter(r[0] for r in rows) == Counter({r.k: r.n for r in got.collect()})
    assert folds.clamped_sums(events.limit(0), ["k"], ["ts", "i"], {"x": ("d", 500, 0, 1000)}).count() == 0


def test_replay_and_progress(spark):
    rows = [("p", "c", 1, 1, 80, 80), ("p", "c", 2, 2, -800, 120), ("p", "c", 3, 3, 80, 900)]
    events = spark.createDataFrame(rows, "profile string, concept string, s long, event_id long, delta long, confidence_delta long").withColumn("ts", F.timestamp_seconds("s"))
    (got,) = learning.replay(events).collect()
    assert (got.score, got.confidence, got.n) == (80, 1000, 3)
    kinds = spark.createDataFrame([("p", 1, 1, "needs_help"), ("p", 2, 2, "needs_help"), ("p", 3, 3, "needs_help"), ("p", 4, 4, "understood"), ("p", 5, 5, "opened")], "profile string, s long, event_id long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    (got,) = learning.reduce_progress(kinds).collect()
    assert (got.opened, got.understood, got.help, got.style) == (1, 1, 3, 1)


def test_reserve(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "x", None]), i, rng.randrange(0, 400)) for i in range(2000)]
    requests = spark.createDataFrame(rows, "org string, event_id long, micro long").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    used, want = Counter(), {}
    for org, i, micro in rows:
        want[i] = used[org] + micro <= 5000
        used[org] += micro * want[i]
    assert {r.event_id: r.granted for r in ledger.reserve(requests, 5000).collect()} == want


@pytest.fixture(scope="module")
def drafts(spark):
    words = "Runner run main index Auth auth_token server test x1 ab".split()
    rng = random.Random(3)
    rows = [(i, f"src/{rng.choice(words)}/{rng.choice(words)}{i % 3}.ts", rng.choice([None, *words]), " ".join(rng.choice(words) for _ in range(30)), rng.choice([1, 2, 3])) for i in range(300)]
    return [(i, p, s, f"{p}#{s}", t, n) for i, p, s, t, n in rows], spark.createDataFrame([(i, p, s and s.lower(), f"{p}#{s}", t, n) for i, p, s, t, n in rows], "chunk_id long, path string, symbol string, title string, text string, specificity int")


TERMS = [(1, "run"), (1, "in"), (2, "auth"), (3, "ts"), (3, "none"), (4, "x1"), (4, "ab"), (5, "runner")]


def test_exact_bands(spark, drafts):
    rows, chunks = drafts
    want = {}
    for q in {q for q, _ in TERMS}:
        scored = []
        for i, p, s, title, _, n in rows:
            low, path, title = (s or "").lower(), p.lower(), title.lower()
            best = max(max(1.0 if t == low else 0.9 if t in low else 0, 0.85 if path.endswith(t) else 0.7 if t in path else 0, 0.65 if t in title else 0) for x, t in TERMS if x == q)
            if best:
                scored.append((-best, -n, i))
        want[q] = [(i, -b) for b, _, i in sorted(scored)[:24]]
    got = {}
    for r in retrieval.exact(chunks, spark.createDataFrame(TERMS, "query_id long, term string")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert got == {q: w for q, w in want.items() if w}


def test_vector_index(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    v = Tables(spark, folder).embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    whole = pairs(search.ret4_vector_topk(Tables(spark, folder)))
    index = VectorIndex(v)
    assert len(whole & pairs(index.nearest(v.filter("id % 20 = 0"), 8))) >= 0.9 * len(whole) > 0
    compared = index.candidates(v.filter("id % 20 = 0"), 200).count()
    assert compared <= 0.1 * index.n * v.filter("id % 20 = 0").count()


def test_vector_index_prunes_lists(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    m = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.2
    rows = [(i, x) for i, x in enumerate(m.tolist())] + [(4000, None), (4001, [0.0] * 16)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    index = VectorIndex(v, lists=40)
    assert index.probes <= 8
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    asked = v.filter("id % 20 = 1")
    whole = pairs(retrieval.nearest(v, asked, 5))
    assert len(whole & pairs(index.nearest(asked, 5))) >= 0.9 * len(whole)


def test_cache_lookup_by_index(spark, sf_dir):
    v = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").cast("string").alias("fingerprint"), F.col("label").alias("manifest"))
    requests, entries = v.filter("id % 20 = 0"), v.filter("id % 3 > 0")
    one = {r.id: r.entry for r in retrieval.cache_lookup(requests, entries, 0.2).collect()}
    two = {r.id: r.entry for r in retrieval.cache_lookup(requests, entries, 0.2, VectorIndex(entries, k=1)).collect()}
    assert one.keys() == two.keys() and sum(one[i] == two[i] for i in one) >= 0.9 * len(one)


def test_no_vectors(spark):
    rows = spark.createDataFrame([(1, 5, 0.5, 1)], "query_id long, chunk_id long, score double, rank int")
    none, status = retrieval.by_vector(rows, None)
    assert (none, status) == (None, "unavailable")
    assert retrieval.fuse({"exact": rows, "vector": none}).first().score == round(1.5 / 61, 10)


def test_hash_embedding(spark):
    texts = [None, "", "getUserName get_user x", "abcd abcd abce", "한국어 테스트", "..."]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.v for r in frame.select("i", retrieval.hash_embedding(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        words = [w.lower() for w in re.findall("[A-Za-z0-9가-힣]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", t or ""))]
        features = Counter(words)
        for w in words:
            if len(w) >= 4:
                features.update(f"^{w}$"[k : k + 3] for k in range(len(w)))
        v = [0.0] * 768
        for f, n in features.items():
            d = hashlib.blake2b(f.encode(), digest_size=16).digest()
            v[int.from_bytes(d[:8], "big") % 768] += (1 if d[8] & 1 else -1) * (1 + math.log(n))
        size = math.sqrt(sum(x * x for x in v)) or 1
        assert all(math.isclose(a, b / size, abs_tol=1e-12) for a, b in zip(got[i], v, strict=True))


def test_chunk_hash_is_whole(spark):
    line = "a" * 30_000
    files = spark.createDataFrame([(1, "p", "en", line + "b"), (2, "p", "en", line + "c")], "file_id long, path string, language string, content string")
    assert len({r.text_hash for r in ch.chunks(files).collect()}) == 2
    made = ch.chunks(files).select(ch.embedding_text().alias("e")).collect()
    assert {len(r.e) for r in made} == {24_000}


def test_renames(spark):
    side = lambda rows: spark.createDataFrame([(p, h, "en", 1) for p, h in rows], "path string, content_hash string, language string, byte_size long")
    base = side([("a/x.py", "h"), ("b/y.py", "h"), ("c/z.py", "h"), ("same.py", "s"), ("gone.py", "g")])
    current = side([("b/y2.py", "h"), ("d/x.py", "h"), ("q/new.py", "h"), ("r/more.py", "h"), ("same.py", "s")])
    got = {r.path: (r.change, r.old_path) for r in snapshot.diff(base, current).collect()}
    assert got == {"d/x.py": ("renamed", "a/x.py"), "b/y2.py": ("renamed", "b/y.py"), "q/new.py": ("renamed", "c/z.py"), "r/more.py": ("added", None), "same.py": ("unchanged", None), "gone.py": ("deleted", None)}


def test_ignore_rules(spark):
    cases = {
        ("*.log",): {"a.log": True, "x/b.log": True, "log.txt": False, "a.log/x": True},
        ("/build",): {"build/x": True, "a/build": False},
        ("node_modules/",): {"node_modules/x": True, "a/node_modules/y": True, "node_modules": False},
        ("docs/*.md",): {"docs/a.md": True, "x/docs/a.md": False, "docs/a/b.md": False},
        ("a/**/z",): {"a/z": True, "a/b/c/z": True, "b/z": False},
        ("*.env", "!ok.env", "# no", ""): {"x.env": True, "ok.env": False},
        ("file?.txt",): {"file1.txt": True, "file12.txt": False},
    }
    for rules, paths in cases.items():
        frame = spark.createDataFrame([(p,) for p in paths], "path string")
        assert {r.path: r.out for r in frame.select("path", fx.ignored(F.col("path"), rules).alias("out")).collect()} == paths, rules


def test_route_paths(spark):
    cases = {"app/api/users/route.ts": "/api/users", "src/app/api/(admin)/x/route.js": "/api/x", "app/api/[id]/route.ts": None, "app/api/_p/route.ts": None, "app/api/page.ts": None, "api/x/route.ts": None, "app/api/route.tsx": "/api"}
    frame = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.route for r in frame.select("path", fx.route_path(F.col("path")).alias("route")).collect()} == cases


def test_concepts(spark):
    source = "async function f(a) { try { if (a) { return await f(a) } } catch (e) {} }"
    frame = spark.createDataFrame([(source, "tsx"), ("plain words", "en"), (None, "en")], "t string, l string")
    got = frame.select(fx.concept_candidates(F.col("t"), F.col("l")).alias("c"), fx.required_concepts(F.col("t"), F.col("l")).alias("r")).collect()
    assert got[0].c == ["async_await", "exception_handling", "recursion"] and got[0].r == ["async", "errors", "conditional", "return"]
    assert got[1].c == [] and got[1].r == ["sequence"]


def test_readme(spark):
    text = "# Name\n\n[![badge](x)](y)\n```\ncode line\n```\nFirst **line**\nsecond [link](u).\n\nOther.\n\n## Key Features:\n- One\n* `Two`\ntext\n### Details\n- no\n# What it does\n+ Three"
    files = spark.createDataFrame([("s", 1, "README.md", "md", text), ("s", 2, "x/readme", "md", "- list only")], "snapshot string, file_id long, path string, language string, content string")
    assert [(r.line, r.feature) for r in mapping.readme_features(files).orderBy("line").collect()] == [(13, "One"), (14, "Two"), (19, "Three")]
    assert [r.summary for r in mapping.readme_summary(files).collect()] == ["First line second link."]


def test_closure_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 3), (20, 21)], "source long, target long")
    got = graph.closure(edges, spark.createDataFrame([(12,)], "node long"))
    assert {r.node for r in got.collect()} == set(range(13))


def test_guided_path_repeats(spark):
    kinds = "snapshot string, file_id long, path string, language string, chunk_type string, kind string, signature string, top boolean, degree int, start int, raises boolean, is_test boolean"
    rows = [("s", 1, "a/m.ts", "typescript", "file", None, "", True, 0, 1, False, False), ("s", 2, "a/m.ts", "typescript", "symbol", "function", "export f", True, 3, 5, True, False), ("s", 3, "t/m.test.ts", "typescript", "symbol", "function", "f", True, 0, 1, False, True), ("u", 4, "x", "md", "block", None, None, False, 0, 1, False, False)]
    got = {(r.snapshot, r.slot): r.file_id for r in resolution.guided_path(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {("s", 1): 1, ("s", 2): 2, ("s", 5): 3, ("u", 6): 4}


def greedy(scored):
    lefts, rights, out = set(), set(), []
    for s, a, b in sorted(scored, key=lambda p: (-p[0], p[1], p[2])):
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            out.append((a, b))
    return sorted(out)


def test_flow_matching(spark):
    rng = random.Random(6)
    gold = {(g, rng.randrange(12)) for g in range(25) for _ in range(4)}
    actual = {(a, rng.randrange(12)) for a in range(30) for _ in range(5)}
    size, shared = Counter(g for g, _ in gold), Counter((g, a) for g, s in gold for a, x in actual if x == s)
    want = greedy([((n / size[g], n), g, a) for (g, a), n in shared.items()] and [(round(n / size[g], 9) * 10**6 + n / 10**6, g, a) for (g, a), n in shared.items()])
    got = matched_flows(spark.createDataFrame(sorted(gold), "gold_id long, step long"), spark.createDataFrame(sorted(actual), "actual_id long, step long"))
    assert sorted((r.gold_id, r.actual_id) for r in got.collect()) == want


def test_matching_query(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("s")).collect()
    want = greedy([(r.s, r.l_suppkey, r.l_partkey) for r in rows])
    assert sorted((r.left, r.right) for r in learning_plans.join20_greedy_matching(Tables(spark, sf_dir)).collect()) == want


def test_scanning(spark, tmp_path):
    from corpusloom.operators import scanning

    files = {"a/x.py": b"\xef\xbb\xbfprint(1)\n", "a/y.py": b"\xff\xfe", "a/z.py": b"a\0b", "b/big.py": b"x" * 50, "b/my.pem": b"k", "c/notes.txt": b"t", "build/o.py": b"1", "d/u.py": "\u00e9".encode()}
    for name, raw in files.items():
        at = tmp_path / "tree" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(raw)
    rows = scanning.read_folder(spark, str(tmp_path / "tree")).withColumn("snapshot", F.lit("s"))
    assert {(r.path, bytes(r.raw)) for r in rows.collect()} == set(files.items())
    got = scanning.collected(rows, ["build/"], {".py": "python", ".pem": "key"}, 20)
    assert {(r.path, r.content) for r in got.collect()} == {("a/x.py", "print(1)\n"), ("d/u.py", "\u00e9")}
    assert [tuple(r) for r in scanning.within_limits(got, 1, 99).collect()] == [("s", 2, 14, "too many files")]


def granted_in_order(rows, allowance):
    left, out = {}, {}
    for org, i, micro in rows:
        have = left.setdefault(org, allowance)
        out[i] = micro <= have
        left[org] -= micro * out[i]
    return out


@pytest.mark.parametrize("sizes", ["mixed", "small", "large", "falling"])
def test_one_org_holds_all_requests(spark, sizes):
    rng = random.Random(len(sizes))
    pick = {"mixed": lambda i: rng.choice([0, 1, 7, 300, 4_000, 60_000]), "small": lambda i: rng.randrange(1, 9), "large": lambda i: rng.randrange(20_000, 60_000), "falling": lambda i: max(1, 50_000 >> (i // 97))}[sizes]
    rows = [("hot" if i % 50 else None if i % 3 else "b", i, pick(i)) for i in range(6000)]
    requests = spark.createDataFrame(rows, "org string, event_id long, micro long").withColumn("ts", F.timestamp_seconds(F.col("event_id"))).repartition(7)
    log = []
    got = admission.admitted(requests, 50_000, "org", ("ts", "event_id"), "micro", block=40, log=log)
    assert {r.event_id: r.granted for r in got.collect()} == granted_in_order(rows, 50_000)
    assert len(log) <= 18  # the logarithm of 50,000, and two


def test_reservations(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), i, rng.randrange(0, 500), rng.choice([None, f"k{rng.randrange(60)}"]), rng.random() < 0.1) for i in range(300)]
    frame = spark.createDataFrame(rows, "org string, event_id long, micro long, idempotency_key string, over boolean").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    for mode in ledger.MODES:
        left, seen, want = {}, {}, {}
        for org, i, micro, again, over in rows:
            key = (org, again if again is not None else i)
            if mode == "off":
                want[i] = ("off", 0)
            elif key in seen:
                want[i] = (seen[key], 0)
            else:
                have = left.setdefault(org, 5000)
                ok = micro <= have and not over
                left[org] -= micro * ok
                seen[key] = "reserved" if ok else "refused" if mode == "enforce" else "shadow_exceeded"
                want[i] = (seen[key], micro * ok)
        assert {r.event_id: (r.status, r.charged) for r in ledger.reservations(frame, 5000, mode, blocked="over").collect()} == want
    with pytest.raises(ValueError):
        ledger.reservations(frame, 1, "maybe")
    with pytest.raises(Exception, match="below 0"):
        ledger.reserve(frame.withColumn("micro", F.lit(-1)), 5).collect()


def test_nearest_holds_few_scores_at_a_time():
    """Two full blocks: the scores of all their pairs are never held at once, and the best are those of all scores."""
    import tracemalloc

    n, rng = retrieval.VECTOR_BLOCK, np.random.default_rng(4)
    ids, values, asked = rng.permutation(n) + 7, rng.normal(size=(n, 16)), rng.normal(size=(n, 16))
    tracemalloc.start()
    out = list(retrieval._best_of_blocks(ids, values.ravel(), np.arange(n), asked.ravel(), 3, -1.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6 < n * n * 8
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    score = np.round(unit(asked) @ unit(values).T, 9)
    found = [(q, i) for b in out for q, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert found == [(q, int(i)) for q in range(n) for i in ids[np.lexsort((ids, -score[q]))[:3]]]
