"""Briefs, stories, segments, bridges and grounded turns against plain versions."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import briefs, chunks, grounded, learning, relational, story


def test_change_briefs(spark):
    rng = random.Random(4)
    symbols = [(i, rng.choice("ab"), s, s + rng.choice([3, 9, 30])) for i in range(12) for s in [rng.randrange(1, 60)]]
    of = {i: (f, s, e) for i, f, s, e in symbols}
    relations = ["WRITES", "CALLS", "READS", "REQUESTS", "RAISES", "IMPORTS"]
    edges = []
    for n in range(90):
        source = rng.choice([None, *range(12)])
        first = rng.choice([None, rng.randrange(1, 70)])
        edges.append((f"e{n:02d}", rng.choice(relations), rng.choice([0.5, 0.79, 0.8, 1.0]), of[source][0] if source is not None else "a", source, rng.choice([None, *range(12)]), first, None if first is None else first + rng.randrange(3)))
    selections = [(i, rng.choice("abc"), s, s + rng.randrange(5)) for i in range(25) for s in [rng.randrange(1, 70)]]
    got = {
        r.brief: r
        for r in briefs.change_briefs(
            spark.createDataFrame(selections, "brief long, file_id string, start long, end long"),
            spark.createDataFrame(symbols, "symbol_id long, file_id string, start long, end long"),
            spark.createDataFrame(edges, "edge_id string, relation string, confidence double, source_file string, source_symbol long, target_symbol long, first long, last long"),
        ).collect()
    }
    assert len(got) == len(selections)
    for brief, file, start, end in selections:
        around = [(e - s, s, i) for i, f, s, e in symbols if f == file and s <= start and e >= end]
        mine = min(around)[2] if around else None
        out = [x for x in edges if x[3] == file and (x[6] is not None and x[6] <= end and x[7] >= start or mine is not None and x[4] == mine)]
        into = [x for x in edges if mine is not None and x[5] == mine]
        hit = sorted({x for x in out + into}, key=lambda x: (0 if x in out else 1, x[6] or 0, x[1], x[0]))
        sure = [x for x in hit if x[2] >= 0.8 and (x[1] in briefs.DIRECT or x in into)]
        rest = [x[0] for x in hit if x not in sure]
        places = [(file, start)]
        for x in hit:
            symbol = x[4] if x in into else x[5]
            place = of[symbol][:2] if symbol is not None else (x[3], 1) if x in into else None
            if place and place not in places:
                places.append(place)
        strong = {x[1] for x in hit if x[2] >= 0.8}
        risk = "high" if strong & set(briefs.HIGH) else "medium" if len({f for f, _ in places}) > 1 or strong & set(briefs.MIDDLE) else "low" if hit else "unknown"
        r = got[brief]
        assert (r.symbol_id, list(r.confirmed), list(r.possible), r.to_verify, r.risk) == (mine, [x[0] for x in sure][:8], rest[: 8 if sure else 7], not sure, risk)
        assert [(p.file_id, p.line) for p in r.places] == places[:8]


def test_change_briefs_pair_no_edges_with_selections(spark, monkeypatch):
    """Many selections of lines that many edges have: what is written stays in proportion, and edges into the own symbol leave the lists whole."""
    rows = []
    keep = briefs.written
    monkeypatch.setattr(briefs, "written", lambda df, name: rows.append((name, (out := keep(df, name)).count())) or out)
    symbols = [(0, "a", 1, 100), (1, "a", 200, 210), (2, "b", 1, 5), (3, "b", 7, 9)]
    # The first 300 possible ones by line come into the selection's symbol, so they are confirmed; others follow behind them.
    edges = [(f"e{n:03d}", "CALLS", 0.9, "a", 1, 0 if n < 300 else 2 + n % 2, 5 + n // 100, 12) for n in range(400)]
    selections = [(i, "a", 5 + i % 7, 12) for i in range(2000)]
    got = briefs.change_briefs(
        spark.createDataFrame(selections, "brief long, file_id string, start long, end long"),
        spark.createDataFrame(symbols, "symbol_id long, file_id string, start long, end long"),
        spark.createDataFrame(edges, "edge_id string, relation string, confidence double, source_file string, source_symbol long, target_symbol long, first long, last long"),
    ).collect()
    assert len(got) == 2000 and max(n for _, n in rows) <= 6 * len(edges), rows
    for r in got:
        assert (r.symbol_id, list(r.confirmed), list(r.possible), r.risk) == (0, [f"e{n:03d}" for n in range(8)], [f"e{n}" for n in range(300, 308)], "medium")
        start = 5 + r.brief % 7
        assert [(p.file_id, p.line) for p in r.places] == [("a", start), ("a", 200), ("b", 1), ("b", 7)]


def test_line_segments(spark):
    text = " one\n\n\t\r\ntwo \x0b three\rfour \x1c five  \n" + "x\n" * 100
    want = [(n, line.strip()) for n, line in enumerate(text.splitlines()) if line.strip()][:80]
    rows = spark.createDataFrame([(1, 10, text), (2, 1, ""), (3, 1, None), (4, 1, " \n ")], "chunk_id long, start int, text string")
    got = sorted((r.segment_id, r.line, r.source) for r in chunks.line_segments(rows).collect())
    assert got == [(f"seg_{i:03d}", 10 + n, s) for i, (n, s) in enumerate(want, 1)]


def test_concept_bridge(spark):
    wanted = spark.createDataFrame([(1, ["loop", "call", "loop", "state_x"]), (2, [])], "id long, concepts array<string>")
    copy = spark.createDataFrame([("loop", "Loops", "Repeats."), ("loop", "Loops", "Repeats."), ("call", "Calls", None)], "concept string, title string, definition string")
    code = spark.createDataFrame([("call", "f()")], "concept string, code string")
    got = [(r.place, r.concept, r.title, r.definition, r.code) for r in learning.concept_bridge(wanted, copy, code, "id", "concepts").orderBy("place").collect()]
    assert [g[:3] for g in got] == [(1, "loop", "Loops"), (2, "call", "Calls"), (3, "state_x", "state x")]
    assert got[0][3] == "Repeats." and "Calls" in got[1][3] and got[1][4] == "f()" and got[2][4].startswith("//")


def test_roles(spark):
    rows = [
        ("s", "web/Page.tsx", "Page", "file", "client", False, "experience"),
        ("s", "api/chat/x.py", "x", "file", "server", False, "learning"),
        ("s", "api/app/retrieval.py", "r", "file", "server", False, "understanding"),
        ("s", "jobs/run.py", "run", "worker", "server", False, "analysis"),
        ("s", "api/main.py", "app", "file", "server", False, "request_gateway"),
        ("s", "db/models/a.py", "a", "file", "domain", False, "persistence"),
        ("s", "x.py", "x", "file", "external", False, "external"),
        ("s", "y.py", "y", "file", "domain", True, "application"),
        ("lib", "src/Index.ts", "i", "file", "shared", False, "public_api"),
        ("lib", "src/a.ts", "a", "file", "domain", False, "core"),
        ("lib", "src/b.ts", "chat", "file", "domain", True, "public_api"),
        ("lib", "p.json", "p", "file", "configuration", False, "runtime"),
    ]
    nodes = story.with_roles(spark.createDataFrame([r[:6] for r in rows], "snapshot string, path string, label string, node_type string, layer string, in_flow boolean")).withColumn("confidence", F.lit("inferred"))
    assert {(r.snapshot, r.path): r.role for r in nodes.collect()} == {(r[0], r[1]): r[6] for r in rows}
    told = story.roles(nodes)
    assert [r.role for r in told.filter("snapshot = 'lib'").orderBy("place").collect()] == ["public_api", "runtime", "core"]
    none = spark.createDataFrame([], "snapshot string, summary string, rank int, outcome string")
    got = {r.snapshot: (r.audience, r.one_liner, r.steps[0]) for r in story.purpose(told, nodes, none.select("snapshot", "summary"), none.select("snapshot", "rank", "outcome")).collect()}
    assert got == {"s": ("people", "s", "1. experience"), "lib": ("developers", "lib", "1. public_api")}


def test_grounded_turns(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]
    asked = [(1, "o", 1, "a", "f1", v[0], "m"), (2, "o", 2, "b", "none", v[2], "m"), (3, "o", 3, "c", "f2", v[1], "x"), (4, "o", 4, "d", "none", None, "m"), (5, "o", 5, "e", "none", None, "m"), (6, "p", 6, "f", "none", None, "m")]
    requests = spark.createDataFrame(asked, "id long, org string, s long, idempotency_key string, fingerprint string, vector array<double>, manifest string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    entries = spark.createDataFrame([(100, "f1", v[0], "m", "one"), (101, "f2", v[1], "m", "two")], "id long, fingerprint string, vector array<double>, manifest string, answer string")
    files = spark.createDataFrame([(7, "h", "a\nb\nc")], "file_id long, content_hash string, content string")
    hits = [(q, 70 + k, 7, 1 + k, 1 + k, "abc"[k], "h" if q != 6 else "old", k + 1) for q in (1, 2, 3, 4, 5, 6) for k in (0, 1)]
    retrieve = lambda ids: spark.createDataFrame(hits, "query_id long, chunk_id long, file_id long, start int, end int, text string, file_hash string, rank int").join(ids, "query_id", "left_semi")
    prices = spark.createDataFrame([("answer", "2020", 5), ("answer", "2024", 7)], "usage_type string, since string, micro_per_unit long")
    got = {r.id: (r.how, r.answer, r.status, r.cost) for r in grounded.grounded_turns(requests, entries, retrieve, files, prices, allowance=20, estimate=10, least=0.7).collect()}
    assert got == {
        1: ("exact", "one", "free", 0),
        2: ("semantic", "two", "free", 0),
        3: ("quarantined", "ev_70,ev_71", "settled", 14),
        4: ("miss", "ev_70,ev_71", "settled", 14),
        5: ("miss", None, "refused", 0),
        6: ("miss", None, "insufficient", 0),
    }


def test_manifest_hash(spark):
    import hashlib
    import json

    files = [("b/é.py", "h1", "py", 3, "s"), ("a.py", None, None, 1, "s"), ("z", "h", "x", 0, None)]
    got = {r.k: r.manifest for r in relational.manifest_hash(spark.createDataFrame(files, "path string, content_hash string, language string, byte_size int, k string").repartition(3), "k").collect()}
    for key in ("s", None):
        rows = [{"path": p, "content_hash": h, "language": g, "byte_size": n} for p, h, g, n, k in sorted(files, key=lambda f: f[0]) if k == key]
        assert got[key] == "sha256:" + hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_turns_keep_texts_of_hits_only(spark, sf_dir, monkeypatch):
    """Of the tables a grounded turn writes on its way only the evidence has texts."""
    from corpusloom.plans import search

    tables = {}
    monkeypatch.setattr(search, "written", lambda df, name, write=search.written: tables.setdefault(name, write(df, name)))
    answered = search.query.queries["cp9_grounded_turn"](spark, sf_dir).filter("status = 'settled'").count()
    assert [name for name, df in tables.items() if "text" in df.columns] == ["evidence"]
    assert 0 < answered <= tables["evidence"].select("query_id").distinct().count() and tables["evidence"].count() == tables["hits"].count() < tables["chunks"].count()
