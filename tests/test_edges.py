"""Resolution of parsed edges: one row for each edge, whatever repeats on the other side."""

import pytest

from corpusloom.operators import edges


def frame(spark, kinds, *rows):
    return spark.createDataFrame(list(rows), kinds)


def test_calls_stay_one_row(spark):
    calls = frame(spark, "snapshot string, path string, target string, n int", ("s", "a.ts", "run", 1), ("s", "a.ts", "lib.go", 2), ("s", "a.ts", "use", 3), ("s", "a.ts", "gone", 4))
    symbols = frame(spark, "snapshot string, path string, name string, symbol_id long", ("s", "a.ts", "run", 1), ("s", "a.ts", "run", 2), ("s", "b.ts", "go", 3), ("s", "b.ts", "go", 4), ("s", "c.ts", "used", 9), ("t", "a.ts", "gone", 8))
    bindings = frame(spark, "snapshot string, path string, local string, target_path string, imported string", ("s", "a.ts", "lib", "b.ts", "default"), ("s", "a.ts", "use", "b.ts", "none"), ("s", "a.ts", "use", "c.ts", "used"))
    got = sorted((r.n, r.symbol_id, r.resolution) for r in edges.resolved_calls(calls, symbols, bindings).collect())
    assert got == [(1, 2, "resolved_symbol"), (2, 4, "resolved_symbol"), (3, 9, "resolved_symbol"), (4, None, "syntactic_target_only")]


def test_imports(spark):
    files = frame(spark, "snapshot string, path string", *[("s", p) for p in ("web/src/lib/a.ts", "web/src/lib/b/index.tsx", "x/src/two.js", "y/src/two.ts", "src/top.ts", "web/src/app/page.tsx", "web/src/lib/a.js")])
    cases = {
        "./lib/../../lib/a": "web/src/lib/a.ts",  # .ts is tried before .js
        "../lib/b": "web/src/lib/b/index.tsx",
        "../lib/a.js": "web/src/lib/a.js",
        "./none": "./none",
        "../../../../src/top": "src/top.ts",
        "@/lib/b": "web/src/lib/b/index.tsx",
        "@/lib/a": "@/lib/a",  # two files fit
        "@/two": "@/two",
        "@/top": "@/top",  # not below another folder
        "react": "react",
    }
    imports = frame(spark, "snapshot string, path string, target string", *[("s", "web/src/app/page.tsx", t) for t in cases], ("t", "web/src/app/page.tsx", "../lib/b"))
    got = {(r.snapshot, r.target): r.resolved for r in edges.resolved_imports(imports, files).collect()}
    assert got == {("s", k): v for k, v in cases.items()} | {("t", "../lib/b"): "../lib/b"}


def test_triggers_look_outwards(spark):
    rows = [(1, "f::A.b.c", "go"), (2, "f::A.b", "up"), (3, "f::A.b.c", "up"), (4, "other::A.b", "go"), (5, None, "top"), (6, "f::A", "none")]
    asked = frame(spark, "snapshot string, path string, edge_id long, source string, target string", *[("s", "f", *r) for r in rows])
    names = ["f::A.b.go", "f::go", "f::A.up", "f::A.b.c.up", "f::top"]
    symbols = frame(spark, "snapshot string, qualified string, symbol_id long", *[("s", n, i) for i, n in enumerate(names)], ("t", "f::none", 9))
    got = {r.edge_id: (r.symbol_id, r.resolution) for r in edges.resolved_triggers(asked, symbols).collect()}
    assert got == {1: (0, "local_symbol"), 2: (2, "local_symbol"), 3: (3, "local_symbol"), 4: (1, "local_symbol"), 5: (4, "local_symbol"), 6: (None, "unresolved_identifier")}


def test_requests_prefer_their_package(spark):
    routes = frame(
        spark,
        "snapshot string, package_root string, request_path string, method string, symbol_id long, route_file string",
        ("s", "apps/web", "/api/x", "GET", 1, "web"),
        ("s", "*", "/api/x", "GET", 2, "any"),
        ("s", "*", "/api/{id}", "POST", 3, "post"),
        ("s", "*", "/api/two", "GET", 4, "a"),
        ("s", "*", "/api/two", "GET", 5, "b"),
        ("s", "", "/api/r", "GET", 6, "root"),
    )
    roots = frame(spark, "snapshot string, root string", ("s", "apps"), ("s", "apps/web"), ("s", ""))
    asked = frame(
        spark,
        "snapshot string, path string, edge_id long, request_path string, method string",
        ("s", "apps/web/a.ts", 1, "/api/x/", None),
        ("s", "apps/other.ts", 2, "/api/x", "get"),
        ("s", "apps/web/a.ts", 3, "/api/[slug]", "post"),
        ("s", "a.ts", 4, "/api/two", "GET"),
        ("s", "a.ts", 5, "/api/r", "GET"),
        ("s", "apps/web/a.ts", 6, "/api/r", "GET"),
        ("s", "a.ts", 7, None, "GET"),
        ("t", "a.ts", 8, "/api/x", "GET"),
    )
    got = {r.edge_id: (r.symbol_id, r.resolution) for r in edges.resolved_requests(asked, routes, roots).collect()}
    assert got == {
        1: (1, "exact_package_route"),
        2: (2, "exact_route"),
        3: (3, "exact_route"),
        4: (None, "literal_only"),
        5: (6, "exact_package_route"),
        6: (None, "literal_only"),
        7: (None, "literal_only"),
        8: (None, "literal_only"),
    }


def test_models_need_one_symbol(spark):
    rows = frame(spark, "snapshot string, edge_id long, model string", ("s", 1, "User"), ("s", 2, "Twice"), ("s", 3, None), ("t", 4, "User"))
    symbols = frame(spark, "snapshot string, name string, symbol_id long", ("s", "User", 5), ("s", "Twice", 6), ("s", "Twice", 7))
    assert {r.edge_id: r.symbol_id for r in edges.resolved_models(rows, symbols).collect()} == {1: 5, 2: None, 3: None, 4: None}


@pytest.mark.parametrize("name", ["gr11_suppress_weaker", "gr13_import_view"])
def test_tasks_of_edges_do_not_grow(spark, sf_dir, monkeypatch, name):
    """With more rows than a task groups there are more tasks, whatever number of partitions the session has."""
    from corpusloom import session
    from corpusloom.plans import snapshots
    from corpusloom.sources.tables import Tables
    from tests.oracle import duck, rows

    monkeypatch.setattr(session, "TASK_ROWS", 250, raising=False)
    t = Tables(spark, sf_dir)
    least = t.lineitem.count() // 250
    made = t.edges() if name == "gr11_suppress_weaker" else snapshots.query.queries[name](spark, sf_dir)
    assert made.rdd.getNumPartitions() >= least > 8
    assert rows(snapshots.query.queries[name](spark, sf_dir)) == duck(sf_dir, snapshots.query.sql[name])
