"""Shared words of rows and queries against plain counting, and retrieval quality on odd passages."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as rt
from corpusloom.plans.registry import collected

WORDS = [f"w{i}" for i in range(40)]
ROWS, ASKED = "item long, terms array<string>", "query_id long, terms array<string>, need int"


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_shared_words(spark, monkeypatch, most):
    monkeypatch.setattr(rt, "WORD_QUERIES", 7)
    monkeypatch.setattr(rt, "WORD_ROWS", 11)
    rng = random.Random(3)
    some = lambda n: rng.sample(WORDS, rng.randrange(n))
    docs = [(i % 290 if i % 50 else None, some(30)) for i in range(300)] + [(900, None)]
    asked = [(i % 19 if i else None, some(12), rng.choice([None, 1, 3, 5, 7])) for i in range(20)]
    want, needs = Counter(), {}
    for q, own, need in asked:
        if need is not None:
            needs[q] = min(need, needs.get(q, need))
        for i, terms in docs:
            want[q, i] += len(set(own) & set(terms or []))
    got = rt.by_words(spark.createDataFrame(docs, ROWS).repartition(3), spark.createDataFrame(asked, ASKED), 4, most).collect()
    found = {(r.query_id, r.item): (r.n, r.enough) for r in got}
    assert len(found) == len(got)
    assert all(want[k] == n > 0 and enough == (k[0] in needs and n >= needs[k[0]]) for k, (n, enough) in found.items())
    by = lambda pairs: sorted(pairs, key=lambda p: (-p[1], p[0][1] is None, p[0][1] or 0))
    for q in {q for q, _, _ in asked}:
        mine = [(k, n) for k, n in want.items() if k[0] == q and n]
        assert {k for k, _ in by(mine)[:4]} <= set(found)
        assert {k for k, n in mine if q in needs and n >= needs[q]} <= set(found)


def test_pairs_are_cut_where_they_are_counted(spark):
    docs = spark.range(6000).select(F.col("id").alias("item"), F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id") % 7)).alias("terms")).repartition(2)
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.lit("a"), F.lit("b3")).alias("terms"), F.lit(None).cast("int").alias("need"))
    assert rt.by_words(docs, asked, 8).count() <= 50 * 8 * 16  # of 300,000 pairs


def test_passages_that_begin_within_words(spark, tmp_path):
    texts = ["The concat doggy runs home", "cat dog", None, "", "x concat doggy", "no such thing", "ÄÖ --- ß", "cat dogs run"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    passages = ["cat dog", "oncat doggy run", "dog", "---", None, "absent words here", "run", "cat dogs run"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    queries, sql = collected()
    want = con.execute(sql["ev1_retrieval_quality"]).fetchall()
    got = queries["ev1_retrieval_quality"](spark, str(tmp_path)).select("queries", "recall", "mrr").collect()
    assert [tuple(r) for r in got] == want and want[0][0] == 6
