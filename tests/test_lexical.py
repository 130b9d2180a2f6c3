"""The lexical index against plain counting: built, updated by changed files, and with blocks skipped."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexical
from corpusloom.session import shared_dir

WORDS = [f"w{i}" for i in range(30)]


def made(rng, ids, chunks):
    """Files of chunks of random words; the words of a file come from its own part of the list."""
    return {i: [[WORDS[int(rng.triangular(0, 29, (i * 7) % 30))] for _ in range(rng.randrange(0, 40))] for _ in range(chunks(i))] for i in ids}


def frames(spark, corpus):
    files = spark.createDataFrame([(i, f"sha256:{hash(str(c)) & 0xFFFFFFFF:x}", c) for i, c in corpus.items()], "file_id long, content_hash string, chunks array<array<string>>")
    cut = lambda f: f.select("file_id", F.posexplode("chunks").alias("p", "terms")).select("file_id", (F.col("file_id") * 100_000 + F.col("p")).alias("chunk_id"), (F.col("p") + 1).alias("ordinal"), "terms")
    return files.repartition(3), cut


QUERIES = [(1, "w1"), (1, "w2"), (2, "w29"), (3, "none"), (4, "w0"), (4, "w15"), (4, "w28"), (5, "w7")]


def plain(corpus, limit):
    out = {}
    for q in {q for q, _ in QUERIES}:
        mine = Counter(t for x, t in QUERIES if x == q)
        scored = sorted((-sum(mine[t] for t in terms), i * 100_000 + p) for i, c in corpus.items() for p, terms in enumerate(c))
        out[q] = [(c, -n) for n, c in scored[:limit] if n]
    return {q: v for q, v in out.items() if v}


def found(spark, index, limit, **more):
    out = {}
    for r in index.search(spark.createDataFrame(QUERIES, "query_id long, term string"), limit, **more).orderBy("rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.n))
    return out


def test_index(spark):
    rng = random.Random(1)
    path = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    corpus = made(rng, range(40), lambda i: 700 if i == 3 else i % 9)
    index = lexical.Lexical.at(path, *frames(spark, corpus))
    for limit in (1, 5, 24):
        assert found(spark, index, limit) == plain(corpus, limit)
        assert found(spark, index, limit, broadcast_terms=0) == plain(corpus, limit)
    version = index.table.latest()
    assert lexical.Lexical.at(path, *frames(spark, corpus)).table.latest() == version  # nothing has changed
    del corpus[5], corpus[30]
    corpus |= made(rng, [7, 100, 101], lambda i: 4)
    corpus[3] = corpus[3][:300]
    index = lexical.Lexical.at(path, *frames(spark, corpus))
    assert index.table.latest() == version + 1
    assert found(spark, index, 24) == plain(corpus, 24)
    assert index.blocks() == lexical.Lexical(spark, path).blocks()
    fresh = lexical.Lexical.at(f"{path}-fresh", *frames(spark, corpus))
    postings = lambda x: sorted((r.term, f.chunk_id, f.n) for r in x.rows.filter("term not like ':%'").collect() for f in r.found if f.chunk_id is not None)
    assert postings(index) == postings(fresh)


def test_blocks_that_cannot_reach_are_skipped(spark):
    rng = random.Random(2)
    corpus = {i: [[f"w{rng.randrange(30)}" for _ in range(5)] + ["w1"] * (30 if i < 3 else 0) for _ in range(100)] for i in range(60)}
    index = lexical.Lexical.at(f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}", *frames(spark, corpus))
    log = {}
    terms = spark.createDataFrame([(1, "w1")], "query_id long, term string")
    assert index.search(terms, 24, log=log).count() == 24
    assert log["blocks"] > 20 and log["scored"] <= lexical.FIRST


def test_most_files_changed(spark):
    rng = random.Random(4)
    path = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    small = lexical.Lexical.at(path, *frames(spark, made(rng, range(3), lambda i: 2)))
    corpus = made(rng, range(50), lambda i: 300)
    index = lexical.Lexical.at(path, *frames(spark, corpus))
    assert index.blocks() > small.blocks() and found(spark, index, 9) == plain(corpus, 9)


def test_empty(spark):
    index = lexical.Lexical.at(f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}", *frames(spark, {}))
    assert found(spark, index, 3) == {}
    corpus = {1: [["w1"]], 2: []}
    index = lexical.Lexical.at(index.table.path, *frames(spark, corpus))
    assert found(spark, index, 3) == plain(corpus, 3)


@pytest.mark.parametrize("least", [0, 1])
def test_block_of_a_file(spark, least):
    got = spark.range(2000).select(lexical._block(F.lit(5), F.col("id") + least, 1000).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in got) <= lexical.BLOCK and len(got) > 10


def test_chunks_cross_without_their_overlap(spark):
    """Chunks are cut once, and what is written of them and dealt out grows far less than their overlap."""
    rng = random.Random(7)
    text = {i: [f"{rng.randrange(1 << 30):x}é\n" for _ in range(200)] for i in range(20)}
    kept = {}
    for times in (1, 30):
        corpus = {i: [words] * times for i, words in text.items()} | {99: [[]] * 150 + [["x"]]}
        files, cut = frames(spark, corpus)
        calls = spark.sparkContext.accumulator(0)
        seen = F.udf(lambda terms: calls.add(1) or terms, "array<string>")
        index = lexical.Lexical.at(f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}", files, lambda f: cut(f).withColumn("terms", seen("terms")))  # noqa: B023
        assert calls.value == 20 * times + 151
        kept[times] = index._cut(cut(files)).agg(F.sum(F.length("data"))).first()[0]
        asked = spark.createDataFrame([(1, text[3][5]), (2, text[4][0]), (3, "x")], "query_id long, term string")
        hits = {(r.query_id, r.chunk_id, r.n) for r in index.search(asked, 1000).collect()}
        assert hits == {(q, f * 100_000 + p, 1) for q, f in ((1, 3), (2, 4)) for p in range(times)} | {(3, 99 * 100_000 + 150, 1)}
    assert kept[30] < 4 * kept[1]
