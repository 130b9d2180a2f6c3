"""The stages of the pipeline over the smallest documents: each keeps the columns and takes effect."""

import corpus_pipeline
from corpusloom.llm import queries


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    first, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == first.columns
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    assert set(kept[2]) <= set(kept[1]) <= set(kept[0]) and len(kept[1]) == len(set(kept[1]))
    assert set(kept[3]) == set(kept[2])
    out = corpus_pipeline.token_output(spark, docs, sf_dir).orderBy("start").collect()
    assert sorted(r.doc_id for r in out) == sorted(kept[3])
    assert [r.start for r in out][1:] == [r.start + r.n_tokens for r in out][:-1]


KINDS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `result` string, `key` string, position long, text_2 string, cid string, `pass` int"
LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(300_000))  # more than a piece of work


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, ids and texts, and columns named like those of the stages."""
    fair = " ".join(f"word{i} and" for i in range(80))
    rows = [(1, fair, "a"), (1, fair, "a"), (None, fair + " more", None), (None, None, None), (2, "", "a"), (3, LONG, "b"), (4, LONG + " x", "b"), (5, "short", "a"), (5, "other", None), (6, fair.upper() * 3, "c")]
    return spark.createDataFrame([(i, t, "en", s, None, "r", "s", "k", 9, "t", "c", 3) for i, t, s in rows], KINDS)


def test_stages_take_odd_documents(spark, sf_dir):
    docs = odd_documents(spark)
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert out.columns == columns and (name == "mix_sources" or out.count() <= n), name
        empty = corpus_pipeline.written(stage(spark, docs.limit(0), sf_dir), name)
        assert empty.columns == columns and empty.count() == 0, name
    assert corpus_pipeline.decontamination(spark, docs, sf_dir).count() == n
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    assert sum(t is not None and t.startswith(LONG) for _, t in kept) == 1 and (None, None) in kept and (2, "") in kept
    mixed = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()]
    assert {x[:2] for x in mixed} == {(r.doc_id, r.text) for r in docs.collect()}
    out = corpus_pipeline.token_output(spark, docs, sf_dir).orderBy("start").collect()
    assert len(out) == n and [r.start for r in out][1:] == [r.start + r.n_tokens for r in out][:-1]
    assert max(r.n_tokens for r in out) > 300_000
    assert corpus_pipeline.token_output(spark, docs.limit(0), sf_dir).count() == 0


def test_tables_on_the_way_are_deleted(spark, sf_dir):
    import os

    docs = queries.table(spark, sf_dir, "documents")
    first = corpus_pipeline.written(corpus_pipeline.quality_rules(spark, docs, sf_dir), "first")
    second = corpus_pipeline.near_dedup(spark, first, sf_dir)  # not written yet
    made = [f.removeprefix("file://") for f in corpus_pipeline._before]
    assert made and all(map(os.path.exists, made))
    third = corpus_pipeline.decontamination(spark, second, sf_dir)
    assert any(map(os.path.exists, made))  # what is still read stays
    assert third.count() <= first.count()
    corpus_pipeline.mix_sources(spark, corpus_pipeline.written(third, "third"), sf_dir)
    assert corpus_pipeline._before


def test_run(spark, sf_dir):
    """The registered query has the rows that its stages have one after the other, and keeps no stage's input."""
    import os

    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
    want = sorted(tuple(r) for r in corpus_pipeline.token_output(spark, docs, sf_dir).collect())
    before = set(os.listdir(corpus_pipeline.shared_dir(spark).removeprefix("file://")))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
    left = [f for f in set(os.listdir(corpus_pipeline.shared_dir(spark).removeprefix("file://"))) - before if f.startswith(("quality_rules", "near_dedup", "decontamination"))]
    assert not left
