"""Hybrid retrieval: exact, lexical, vector and selection candidates, rank fusion, reranking, verification."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, tokens
from .lexical import BROADCAST_TERMS, Lexical
from .vector_index import VectorIndex, _packed, _units

#: Weights and the constant of reciprocal-rank fusion, candidates of each retriever, final hits.
WEIGHTS = {"exact": 1.5, "lexical": 1.0, "vector": 1.0, "selection": 1.25}
RRF_K, CANDIDATES, HITS, MAX_TERMS = 60, 24, 8, 10
#: Rows of a block that is multiplied with another, and queries of a product.
VECTOR_BLOCK, QUERY_ROWS = 2048, 128


def query_terms(queries: DataFrame, text: Column, limit: int = MAX_TERMS) -> DataFrame:
    """``query_id, term``: the first distinct words of two letters or more of each query."""
    words = F.slice(F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) >= 2)), 1, limit)
    return queries.select("query_id", F.explode(words).alias("term"))


def query_hints(queries: DataFrame, text: Column, hints: Mapping[str, str]) -> DataFrame:
    """``query_id`` and a boolean for each hint: whether its pattern is in the query."""
    return queries.select("query_id", *[F.lower(text).rlike(pattern).alias(name) for name, pattern in hints.items()])


def ranked(scored: DataFrame, limit: int = CANDIDATES, order: Sequence[Column] | None = None) -> DataFrame:
    """Rank within each query by score and chunk id, or another order, cut to the retriever's candidates."""
    w = Window.partitionBy("query_id").orderBy(*(order or [F.desc("score"), F.asc("chunk_id")]))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def containing(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``word, term`` of each distinct word that a term of two letters or more is in: an equi join on the term's first letters."""
    grams = lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    each = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(grams(2), grams(3)))).alias("gram"))
    asked = terms.select("term").distinct().withColumn("gram", F.substring("term", 1, 3))
    return each.join(asked, "gram").filter(F.contains("word", "term")).select("word", "term")


def exact(chunks: DataFrame, terms: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Best band over a query's terms: the symbol 1.0, in it 0.9; the path's end 0.85, in it 0.7; in the title 0.65.

    Terms are ASCII words, so where one is in a text it is in a word of it. Words are matched with
    terms once each, however many chunks have them. Of the chunks that have a word in one place only
    the most specific ``limit`` can be among a query's candidates by it, as all of them have the same
    score for it; so a word that is everywhere costs no more than any other.
    """
    place = lambda column, kind: F.transform(F.array_distinct(tokens(F.col(column))), lambda w: F.struct(w.alias("word"), F.lit(kind).alias("kind")))
    last = F.regexp_extract(F.lower("path"), "[a-z0-9]+$", 0)
    ends = F.when(last != "", F.array(F.struct(last.alias("word"), F.lit("end").alias("kind")))).otherwise(F.array().cast("array<struct<word:string,kind:string>>"))
    kind = F.when(F.lower("symbol").rlike("^[a-z0-9]+$"), "name").otherwise("symbol")
    of_symbol = F.coalesce(F.transform(F.array_distinct(tokens(F.col("symbol"))), lambda w: F.struct(w.alias("word"), kind.alias("kind"))), F.array().cast("array<struct<word:string,kind:string>>"))
    words = chunks.select("chunk_id", "specificity", F.explode(F.concat(of_symbol, place("path", "path"), ends, place("title", "title"))).alias("w")).select("chunk_id", "specificity", "w.*")
    first = Window.partitionBy("kind", "word").orderBy(F.desc("specificity"), "chunk_id")
    postings = words.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit).drop("_n")
    pairs = containing(postings, terms)
    whole, at_end = F.col("word") == F.col("term"), F.endswith("word", "term")
    score = F.when((F.col("kind") == "name") & whole, 1.0).when(F.col("kind").isin("name", "symbol"), 0.9).when(F.col("kind") == "end", F.when(at_end, 0.85).otherwise(0.7)).when(F.col("kind") == "path", 0.7).otherwise(0.65)
    found = postings.join(pairs, "word").join(terms, "term").groupBy("query_id", "chunk_id").agg(F.max(score).alias("score"), F.max("specificity").alias("specificity"))
    return ranked(found, limit, [F.desc("score"), F.desc("specificity"), F.asc("chunk_id")]).drop("specificity")


def lexical(index: Lexical, terms: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """A tenth for each occurrence of a query's term in a chunk, by the index of the chunks."""
    return index.search(terms, limit).select("query_id", "chunk_id", F.round(F.col("n") / 10, 6).alias("score"), "rank")


#: Queries whose words are one matrix, and rows that are multiplied with it at a time.
WORD_QUERIES, WORD_ROWS = 256, 256


def by_words(rows: DataFrame, queries: DataFrame, limit: int, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """``query_id, item, n, enough`` of pairs that share ``n`` words: all with ``enough``, and of the others at least each query's best ``limit``, ties by item.

    ``rows`` has item and terms, ``queries`` query_id, terms and need, each term once in its row; ``enough`` is
    ``n`` of at least need, and never if that is null. Rows of one id add up, and the least need counts. A row
    keeps its words that queries have as numbers, and no pairs are grouped: tasks multiply rows with queries and
    pass on the best of a batch. With more than ``broadcast_terms`` words of queries pairs are counted in a shuffle.
    """
    asked = queries.filter(F.size("terms") > 0).groupBy("query_id").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.min("need").alias("need"))
    if (asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0) > broadcast_terms:
        each = lambda df, key: df.select(key, F.explode("terms").alias("term"))
        n = each(rows, "item").join(each(queries, "query_id"), "term").groupBy("query_id", "item").agg(F.count("*").alias("n"))
        needed = asked.select(F.col("query_id").alias("_q"), "need")
        return n.join(needed, F.col("query_id").eqNullSafe(F.col("_q"))).select("query_id", "item", "n", F.coalesce(F.col("n") >= F.col("need"), F.lit(False)).alias("enough"))
    table = asked.toArrow().combine_chunks()
    lists = table.column("terms").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    need = np.array([1 << 62 if x is None else x for x in table.column("need").to_pylist()], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((table.column("query_id").combine_chunks() if table.num_rows else pa.array([], pa.int64()), coded.dictionary, coded.indices.to_numpy(), ends, need))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value[1]
        for batch in batches:
            lists = batch.column(1)
            number = pc.index_in(lists.flatten(), value_set=words)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            has = number.is_valid().to_numpy(zero_copy_only=False)
            size = np.bincount(row[has], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), number.drop_null())], ["item", "words"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, of_query, ends, need = shared.value
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))  # nulls last
            lists = batch.column(1)
            word, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            for q in range(0, len(need), WORD_QUERIES):
                least = need[q : q + WORD_QUERIES]
                own, at = np.unique(of_query[ends[q] : ends[q + len(least)]], return_inverse=True)
                has = np.zeros((len(own), len(least)))
                np.add.at(has, (at, np.repeat(np.arange(len(least)), np.diff(ends[q : q + len(least) + 1]))), 1)
                place = np.full(len(words), -1)
                place[own] = np.arange(len(own))
                here = place[word]
                inside, n = here >= 0, np.zeros((batch.num_rows, len(least)), np.int64)
                key, first = row[inside] * len(own) + here[inside], np.arange(0, batch.num_rows, WORD_ROWS)
                cuts = np.searchsorted(row[inside], np.r_[first, batch.num_rows])
                for a, x, y in zip(first, cuts, cuts[1:], strict=False):
                    size = min(WORD_ROWS, batch.num_rows - a)
                    n[a : a + size] = np.bincount(key[x:y] - a * len(own), minlength=size * len(own)).reshape(size, len(own)) @ has
                keep = n >= least
                np.put_along_axis(keep, np.argsort(-n, axis=0, kind="stable")[:limit], True, axis=0)
                item, query = np.nonzero(keep & (n > 0))
                found = n[item, query]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query + q)), batch.column(0).take(pa.array(item)), pa.array(found), pa.array(found >= least[query])], ["query_id", "item", "n", "enough"])

    kind = lambda df, name: df.schema[name].dataType.simpleString()
    numbers = rows.select("item", "terms").mapInArrow(known, f"item {kind(rows, 'item')}, words array<int>")
    of_item = numbers.filter(F.size("words") > 0).groupBy("item").agg(F.flatten(F.collect_list("words")).alias("words"))
    return of_item.mapInArrow(best, f"query_id {kind(queries, 'query_id')}, item {kind(rows, 'item')}, n bigint, enough boolean")


def selected(chunks: DataFrame, selections: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Chunks that overlap a query's selection (query_id, file_id, first, last), by place; a null range is the whole file. Score 1 / rank."""
    hit = chunks.join(selections, "file_id").filter(F.coalesce((F.col("start") <= F.col("last")) & (F.col("end") >= F.col("first")), F.lit(True)))
    rows = ranked(hit.select("query_id", "chunk_id", "start", "end"), limit, [F.asc("start"), F.asc("end"), F.asc("chunk_id")])
    return rows.select("query_id", "chunk_id", F.round(1 / F.col("rank"), 6).alias("score"), "rank")


def by_vector(vectors: DataFrame, query_vectors: DataFrame | None, limit: int = CANDIDATES) -> tuple[DataFrame | None, str]:
    """Vector candidates and a status: without query vectors (no model to embed them) there are none, and retrieval goes on.

    ``vectors`` has id and vector of chunks, ``query_vectors`` of queries; null vectors are left out.
    """
    if query_vectors is None:
        return None, "unavailable"
    return nearest(vectors, query_vectors, limit).select("query_id", F.col("id").alias("chunk_id"), "score", "rank"), "ready"


def fuse(retrievers: Mapping[str, DataFrame | None]) -> DataFrame:
    """``query_id, chunk_id, score, first_retriever, first_rank`` by weighted reciprocal ranks; a retriever that is None has no candidates."""
    out = None
    for place, (name, candidates) in enumerate(retrievers.items()):
        if candidates is None:
            continue
        part = candidates.select("query_id", "chunk_id", "rank", F.lit(place).alias("place"), (F.lit(WEIGHTS[name]) / (F.lit(RRF_K) + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no retriever has candidates")
    first = F.min(F.struct("place", "rank"))
    return out.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 10).alias("score"), first.alias("_f")).select("query_id", "chunk_id", "score", F.col("_f.place").alias("first_retriever"), F.col("_f.rank").alias("first_rank"))


def rerank(fused: DataFrame, chunks: DataFrame, hints: DataFrame, noise: str, entry: str, hits: int = HITS) -> DataFrame:
    """Structural adjustment by path and the query's hints, then the final order and cut: score, specificity, first retriever, first rank, id.

    ``hints`` has test and entry_point of each query. A path that ``noise`` matches loses 0.015 unless the query
    hints at tests; if it hints at an entry point, a path that ``entry`` matches gains 0.018 and noise loses another 0.012.
    """
    is_noise, is_entry = F.col("path").rlike(noise), F.col("path").rlike(entry)
    adjust = F.when(is_noise & ~F.col("test"), -0.015).otherwise(0.0) + F.when(F.col("entry_point") & is_entry, 0.018).otherwise(0.0) + F.when(F.col("entry_point") & is_noise, -0.012).otherwise(0.0)
    scored = fused.join(hints, "query_id").join(chunks.select("chunk_id", "path", "specificity"), "chunk_id").withColumn("score", F.round(F.col("score") + adjust, 10))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("specificity"), "first_retriever", "first_rank", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= hits).select("query_id", "chunk_id", "score", "rank")


def trace(fused: DataFrame, final: DataFrame) -> DataFrame:
    """All candidates with whether, and where, they were selected."""
    chosen = final.select("query_id", "chunk_id", F.col("rank").alias("final_rank"))
    return fused.join(chosen, ["query_id", "chunk_id"], "left").withColumn("selected", F.col("final_rank").isNotNull())


def verified(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence rows (file_id, start, end, text, file_hash) whose hash, range and text agree with the file."""
    f = files.select("file_id", F.col("content_hash").alias("_hash"), lines(F.col("content")).alias("_lines"))
    same = F.array_join(F.slice("_lines", F.col("start"), F.col("end") - F.col("start") + 1), "\n") == F.col("text")
    ok = (F.col("_hash") == F.col("file_hash")) & (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.greatest(F.lit(1), F.size("_lines")))
    return evidence.join(f, "file_id").filter(ok).filter(same).drop("_hash", "_lines")


def spread_answers(hits: DataFrame, distinct: Sequence[str], first: int = 3) -> DataFrame:
    """Hits in answer order: the best of each of the first few distinct keys, then all others by rank."""
    own = Window.partitionBy("query_id", *distinct).orderBy("rank")
    lead = hits.withColumn("_n", F.row_number().over(own)).withColumn("_d", F.row_number().over(Window.partitionBy("query_id", F.col("_n") == 1).orderBy("rank")))
    early = F.when((F.col("_n") == 1) & (F.col("_d") <= first), 0).otherwise(1)
    return lead.withColumn("answer_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(early, "rank"))).drop("_n", "_d")


def _best_of_blocks(ids: np.ndarray, values: np.ndarray, queries: np.ndarray, asked: np.ndarray, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """``query_id, id, score`` of the best ``k`` rows of a block for each of a block of queries; scores of ``QUERY_ROWS`` queries are held at a time."""
    order = np.argsort(ids, kind="stable")
    ids, rows, asked = ids[order], _units(values, len(ids))[order].T, _units(asked, len(queries))
    for a in range(0, len(queries), QUERY_ROWS):
        score = np.round(asked[a : a + QUERY_ROWS] @ rows, 9)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(score, top, 1)
        keep = best >= least
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[a : a + QUERY_ROWS], top.shape[1])[keep.ravel()]), pa.array(ids[top][keep]), pa.array(best[keep])], ["query_id", "id", "score"])


def _best_of_pairs(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """``query_id, id, score, rank`` of pairs of blocks (r_ids, r_values, q_ids, q_values): matrix products, which leave ``k`` rows of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _best_of_blocks(*(np.asarray(batch.column(c)[row].values) for c in range(4)), k, least)

    part = pairs.select("r_ids", "r_values", "q_ids", "q_values").mapInArrow(run, "query_id bigint, id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int, least: float = -1.0, block: int = VECTOR_BLOCK) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` rows of highest cosine for each query, ties by id, exactly.

    Both sides have id and vector. Every block of queries meets every block of rows, so the work is
    rows times queries; ``VectorIndex`` is the way for more. Zero vectors have score 0; null vectors are left out.
    """
    sides = [_packed(df.filter("vector is not null"), prefix, block) for df, prefix in ((rows, "r"), (queries, "q"))]
    return _best_of_pairs(sides[0].join(sides[1]), k, least)


def cache_lookup(requests: DataFrame, entries: DataFrame, least: float, index: VectorIndex | None = None) -> DataFrame:
    """``id, entry, how``: the entry with the request's fingerprint, else the nearest one of ``least`` similarity, else none.

    The nearest is found exactly, or by an index of the entries' vectors where there are many.

    Both sides have id, fingerprint, vector and manifest. An entry that was made of other files than
    the request's is not used, whichever way it was found: its row has no entry and is quarantined.
    """
    same = requests.join(entries.groupBy("fingerprint").agg(F.min("id").alias("entry")), "fingerprint", "left")
    missed = same.filter("entry is null").select("id", "vector")
    hits = index.nearest(missed, 1, least) if index else nearest(entries.select("id", "vector"), missed, 1, least)
    near = hits.select(F.col("query_id").alias("id"), F.col("id").alias("near"))
    found = same.select("id", "manifest", "entry").join(near, "id", "left").withColumn("hit", F.coalesce("entry", "near"))
    made_of = entries.select(F.col("id").alias("hit"), F.col("manifest").alias("made_of"))
    joined = found.join(made_of, "hit", "left")
    other = F.col("hit").isNotNull() & ~F.col("manifest").eqNullSafe(F.col("made_of"))
    how = F.when(other, "quarantined").when(F.col("entry").isNotNull(), "exact").when(F.col("near").isNotNull(), "semantic").otherwise("miss")
    return joined.select("id", F.when(~other, F.col("hit")).alias("entry"), how.alias("how"))


#: Fixed value: numbers of a local hash embedding.
DIMENSIONS = 768


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector for each text without a model: words and, of words of four letters or more, trigrams of ``^word$``.

    Each feature has a place and a sign by BLAKE2b and counts 1 + ln(times); the vector has length 1, or
    is all zero for a null text or one without words. Words are ASCII letters and digits and Hangul,
    parted at camel-case boundaries.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<double>")
    def embed(texts):  # noqa: ANN001, ANN202
        import hashlib
        import re
        from collections import Counter

        import pandas as pd

        word, boundary = re.compile("[A-Za-z0-9\uac00-\ud7a3]+"), re.compile("(?<=[a-z0-9])(?=[A-Z])")
        places: dict[str, tuple[int, float]] = {}

        def place(feature: str) -> tuple[int, float]:
            if feature not in places:
                digest = hashlib.blake2b(feature.encode(), digest_size=16).digest()
                places[feature] = int.from_bytes(digest[:8], "big") % dimensions, 1.0 if digest[8] & 1 else -1.0
            return places[feature]

        def one(t: str | None) -> np.ndarray:
            words = Counter(w.lower() for w in word.findall(boundary.sub(" ", t or "")))
            features = Counter(words)
            for w, n in words.items():
                if len(w) >= 4:
                    marked = f"^{w}$"
                    for i in range(len(marked) - 2):
                        features[marked[i : i + 3]] += n
            out = np.zeros(dimensions)
            if features:
                at, sign = zip(*(place(f) for f in features), strict=True)
                np.add.at(out, np.array(at), np.array(sign) * (1 + np.log(np.fromiter(features.values(), float, len(features)))))
            size = np.sqrt((out * out).sum())
            return out / size if size else out

        return pd.Series([one(t) for t in texts])

    return embed(text)
