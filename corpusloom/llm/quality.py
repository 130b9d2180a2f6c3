"""Quality rules: boosted trees over statistics of each document, behind two plain rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from ._bytes import NON_SPACE, Texts, Words, byte_set, gram_hashes, mix, span_hashes
from ._rows import map_texts
from ._store import bounded_sample

SYMBOL = byte_set(r"#*$%&|<>")
UPPER, LETTER, DIGIT, MARK = byte_set("A-Z"), byte_set(r"A-Za-z\x80-\xFF"), byte_set("0-9"), byte_set(r"!?.,;:")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, each with the direction in which a higher value may change the score.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "upper_ratio": -1, "digit_ratio": -1, "mark_ratio": 0, "distinct_ratio": 0, "top_word_ratio": -1, "words_per_line": 0}
#: Labelled rows the trees are fitted on at most, in expectation.
SAMPLE = 20_000


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how often it occurs, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    times, before = np.empty(len(k), np.int64), np.empty(len(k), bool)
    times[order] = np.bincount(group)[group] if len(k) else 0
    before[order] = ~new
    return times, before


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and features of each text; null counts as empty."""
    texts = Texts(column)
    words = Words(texts, NON_SPACE)
    buf, doc = texts.buf, words.doc
    sums = lambda mask: np.bincount(doc[mask], minlength=texts.n).astype(np.int64)
    salt = mix(np.arange(1, texts.n + 1, dtype=np.uint64))
    lead = (buf & 0xC0) != 0x80
    dense = NON_SPACE[buf]
    out = {"n_words": words.counts.astype(np.int64), "word_chars": texts.per_doc(dense & lead), "n_symbols": texts.per_doc(SYMBOL[buf])}
    stop = buf == 10
    stop[texts.at[1:] - 1] = True
    end = np.flatnonzero(stop)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    full = np.cumsum(np.r_[0, dense.astype(np.int64)])
    some = full[end] > full[start]
    start, end = start[some], end[some]
    line_doc = texts.doc_of(start)
    _, before = _repeats(span_hashes(buf, start, end) ^ salt[line_doc])
    n_lines = np.bincount(line_doc, minlength=texts.n)
    out["n_dup_lines"] = np.bincount(line_doc[before], minlength=texts.n).astype(np.int64)
    hashes = words.hashes()
    valid = np.flatnonzero(words.inside(3))
    times, _ = _repeats(gram_hashes(hashes, 3)[valid] ^ salt[doc[valid]])
    covered = np.zeros(len(words) + 3, bool)
    for k in range(3):
        covered[valid[times > 1] + k] = True
    out["n_repeat_words"] = sums(covered[: len(words)])
    times, before = _repeats(hashes ^ salt[doc])
    top = np.zeros(texts.n, np.int64)
    np.maximum.at(top, doc, times)
    n, chars = np.maximum(out["n_words"], 1), np.maximum(out["word_chars"], 1)
    letters = np.maximum(texts.per_doc(LETTER[buf] & lead), 1)
    values = (np.log1p(out["n_words"]), out["word_chars"] / n, out["n_symbols"] / n, out["n_dup_lines"] / np.maximum(n_lines, 1), out["n_repeat_words"] / n, texts.per_doc(UPPER[buf]) / letters, texts.per_doc(DIGIT[buf]) / chars, texts.per_doc(MARK[buf]) / chars, sums(~before) / n, top / n, n / np.maximum(n_lines, 1))
    return out | dict(zip(FEATURES, values, strict=True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> trees.Forest:
    """Fit the trees to ``labels.quality`` on a bounded sample of the labelled rows.

    Labels that are null, or whose document is missing, are left out; with none left, or with one
    value only, the forest is a constant.
    """
    chosen = bounded_sample(labels.select("doc_id", "quality").dropna(), F.col("doc_id"), sample).groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    measured = map_texts(rows, lambda c: [pa.array(v.astype(float)) for k, v in statistics(c).items() if k in FEATURES], ", ".join(f"{k} double" for k in FEATURES), carry=["doc_id", "y"])
    table = measured.select("row.doc_id", "row.y", "result.*").toPandas().sort_values("doc_id", kind="stable")
    return trees.fit(table[list(FEATURES)].to_numpy(float), (table["y"].to_numpy(float) > 0.5).astype(float), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: trees.Forest, threshold: float = 0.5, least_words: int = 50, most_repeated: int = 50, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the document) and ``result`` (counts, base_failed, score, kept) for every document.

    A document fails the base rules if it has fewer than ``least_words`` words, or if more than
    ``most_repeated`` per cent of its words stand in three-word windows found twice or more. Others
    are kept if the trees give them ``threshold`` or more. Null and empty texts have no words and
    fail; every row has its own verdict, so repeated rows have the same one, and a score at the
    threshold is kept. Very long texts are measured whole; an empty table gives no rows. Carried
    columns are in ``row``, so their names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(column: pa.Array) -> list[pa.Array]:
        s = statistics(column)
        failed = (s["n_words"] < least_words) | (100 * s["n_repeat_words"] > most_repeated * s["n_words"])
        score = shared.value.probability(np.stack([s[k] for k in FEATURES], 1).astype(float))
        return [*(pa.array(s[k]) for k in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]

    return map_texts(docs, run, ", ".join(f"{k} bigint" for k in COUNTS) + ", base_failed boolean, score double, kept boolean", carry=carry)
