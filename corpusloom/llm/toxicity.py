"""Toxicity by subword-bag embeddings, averaged into a linear softmax.

A text is the average of the vectors of its words' subwords: the word and its character n-grams with
a mark at either end, hashed into ``BUCKETS``. Vectors and softmax are trained jointly by gradient
descent in numpy, so a misspelling that wasn't seen shares the vectors of the n-grams that were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _P, ALNUM, Texts, _table, mix, powers
from ._rows import map_texts
from ._store import bounded_sample, written

BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 16, (3, 4, 5, 6)
#: The fit's sample: labelled texts of each label at most, and bytes of text of each label at most, both in
#: expectation; texts of more bytes than the last are scored like all, but not learned from.
SAMPLE, SAMPLE_BYTES, LONGEST = 1500, 6 << 20, 1 << 20


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of each text, n-gram lengths one after another, and the text it is in."""
    texts = Texts(column)
    buf = np.r_[np.uint8(32), texts.buf]
    inside = ALNUM[buf]
    inside[0] = False
    inside[texts.at[1:]] = False
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # of each character
    word = inside[at]
    up, down = powers(_P, len(buf) + 1)
    table = _table(True)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(np.where(inside, table[buf], table[32]) * up[:-1], out=total[1:])
    ends = np.r_[at[1:], len(buf)]
    breaks = np.r_[0, np.cumsum(~word)]
    buckets, owners = [], []

    def add(first: np.ndarray, last: np.ndarray, salt: int) -> None:
        s, e = at[first], ends[last]
        h = mix((total[e] - total[s]) * down[s] + np.uint64(salt))
        buckets.append((h & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append((np.searchsorted(texts.at, s - 1 + (~word[first]), side="right") - 1).astype(np.int32))

    n = len(at)
    for k in GRAMS:
        i = np.arange(max(0, n - k + 1))
        i = i[breaks[i + k - 1] == breaks[i + 1]]
        add(i, i + k - 1, k)
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    add(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, 99)
    return np.concatenate(buckets), np.minimum(np.concatenate(owners), max(texts.n - 1, 0))


@dataclass
class Model:
    """``gain``: what each bucket adds to the difference of the two logits; ``bias`` the difference without any."""

    gain: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        buckets, owner = subwords(column)
        n = np.bincount(owner, minlength=len(column))
        mean = np.bincount(owner, self.gain[buckets], len(column)) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def fit(columns: np.ndarray, values: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 150, rate: float = 20.0, decay: float = 1e-5, seed: int = 3) -> Model:
    """Train vectors and softmax on bags, each label weighing half.

    ``columns`` has the distinct buckets of each text, one text after another, ``values`` their shares
    of the text's subwords, ``sizes`` how many buckets each text has.

    With two classes the gradient of a text's vector lies along the difference of the two softmax
    columns, so both products with the bags are sparse sums.
    """
    y = labels.astype(float)
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    head = rng.normal(0, 1, DIMENSIONS).astype(np.float32)
    bias = 0.0
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    seen = np.zeros(BUCKETS, bool)
    seen[columns] = True
    used = np.flatnonzero(seen)
    columns = (np.cumsum(seen, dtype=np.int32) - np.int32(1))[columns]
    # The same entries once more by bucket, for sums over texts.
    order = np.argsort(columns, kind="stable").astype(np.int32)
    rows = np.repeat(np.arange(len(y), dtype=np.int32), sizes)[order]
    by_bucket = values[order]
    del order
    bucket_starts = np.r_[0, np.cumsum(np.bincount(columns, minlength=len(used)))[:-1]].astype(np.int64)
    own = vectors[used]
    step_head, step_line = np.zeros(DIMENSIONS, np.float32), np.zeros(len(used), np.float32)
    for epoch in range(epochs):
        pull = rate * (1 - epoch / epochs)
        z = np.full(len(y), bias)
        if len(some):
            z[some] += np.add.reduceat((own @ head)[columns] * values, starts)
        g = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32)
        along = np.add.reduceat(g[rows] * by_bucket, bucket_starts) if len(rows) else step_line * 0
        step_line = 0.9 * step_line + along
        step_head = 0.9 * step_head + own.T @ along
        own *= np.float32(1 - decay * pull)
        own -= (np.float32(50 * pull) * step_line)[:, None] * head
        head -= np.float32(0.05 * pull) * step_head
        bias -= 0.1 * float(g.sum()) * pull
    vectors[used] = own
    return Model((vectors @ head).astype(float), bias)


def bag(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and the share of its subwords that fall in each."""
    distinct, counts = np.unique(buckets, return_counts=True)
    return distinct, counts / np.float32(max(counts.sum(), 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, longest: int = LONGEST) -> Model:
    """Fit to ``labels.toxic`` on a sample of the documents of either label, chosen by their ids' hashes.

    About ``sample`` texts and ``sample_bytes`` bytes of each label at most, none of more than
    ``longest`` bytes, so what comes to the driver is bounded whatever the tables hold. Labels that are
    null or without a document are left out; an id with both labels is toxic. Without labels, or with
    one label only, every text gets that label's share.
    """
    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("y"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    some = [bounded_sample(known.filter(F.col("y") == v), F.col("doc_id"), sample) for v in (0, 1)]
    rows = docs.select("doc_id", "text").filter(size <= longest).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    rows = written(rows, "toxicity-sample")
    held = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum(size).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("y") == v, F.lit(min(1.0, sample_bytes / max(n, 1)))) for v, n in held.items()], F.lit(1.0))
    slots = 1 << 30
    rows = rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("bytes")), F.lit(slots)) < share * F.lit(slots))

    def run(column: pa.Array) -> list[pa.Array]:
        buckets, owner = subwords(column)
        order = np.argsort(owner, kind="stable")
        bags = [bag(b) for b in np.split(buckets[order], np.cumsum(np.bincount(owner, minlength=len(column)))[:-1])]
        return [pa.array([b.astype("<i4").tobytes() for b, _ in bags], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in bags], pa.binary())]

    table = map_texts(rows, run, "buckets binary, shares binary", carry=["doc_id", "y"]).select("row.*", "result.*").toArrow().sort_by("doc_id")
    labels_of = table.column("y").to_numpy().astype(float) > 0.5
    sizes = pc.binary_length(table.column("buckets")).to_numpy() // 4
    joined = lambda name, kind: np.frombuffer(b"".join(v.as_buffer() for v in table.column(name)), kind)
    held = [joined("buckets", "<i4"), joined("shares", "<f4")]
    del table
    pa.default_memory_pool().release_unused()
    return fit(held.pop(0), held.pop(0), sizes, labels_of)  # no other reference: the fit replaces its columns


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``result.score`` of every document; null and empty texts get the bias alone, equal texts equal scores.

    Whole texts are scored, however long; an empty table gives no rows. Carried columns are in
    ``row``, so their names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda column: [pa.array(shared.value.score(column))], "score double", carry=carry)
