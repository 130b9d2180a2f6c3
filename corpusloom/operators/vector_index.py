"""An index of vectors by cosine: inverted lists of product-quantised residuals, and exact scores of the survivors.

Each row is in the list of its nearest centre, and what its unit vector is beyond the centre is kept
as one byte for each of eight parts. A query looks into its nearest lists, adds up table entries for
every code there, and only the best ``rerank`` rows by that sum are compared by their vectors. Lists
grow in number with the root of the rows. How many are looked into is calibrated on the sample that
centres and codebooks are fitted on: enough to hold the target share of the sample's own neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .relational import top_per_key

#: Parts of a code, entries of a part's codebook, codes of a block, vectors of the sample, and sample queries of the calibration.
PARTS, ENTRIES, BLOCK, SAMPLE, PROBED = 8, 256, 8192, 20_000, 256


def _packed(df: DataFrame, prefix: str, size: int, key: Sequence[str] = ()) -> DataFrame:
    """Rows (key, id, vector) packed into blocks of about ``size`` rows by hash: key, ids and values as arrays."""
    n = df.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("_blocks"))
    sized = df.join(n, list(key)) if key else df.join(F.broadcast(n))
    rows = sized.groupBy(*key, F.pmod(F.xxhash64("id"), F.col("_blocks")).alias(f"{prefix}_block")).agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    return rows.select(*key, F.col("rows.id").alias(f"{prefix}_ids"), F.flatten("rows.vector").alias(f"{prefix}_values"))


def _units(values: np.ndarray, n: int) -> np.ndarray:
    m = values.astype(np.float64).reshape(n, -1)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size == 0, 1, size)


def _centres(m: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """k-means of the rows of a bounded matrix."""
    centres = m[np.sort(rng.choice(len(m), min(k, len(m)), replace=False))]
    for _ in range(rounds):
        of = _nearest(m, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, m)
        counts = np.bincount(of, minlength=len(centres))[:, None]
        new = _units(sums, len(sums)) if unit else sums / np.maximum(counts, 1)
        centres = np.where(counts > 0, new, centres)
    return centres


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (m @ centres.T)).argmin(1)


class VectorIndex:
    """The index of rows (id, vector); null vectors are left out.

    Centres and codebooks are fitted on about ``sample`` rows, chosen by their ids' hashes; every row is
    indexed. ``target`` is the share of the sample's neighbours that the lists looked into have to hold.
    """

    def __init__(self, rows: DataFrame, k: int = 8, target: float = 0.98, sample: int = SAMPLE, lists: int | None = None, rounds: int = 8, seed: int = 5):
        self.vectors = rows.filter("vector is not null").select("id", "vector")
        self.n, slots = self.vectors.count(), 1 << 30
        chosen = self.vectors if self.n <= sample else self.vectors.filter(F.pmod(F.xxhash64("id", F.lit("lists")), F.lit(slots)) < int(slots * sample / self.n))
        found = chosen.select("vector").toArrow().column(0)
        m = _units(np.array([v.as_py() for v in found], np.float64), len(found)) if len(found) else np.zeros((1, 1))
        rng = np.random.default_rng(seed)
        self.centres = _centres(m, lists or max(1, int(self.n**0.5 / 4)), rounds, rng, unit=True)
        rest = m - self.centres[_nearest(m, self.centres)]
        self.cuts = [p * m.shape[1] // PARTS for p in range(PARTS + 1)]
        self.books = [_centres(rest[:, a:b], ENTRIES, rounds, rng) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.probes = self._calibrated(m, k, target, rng)
        self.codes = written(self._coded(), "vector-codes")

    def _calibrated(self, m: np.ndarray, k: int, target: float, rng: np.random.Generator) -> int:
        """The least number of nearest lists that hold ``target`` of the ``k`` nearest rows of some of the sample."""
        queries = m[rng.choice(len(m), min(PROBED, len(m)), replace=False)]
        near = np.argsort(-(queries @ m.T), axis=1, kind="stable")[:, :k]
        order = np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)  # of each list among a query's
        ranks = np.sort(np.take_along_axis(place, _nearest(m, self.centres)[near], 1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1

    def _coded(self) -> DataFrame:
        """``list, id, code`` of all rows."""
        shared = self.vectors.sparkSession.sparkContext.broadcast((self.centres, self.books, self.cuts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books, cuts = shared.value
            for batch in batches:
                if batch.num_rows:
                    m = _units(np.asarray(batch.column(1).flatten()), batch.num_rows)
                    of = _nearest(m, centres)
                    rest = m - centres[of]
                    codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(cuts, cuts[1:], books, strict=False)], 1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "code"])

        return self.vectors.mapInArrow(run, "list int, id bigint, code binary")

    def _probed(self, queries: DataFrame) -> DataFrame:
        """Queries with each of the lists that they look into."""
        shared, probes = queries.sparkSession.sparkContext.broadcast(self.centres), self.probes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    m = _units(np.asarray(batch.column(1).flatten()), batch.num_rows)
                    near = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :probes]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], ["list", "id", "vector"])

        kind = queries.schema["vector"].dataType.simpleString()
        return queries.select("id", "vector").mapInArrow(run, f"list int, id bigint, vector {kind}")

    def candidates(self, queries: DataFrame, rerank: int) -> DataFrame:
        """``query_id, id`` of the best ``rerank`` rows of each query by their codes."""
        sized = self.codes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        blocks = self.codes.join(sized, "list").groupBy("list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("id", "code")).alias("rows"))
        asked = _packed(self._probed(queries.filter("vector is not null")), "q", 512, ["list"])
        shared = queries.sparkSession.sparkContext.broadcast((self.centres, self.books, self.cuts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books, cuts = shared.value
            for batch in batches:
                for row in range(batch.num_rows):
                    queries = np.asarray(batch.column("q_ids")[row].values)
                    held = batch.column("rows")[row].values
                    ids, codes = np.asarray(held.field("id")), np.frombuffer(b"".join(held.field("code").to_pylist()), np.uint8).reshape(-1, PARTS)
                    q = _units(np.asarray(batch.column("q_values")[row].values), len(queries))
                    score = np.repeat((q @ centres[batch.column("list")[row].as_py()])[:, None], len(ids), 1)
                    for p, (a, b, book) in enumerate(zip(cuts, cuts[1:], books, strict=False)):
                        score += (q[:, a:b] @ book.T)[:, codes[:, p]]
                    top = np.argsort(-score, axis=1, kind="stable")[:, :rerank]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(score, top, 1).ravel())], ["query_id", "id", "near"])

        found = blocks.select("list", "rows").join(asked, "list").mapInArrow(run, "query_id bigint, id bigint, near double")
        return top_per_key(found, ["query_id"], [F.desc("near"), F.asc("id")], rerank).select("query_id", "id")

    def nearest(self, queries: DataFrame, k: int, least: float = -1.0, rerank: int = 25) -> DataFrame:
        """``query_id, id, score, rank`` as the exact search has them, of the ``rerank`` times ``k`` best candidates of each query."""
        pairs = self.candidates(queries, rerank * k).join(self.vectors, "id").join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("asked")), "query_id")
        length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        dot = F.aggregate(F.zip_with("vector", "asked", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        size = length("vector") * length("asked")
        scored = pairs.select("query_id", "id", F.round(F.when(size == 0, 0.0).otherwise(dot / size), 9).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
