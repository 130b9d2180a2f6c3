"""Renames: added and deleted files of equal content, paired by how alike their paths are.

New paths choose in path order, each the old path left that is most like it, ties by the old path.
Where a content has one path on either side that is a join. Other contents are worked off in
rounds, all contents at once: the next ``CHUNK`` new paths of each meet the old paths left in
blocks, a block hands on the best ``KEPT`` old paths of each new one, and the best over all blocks
are chosen from in order. A new path whose ``KEPT`` best have all gone ends its content's round, so
``KEPT`` new paths at least are settled in each and no result depends on the limits. A block's paths
are first bounded by the characters they share with the new path, and only those whose bound
reaches the best so far are compared.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, written
from .relational import numbered, top_per_key

CHUNK, BLOCK, KEPT = 1024, 1024, 64
#: Characters are counted in so many bins; sharing a bin is no less than sharing a character.
BINS = 128


def _bags(paths: list[str]) -> np.ndarray:
    out = np.zeros((len(paths), BINS), np.int16)
    for i, path in enumerate(paths):
        np.add.at(out[i], np.frombuffer(path.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS, 1)
    return out


def most_alike(new: str, old: list[str], bags: np.ndarray, sizes: np.ndarray, kept: int) -> list[tuple[float, str]]:
    """The ``kept`` old paths of highest ratio of matching blocks, the highest first, ties by path."""
    shared = np.minimum(bags, _bags([new])[0]).sum(1)
    bound = 2.0 * shared / np.maximum(sizes + len(new), 1)
    matcher = SequenceMatcher(None, "", new)
    best: list[tuple[float, str]] = []  # negative ratio and path, in order
    for i in np.argsort(-bound, kind="stable").tolist():
        if len(best) == kept and bound[i] < -best[-1][0]:
            break
        matcher.set_seq1(old[i])
        insort(best, (-matcher.ratio(), old[i]))
        del best[kept:]
    return [(-r, path) for r, path in best]


def _candidates(chunks: DataFrame, blocks: DataFrame, kept: int) -> DataFrame:
    """``hash, path, old_path, ratio`` of each new path of the chunks: the best of all blocks of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, new, old in zip(*(batch.column(c).to_pylist() for c in ("hash", "new", "old")), strict=True):
                bags, sizes = _bags(old), np.array([len(o) for o in old])
                for path in new:
                    found = most_alike(path, old, bags, sizes, kept)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found)), pa.array([path] * len(found)), pa.array([o for _, o in found]), pa.array([r for r, _ in found])], ["hash", "path", "old_path", "ratio"])

    pairs = chunks.join(blocks, "hash").repartition("hash", "block", "part")
    scored = pairs.select("hash", "new", "old").mapInArrow(run, "hash string, path string, old_path string, ratio double")
    return top_per_key(scored, ["hash", "path"], [F.desc("ratio"), F.asc("old_path")], kept)


def _chosen(candidates: DataFrame, kept: int) -> DataFrame:
    """``path, old_path``: of each content, new paths choose in order until one can't tell."""
    lists = candidates.groupBy("hash", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "old_path"))), lambda x: x["old_path"]).alias("old"))
    chunks = lists.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("path", "old"))).alias("lists"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in batch.column(0).to_pylist():
                taken: dict[str, str] = {}
                for one in lists:
                    free = next((o for o in one["old"] if o not in taken), None)
                    if free is None:
                        break  # more than these are left, or none: then no new path is asked
                    taken[free] = one["path"]
                yield pa.RecordBatch.from_arrays([pa.array(list(taken.values()), pa.string()), pa.array(list(taken), pa.string())], ["path", "old_path"])

    return chunks.select("lists").mapInArrow(run, "path string, old_path string")


def renames(rows: DataFrame, chunk: int = CHUNK, block: int = BLOCK, kept: int = KEPT) -> DataFrame:
    """``path, old_path`` of rows (path, change, hash) whose change is added or deleted; each path at most once."""
    sides = rows.filter(F.col("change").isin("added", "deleted") & F.col("hash").isNotNull()).select("path", "change", "hash")
    counts = sides.groupBy("hash").agg(F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "deleted").alias("d")).filter("a > 0 and d > 0")
    counts = checkpointed(counts)
    both = sides.join(counts, "hash")
    old = both.filter("change = 'deleted'").select("hash", "d", "a", F.col("path").alias("old_path"))
    new = both.filter("change = 'added'").select("hash", "path", "a", "d")
    found = new.filter("a = 1 and d = 1").join(old.filter("a = 1 and d = 1").select("hash", "old_path"), "hash").select("path", "old_path")
    if counts.filter("a > 1 or d > 1").isEmpty():
        return found
    # Each new path takes one old path while any is left, so the first as many as there are old ones are renamed.
    new = written(numbered(new.filter("a > 1 or d > 1"), ["hash"], ["path"], "nth").filter("nth <= d").select("hash", "path", ((F.col("nth") - 1) / chunk).cast("int").alias("chunk")), "new-paths")
    old = written(old.filter("a > 1 or d > 1").select("hash", "old_path"), "old-paths")
    while not new.isEmpty():
        now = new.join(new.groupBy("hash").agg(F.min("chunk").alias("chunk")), ["hash", "chunk"])
        # A chunk meets each block in parts, so that one content's work is dealt out.
        chunks = now.groupBy("hash", F.pmod(F.xxhash64("path"), F.lit(8)).alias("part")).agg(F.collect_list("path").alias("new"))
        n = old.groupBy("hash").agg(F.ceil(F.count("*") / block).alias("n"))
        blocks = old.join(n, "hash").groupBy("hash", F.pmod(F.xxhash64("old_path"), F.col("n")).alias("block")).agg(F.collect_list("old_path").alias("old"))
        pairs = checkpointed(_chosen(_candidates(chunks, blocks, kept), kept))
        found = found.unionByName(pairs)
        new = written(new.join(pairs, "path", "left_anti"), "new-paths")
        old = written(old.join(pairs, "old_path", "left_anti").join(new.select("hash").distinct(), "hash", "left_semi"), "old-paths")
    return found
