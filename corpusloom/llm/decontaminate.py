"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item, or a whole shorter item. Of each
document's k-grams the one with the least hash in every run of ``window - k + 1`` is a fingerprint
(the last of equal ones), so any span of ``window`` words shared with an item has a fingerprint
in common. Fingerprints that are not in a bitmap of the benchmark's are dropped where they are
made; the rest are joined with the benchmark's, extended to the windows around them, and the
windows are compared word for word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import ALNUM, MAX64, Texts, Words, mix, signed
from ._rows import map_texts
from ._store import written

WINDOW, K = 13, 8
#: Bits of the bitmap that documents' fingerprints are looked up in; it never grows with the benchmark.
BITS = 1 << 22


def _fingerprints(words: Words, hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each whole window its first word, the word its fingerprint starts at, and the k-gram hashes."""
    grams = words.grams(hashes, k)
    starts = np.flatnonzero(words.inside(window))
    best, at = np.full(len(starts), MAX64), starts.copy()
    for j in range(window - k + 1):
        h = grams[starts + j]
        less = h <= best
        best[less] = h[less]
        at[less] = starts[less] + j
    return starts, at, grams


def _joined(words: Words, first: int, stop: int) -> str:
    buf = words.texts.buf
    return b" ".join(buf[s:e].tobytes() for s, e in zip(words.start[first:stop].tolist(), words.end[first:stop].tolist(), strict=True)).lower().decode("utf-8", "replace")


def _lists(n: int, doc: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``item_id, size, fp, text`` of each window; items without words have none."""

    def run(column: pa.Array) -> list[pa.Array]:
        words = Words(Texts(column), ALNUM)
        hashes = words.hashes(lower=True)
        starts, at, grams = _fingerprints(words, hashes, window, k)
        counts = words.counts
        short = [(int(d), int(words.first[d]), int(c)) for d, c in enumerate(counts) if 0 < c < window]
        rows = sorted([(int(words.doc[s]), window, int(signed(grams[a : a + 1])[0]), _joined(words, s, s + window)) for s, a in zip(starts, at, strict=True)] + [(d, c, int(signed(words.grams(hashes, c)[f : f + 1])[0]), _joined(words, f, f + c)) for d, f, c in short])
        fields = {"size": pa.array([r[1] for r in rows], pa.int32()), "fp": pa.array([r[2] for r in rows], pa.int64()), "text": pa.array([r[3] for r in rows], pa.string())}
        return [_lists(len(counts), np.array([r[0] for r in rows], np.int64), fields)]

    found = map_texts(benchmark, run, "windows array<struct<size int, fp bigint, text string>>", carry=["item_id"])
    return found.select("row.item_id", F.explode("result.windows").alias("w")).select("item_id", "w.*")


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """One bit for each slot that a benchmark fingerprint falls in, by a bitwise aggregate: ``bits / 32`` rows at most."""
    slot = F.pmod("fp", F.lit(bits))
    rows = windows.select(slot.alias("slot")).groupBy((F.col("slot") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("mask")).collect()
    out = np.zeros(bits // 32, np.int64)
    for r in rows:
        out[r.word] = r["mask"]
    return np.unpackbits(out.astype("<u4").view(np.uint8), bitorder="little").astype(bool)


def hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW, k: int = K, bits: int = BITS, carry: list[str] | None = None) -> DataFrame:
    """``row``, ``n_words`` and ``hits`` of each document: fingerprints that the bitmap has, with the words around them."""
    sizes = sorted(r["size"] for r in windows.filter(F.col("size") < window).select("size").distinct().collect())
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(windows, bits)))

    def run(column: pa.Array) -> list[pa.Array]:
        known = np.unpackbits(bitmap.value).view(bool)
        there = lambda h: known[np.mod(signed(h), bits)]
        words = Words(Texts(column), ALNUM)
        hashes = words.hashes(lower=True)
        _, at, grams = _fingerprints(words, hashes, window, k)
        at = np.unique(at)
        at = at[there(grams[at])]
        doc = words.doc[at]
        around = window - k
        rows = [(int(d), max(int(a) - around, int(words.first[d])), min(int(a) + window, int(words.first[d + 1])), window, int(h)) for a, d, h in zip(at, doc, signed(grams[at]), strict=True)]
        for size in sizes:
            g = words.grams(hashes, size)
            s = np.flatnonzero(words.inside(size))
            s = s[there(g[s])]
            rows += [(int(words.doc[a]), int(a), int(a) + size, size, int(h)) for a, h in zip(s, signed(g[s]), strict=True)]
        rows.sort()
        of = np.array([r[0] for r in rows], np.int64)
        fields = {"start": pa.array([r[1] - int(words.first[r[0]]) for r in rows], pa.int32()), "size": pa.array([r[3] for r in rows], pa.int32()), "fp": pa.array([r[4] for r in rows], pa.int64()), "text": pa.array([_joined(words, r[1], r[2]) for r in rows], pa.string())}
        return [pa.array(words.counts.astype(np.int64)), _lists(words.texts.n, of, fields)]

    return map_texts(docs, run, "n_words bigint, hits array<struct<start int, size int, fp bigint, text string>>", carry=carry)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``verdict`` (n_words, n_hit, items, n_items, contaminated) of every document.

    A word is hit if it stands in an occurrence of a window; a document is contaminated if a twentieth
    of its words or more are. Null and empty texts have no words and are clean; repeated rows get the
    same verdict each; with an empty benchmark all are clean, and an empty table gives no rows. Null
    item ids count as the empty string; items of equal text both count. Very long texts are searched
    whole. Carried columns are in ``row``, so their names can't clash.
    """
    windows = written(benchmark_windows(benchmark, window, k), "windows")
    found = hits(docs, windows, window, k, carry=carry).withColumn("rid", F.monotonically_increasing_id())
    found = written(found.select("rid", "row", "result.n_words", "result.hits"), "hits")
    live = found.select("rid", F.explode("hits").alias("h")).select("rid", "h.*").join(windows.select("size", "fp").distinct(), ["size", "fp"], "left_semi")
    parts = F.split("text", " ")
    extended = live.select("rid", "size", "start", parts.alias("words")).select("rid", "size", "start", "words", F.explode(F.expr("sequence(0, size(words) - size)")).alias("j"))
    spans = extended.select("rid", (F.col("start") + F.col("j")).alias("start"), "size", F.array_join(F.expr("slice(words, j + 1, size)"), " ").alias("text")).dropDuplicates(["rid", "start", "size"])
    matched = written(spans.join(windows.select("text").distinct(), "text", "left_semi"), "matched")
    order = Window.partitionBy("rid").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    reached = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = matched.select("rid", F.greatest(end - F.greatest("start", reached), F.lit(0)).alias("new")).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    of_text = windows.select("text", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    items = matched.select("rid", "text").distinct().join(of_text, "text").select("rid", "item").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    verdict = F.struct("n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"), listed.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
    return found.drop("hits").join(counted, "rid", "left").join(items, "rid", "left").select("row", verdict.alias("verdict"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The documents that are not contaminated, with their own columns. Equal texts have equal verdicts, so the text's digest is the key."""
    keyed = docs.select(F.struct("*").alias("row"), "text", F.md5("text").alias("digest"))
    bad = contamination(keyed, benchmark, window, k, carry=["digest"]).filter("verdict.contaminated").select("row.digest").distinct()
    return keyed.join(bad, "digest", "left_anti").select("row.*")
