"""Vector code compression: product codes whose codebooks Lloyd's method fits with heaps.

A vector of whole numbers is cut into parts and each part becomes the index of its codebook's nearest
entry. A block of vectors (what one task holds at once) keeps, for each part position and entry, a
heap of the parts assigned to that entry. A part's key is its lower bound on the distance to any
other entry minus its upper bound on the distance to its own, plus what the entry had drifted when
the part was put in. As entries move, only each entry's drift is added up: its own move and the
largest move of another. Parts whose key isn't above that drift are popped and compared with all
entries exactly, and no other part is touched; its bounds say that its entry is still the only
nearest. Distances are compared as whole numbers, and keys give way by more than floats can be wrong.

Blocks stay cached with their lineage between rounds, so a lost executor costs the rounds of its
own blocks. A round sends sums of what moved, as large as the codebooks, to the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._rows import with_group
from ._store import arrow_rows, written
from ._vectors import blocks, no_rows, usable, whole

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and what a key gives way by, as a share of the numbers that it comes from.
BLOCK, SLACK = 4096, 1e-9

STATE = "vectors binary, assigned binary, keys binary, places binary, sizes binary, moved array<long>, scanned long"


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part position (one matrix each), and where the parts begin and end in a vector."""

    entries: list[np.ndarray]
    cuts: list[int]

    def text(self) -> str:
        """All components by part, entry and position, joined by commas."""
        return ",".join(str(x) for book in self.entries for x in book.ravel().tolist())


def squared(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts to all entries."""
    return ((parts[:, None, :] - book[None, :, :]) ** 2).sum(2)


@dataclass
class Heaps:
    """The parts of one position in one block: their entries, and a heap of (key, place) for each entry."""

    assigned: np.ndarray
    heaps: list[list[tuple[float, int]]]
    new: bool = False

    def due(self, drift: np.ndarray) -> list[int]:
        """Pop the parts whose bounds their entry's drift has used up; at first nothing is known of any part."""
        found = list(range(len(self.assigned))) if self.new else []
        for heap, limit in zip(self.heaps, drift * (1 + SLACK), strict=True):
            while heap and heap[0][0] <= limit:
                found.append(heapq.heappop(heap)[1])
        return found

    def advance(self, parts: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Assign the parts that are due; the places that changed their entry, their old entries, and how many were compared."""
        at = np.array(self.due(drift), np.int64)
        if not len(at):
            return at, at, 0
        d = squared(parts[at], book)
        best = d.argmin(1)
        upper = np.sqrt(d[np.arange(len(at)), best].astype(np.float64))
        d[np.arange(len(at)), best] = np.iinfo(np.int64).max
        lower = np.sqrt(d.min(1).astype(np.float64)) if len(book) > 1 else np.full(len(at), np.inf)
        keys = drift[best] + (lower - upper) - SLACK * (lower + upper) if len(book) > 1 else lower
        many = 4 * len(at) > len(self.assigned)
        for key, place, entry in zip(keys.tolist(), at.tolist(), best.tolist(), strict=True):
            (list.append if many else heapq.heappush)(self.heaps[entry], (key, place))
        for heap in self.heaps if many else ():
            heapq.heapify(heap)
        old = self.assigned[at]
        self.assigned[at] = best
        changed = best != old
        return at[changed], old[changed], len(at)


def _sums(parts: np.ndarray, entries: np.ndarray, n: int) -> np.ndarray:
    """Per entry its parts' sums of components and, last, their number."""
    out = np.zeros((n, parts.shape[1] + 1), np.int64)
    np.add.at(out, entries, np.column_stack([parts, np.ones(len(parts), np.int64)]))
    return out


def _load(record: dict, length: int, n_parts: int, entries: int) -> tuple[np.ndarray, list[Heaps]]:
    vectors = np.frombuffer(record["vectors"], np.int64).reshape(-1, length)
    n = len(vectors)
    if not record["sizes"]:
        return vectors, [Heaps(np.zeros(n, np.uint8), [[] for _ in range(entries)], new=True) for _ in range(n_parts)]
    assigned = np.frombuffer(record["assigned"], np.uint8).reshape(n_parts, n).copy()
    keys = np.frombuffer(record["keys"], np.float64).reshape(n_parts, n)
    places = np.frombuffer(record["places"], np.int32).reshape(n_parts, n)
    ends = np.frombuffer(record["sizes"], np.int32).reshape(n_parts, entries).cumsum(1)
    cut = lambda p, e: slice(ends[p, e - 1] if e else 0, ends[p, e])
    return vectors, [Heaps(assigned[p], [list(zip(keys[p, cut(p, e)].tolist(), places[p, cut(p, e)].tolist(), strict=True)) for e in range(entries)]) for p in range(n_parts)]


def _save(heaps: list[Heaps]) -> dict:
    pairs = [x for h in heaps for heap in h.heaps for x in heap]
    return {
        "assigned": b"".join(h.assigned.tobytes() for h in heaps),
        "keys": np.array([k for k, _ in pairs], np.float64).tobytes(),
        "places": np.array([i for _, i in pairs], np.int32).tobytes(),
        "sizes": np.array([len(heap) for h in heaps for heap in h.heaps], np.int32).tobytes(),
    }


def _packed(vectors: DataFrame, length: int) -> DataFrame:
    """One row for each block of vectors: the rows it holds, and an empty state."""
    schema = T.StructType([T.StructField("rows", T.ArrayType(vectors.schema["row"].dataType)), *T._parse_datatype_string(STATE)])
    most = int((2.0**62 / max(length, 1)) ** 0.5 / 2)  # no squared distance of vectors leaves 63 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK):
            numbers = whole(block.column(1), length, SCALE, most)
            rows = pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), block.column(0))
            empty = [pa.array([b""], pa.binary())] * 4
            yield pa.RecordBatch.from_arrays([rows, pa.array([numbers.tobytes()], pa.binary()), *empty, pa.array([[]], pa.list_(pa.int64())), pa.array([0], pa.int64())], schema.names)

    return vectors.mapInArrow(run, schema)


def _advanced(state: DataFrame, books: Codebooks, drift: np.ndarray) -> DataFrame:
    """Blocks after one assignment, with the sums of what moved to (or from) each entry."""
    length, entries = books.cuts[-1], len(books.entries[0])
    names = state.columns

    def one(record: dict) -> dict:
        vectors, heaps = _load(record, length, len(books.entries), entries)
        moved, scanned = [], 0
        for p, (own, book) in enumerate(zip(heaps, books.entries, strict=True)):
            parts = vectors[:, books.cuts[p] : books.cuts[p + 1]]
            changed, old, n = own.advance(parts, book, drift[p])
            if not record["sizes"]:  # the first: nothing is to be taken from an entry
                sums = _sums(parts, own.assigned, entries)
            else:
                sums = _sums(parts[changed], own.assigned[changed], entries) - _sums(parts[changed], old, entries)
            moved.append(sums.ravel())
            scanned += n
        return _save(heaps) | {"moved": np.concatenate(moved), "scanned": scanned}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                new = one({c: block.column(c)[0].as_py() for c in ("vectors", "sizes", "assigned", "keys", "places")})
                made = [pa.array([new[c]], pa.binary()) for c in ("assigned", "keys", "places", "sizes")]
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *made, pa.array([new["moved"]], pa.list_(pa.int64())), pa.array([new["scanned"]], pa.int64())], names)

    return state.mapInArrow(run, state.schema)


def _coded(state: DataFrame, books: Codebooks) -> DataFrame:
    """``row``, ``code`` and ``error`` of each vector."""
    schema = T.StructType([T.StructField("row", state.schema["rows"].dataType.elementType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vectors = np.frombuffer(batch.column("vectors")[i].as_py(), np.int64).reshape(-1, books.cuts[-1])
                assigned = np.frombuffer(batch.column("assigned")[i].as_py(), np.uint8).reshape(-1, len(vectors))
                near = np.concatenate([book[a] for book, a in zip(books.entries, assigned, strict=True)], axis=1)
                text, width = assigned.T.tobytes().hex(), 2 * len(assigned)
                codes = [text[j : j + width] for j in range(0, len(text), width)]
                yield pa.RecordBatch.from_arrays([batch.column("rows").slice(i, 1).flatten(), pa.array(codes, pa.string()), pa.array(((vectors - near) ** 2).sum(1))], schema.names)

    return state.mapInArrow(run, schema)


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: Iterable[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, log: list[int] | None = None) -> tuple[DataFrame, Codebooks | None]:
    """``row`` (the carried columns), ``code`` (two hex digits a part) and ``error`` of each vector, and the codebooks.

    Components become floor(4096 * x). Codebooks start as the first ``entries`` vectors by key, with
    null keys last and rows of one key in the vectors' order; with fewer vectors there are fewer
    entries. Ties go to the lower index; entries that nothing is assigned to stay. ``usable`` says
    which rows are dropped; repeated rows all stay, and an empty table gives no rows and no codebooks.
    A length that ``parts`` doesn't divide is cut at the floors of equal steps. A component too large
    for exact distances of 63 bits raises ValueError. ``log`` gets the number of parts that each
    assignment compared.
    """
    spark = rows.sparkSession
    carry = list(rows.columns if carry is None else carry)
    named = list(dict.fromkeys([*carry, key]))
    vectors, length = usable(rows, vector, named)
    kept = F.struct(*[F.col(f"row.`{c}`") for c in carry]).alias("row")
    if not length:
        return no_rows(vectors.select(kept), code="string", error="long"), None
    first = vectors.orderBy(F.col(f"row.`{key}`").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = whole(pa.array([r.vector for r in first], pa.list_(pa.float64())), length, SCALE, 1 << 62)
    cuts = [p * length // parts for p in range(parts + 1)]
    books = Codebooks([start[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)], cuts)
    totals = [np.zeros((len(start), b - a + 1), np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]
    drift = np.zeros((parts, len(start)))
    with arrow_rows(spark, 1024):
        state = _packed(vectors.select(kept, "vector"), length).persist(StorageLevel.MEMORY_AND_DISK)
        state.count()
    with arrow_rows(spark, 4):
        for turn in range(rounds + 1):
            before, state = state, _advanced(state, books, drift).persist(StorageLevel.MEMORY_AND_DISK)
            moved = state.select(F.posexplode("moved"), "scanned").groupBy("pos").agg(F.sum("col").alias("total"), F.sum("scanned").alias("scanned")).collect()
            before.unpersist()
            if log is not None:
                log.append(moved[0].scanned)
            if turn == rounds:
                break
            flat = np.zeros(sum(t.size for t in totals), np.int64)
            flat[[r.pos for r in moved]] = [r.total for r in moved]
            new, at = [], 0
            for p, book in enumerate(books.entries):
                totals[p] += flat[at : at + totals[p].size].reshape(totals[p].shape)
                at += totals[p].size
                counts = totals[p][:, -1:]
                new.append(np.where(counts > 0, totals[p][:, :-1] // np.maximum(counts, 1), book))
                drift[p] += _drifts(new[p] - book)
            books = Codebooks(new, cuts)
        coded = written(_coded(state, books), "codes")
        state.unpersist()
    return coded, books


def _drifts(moves: np.ndarray) -> np.ndarray:
    """What a round takes from the keys of each entry: its own move and the largest of another."""
    own = np.sqrt((moves**2).sum(1).astype(np.float64))
    others = np.array([np.delete(own, e).max(initial=0.0) for e in range(len(own))])
    return own + others


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Coded rows with ``label_error``, the errors summed over the rows of equal label; nulls are one label."""
    alike = coded.withColumn("_label", F.struct(F.col(f"row.`{label}`").alias("label")))
    total = (F.sum("error"), F.sum)
    return with_group(alike, ["_label"], F.col("row"), {"label_error": total}).drop("_label")
