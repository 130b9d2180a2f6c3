"""A written inverted index of chunks in blocks, with the largest count of each term in each block.

Chunks are dealt into blocks of about ``BLOCK`` by their file and place. An index row is a term in a
block: the chunks that have it, how often each has it, and the largest of these counts. A query's score
of a chunk is the sum of its terms' counts, so the sum of the largest counts bounds every chunk of a
block. The blocks of highest bound are scored first; their ``limit``-th best score is one that no
block with a lower bound can reach, and those are skipped unread.

Rows live in a versioned table by parts of blocks. A file's content hash is a row too, so an index
knows which files it was made of; an update rewrites only the parts that hold changed files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .commits import Versions
from .relational import top_per_key

BLOCK, FIRST = 128, 8
#: Parts of the table at least, and blocks of a part beyond.
PARTS, PART_BLOCKS = 16, 256
#: Query terms that are handed to all tasks at most; with more, postings meet terms in a shuffle.
BROADCAST_TERMS = 200_000
#: Rows that aren't terms: words have no colon.
BLOCKS, HASH = ":blocks", "sha256:"


def _block(file_id: Column, ordinal: Column, blocks: int) -> Column:
    """The block of a chunk: its file's, or one of its file's if that has more chunks than a block."""
    return F.pmod(F.xxhash64(file_id, F.floor(ordinal / BLOCK)), F.lit(blocks)).cast("int")


FOUND = pa.list_(pa.struct([("chunk_id", pa.int64()), ("n", pa.int32()), ("file_id", pa.int64())]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of chunks (file_id, k, ordinal, chunk_id, terms) that follow each other in a file's place ``k``.

    Chunks of a file overlap, so a piece has each of its words once: their lengths, the steps from one (word, chunk)
    to the next, how often each stands there, and the words, compressed.
    """
    for batch in (whole.slice(at, FED) for whole in batches for at in range(0, whole.num_rows, FED)):
        file, k, lists, rows = batch.column("file_id").to_numpy(), batch.column("k").to_numpy(), batch.column("terms"), batch.num_rows
        cuts = np.r_[0, np.flatnonzero((file[1:] != file[:-1]) | (k[1:] != k[:-1])) + 1, rows]
        sizes = np.diff(cuts)
        first = np.repeat(cuts[:-1], sizes)  # of each chunk's piece
        row = np.repeat(np.arange(rows), lists.value_lengths().fill_null(0).to_numpy())
        words = lists.flatten().dictionary_encode()
        known = max(1, len(words.dictionary))
        key, n = np.unique((first[row] * known + words.indices.to_numpy()) * rows + row, return_counts=True)
        word, row = np.divmod(key, rows)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        text = words.dictionary.take(pa.array(word[starts] % known)).cast(pa.binary())
        at = np.searchsorted(word, cuts * known)  # the pairs of each piece
        at_word = np.searchsorted(word[starts], cuts * known)
        place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(word)]))
        lengths, whole = np.diff(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1)), text.buffers()[2]
        whole, ends = b"" if whole is None else whole.to_pybytes(), np.r_[0, np.cumsum(lengths)]
        raw = []
        for p in range(len(sizes)):
            (x, y), (v, w) = at[p : p + 2], at_word[p : p + 2]
            pairs = (place[x:y] - v) * sizes[p] + row[x:y] - cuts[p]
            raw.append(lengths[v:w].tobytes() + np.diff(pairs, prepend=0).tobytes() + n[x:y].astype(np.int32).tobytes() + whole[ends[v] : ends[w]])
        data = [pa.compress(r, codec="zstd", asbytes=True) for r in raw]
        ints = lambda v: pa.array(np.asarray(v, np.int32))
        ids = pa.ListArray.from_arrays(ints(cuts), batch.column("chunk_id"))
        last = np.maximum.reduceat(batch.column("ordinal").to_numpy(), cuts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(file[cuts[:-1]]), pa.array(k[cuts[:-1]]), ints(last), ids, ints(np.diff(at_word)), ints(np.diff(at)), ints([len(r) for r in raw]), pa.array(data, pa.binary())], PIECE)


#: Chunks that are made into pieces at a time, and a piece's columns.
FED = 512
PIECE = ["file_id", "k", "last", "chunk_ids", "words", "pairs", "size", "data"]


def _packed(part: int, block: int, pieces: pa.Table) -> pa.RecordBatch:
    """The index rows of one block's pieces."""
    column = lambda name: pieces.column(name).to_numpy()
    lists = pieces.column("chunk_ids").combine_chunks()
    chunk, sizes, words, pairs = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), column("words"), column("pairs")
    order = np.argsort(chunk, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    lengths, term, row, n, text = [], [], [], [], []
    before, known = np.r_[0, np.cumsum(sizes)], np.r_[0, np.cumsum(words)]
    for i, data in enumerate(pieces.column("data")):
        raw = pa.decompress(data.as_buffer(), int(pieces.column("size")[i].as_py()), codec="zstd", asbytes=True)
        a, b = 4 * int(words[i]), 4 * int(words[i]) + 8 * int(pairs[i])
        w, r = np.divmod(np.cumsum(np.frombuffer(raw, np.int64, int(pairs[i]), a)), sizes[i])
        lengths.append(np.frombuffer(raw, np.int32, int(words[i])))
        term.append(w + known[i])
        row.append(r + before[i])
        n.append(np.frombuffer(raw, np.int32, int(pairs[i]), b))
        text.append(raw[b + 4 * int(pairs[i]) :])
    lengths, term, row, n = (np.concatenate(v) for v in (lengths, term, row, n))
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    coded = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(text))).dictionary_encode()
    term, row = coded.indices.to_numpy()[term], place[row]
    by = np.argsort(term.astype(np.int64) * max(1, len(order)) + row)
    term, row, n = term[by], row[by], n[by]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    files = np.repeat(column("file_id"), sizes)[order]
    found = pa.StructArray.from_arrays([pa.array(chunk[order][row]), pa.array(n), pa.array(files[row])], fields=list(FOUND.value_type))
    most = np.maximum.reduceat(n, starts) if len(starts) else n
    same = lambda v: pa.array(np.full(len(starts), v, np.int32))
    return pa.RecordBatch.from_arrays([same(part), same(block), coded.dictionary.take(pa.array(term[starts])), pa.array(most), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(term)].astype(np.int32)), found)], ["part", "block", "term", "most", "found"])


def _blocks(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of pieces whose blocks follow each other; no more than a block is held."""
    held: list[pa.RecordBatch] = []
    now = 0
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b and held and block[a] != now:
                yield _packed(now % parts, now, pa.Table.from_batches(held))
                held = []
            if a < b:
                now = int(block[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield _packed(now % parts, now, pa.Table.from_batches(held))


def _parts(blocks: int) -> int:
    return max(PARTS, blocks // PART_BLOCKS)


class Lexical:
    """The index at ``path`` of chunks (file_id, chunk_id, ordinal, terms)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Versions(spark, path, "part")
        self.rows = self.table.read() if self.table.latest() else None

    @classmethod
    def at(cls, path: str, files: DataFrame, chunks: Callable[[DataFrame], DataFrame]) -> Lexical:
        """The index of ``files`` (file_id, content_hash and what ``chunks`` cuts them by): built if there is none, else brought up to date."""
        index = cls(files.sparkSession, path)
        if index.rows is None:
            index._build(files, chunks)
        else:
            index._update(files, chunks)
        return index

    def _cut(self, chunks: DataFrame) -> DataFrame:
        """The chunks in pieces, written: they are cut once, and cross the network without their overlap."""
        fed = chunks.select("file_id", F.floor(F.col("ordinal") / BLOCK).cast("bigint").alias("k"), F.col("ordinal").cast("int").alias("ordinal"), "chunk_id", "terms")
        return written(fed.mapInArrow(_pieces, "file_id bigint, k bigint, last int, chunk_ids array<bigint>, words int, pairs int, size int, data binary"), "index-pieces")

    def _made_of(self, files: DataFrame, pieces: DataFrame, blocks: int) -> DataFrame:
        """An index row for each file: its hash and its number of chunks."""
        numbered = files.select("file_id", F.coalesce("content_hash", F.lit(HASH)).alias("term")).join(pieces.groupBy("file_id").agg(F.max("last").alias("n")), "file_id", "left")
        n, block = F.coalesce("n", F.lit(0)).cast("int"), _block(F.col("file_id"), F.lit(0), blocks)
        found = F.array(F.struct(F.lit(None).cast("bigint").alias("chunk_id"), n.alias("n"), "file_id"))
        return numbered.select((block % _parts(blocks)).alias("part"), block.alias("block"), "term", n.alias("most"), found.alias("found"))

    def _rows(self, files: DataFrame, pieces: DataFrame, blocks: int) -> DataFrame:
        block = _block(F.col("file_id"), F.col("k") * BLOCK, blocks)
        parts = _parts(blocks)
        dealt = pieces.select((block % parts).alias("part"), block.alias("block"), "file_id", "chunk_ids", "words", "pairs", "size", "data").repartition("part").sortWithinPartitions("part", "block")
        made = dealt.drop("part").mapInArrow(lambda batches: _blocks(parts, batches), "part int, block int, term string, most int, found array<struct<chunk_id: bigint, n: int, file_id: bigint>>")
        return made.unionByName(self._made_of(files, pieces, blocks).repartition("part"))

    def _build(self, files: DataFrame, chunks: Callable[[DataFrame], DataFrame], parts_before: int = 0) -> None:
        pieces = self._cut(chunks(files))
        blocks = max(1, -(-(pieces.agg(F.sum(F.size("chunk_ids")).alias("n")).first().n or 0) // BLOCK))
        note = self.spark.range(1).select(F.lit(0).alias("part"), F.lit(0).alias("block"), F.lit(BLOCKS).alias("term"), F.lit(blocks).alias("most"))
        self.table.replace(self._rows(files, pieces, blocks).unionByName(note, allowMissingColumns=True), range(max(_parts(blocks), parts_before)))
        self.rows = self.table.read()

    def blocks(self) -> int:
        return self.rows.filter(F.col("term") == BLOCKS).first().most

    def _update(self, files: DataFrame, chunks: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the parts that hold files which were changed, added or taken away; all anew if most files were."""
        had = self.rows.filter(F.startswith("term", F.lit(HASH))).select("term", F.explode("found").alias("f")).select(F.col("f.file_id").alias("file_id"), F.col("term").alias("old"), F.col("f.n").alias("had"))
        both = files.select("file_id", F.coalesce("content_hash", F.lit(HASH)).alias("new")).join(had, "file_id", "full")
        dirty = written(both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("file_id", "had"), "dirty-files")
        changed, n = dirty.count(), self.blocks()
        if not changed:
            return
        if 2 * changed > both.count():
            self._build(files, chunks, _parts(n))
            return
        ids = dirty.select("file_id")
        current = files.join(ids, "file_id", "left_semi")
        new = written(self._rows(current, self._cut(chunks(current)), n), "index-rows")
        old = dirty.filter("had is not null").select("file_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("had") / BLOCK).cast("int"))).alias("k"))
        held = old.select((_block(F.col("file_id"), F.col("k") * BLOCK, n) % _parts(n)).alias("part")).unionByName(new.select("part"))
        parts = [r.part for r in held.distinct().collect()]
        of_parts = self.table.read(values=parts)
        each = lambda rows: rows.filter(F.col("term") != BLOCKS).select("part", "block", "term", F.explode("found").alias("f")).select("part", "block", "term", "f.*")
        postings = each(of_parts).join(ids, "file_id", "left_anti").unionByName(each(new))
        rows = postings.groupBy("part", "block", "term").agg(F.max("n").alias("most"), F.array_sort(F.collect_list(F.struct("chunk_id", "n", "file_id"))).alias("found"))
        self.table.replace(rows.unionByName(of_parts.filter(F.col("term") == BLOCKS).select(rows.columns)), parts)
        self.rows = self.table.read()

    def search(self, terms: DataFrame, limit: int = 24, broadcast_terms: int = BROADCAST_TERMS, log: dict[str, int] | None = None) -> DataFrame:
        """``query_id, chunk_id, n, rank`` of the best chunks of each query (query_id, term), ties by chunk.

        ``log`` gets how many blocks of queries there were and how many were scored.
        """
        if terms.limit(broadcast_terms + 1).count() > broadcast_terms:
            each = self.rows.join(terms, "term").select("query_id", F.explode("found").alias("f"))
            summed = each.groupBy("query_id", F.col("f.chunk_id").alias("chunk_id")).agg(F.sum("f.n").alias("n"))
            return top_per_key(summed, ["query_id"], [F.desc("n"), F.asc("chunk_id")], limit)
        asked: dict[str, list[int]] = {}
        for r in terms.collect():
            asked.setdefault(r.term, []).append(r.query_id)
        rows = self.rows.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        bounds = written(rows.select("block", "term", "most").join(F.broadcast(terms), "term").groupBy("query_id", "block").agg(F.sum("most").alias("bound")), "bounds")
        first = written(top_per_key(bounds, ["query_id"], [F.desc("bound"), F.asc("block")], FIRST).drop("rank"), "first-blocks")
        best = written(self._scored(rows, first, asked, limit), "first-hits")
        low = top_per_key(best, ["query_id"], [F.desc("n"), F.asc("chunk_id")], limit).filter(F.col("rank") == limit).select("query_id", F.col("n").alias("least"))
        open_ = bounds.join(first, ["query_id", "block"], "left_anti").join(low, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_id", "block")
        rest = written(open_, "open-blocks")
        if log is not None:
            log |= {"blocks": bounds.count(), "scored": first.count() + rest.count()}
        found = best.unionByName(self._scored(rows, rest, asked, limit))
        return top_per_key(found, ["query_id"], [F.desc("n"), F.asc("chunk_id")], limit)

    def _scored(self, rows: DataFrame, pairs: DataFrame, asked: dict[str, list[int]], limit: int) -> DataFrame:
        """``query_id, chunk_id, n``: the best chunks of each (query_id, block)."""
        wanted = pairs.groupBy("block").agg(F.collect_list("query_id").alias("queries"))
        lists = rows.join(wanted.select("block"), "block", "left_semi").groupBy("block").agg(F.collect_list("term").alias("terms"), F.collect_list("found.chunk_id").alias("ids"), F.collect_list("found.n").alias("ns"))
        shared = self.spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    queries = set(batch.column("queries")[i].as_py())
                    ids, ns = batch.column("ids")[i].values, batch.column("ns")[i].values
                    chunks, at = np.unique(ids.flatten().to_numpy(), return_inverse=True)
                    counts, ends = ns.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
                    sums = {q: np.zeros(len(chunks), np.int64) for q in queries}
                    for k, term in enumerate(batch.column("terms")[i].as_py()):
                        where, n = at[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]
                        for q in shared.value[term]:
                            if q in queries:
                                sums[q][where] += n
                    out = [(q, chunks[top], s[top]) for q, s in sums.items() for top in [np.argsort(-s, kind="stable")[:limit]]]
                    out = [(q, c[n > 0], n[n > 0]) for q, c, n in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in out], [len(c) for _, c, _ in out]).astype(np.int64)), pa.array(np.concatenate([c for _, c, _ in out])), pa.array(np.concatenate([n for _, _, n in out]))], ["query_id", "chunk_id", "n"])

        return lists.join(wanted, "block").select("queries", "terms", "ids", "ns").mapInArrow(run, "query_id bigint, chunk_id bigint, n bigint")
