"""Near-duplicate documents by a Chosen Path set similarity join.

A document's set is its distinct word shingles. Equal sets are one class, found by a hash of the
set, and only classes are compared. Each class has a sketch of minwise values. In each of ``TREES``
independent trees a node sends a class to one child for each of two coordinates, picked by the
node's own hash: the child named by that coordinate and its minwise value. Two classes of
similarity 0.8 part on both coordinates of a node in 4 per cent of cases only, and such a pair
survives a tree of any depth with probability 0.937, four trees with 0.99998.

Nodes of ``Limits.node`` classes or fewer are compared exhaustively by sketch, and close classes
tied. A larger one branches again as long as it has half of its parent's classes or fewer, so all
nodes of a level never hold more than those of the one before; one with more than half of them is
of classes alike and is tied as a whole. Ties only say what has to be compared: each component of them is compared exhaustively on full sets, by one task if
it is small and block against block if it is not. In a component of very many blocks all classes
are held against its leader first, and only those that it doesn't take go through all blocks. No
rows are dropped or capped on the way, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import NON_SPACE, Texts, Words, gram_hashes, mix
from ._rows import map_batches, map_texts, with_group
from ._store import written
from .components import connected

SHINGLE, PERCENT = 5, 80
TREES, COORDINATES = 4, 64


@dataclass(frozen=True)
class Limits:
    """How much one task takes; every way round them gives the same links."""

    #: Classes that one task compares by sketch.
    node: int = 4096
    #: Classes and shingles of a block of full sets; a task has two blocks at most.
    block: int = 1024
    weight: int = 1 << 20
    #: Blocks of a component beyond which a leader goes first.
    many: int = 8


#: Sketches may miss the asked similarity by so many deviations before full sets are not looked at.
SLACK = 4.5

_ODD = np.random.default_rng(11).integers(0, 1 << 63, (COORDINATES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and how many each text has."""
    words = Words(Texts(column), NON_SPACE)
    n = words.texts.n
    hashes, counts = words.hashes(lower=True), words.counts
    whole = np.flatnonzero(words.inside(shingle))
    values, doc = gram_hashes(hashes, shingle)[whole], words.doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        extra = np.array([gram_hashes(hashes[words.first[d] : words.first[d + 1]], int(counts[d]))[0] for d in short], np.uint64)
        values, doc = np.r_[values, extra], np.r_[doc, short]
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    if len(values):
        new = np.r_[True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])]
        values, doc = values[new], doc[new]
    return values, np.bincount(doc, minlength=n)


def _class_ids(values: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set; None for empty ones."""
    ends = np.cumsum(sizes)
    sums = []
    for salt in (np.uint64(0x51), np.uint64(0xA3)):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values + salt), out=total[1:])
        sums.append(mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)))
    both = np.stack(sums, 1).astype(">u8")
    return [row.tobytes() if s else None for row, s in zip(both, sizes, strict=True)]


def _sketches(values: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    out = np.zeros((len(sizes), COORDINATES), np.uint32)
    for c, (a, b) in enumerate(_ODD):
        if len(some):
            out[some, c] = np.minimum.reduceat(values * a + b, starts) >> np.uint64(32)
    return [row.tobytes() if s else None for row, s in zip(out, sizes, strict=True)]


def sketch(docs: DataFrame, shingle: int, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``n_shingles, cid, sketch`` of each document."""

    def run(column: pa.Array) -> list[pa.Array]:
        values, sizes = shingle_sets(column, shingle)
        return [pa.array(sizes.astype(np.int64)), pa.array(_class_ids(values, sizes), pa.binary()), pa.array(_sketches(values, sizes), pa.binary())]

    return map_texts(docs, run, "n_shingles bigint, cid binary, sketch binary", carry=carry).select("row.*", "result.*")


def _branch(classes: DataFrame) -> DataFrame:
    """Children (key, cid, of) of classes in nodes: columns key, cid, sketch, and of, how many classes the node has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(0)).view(np.uint64)
            rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            pick = mix(key ^ np.uint64(0x2545F491))
            one = pick % np.uint64(COORDINATES)
            two = (one + np.uint64(1) + (pick >> np.uint64(32)) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
            for c in (one, two):
                value = rows[np.arange(len(rows)), c.astype(np.int64)].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(mix(key ^ mix(value << np.uint64(8) | c)).view(np.int64)), batch.column(1), batch.column(3)], ["key", "cid", "of"])

    return map_batches(classes.select("key", "cid", "sketch", F.col("of").cast("bigint").alias("of")), run, "key bigint, cid binary, of bigint")


def _nodes(members: DataFrame) -> DataFrame:
    """``key, n, of`` of the nodes with two classes or more, once for each set of members; ``of`` is its parent's size."""
    marks = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(name) for i, name in enumerate("xy")]
    return members.groupBy("key").agg(F.count("*").alias("n"), F.first("of").alias("of"), *marks).filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("key", "of")).alias("one")).select("one.key", "n", "one.of")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and keys[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(found: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[bytes, bytes]] = []
    for row in found:
        rows.append(row)
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], ["a", "b"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], ["a", "b"])


def _least(percent: int) -> int:
    """Coordinates that sketches of similar sets share at the least."""
    p = percent / 100
    return int(np.floor(COORDINATES * max(0.0, p - SLACK * np.sqrt(p * (1 - p) / COORDINATES))))


def _tied(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) that connect the classes with close sketches in each node."""
    rows = members.join(classes.select("cid", "sketch"), "cid").select("key", "cid", "sketch").repartition("key").sortWithinPartitions("key")
    least = _least(percent)

    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for node in groups(batches, "key"):
            cids = node.column("cid").to_pylist()
            sketches = np.frombuffer(b"".join(node.column("sketch").to_pylist()), np.uint32).reshape(len(cids), -1)
            left = np.arange(len(cids))  # not reached yet
            while len(left):
                front, left = [int(left[0])], left[1:]
                root = front[0]
                while front and len(left):
                    near = (sketches[left] == sketches[front.pop()]).sum(1) >= least
                    reached, left = left[near].tolist(), left[~near]
                    front += reached
                    yield from ((cids[x], cids[root]) for x in reached)

    return map_batches(rows, lambda batches: _pairs(ties(batches)), "a binary, b binary")


def common_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many values each set of ``a`` shares with each of ``b`` (of ``a`` itself by default).

    Values in many sets are counted by matrix products over parts of the columns, others pair by pair.
    """
    sets = a if b is None else [*a, *b]
    n, first = len(sets), len(a)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((first, n - first if b is not None else n), np.int32)
    dense = times >= max(16, n // 16)
    column = np.cumsum(dense) - 1
    many = dense[value]
    rows, columns = owner[many], column[value[many]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    width = 2048
    for at in range(0, int(dense.sum()), width):
        s, e = np.searchsorted(columns, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[rows[s:e], columns[s:e] - at] = 1
        out += (part[:first] @ (part if b is None else part[first:]).T).astype(np.int32)
    few = ~many & (times > 1)[value]
    order = np.lexsort((owner[few], value[few]))
    rows, values = owner[few][order], value[few][order]
    for k in range(1, int(times[~dense].max(initial=1))):
        same = values[k:] == values[:-k]
        if not same.any():
            break
        i, j = rows[:-k][same], rows[k:][same]
        if b is None:
            out += np.bincount(i * n + j, minlength=n * n).reshape(n, n)
            out += np.bincount(j * n + i, minlength=n * n).reshape(n, n)
        else:
            across = (i < first) & (j >= first)
            out += np.bincount(i[across] * (n - first) + j[across] - first, minlength=out.size).reshape(out.shape)
    return out


def _linked(sets: list[np.ndarray], sides: np.ndarray, taken: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of places that connect what similar sets connect; those in ``taken`` are connected already."""
    n = len(sets)
    first = int((sides == 0).sum())
    cross = first < n
    common = common_counts(sets[:first], sets[first:] if cross else None)
    size = np.array([len(x) for x in sets], np.int64)
    right = size[None, first:] if cross else size[None, :]
    near = np.zeros(common.shape, bool)
    for at in range(0, first, 256):  # whole numbers, some rows at a time
        part = common[at : at + 256].astype(np.int64)
        near[at : at + 256] = 100 * part >= percent * (size[at : min(at + 256, first), None] + right - part)
    reached, pairs = np.zeros(n, bool), []
    held = np.flatnonzero(taken)
    for root in range(n):
        if reached[root]:
            continue
        reached[root] = True
        front = [root]
        while front:
            x = front.pop()
            if taken[x] and not reached[held].all():
                joined = held[~reached[held]]
            elif not cross:
                joined = np.flatnonzero(near[x] & ~reached)
            elif x < first:
                joined = first + np.flatnonzero(near[x] & ~reached[first:])
            else:
                joined = np.flatnonzero(near[:, x - first] & ~reached[:first])
            if len(joined):
                reached[joined] = True
                front += [x, *joined.tolist()]
                pairs += [(root, int(j)) for j in joined]
    return pairs


def _compared(work: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is similar in each task: columns task, side, taken, cid, values."""
    rows = work.select("task", "side", "taken", "cid", "values").repartition("task").sortWithinPartitions("task", "side")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for task in groups(batches, "task"):
            cids = task.column("cid").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in task.column("values").to_pylist()]
            sides, taken = (np.array(task.column(c).to_pylist()) for c in ("side", "taken"))
            yield from ((cids[i], cids[j]) for i, j in _linked(sets, sides, taken.astype(bool), percent))

    return map_batches(rows, lambda batches: _pairs(links(batches)), "a binary, b binary")


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("cid", F.lit("block")), n).cast("int")


def _tasks(members: DataFrame, blocks: Column, rest: Column, rests: Column) -> DataFrame:
    """``task, side, taken, cid`` of components (comp, cid): every pair of blocks of which one is in the rest.

    The rest is dealt into ``rests`` blocks, what a leader has taken into ``blocks``. Blocks of the
    rest meet themselves, one another and all other blocks.
    """
    m = members.withColumns({"_rest": rest, "_rests": rests, "_blocks": blocks}).withColumn("_own", F.when(F.col("_rest"), _block(F.col("_rests"))).otherwise(_block(F.greatest("_blocks", F.lit(1)))))
    pair = lambda kind, i, j, side: F.struct(F.xxhash64("comp", F.lit(kind), i, j).alias("task"), F.lit(side).alias("side"))
    own, upto = F.col("_own"), lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(upto("_rests"), lambda i: F.when(i < own, pair("rest", i, own, 1)).otherwise(pair("rest", own, i, 0)))
    outside = F.transform(upto("_blocks"), lambda j: pair("taken", own, j, 0))
    tasks = F.when(F.col("_rest"), F.concat(among, outside)).otherwise(F.transform(upto("_rests"), lambda i: pair("taken", i, own, 1)))
    return m.select("cid", (~F.col("_rest")).cast("int").alias("taken"), F.explode(tasks).alias("t")).select("t.*", "taken", "cid")


def _is_similar(percent: int) -> Column:
    """Whether the packed sets x and y are similar."""

    @F.pandas_udf("boolean")
    def check(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y, strict=True)], dtype=bool)

    return check("x", "y")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a ∩ b| >= percent |a ∪ b|, for sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _ties(classes: DataFrame, percent: int, trees: int, limits: Limits) -> DataFrame:
    """Ties of all trees: whatever is similar is connected by them, with the recall of the trees."""
    roots = F.explode(F.array(*[F.lit(t).cast("bigint") for t in range(1, trees + 1)]))
    members = written(_branch(classes.select(roots.alias("key"), "cid", "sketch", F.lit(classes.count()).alias("of"))), "members")
    ties = []
    while True:
        nodes = written(_nodes(members), "nodes")
        ties.append(_tied(members.join(nodes.filter(F.col("n") <= limits.node), "key", "left_semi"), classes, percent))
        large = nodes.filter(F.col("n") > limits.node)
        alike = large.filter("2 * n > of").select("key")
        if not alike.isEmpty():
            big = members.join(alike, "key", "left_semi").select("key", "cid")
            ties.append(with_group(big, ["key"], F.col("cid"), {"b": (F.min("cid"), F.min)}).select(F.col("cid").alias("a"), "b"))
        parted = large.filter("2 * n <= of").select("key", F.col("n").alias("of"))
        if parted.isEmpty():
            return written(_union(ties), "ties")
        members = written(_branch(members.drop("of").join(parted, "key").join(classes.select("cid", "sketch"), "cid")), "members")


def _links(docs: DataFrame, classes: DataFrame, percent: int, shingle: int, trees: int, limits: Limits) -> DataFrame:
    """Links (a, b) of classes on full sets, as many as connect what is similar."""
    parts = connected(_ties(classes, percent, trees, limits))
    members = written(parts.select(F.col("node").alias("cid"), F.col("root").alias("comp")).join(classes, "cid").select("cid", "comp", "doc_id", "n_shingles", "copies"), "compared")
    best = F.struct("copies", "cid")
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.max_by("cid", best).alias("lead"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("n") / limits.block), F.ceil(F.col("weight") / limits.weight)).cast("int"))
    sizes = written(sizes, "components")
    sets = sets_of(docs, members, shingle)
    placed = members.join(sizes, "comp")
    whole = _tasks(placed.filter(F.col("blocks") <= limits.many), F.lit(0), F.lit(True), F.col("blocks"))
    found = []
    of_many = F.col("blocks") > limits.many
    if not sizes.filter(of_many).isEmpty():
        big = placed.filter(of_many).select("cid", "comp", "lead", "n_shingles", "blocks").withColumn("salt", _block(F.col("blocks")))
        leads = sizes.filter(of_many).join(sets.select(F.col("cid").alias("lead"), F.col("values").alias("y")), "lead").select("comp", "y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
        held = big.join(sets.select("cid", F.col("values").alias("x")), "cid").join(leads, ["comp", "salt"]).select("cid", "comp", "lead", "n_shingles", _is_similar(percent).alias("taken"))
        held = written(held, "led")
        found.append(held.filter("taken and cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")))
        amount = lambda mine, name: F.ceil(F.greatest(F.count_if(mine) / limits.block, F.sum(F.when(mine, F.col("n_shingles")).otherwise(0)) / limits.weight)).cast("int").alias(name)
        counts = held.groupBy("comp").agg(amount(F.col("taken"), "n_taken"), amount(~F.col("taken"), "n_rest")).filter("n_rest > 0")
        whole = whole.unionByName(_tasks(held.join(counts, "comp"), F.col("n_taken"), ~F.col("taken"), F.col("n_rest")))
    found.append(_compared(whole.join(sets, "cid"), percent))
    return written(_union(found), "links")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def sets_of(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``cid, values``: the full set of each of the classes, from the text of its representative."""
    wanted = classes.select("cid", F.col("doc_id").alias("rep"))
    texts = docs.select("doc_id", "text").join(wanted.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def run(column: pa.Array) -> list[pa.Array]:
        values, sizes = shingle_sets(column, shingle)
        ends = np.cumsum(sizes)
        return [pa.array(_class_ids(values, sizes), pa.binary()), pa.array([values[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())]

    made = map_texts(texts, run, "cid binary, values binary", carry=[]).select("result.*")
    # A null id stands for several rows, and rows may repeat: what isn't asked for goes, and of equal sets all but one.
    return written(made.join(wanted.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.first("values").alias("values")), "sets")


def _grouped(docs: DataFrame, shingle: int, percent: int, trees: int, limits: Limits, carry: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of documents with the carried columns, the classes of equal sets, and ``node, root`` of the linked classes."""
    sketches = written(sketch(docs, shingle, carry), "sketches")
    one = F.min_by(F.struct("doc_id", "n_shingles", "sketch"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("one")
    classes = sketches.filter("cid is not null").groupBy("cid").agg(one, F.count("*").alias("copies")).select("cid", "copies", "one.*")
    classes = written(classes, "classes")
    return sketches, classes, connected(_links(docs, classes, percent, shingle, trees, limits))


def similarity_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, n_shingles, cid, component_id`` of each document.

    Documents of ``percent`` or more shared shingles are linked, and the least doc_id that links lead
    to names the component. Null and empty texts have empty sets and are components of their own;
    repeated rows and equal sets share one. Null ids never name a component with other ids in it. Very
    long texts count with all their shingles, an empty table gives no rows, and columns other than
    doc_id and text aren't read.
    """
    sketches, classes, labels = _grouped(docs, shingle, percent, trees, limits)
    named = classes.select("cid", "doc_id").join(labels.withColumnRenamed("node", "cid"), "cid")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    of_class = classes.select("cid", F.col("doc_id").alias("own")).join(named.select("cid", "root").join(least, "root").select("cid", "component"), "cid", "left").select("cid", F.coalesce("component", "own").alias("component"))
    return sketches.select("doc_id", "n_shingles", "cid").join(of_class, "cid", "left").select("doc_id", "n_shingles", "cid", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: kept where the document names its component."""
    found = similarity_classes(docs, shingle, percent, trees, limits)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, limits: Limits = Limits()) -> DataFrame:
    """One row of each component, one with the least id; null ids come last and stand for rows of their own.

    Rows are told apart by id and text, so nothing goes because its id is null or repeats that of
    another text; of rows equal in both one is left. Null and empty texts are components of their own.
    All columns come through, whatever they are called; an empty table stays empty.
    """
    digest = lambda c: F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit(""))
    key = F.unhex(F.sha2(F.concat(digest("doc_id"), F.lit("|"), digest("text")), 256))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    sketches, _, labels = _grouped(docs.select("doc_id", "text", key.alias("key")), shingle, percent, trees, limits, ("doc_id", "key"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("best")
    of_class = sketches.groupBy(F.coalesce("cid", "key").alias("node")).agg(best)
    of_part = of_class.join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("part")).agg(F.min("best").alias("best"))
    return rows.join(of_part.select("best.key"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
