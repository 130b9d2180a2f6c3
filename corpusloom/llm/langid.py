"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its
words. Piece probabilities are learned by expectation maximisation, whose expectations are aggregated
by Spark over a bounded sample of texts of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import Texts, Words, byte_set, mix, pieces, span_hashes
from ._rows import map_batches, map_texts
from ._store import written

#: Runs of ASCII letters and of everything beyond ASCII.
LETTERS = byte_set(r"A-Za-z\x80-\xFF")
_ASCII = byte_set("A-Za-z")
#: Pieces of more letters aren't in the vocabulary used here.
LONGEST = 16
#: Letters up to which runs of one length are summed side by side; longer ones go one by one, and are learned from in stretches.
STRETCH = 32
#: Each character's probability is scaled by this, so that products stay within doubles.
SCALE = 300.0
UNKNOWN, SMOOTH = 1e-5, 0.05
#: Texts of each language that are learned from, at most, in expectation; rounds of learning.
SAMPLE, ROUNDS = 1000, 3
#: Words a worker remembers the scores of.
REMEMBER = 1_000_000

_BASE = np.uint64(0xA0761D6478BD642F)
_UP = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(STRETCH + 2, _BASE, np.uint64)])
_DOWN = np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(STRETCH + 2, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)])
_START = 0x2581


def _prefix(points: np.ndarray) -> np.ndarray:
    """Prefix sums of character hashes, along the last axis."""
    terms = mix(points.astype(np.uint64) + np.uint64(0x1F3)) * _UP[: points.shape[-1]]
    return np.concatenate([np.zeros((*points.shape[:-1], 1), np.uint64), np.cumsum(terms, axis=-1, dtype=np.uint64)], axis=-1)


class Vocabulary:
    """Pieces by hash: sorted hashes, their numbers, and a table that rules most other strings out."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        hashes = np.array([_prefix(np.array([ord(c) for c in t], np.uint64))[-1] for t in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(hashes)] = True
        self.longest = max(map(len, texts), default=1)

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(44)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, as indices, and the pieces' numbers."""
        there = np.flatnonzero(self.maybe[self._slot(hashes)])
        at = np.searchsorted(self.hashes, hashes[there])
        at[at == self.n] = 0
        hit = self.hashes[at] == hashes[there]
        return there[hit], self.number[at[hit]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(sorted({p for p in (model.id_to_piece(i) for i in ids) if len(p) <= LONGEST and p == p.lower()}))


def _matrices(words: list[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owners and code points of words (owner, lower-case letters), by length."""
    rows: dict[int, tuple[list[int], list[str]]] = {}
    for owner, word in words:
        owners, parts = rows.setdefault(len(word), ([], []))
        owners.append(owner)
        parts.append(word)
    for n, (owners, parts) in rows.items():
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).reshape(-1, n)
        yield np.array(owners), np.concatenate([np.full((len(points), 1), _START, np.uint32), points], 1)


def _by_length(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[int, np.ndarray]]]:
    """Words with their number: those of up to ``STRETCH`` letters, and the code points of longer ones."""
    short, long = [], []
    for i, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        word = raw[s:e].lower().decode("utf-8", "replace")
        if len(word) <= STRETCH:
            short.append((i, word))
        else:
            long.append((i, np.array([_START, *map(ord, word)], np.uint32)))
    return short, long


def _edges(points: np.ndarray, words: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces in equally long words, by end and then length: (start, end, words, pieces)."""
    prefix, n = _prefix(points), points.shape[1]
    for j in range(1, n + 1):
        for size in range(1, min(j, words.longest) + 1):
            i = j - size
            rows, found = words.find((prefix[:, j] - prefix[:, i]) * _DOWN[i])
            if len(rows):
                yield i, j, rows, found


def forward(points: np.ndarray, words: Vocabulary, theta: np.ndarray) -> tuple[np.ndarray, list]:
    """Scaled sums over all segmentations up to each character (n + 1, words, languages), and the pieces used, None for a character by itself."""
    n = points.shape[1]
    alpha = np.zeros((n + 1, len(points), theta.shape[1]))
    alpha[0] = 1.0
    used, last = [], 0

    def close(j: int) -> None:
        # A character that no piece reaches is a piece by itself.
        alone = np.flatnonzero(alpha[j, :, 0] == 0)
        if len(alone):
            alpha[j, alone] = alpha[j - 1, alone] * (UNKNOWN * SCALE)
            used.append((j - 1, j, alone, None))

    for i, j, rows, found in _edges(points, words):
        while last < j - 1:
            last += 1
            close(last)
        alpha[j, rows] += alpha[i, rows] * theta[found] * SCALE ** (j - i)
        used.append((i, j, rows, found))
    while last < n:
        last += 1
        close(last)
    return alpha, used


def _all_pieces(points: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End, size and number of all pieces in one run, by end."""
    n = len(points)
    terms = mix(points.astype(np.uint64) + np.uint64(0x1F3))
    hashes = np.zeros(n, np.uint64)
    ends, sizes, numbers = [], [], []
    for size in range(1, min(n, words.longest) + 1):
        hashes = hashes[: n - size + 1] + terms[size - 1 :] * _UP[size - 1]
        at, found = words.find(hashes)
        ends.append(at + size)
        sizes.append(np.full(len(at), size))
        numbers.append(found)
    end, size, number = (np.concatenate(x) for x in (ends, sizes, numbers))
    order = np.argsort(end, kind="stable")
    return end[order], size[order], number[order]


def log_sum(points: np.ndarray, words: Vocabulary, theta: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of one run of any length, by language.

    All pieces in it are found at once; the sums go on from end to end with the last ``longest`` of
    them held, rescaled as they go.
    """
    n, longest = len(points), words.longest
    end, size, number = _all_pieces(points, words)
    cut = np.searchsorted(end, np.arange(1, n + 2))
    held, scale = np.zeros((longest + 1, theta.shape[1])), np.zeros(theta.shape[1])
    held[0] = 1.0
    for j in range(1, n + 1):
        a, b = cut[j - 1], cut[j]
        if a < b:
            held[j % (longest + 1)] = (held[(j - size[a:b]) % (longest + 1)] * theta[number[a:b]] * SCALE ** size[a:b, None]).sum(0)
        else:
            held[j % (longest + 1)] = held[(j - 1) % (longest + 1)] * (UNKNOWN * SCALE)
        if j % longest == 0:
            top = np.maximum(held.max(0), 1e-300)
            held /= top
            scale += np.log(top)
    return np.log(np.maximum(held[n % (longest + 1)], 1e-300)) + scale - n * np.log(SCALE)


def run_expectations(points: np.ndarray, words: Vocabulary, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and how often each is expected in one run of any length, in one language, over all its segmentations.

    Logs of the sums up to each letter and from each letter on; a piece's share is what goes through it.
    """
    n, log_theta, alone = len(points), np.log(theta), np.log(UNKNOWN)
    end, size, number = _all_pieces(points, words)
    start = end - size
    weight = log_theta[number]
    to = np.searchsorted(end, np.arange(1, n + 2))
    ahead = np.zeros(n + 1)
    for j in range(1, n + 1):
        a, b = to[j - 1], to[j]
        ahead[j] = np.logaddexp.reduce(ahead[start[a:b]] + weight[a:b]) if a < b else ahead[j - 1] + alone
    order = np.argsort(start, kind="stable")
    since = np.searchsorted(start[order], np.arange(n + 1))
    behind = np.full(n + 1, -np.inf)
    behind[n] = 0.0
    for i in range(n - 1, -1, -1):
        on = order[since[i] : since[i + 1]]
        ways = behind[end[on]] + weight[on]
        if to[i] == to[i + 1]:  # no piece ends at the next letter, which so stands by itself
            ways = np.append(ways, behind[i + 1] + alone)
        behind[i] = np.logaddexp.reduce(ways) if len(ways) else -np.inf
    return number, np.exp(ahead[start] + weight + behind[end] - ahead[n])


@dataclass
class Model:
    languages: list[str]
    log_theta: np.ndarray
    path: str


def uniform(languages: list[str], path: str) -> Model:
    n = vocabulary(path).n
    return Model(languages, np.full((n, len(languages)), -np.log(n)), path)


class Scorer:
    """Log probabilities of words in every language, remembered by hash."""

    def __init__(self, model: Model):
        self.words, self.theta = vocabulary(model.path), np.exp(model.log_theta)
        self.languages = model.languages
        self._clear()

    def _clear(self) -> None:
        k = len(self.languages)
        self.parts = [(np.zeros(0, np.uint64), np.zeros((0, k), np.float32)) for _ in range(2)]

    def compute(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """As 32-bit numbers, which is what is remembered, so a word has one score whenever it is asked for."""
        out = np.zeros((len(start), len(self.languages)))
        short, long = _by_length(raw, start, end)
        for i, points in long:
            out[i] = log_sum(points, self.words, self.theta)
        for owners, points in _matrices(short):
            alpha, _ = forward(points, self.words, self.theta)
            out[owners] = np.log(np.maximum(alpha[-1], 1e-300)) - points.shape[1] * np.log(SCALE)
        return out.astype(np.float32)

    def of_words(self, texts: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the distinct words and which of them each word is."""
        hashes, example, inverse = np.unique(span_hashes(texts.buf, start, end, lower=True), return_index=True, return_inverse=True)
        if sum(len(p[0]) for p in self.parts) > REMEMBER:
            self._clear()
        out, there = np.zeros((len(hashes), len(self.languages)), np.float32), np.zeros(len(hashes), bool)
        for keys, rows in self.parts:
            if len(keys):
                i = np.searchsorted(keys, hashes)
                i[i == len(keys)] = 0
                hit = keys[i] == hashes
                out[hit] = rows[i[hit]]
                there |= hit
        new = ~there
        if new.any():
            out[new] = self.compute(texts.buf.tobytes(), start[example[new]], end[example[new]])
            self._remember(hashes[new], out[new])
        return out, inverse

    def _remember(self, keys: np.ndarray, rows: np.ndarray) -> None:
        def merged(a: tuple, b: tuple) -> tuple:
            at = np.searchsorted(a[0], b[0])
            return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1], axis=0)

        recent = merged(self.parts[1], (keys, rows))
        self.parts = [self.parts[0], recent] if len(recent[0]) < 60_000 else [merged(self.parts[0], recent), (recent[0][:0], recent[1][:0])]


def expectations(column: pa.Array, langs: np.ndarray, model: Model) -> np.ndarray:
    """Expected piece counts (pieces, languages) of texts whose language numbers are given."""
    vocab, out = vocabulary(model.path), np.zeros_like(model.log_theta)
    texts = Texts(column)
    words = Words(texts, LETTERS)
    hashes, of = words.hashes(lower=True), langs[words.doc]
    raw = texts.buf.tobytes()
    for k in np.unique(of):
        mine = np.flatnonzero(of == k)
        _, example, counts = np.unique(hashes[mine], return_index=True, return_counts=True)
        theta = np.exp(model.log_theta[:, [k]])
        short, long = _by_length(raw, words.start[mine[example]], words.end[mine[example]])
        for i, points in long:
            found, n = run_expectations(points, vocab, theta[:, 0])
            np.add.at(out[:, k], found, n * counts[i])
        for owners, points in _matrices(short):
            alpha, used = forward(points, vocab, theta)
            beta = np.zeros_like(alpha)
            beta[-1] = counts[owners][:, None] / np.maximum(alpha[-1], 1e-300)
            for i, j, rows, found in reversed(used):
                if found is None:
                    beta[i, rows] += beta[j, rows] * (UNKNOWN * SCALE)
                    continue
                flow = beta[j, rows] * theta[found] * SCALE ** (j - i)
                np.add.at(out[:, k], found, (alpha[i, rows] * flow)[:, 0])
                beta[i, rows] += flow
    return out


def train(docs: DataFrame, path: str, held_in: Column, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learn from the texts of rows with ``held_in`` and a language, about ``sample`` of each at most, by their ids' hashes.

    Rows without text or language are left out; with none left the model has no languages. Of texts of
    one id all are in the sample or none. Runs of letters are learned from whole, however long.
    """
    known = docs.filter(held_in & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return uniform([], path)
    slots = 1 << 30
    bound = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(slots * min(1.0, sample / sizes[lang])))])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    chosen = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(slots)) < bound[F.col("lang")])
    chosen = written(chosen.select("text", number[F.col("lang")].alias("k")).repartition(spark_tasks(docs)), "language-sample")
    model = uniform(languages, path)
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(shared.value.log_theta)
            for batch in batches:
                for part in pieces(batch):
                    total += expectations(part.column(0), np.asarray(part.column(1)), shared.value)
            piece, k = np.nonzero(total)
            if len(piece):
                yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], ["piece", "k", "n"])

        rows = map_batches(chosen, run, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full_like(model.log_theta, SMOOTH)
        counts[rows["piece"], rows["k"]] += rows["n"]
        model = Model(languages, np.log(counts / counts.sum(0)), path)
    return model


def spark_tasks(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``result`` (lang_pred, score) of each document.

    The score is the share of the best language in the sum of all, languages weighing the same; ties
    go to the first by name. Null texts and those without a letter are ``und`` with score 0, and so
    are all texts if no language was learned. Repeated rows get the same prediction each, an empty
    table none; whole texts are summed, however long they or their words are. Carried columns are in
    ``row``, so their names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []

    def run(column: pa.Array) -> list[pa.Array]:
        if not held:
            held.append(_scorer(shared))
        scorer = held[0]
        texts = Texts(column)
        words = Words(texts, LETTERS)
        letters = texts.per_doc(_ASCII[texts.buf]) > 0
        for i in np.flatnonzero(~letters & (words.counts > 0)).tolist():
            letters[i] = any(c.isalpha() for c in column[i].as_py())
        k = len(scorer.languages)
        if not k or not len(words):
            sums = np.zeros((texts.n, max(k, 1)))
        else:
            scores, inverse = scorer.of_words(texts, words.start, words.end)
            scores = scores.astype(float)
            sums = np.stack([np.bincount(words.doc, scores[inverse, c], texts.n) for c in range(k)], 1)
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        ok = letters & (k > 0)
        return [pa.array([scorer.languages[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist(), strict=True)]), pa.array(np.where(ok, share, 0.0))]

    return map_texts(docs, run, "lang_pred string, score double", carry=carry)


_scorers: list[tuple[Model, Scorer]] = []


def _scorer(shared) -> Scorer:  # noqa: ANN001
    """One scorer for each worker and model, so that words stay known from task to task."""
    model = shared.value
    if not _scorers or _scorers[0][0] is not model:
        _scorers[:] = [(model, Scorer(model))]
    return _scorers[0][1]
