"""Masked pseudo-likelihood: a bidirectional window network scores every document.

Each word is predicted from ``REACH`` words on both sides; the sum of the
conditional log-probabilities scores the document.

The vocabulary is counted over the whole corpus: the most frequent words have ids
of their own, the others share classes by their last letters.  The network (word
vectors of the window, a hidden layer, a softmax) is written in numpy.  It is
trained on the whole corpus in rounds: every partition runs stochastic gradient
steps on its share of the windows, every word of each document, starting from the
common weights, and the results are averaged by the number of words they come from.

A word without an id of its own has the probability of its class, given the window,
times its share of the class in the corpus, so every word has its own probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medley.session import cut

REACH = 2  # words on each side
FREQUENT = 191
CLASSES = 64  # shared by all other words
EDGE = 0  # id of the place before the first word and after the last
SIZE = 1 + FREQUENT + CLASSES
WIDTH = 16
HIDDEN = 32
STRIDE = 1  # every so many-th word of a document is a training target
ROUNDS = 2
BATCH = 512
RATE = 0.1
COUNTS_HELD = 200_000
WORDS_AT_ONCE = 65_536
KNOWN = 100_000  # words whose corpus counts every task holds; the other counts are joined
SAFE = 80.0  # single precision holds the exponential of every number up to this size
SHIFTS = np.array([s for s in range(-REACH, REACH + 1) if s])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts: lower-cased words at white space, counted per partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update((text or "").lower().split())
                if len(counts) > COUNTS_HELD:
                    yield from flush()
        yield from flush()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, count: int = FREQUENT) -> list[str]:
    """The most frequent words of the corpus, equal counts by word."""
    return [r["word"] for r in word_counts(docs).orderBy(F.col("n").desc(), "word").limit(count).collect()]


class Coder(dict):
    """Ids of words; those of the last words seen are remembered."""

    def __init__(self, frequent: list[str]):
        super().__init__()
        self.frequent = {w: 1 + i for i, w in enumerate(frequent)}

    def __missing__(self, word: str) -> int:
        code = self.frequent.get(word)
        if code is None:
            code = 1 + FREQUENT + zlib.crc32(word[-3:].encode()) % CLASSES
        if len(self) > COUNTS_HELD:
            self.clear()
        self[word] = code
        return code

    def code(self, text: str | None) -> bytes:
        return bytes(map(self.__getitem__, (text or "").lower().split()))


def coded(docs: DataFrame, frequent: list[str]) -> DataFrame:
    """(doc_id, words): the text as one byte for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequent)
        for batch in batches:
            codes = [coder.code(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["doc_id", "words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, words binary"
    )


@dataclass
class Network:
    vectors: np.ndarray  # SIZE x WIDTH, for the words of the window
    inner: np.ndarray  # (2 * REACH * WIDTH) x HIDDEN
    inner_bias: np.ndarray
    outer: np.ndarray  # HIDDEN x SIZE
    outer_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        wide = 2 * REACH * WIDTH
        return cls(
            rng.normal(0, 0.1, (SIZE, WIDTH)).astype(np.float32),
            rng.normal(0, wide**-0.5, (wide, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            np.zeros((HIDDEN, SIZE), np.float32),  # so that the first guess is the bias alone
            np.zeros(SIZE, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.inner, self.inner_bias, self.outer, self.outer_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def from_flat(cls, values: np.ndarray) -> Network:
        parts, at = [], 0
        for like in cls.fresh().parts():
            parts.append(values[at : at + like.size].reshape(like.shape).astype(np.float32))
            at += like.size
        return cls(*parts)

    def forward(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The window's vectors, the hidden layer with a last column of ones, and the scores of all ids.

        The scores may be exponentiated as they are: a hidden value is at most 1, so they are bounded by the
        weights, and only weights that are too large for it cost the search for each row's greatest."""
        seen = self.vectors.take(window, axis=0).reshape(len(window), 2 * REACH * WIDTH)
        within = seen @ self.inner
        within += self.inner_bias
        hidden = np.ones((len(window), HIDDEN + 1), within.dtype)
        np.tanh(within, out=hidden[:, :HIDDEN])
        weights = np.vstack([self.outer, self.outer_bias])
        logits = hidden @ weights
        if not np.abs(weights).sum(axis=0).max() < SAFE:
            logits -= logits.max(axis=1, keepdims=True)
        return seen, hidden, logits

    def log_probabilities(self, window: np.ndarray, target: np.ndarray) -> np.ndarray:
        logits = self.forward(window)[2]
        own = logits[np.arange(len(target)), target]
        np.exp(logits, out=logits)
        return own - np.log(logits @ np.ones(SIZE, logits.dtype))

    def step(self, window: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of stochastic gradient descent on the mean negative log-probability.

        The large array (windows by ids) is passed over by the exponential and the products alone: what
        divides its rows goes to the hidden layer's side, and the biases ride on the column of ones."""
        n = len(target)
        seen, hidden, odds = self.forward(window)
        np.exp(odds, out=odds)
        total = odds @ np.ones(SIZE, odds.dtype)
        odds[np.arange(n), target] -= total
        part = (1 / (n * total))[:, None]
        own = hidden[:, :HIDDEN]
        back = odds @ self.outer.T
        back *= (1 - own * own) * part
        hidden *= 8 * rate * part
        moved = (odds.T @ hidden).T
        into = (back @ self.inner.T).reshape(n * 2 * REACH, WIDTH)
        self.outer -= moved[:HIDDEN]
        self.outer_bias -= moved[HIDDEN]
        self.inner -= 8 * rate * (seen.T @ back)
        self.inner_bias -= 8 * rate * back.sum(axis=0)
        ids = window.ravel()
        count = np.bincount(ids, minlength=SIZE)
        used = np.flatnonzero(count)
        first = (np.cumsum(count) - count)[used]
        order = np.argsort(ids, kind="stable")  # few comparisons where ids are bytes
        self.vectors[used] -= 8 * rate * np.add.reduceat(into.take(order, axis=0), first, axis=0)


def code_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(data or b"", np.uint8), minlength=SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE)), pa.array(total)], ["id", "n"])

    counted = rows.select("words").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE, np.int64)
    for code, n in counted.collect():
        out[code] = n
    return out


def padded(texts: list[bytes]) -> np.ndarray:
    """The ids of the texts in one line, EDGE on both sides of each."""
    edge = bytes([EDGE]) * REACH
    return np.frombuffer(edge + edge.join(texts) + edge, np.uint8)


def windows(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The REACH words on both sides of each place, EDGE beyond the text."""
    line = np.zeros(len(words) + 2 * REACH, words.dtype)
    line[REACH : REACH + len(words)] = words
    return line[places[:, None] + REACH + SHIFTS]


def train_round(rows: DataFrame, start: np.ndarray, stride: int = STRIDE) -> np.ndarray | None:
    """One round over all partitions: flat weights averaged by words, None without any word."""
    begin = rows.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, seen = Network.from_flat(begin.value.copy()), 0
        held: list[bytes] = []
        targets: list[np.ndarray] = []  # their places in the line of the held texts
        waiting, end = 0, REACH

        def learn():
            nonlocal waiting, end, seen
            line, places = padded(held), np.concatenate(targets)
            places = places[np.random.default_rng(seen).permutation(len(places))]
            for at in range(0, len(places), BATCH):
                pick = places[at : at + BATCH]
                network.step(line[pick[:, None] + SHIFTS], line[pick], RATE)
            seen += len(places)
            held.clear()
            targets.clear()
            waiting, end = 0, REACH

        for batch in batches:
            for data in batch.column(0).to_pylist():
                size = len(data or b"")
                places = np.arange(size % stride // 2, size, stride)
                if len(places):
                    held.append(data)
                    targets.append(end + places)
                    end += size + REACH
                    waiting += len(places)
                if waiting >= 32 * BATCH:
                    learn()
        if waiting:
            learn()
        if seen:
            moved = network.flat().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(moved))), pa.array(moved), pa.array(np.full(len(moved), seen))], ["i", "value", "words"]
            )

    sums = (
        rows.select("words")
        .mapInArrow(run, "i long, value double, words long")
        .groupBy("i")
        .agg((F.sum("value") / F.sum("words")).alias("value"))
        .collect()
    )
    if not sums:
        return None
    out = np.zeros(len(sums))
    for i, value in sums:
        out[i] = round(value, 6)
    return out.astype(np.float32)


def score(rows: DataFrame, weights: np.ndarray, added: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_words, log_likelihood) from (doc_id, words): every word of every text; other columns stay.
    ``added``: what each id adds to the log-probability of its words."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    kept = [name for name in rows.columns if name != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.from_flat(shared.value)
        for batch in batches:
            texts = [data or b"" for data in batch.column("words").to_pylist()]
            count = np.array([len(text) for text in texts], np.int64)
            starts = REACH + np.cumsum(count + REACH) - (count + REACH)
            line, sums = padded(texts), np.zeros(len(texts))
            for begin in range(0, len(line), WORDS_AT_ONCE):
                places = begin + np.flatnonzero(line[begin : begin + WORDS_AT_ONCE] != EDGE)
                for at in range(0, len(places), BATCH):
                    pick = places[at : at + BATCH]
                    target = line[pick]
                    own = network.log_probabilities(line[pick[:, None] + SHIFTS], target).astype(np.float64)
                    owner = np.searchsorted(starts, pick, side="right") - 1
                    first = owner[0]
                    found = np.bincount(owner - first, own if added is None else own + added[target])
                    sums[first : first + len(found)] += found
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(count), pa.array(sums)], [*kept, "n_words", "log_likelihood"]
            )

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"{name} {types[name]}" for name in kept), "n_words long", "log_likelihood double"]))


def score_documents(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE) -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word) for every row of ``docs``.

    Trains on the corpus itself and scores all of it.  A NULL text or one without words
    has 0 words, log-likelihood 0 and a NULL ``per_word``.  An empty table gives no rows.
    """
    rows = cut(coded(docs, frequent_words(docs)))
    return _per_word(score(rows, trained_weights(rows, code_counts(rows), rounds, stride)))


def trained_weights(rows: DataFrame, counts: np.ndarray, rounds: int, stride: int) -> np.ndarray:
    start = Network.fresh()
    counts = counts + 0.5
    start.outer_bias = np.log(counts / counts.sum()).astype(np.float32)  # begin with the frequencies
    weights = start.flat()
    for _ in range(rounds):
        trained = train_round(rows, weights, stride)
        weights = weights if trained is None else trained
    return weights


def _per_word(scored: DataFrame) -> DataFrame:
    return scored.withColumn(
        "per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    )


def known_words(counted: DataFrame, count: int = KNOWN) -> dict[str, int]:
    """The most frequent words and their counts.  Only words that make up more than a millionth of the
    corpus, a million words at most, are compared for it."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    some = counted.filter(F.col("n") > total // 1_000_000).orderBy(F.col("n").desc(), "word").limit(count)
    return {r["word"]: r["n"] for r in some.collect()}


def coded_with_rare(docs: DataFrame, frequent: list[str], known: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, words, own, rare): as ``coded``; of the words that have no id of their own, the sum of log(count)
    over those whose count is ``known``, and the others themselves."""
    held = docs.sparkSession.sparkContext.broadcast(known or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequent)
        counts = {w: n for w, n in held.value.items() if w not in coder.frequent}
        # each known word has a number beyond the ids, which tells its id and the log of its count
        ids = np.concatenate([np.arange(SIZE), [coder[w] for w in counts]]).astype(np.uint8)
        logs = np.concatenate([np.zeros(SIZE), np.log(list(counts.values()))])
        coder.clear()
        numbers = Coder(frequent)
        numbers.frequent |= {w: SIZE + i for i, w in enumerate(counts)}
        for batch in batches:
            codes, own, rare = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").lower().split()
                found = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                codes.append(ids[found].tobytes())
                own.append(logs[found].sum())
                rare.append([words[i] for i in np.flatnonzero((found > FREQUENT) & (found < SIZE)).tolist()])
            columns = [batch.column(0), pa.array(codes, pa.binary()), pa.array(own, pa.float64()), pa.array(rare, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "own", "rare"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, words binary, own double, rare array<string>"
    )


def score_words(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, known: int = KNOWN) -> DataFrame:
    """As ``score_documents``, but for the words themselves: a word without an id of its own adds
    log(count of the word / count of its class) to the log-probability of its class.  The counts of the
    ``known`` most frequent words go to every task; those of the others are joined."""
    counted = cut(word_counts(docs))
    frequent = [r["word"] for r in counted.orderBy(F.col("n").desc(), "word").limit(FREQUENT).collect()]
    coded = coded_with_rare(docs, frequent, known_words(counted, known))
    rows = cut(coded.withColumn("row", F.monotonically_increasing_id()))
    counts = code_counts(rows)
    weights = trained_weights(rows, counts, rounds, stride)
    shares = np.zeros(SIZE)
    shares[1 + FREQUENT :] = -np.log(np.maximum(counts[1 + FREQUENT :], 1))
    scored = score(rows.select("row", "doc_id", "words", "own"), weights, shares)
    # words that occur once add log(1) = 0
    joined = rows.select("row", F.explode("rare").alias("word")).join(counted.filter("n > 1"), "word")
    joined = joined.groupBy("row").agg(F.sum(F.log("n")).alias("joined"))
    value = F.col("log_likelihood") + F.col("own") + F.coalesce("joined", F.lit(0.0))
    return _per_word(scored.join(joined, "row", "left").select("doc_id", "n_words", value.alias("log_likelihood")))
