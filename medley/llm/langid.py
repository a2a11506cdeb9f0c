"""Language identification by a linear-chain conditional random field over words.

Every word of a text carries a language label.  A word's scores come from its
affixes, its letter n-grams and a lexicon; learned transitions tie neighbouring
words together, and forward-backward gives each word's label probabilities, also
where a text switches language.  A document's language is the label with most
expected words.

The field is trained here, on a bounded sample of labelled documents: SAMPLE
documents of each language, the ones whose ids hash lowest, and of these windows
of words spliced together from several languages, so that transitions are
learned from switches too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SAMPLE = 250  # labelled documents of each language that the field is fitted on
WORDS = 60_000  # words of the training windows of each language
BUCKETS = 1 << 15  # hashed features
CHAIN = 64  # words of one chain: a line, or a stretch of a longer one
ROUNDS = 60
WORDS_KEPT = 150_000
NAMES_KEPT = 150_000
WORDS_AT_ONCE = 4096
UNKNOWN = "und"
SURE = 0.3  # a text that switches between two or three languages is still text in these languages


def words(text: str | None) -> list[str]:
    """White-space separated words with at least one letter, in lower case, without marks around."""
    return [w for w in (clean(t) for t in (text or "").split()) if w]


def clean(token: str) -> str:
    """The token from its first letter to its last, in lower case; empty without a letter."""
    if token.isalpha():
        return token.lower()
    start, end = 0, len(token)
    while start < end and not token[start].isalpha():
        start += 1
    while end > start and not token[end - 1].isalpha():
        end -= 1
    return token[start:end].lower()


class _Buckets(dict):
    """Bucket of each feature name; names seen before are looked up."""

    def __missing__(self, name: str) -> int:
        bucket = zlib.crc32(name.encode()) % BUCKETS
        if len(self) >= NAMES_KEPT:
            self.clear()
        self[name] = bucket
        return bucket


_bucket = _Buckets()
AFFIXES = 7


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, first place of each word) of the hashed features of all words: three
    prefixes, three suffixes and the word itself as a lexicon entry, then its letter pairs
    and triples, scaled down by their number."""
    names: list[str] = []
    grams = []
    for word in words:
        marked = f"^{word}$"
        size = len(marked)
        names += ["p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:], "w" + word]
        names += [marked[i : i + 2] for i in range(size - 1)]
        names += [marked[i : i + 3] for i in range(size - 2)]
        grams.append(2 * size - 3)
    count = np.array(grams, np.int64)
    scale = np.ones((len(words), 2))
    scale[:, 1] = 2.0 / np.sqrt(count)
    spans = np.stack([np.full(len(words), AFFIXES), count], axis=1)
    ids = np.array([_bucket[n] for n in names], np.int64)
    return ids, np.repeat(scale.ravel(), spans.ravel()), np.cumsum(AFFIXES + count) - AFFIXES - count


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # label x next label
    lexicon: dict[str, np.ndarray]  # word -> scores from its counts in the sample

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, labels)."""
        if not words:
            return np.zeros((0, len(self.labels)))
        ids, values, first = features(words)
        out = np.add.reduceat(self.weights[ids] * values[:, None], first, axis=0)
        for i, word in enumerate(words):
            known = self.lexicon.get(word)
            if known is not None:
                out[i] += known
        return out


def posteriors(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains side by side: scores are (chains, words, labels), filled
    up beyond each chain's length.  Returns label probabilities, expected moves, and
    log-partition of each chain."""
    chains, steps, labels = scores.shape
    top = scores.max(axis=2, keepdims=True)
    emit = np.exp(scores - top)
    step = np.exp(moves)
    alive = np.arange(steps) < lengths[:, None]
    forward = np.zeros_like(emit)
    scale = np.ones((chains, steps))
    now = np.ones((chains, labels))
    for t in range(steps):
        raw = (now @ step if t else now) * emit[:, t]
        scale[:, t] = raw.sum(axis=1)
        now = raw / scale[:, t, None]
        forward[:, t] = now
    backward = np.ones((chains, steps, labels))
    expected = np.zeros((labels, labels))
    after = np.ones((chains, labels))
    for t in range(steps - 2, -1, -1):
        weight = emit[:, t + 1] * after / scale[:, t + 1, None]
        weight *= alive[:, t + 1, None]
        expected += forward[:, t].T @ weight * step
        after = np.where(alive[:, t + 1, None], weight @ step.T, 1.0)
        backward[:, t] = after
    gamma = forward * backward * alive[:, :, None]
    partition = ((np.log(scale) + top[:, :, 0]) * alive).sum(axis=1)
    return gamma, expected, partition


def chains_of(ids: np.ndarray, longest: int = CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, step of each word, chain lengths) for one run of words cut at ``longest``."""
    place = np.arange(len(ids))
    count = -(-len(ids) // longest)
    lengths = np.full(count, longest)
    if count:
        lengths[-1] = len(ids) - longest * (count - 1)
    return place // longest, place % longest, lengths


def fit(sample: list[tuple[str, str]], seed: int = 7, rounds: int = ROUNDS, words_each: int = WORDS) -> Field:
    """A field from (text, language) pairs: maximum likelihood with a Gaussian prior."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in sample})
    if not labels:
        return Field([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), {})
    texts = {lang: [w for text, own in sample if own == lang for w in words(text)] for lang in labels}
    vocabulary: dict[str, int] = {}
    coded = {lang: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for lang, ws in texts.items()}
    known = list(vocabulary)
    counts = np.stack([np.bincount(coded[lang], minlength=len(known)) for lang in labels], axis=1).astype(float)
    lexicon_scores = np.zeros((len(known), len(labels)))
    if known:
        smooth = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(known)))
        often = counts.sum(axis=1) >= 5
        lexicon_scores[often] = 0.25 * (smooth - smooth.mean(axis=1, keepdims=True))[often]
    rows: list[np.ndarray] = []
    tags: list[np.ndarray] = []
    for number, lang in enumerate(labels):  # windows of 64 words: stretches of this language, some joined by others
        own = coded[lang]
        for _ in range(0, min(len(own), words_each), CHAIN):
            parts, marks, left = [], [], CHAIN
            which = number
            while left > 0:
                source = coded[labels[which]]
                size = min(left, int(rng.integers(8, CHAIN + 1)), len(source))
                if size:
                    at = int(rng.integers(0, len(source) - size + 1))
                    parts.append(source[at : at + size])
                    marks.append(np.full(size, which))
                left -= max(size, 1)
                which = int(rng.integers(0, len(labels))) if rng.random() < 0.5 else number
            rows.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            tags.append(np.concatenate(marks) if marks else np.zeros(0, np.int64))
    k = len(labels)
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    field = Field(labels, weights, moves, {w: lexicon_scores[i] for i, w in enumerate(known) if lexicon_scores[i].any()})
    rows, tags = [r for r in rows if len(r)], [t for t in tags if len(t)]
    if not rows or k < 2:
        return field
    lengths = np.array([len(r) for r in rows])
    word = np.zeros((len(rows), CHAIN), np.int64)
    gold = np.zeros((len(rows), CHAIN), np.int64)
    for i, (r, t) in enumerate(zip(rows, tags)):
        word[i, : len(r)], gold[i, : len(t)] = r, t
    alive = np.arange(CHAIN) < lengths[:, None]
    used, place = np.unique(word[alive], return_inverse=True)
    feature, value, first = features([known[u] for u in used])
    owner = np.repeat(np.arange(len(used)), np.diff([*first, len(feature)]))
    fixed = lexicon_scores[used]
    right = np.zeros((len(used), k))
    np.add.at(right, (place, gold[alive]), 1.0)
    pair = alive[:, 1:]
    moved = np.zeros((k, k))
    np.add.at(moved, (gold[:, :-1][pair], gold[:, 1:][pair]), 1.0)
    total = alive.sum()
    grow_w, grow_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(rounds):
        scored = fixed.copy()
        for j in range(k):
            scored[:, j] += np.bincount(owner, value * weights[feature, j], minlength=len(used))
        scores = np.zeros((len(rows), CHAIN, k))
        scores[alive] = scored[place]
        gamma, expected, _ = posteriors(scores, moves, lengths)
        guess = gamma[alive]
        error = right.copy()
        for j in range(k):
            error[:, j] -= np.bincount(place, guess[:, j], minlength=len(used))
        slope = np.stack(
            [np.bincount(feature, value * error[owner, j], minlength=BUCKETS) for j in range(k)], axis=1
        ) / total - 1e-6 * weights
        grow_w += slope**2
        weights += 0.3 * slope / np.sqrt(grow_w)
        push = (moved - expected) / total - 1e-4 * moves
        grow_m += push**2
        moves += 0.3 * push / np.sqrt(grow_m)
    return field


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, per_language: int = SAMPLE) -> Field:
    """Fits the field on the rows that have a text, an id and a language and are not held out:
    at most ``per_language`` of each language, picked by a hash of the id."""
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        usable.select("doc_id", F.col("lang").cast("string"))
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= per_language)
        .select("doc_id")
        .distinct()
    )
    ids = [r[0] for r in chosen.collect()]
    rows = usable.filter(F.col("doc_id").isin(ids)).select("doc_id", F.col("lang").cast("string"), "text").collect() if ids else []
    return fit([(text, lang) for _, lang, text in sorted(rows, key=lambda r: (r[0], r[1]))])


class Tagger:
    """Labels batches of texts; the scores of frequent words are remembered."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(field.labels)), np.float32)
        self.cleaned: dict[str, int] = {}

    def _learn(self, tokens: set[str]) -> None:
        """Codes for tokens not seen before: the row of their word's scores, -1 without a letter."""
        cleaned = {token: clean(token) for token in tokens}
        fresh = sorted({w for w in cleaned.values() if w} - self.known.keys())
        base = len(self.known)
        while base + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for i in range(0, len(fresh), WORDS_AT_ONCE):
            part = fresh[i : i + WORDS_AT_ONCE]
            self.table[base + i : base + i + len(part)] = self.field.word_scores(part)
        self.known.update(zip(fresh, range(base, base + len(fresh))))
        for token, word in cleaned.items():
            self.cleaned[token] = self.known[word] if word else -1

    def expected_words(self, texts: list[str | None]) -> np.ndarray:
        """Expected number of words of each label in each text."""
        if len(self.cleaned) > WORDS_KEPT:
            self.known, self.cleaned = {}, {}
            self.table = np.zeros((1024, len(self.field.labels)), np.float32)
        out = np.zeros((len(texts), len(self.field.labels)))
        if not self.field.labels:
            return out
        lines = [[line.split() for line in (text or "").split("\n")] for text in texts]
        self._learn({t for own in lines for line in own for t in line} - self.cleaned.keys())
        get = self.cleaned.__getitem__
        rows, steps, lengths, codes, owner = [], [], [], [], []
        base = 0
        for n, own in enumerate(lines):
            for line in own:
                ids = np.array(list(map(get, line)), np.int64)
                ids = ids[ids >= 0]
                if not len(ids):
                    continue
                row, step, size = chains_of(ids)
                rows.append(row + base)
                steps.append(step)
                lengths.append(size)
                codes.append(ids)
                owner.append(np.full(len(size), n))
                base += len(size)
        if not base:
            return out
        lengths, owner = np.concatenate(lengths), np.concatenate(owner)
        rows, steps, codes = np.concatenate(rows), np.concatenate(steps), np.concatenate(codes)
        order = np.argsort(lengths, kind="stable")  # chains of like length side by side: little filling
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rows = rank[rows]
        by_row = np.argsort(rows, kind="stable")
        rows, steps, codes = rows[by_row], steps[by_row], codes[by_row]
        sums = np.zeros((base, out.shape[1]))
        for at in range(0, base, 4096):
            top = min(base, at + 4096)
            lo, hi = np.searchsorted(rows, (at, top))
            size = lengths[order[at:top]]
            scores = np.zeros((top - at, int(size.max()), out.shape[1]))
            scores[rows[lo:hi] - at, steps[lo:hi]] = self.table[codes[lo:hi]]
            sums[at:top] = posteriors(scores, self.field.moves, size)[0].sum(axis=1)
        np.add.at(out, owner[order], sums)
        return out

    def languages(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        expected = self.expected_words(texts)
        total = expected.sum(axis=1)
        best = expected.argmax(axis=1) if self.field.labels else np.zeros(len(texts), int)
        names = [self.field.labels[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
        scores = [float(min(1.0, e[b] / t)) if t > 0 else 0.0 for e, b, t in zip(expected, best, total)]
        return names, scores


TEXTS_AT_ONCE = 256


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with lang_pred and score added (replacing columns of these names).

    ``score`` is the expected share of the words in the predicted language.  A text
    that is NULL or has no letter is ``und`` with score 0, as is any text if no language was learned.  One pass, no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(columns)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(i, TEXTS_AT_ONCE)
                names, scores = tagger.languages(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*columns, "lang_pred", "score"],
                )

    schema = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    for field_ in schema.fields[-2:]:
        field_.nullable = True
    return rows.mapInArrow(run, schema)
