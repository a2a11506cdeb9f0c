"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

The rows of an Arrow batch are taken in portions of about ``PORTION`` characters,
a longer text in blocks of that size, so what a task holds does not follow the
length of its texts.  Blocks end at safe boundaries only, places where no
vocabulary joins what stands on both sides.  The same boundaries part a block
into pieces; pieces whose length is not known yet are put together into inputs
of about ``INPUT`` characters, which the library encodes as a batch, and the
tokens of an input are told to its pieces by their offsets.  Nothing but lengths
is kept or returned.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PORTION = 1 << 20
INPUT = 1 << 17
KEPT = 300_000  # lengths remembered by a Python worker
SHORT = 40  # characters of a piece whose length is remembered
#: A safe boundary: white space in the narrowest sense after anything but white space in the widest.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\x0b\f\r])")
BEFORE_SAFE = re.compile(r"\S(?=[ \t\n\x0b\f\r])")
#: SentencePiece marks a single blank itself at the start of each text it gets.
BEFORE_BLANK = re.compile(r"\w(?= \w)")
PROBES = ("ab cd", "ab. cd", "a1 2b", "ab\ncd", "ab  cd", "ab \n. c", "a' 'b", "(a) (b)", "é é", "ab\t-\rcd")


def blocks(text: str, before: re.Pattern | None, size: int, skip: int = 0) -> list[str]:
    """The text in blocks of about ``size`` characters that end at safe boundaries, without the
    ``skip`` characters that follow one; a stretch without a boundary stays whole."""
    if before is None or len(text) <= size:
        return [text]
    found, start = [], 0
    while len(text) - start > size and (end := before.search(text, start + size - 1)):
        found.append(text[start : end.end()])
        start = end.end() + skip
    return [*found, text[start:]]


class TokenizersCounter:
    """Lengths by the ``tokenizers`` library, special strings inside texts as the file has them."""

    def __init__(self, path: str, portion: int = PORTION, inputs: int = INPUT, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.portion, self.inputs, self.kept = portion, inputs, kept
        self.safe = self._boundaries_hold()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _boundaries_hold(self) -> bool:
        """Whether this vocabulary never joins over a safe boundary: its pre-tokenizer parts all
        probes there, and no added token takes in blanks or looks at its neighbours."""
        pre = self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder().values()
        if pre is None or any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added):
            return False
        parts = lambda text: [part for part, _ in pre.pre_tokenize_str(text)]
        return all(parts(p) == [x for part in SAFE.split(p) for x in parts(part)] for p in PROBES)

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        totals = np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, str, bool, bool]] = []
        size = 0
        for i, text in enumerate(texts):
            cut = blocks(text, BEFORE_SAFE if self.safe else None, self.portion)
            for k, block in enumerate(cut):
                waiting.append((i, block, k == 0, k == len(cut) - 1))
                size += len(block)
                if size >= self.portion:
                    self._settle(waiting, totals)
                    waiting, size = [], 0
        self._settle(waiting, totals)
        return totals

    def _settle(self, waiting: list[tuple[int, str, bool, bool]], totals: np.ndarray) -> None:
        """Adds the lengths of these blocks to the totals of their texts."""
        alone: list[tuple[int, str]] = []  # pieces that the ends of a text touch, and long ones
        sums: list[tuple[int, list[str]]] = []
        unknown: dict[str, None] = {}
        known, old = self.young, self.old
        for i, block, first, last in waiting:
            if not block:
                continue
            pieces = SAFE.split(block) if self.safe else [block]
            if last and pieces[-1][-1].isspace():
                alone.append((i, pieces.pop()))
            if first and pieces and pieces[0][0] not in " \t\n\x0b\f\r":
                alone.append((i, pieces[0]))
                del pieces[0]
            if len(block) > SHORT and max(map(len, pieces), default=0) > SHORT:
                alone += [(i, p) for p in pieces if len(p) > SHORT]
                pieces = [p for p in pieces if len(p) <= SHORT]
            sums.append((i, pieces))
            unknown.update(dict.fromkeys(p for p in pieces if p not in known))
        for piece in list(unknown):
            if piece in old:
                known[piece] = old[piece]
                del unknown[piece]
        self._learn(list(unknown))
        for i, pieces in sums:
            totals[i] += sum(map(known.__getitem__, pieces))
        for chunk in _portions(alone, self.inputs, lambda a: len(a[1])):
            encoded = self.tokenizer.encode_batch_fast([piece for _, piece in chunk], add_special_tokens=False)
            for (i, _), tokens in zip(chunk, encoded):
                totals[i] += len(tokens)
        if len(known) > self.kept:  # the young generation becomes the old one
            self.young, self.old = {}, known

    def _learn(self, pieces: list[str]) -> None:
        inputs = list(_portions(pieces, self.inputs, len))
        for chunk in inputs:
            (tokens,) = self.tokenizer.encode_batch(["".join(chunk)], add_special_tokens=False)
            ends = np.cumsum([len(piece) for piece in chunk])
            starts = np.fromiter((start for start, _ in tokens.offsets), np.int64, len(tokens))
            lengths = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(chunk))
            self.young.update(zip(chunk, lengths.tolist()))


class SentencePieceCounter:
    """Lengths by the ``sentencepiece`` library."""

    def __init__(self, path: str, portion: int = PORTION):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.portion = portion
        joins = re.compile("[^▁]▁")
        whole = not any(joins.search(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
        parts = lambda p: [x for part in p.split(" ") for x in self.model.encode(part)]
        self.safe = whole and all(self.model.encode(p) == parts(p) for p in ("ab cd", "a1 2b c", "é é"))

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        totals = np.zeros(len(texts), np.int64)
        cut = [
            (i, block)
            for i, text in enumerate(texts)
            for block in blocks(text, BEFORE_BLANK if self.safe else None, self.portion, skip=1)
        ]
        for chunk in _portions(cut, self.portion, lambda c: len(c[1])):
            for (i, _), ids in zip(chunk, self.model.encode([block for _, block in chunk], num_threads=1)):
                totals[i] += len(ids)
        return totals


def _portions(items: list, size: int, weight) -> Iterator[list]:
    """The items in runs of about ``size``, at least one each."""
    run, total = [], 0
    for item in items:
        if run and total + weight(item) > size:
            yield run
            run, total = [], 0
        run.append(item)
        total += weight(item)
    if run:
        yield run


@lru_cache(2)
def counter(path: str) -> TokenizersCounter | SentencePieceCounter:
    """One counter for each Python worker and file, by the library that the file is for."""
    return SentencePieceCounter(path) if path.endswith(".model") else TokenizersCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``, in one pass without a shuffle.

    ``path`` is a ``.json`` file of the tokenizers library or a ``.model`` of sentencepiece,
    readable on every worker.  No begin, end or special token is added and nothing is cut
    off or filled up.  A NULL text counts as empty, with no bytes and tokens; repeated rows
    and rows without an id are counted like any other; an empty table gives an empty one.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array(counter(path).count([text or "" for text in texts.to_pylist()]))
            over = pc.greater(n_tokens, limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, n_tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
