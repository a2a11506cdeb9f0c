"""SimHash fingerprints and near-duplicate classes by anchor-point covering.

The 64 bits are cut into four blocks (23, 23, 15 and 3 bits) and each block is
covered by a perfect cyclic code: binary Golay twice (covering radius 3),
Hamming (1) and repetition (1).  The code words of their direct sum are the
anchors: every point has exactly one anchor within the covering radius, and the
anchors near a point are read from syndrome tables.

Two fingerprints x, y that differ in at most two bits have a point z between
them that differs from each in at most one bit.  The anchor of z is, for both,
within the covering radius plus one.  So when *both* are replicated to every
anchor within the covering radius plus half the threshold (the threshold shared
out between the two sides; 17 anchors on average), each pair meets at one anchor
at least, and comparing per anchor loses no link.

An anchor with more than ``CROWD`` fingerprints is not compared: its
fingerprints go to the finest anchors instead, all points of the space (radius
zero), again within half the threshold.  No such point has more than 65
fingerprints near it, so that way is exact and no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medley.llm.components import connected
from medley.session import cut

#: (bits, generator polynomial, covering radius) of the perfect codes, from the lowest bits up.
CODES = [(23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1), (3, 0b111, 1)]
CROWD = 512
SEED = 42
SHINGLES_AT_ONCE = 65_536


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, SHINGLES_AT_ONCE):
        here = words[at : min(at + SHINGLES_AT_ONCE, count) + width - 1]
        shingles = zip(*(here[k:] for k in range(width))) if len(here) >= width else [here]
        digests = b"".join([xxhash.xxh64_digest(b" ".join(s), SEED) for s in shingles])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row: one pass over the texts, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text, width) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


@cache
def _code(bits: int, generator: int, radius: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(syndrome of each single bit, tables of flips): ``tables[e][s]`` lists the flips
    of ``radius + e`` bits (for e = 0: of up to ``radius`` bits) that turn a word with
    syndrome s into a code word, filled up with -1."""
    check = generator.bit_length() - 1
    single = np.zeros(bits, np.int64)
    value = 1
    for i in range(bits):
        single[i] = value
        value <<= 1
        if value >> check:
            value ^= generator
    tables = []
    for weights in (range(radius + 1), [radius + 1]):
        found: list[list[int]] = [[] for _ in range(1 << check)]
        for weight in weights:
            for places in combinations(range(bits), weight):
                syndrome = 0
                for i in places:
                    syndrome ^= int(single[i])
                found[syndrome].append(sum(1 << i for i in places))
        wide = max(map(len, found))
        tables.append(np.array([row + [-1] * (wide - len(row)) for row in found], np.int64))
    return single, tables


def anchors(prints: np.ndarray, slack: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``prints``, anchor) for all anchors within covering radius plus ``slack`` (0 or 1)."""
    points = prints.astype(np.uint64)
    rows = np.arange(len(points))
    found = np.zeros(len(points), np.uint64)
    spent = np.zeros(len(points), np.int64)
    shift = 0
    for bits, generator, radius in CODES:
        single, tables = _code(bits, generator, radius)
        part = ((points >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = np.zeros(len(part), np.int64)
        for i in range(bits):
            syndrome ^= ((part >> i) & 1) * single[i]
        made = []
        for extra, flips in enumerate(tables[: slack + 1]):
            may = np.flatnonzero(spent + extra <= slack)
            options = flips[syndrome[rows[may]]]
            i, k = np.nonzero(options >= 0)
            word = (part[rows[may[i]]] ^ options[i, k]).astype(np.uint64) << np.uint64(shift)
            made.append((rows[may[i]], found[may[i]] | word, spent[may[i]] + extra))
        rows, found, spent = (np.concatenate(x) for x in zip(*made))
        shift += bits
    return rows, found.view(np.int64)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        rows, found = anchors(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(prints[rows])], ["anchor", "fp"])


def _roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``count`` items reaches over the given pairs."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[left], root[right])
        after = root.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def _links(anchor: np.ndarray, prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of equal anchors (rows sorted by anchor): a tree per class."""
    ends = np.searchsorted(anchor, anchor, side="right")
    points = prints.view(np.uint64)
    left, right = [], []
    lag, open_ = 1, np.flatnonzero(ends - np.arange(len(anchor)) > 1)
    while len(open_):
        near = np.bitwise_count(points[open_] ^ points[open_ + lag]) <= threshold
        left.append(open_[near])
        right.append(open_[near] + lag)
        lag += 1
        open_ = open_[open_ + lag < ends[open_]]
    if not left:
        return prints[:0], prints[:0]
    root = _roots(len(anchor), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return prints[moved], prints[root[moved]]


def _compare(threshold: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares per anchor; the open last group waits for the next batch, and of a
        crowded one only the anchor is remembered."""
        anchor = prints = np.zeros(0, np.int64)
        crowded = None

        def rows(src, dst, flag):
            return pa.RecordBatch.from_arrays(
                [pa.array(src), pa.array(dst), pa.array(np.full(len(src), flag))], ["src", "dst", "crowded"]
            )

        def settle(final: bool):
            nonlocal anchor, prints, crowded
            if crowded is not None:
                stay = np.searchsorted(anchor, crowded, side="right") if len(anchor) and anchor[0] == crowded else 0
                if stay:
                    yield rows(prints[:stay], prints[:stay], True)
                    anchor, prints = anchor[stay:], prints[stay:]
                if len(anchor):
                    crowded = None
            if not len(anchor):
                return
            first = 0 if final else np.searchsorted(anchor, anchor[-1])
            whole = len(anchor) if final else first
            a, p = anchor[:whole], prints[:whole]
            if len(a):
                size = np.searchsorted(a, a, side="right") - np.searchsorted(a, a)
                big = size > crowd
                yield rows(p[big], p[big], True)
                yield rows(*_links(a[~big], p[~big], threshold), False)
            anchor, prints = anchor[whole:], prints[whole:]
            if len(anchor) > crowd:
                crowded = anchor[0]
                yield rows(prints, prints, True)
                anchor = prints = np.zeros(0, np.int64)

        for batch in batches:
            anchor = np.concatenate([anchor, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
            yield from settle(False)
        yield from settle(True)

    return run


def linked_prints(prints: DataFrame, threshold: int = 2, crowd: int = CROWD) -> DataFrame:
    """(src, dst) links between different fingerprints ``fp``: enough of them to join all
    that differ in at most ``threshold`` bits into one component, not every pair."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors are laid out for thresholds of up to two bits")
    visits = prints.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    compared = cut(
        visits.repartition("anchor")
        .sortWithinPartitions("anchor", "fp")
        .mapInArrow(_compare(threshold, crowd), "src long, dst long, crowded boolean")
    )
    points = F.expr("transform(sequence(0, 64), b -> if(b = 64, src, src ^ shiftleft(1L, b)))")
    near = (
        compared.filter("crowded")
        .select("src")
        .distinct()
        .select("src", F.explode(points).alias("point"))
        .groupBy("point")
        .agg(F.min("src").alias("least"), F.collect_list("src").alias("members"))  # 65 members at most
        .filter(F.size("members") > 1)
    )
    # members of a point differ from it in one bit at most: all are within two bits of each other
    near = near.select(F.explode("members").alias("src"), F.col("least").alias("dst")) if threshold == 2 else near.filter(
        F.array_contains("members", F.col("point")) & F.lit(threshold == 1)
    ).select(F.explode("members").alias("src"), F.col("point").alias("dst"))
    near = near.filter("src <> dst")
    return compared.filter("not crowded").select("src", "dst").union(near.distinct())


def _classes(docs: DataFrame, width: int, threshold: int, crowd: int) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``; ``root`` names the class itself."""
    prints = cut(fingerprints(docs, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = connected(linked_prints(distinct, threshold, crowd))
    classes = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = cut(classes.join(named, "root").select("fp", "root", "component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 2, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and hashed as
    ``width``-word shingles, repeats included; a shorter text is one shingle, a text
    without words (or NULL) has fingerprint zero and is linked like any other.
    Copies share a fingerprint and are compared once.  ``component_id`` is the
    smallest doc_id that can be reached over links; rows whose doc_id is NULL are
    linked too but never name a component that has another id.
    """
    return _classes(docs, width, threshold, crowd).select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first_of_groups(docs: DataFrame, width: int = 3, threshold: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with its own columns: the one with the
    smallest doc_id.  Where several rows of a group carry that id, the smallest fingerprint
    and then the smallest text decide; rows of other groups that carry it too are not touched.
    Rows without an id cannot be named and all stay.  An empty table gives an empty one.

    Only where an id is repeated does it not name a row; the texts of those ids alone
    are fingerprinted once more, to find the row by id and fingerprint.
    """
    found = cut(_classes(docs, width, threshold, crowd))
    best = found.filter("doc_id = component_id").groupBy("root").agg(
        F.first("component_id").alias("__winner"), F.min("fp").alias("__fp")
    )
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"))
    names = cut(best.join(rows, F.col("__winner") == F.col("doc_id")).select("__winner", "__fp", "__rows"))
    owned = docs.withColumn("__id", F.col("doc_id").cast("long"))
    single = owned.join(names.filter("__rows = 1"), F.col("__id") == F.col("__winner")).select(docs.columns)
    kept = single.union(docs.filter("doc_id is null"))
    shared = names.filter("__rows > 1")
    if shared.isEmpty():
        return kept

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(text, width) for text in texts], dtype="int64")

    text = F.col("text").cast("string")
    again = owned.join(shared.select(F.col("__winner").alias("__id")).distinct(), "__id", "left_semi")
    again = again.withColumn("__own", print_of(text))
    met = again.join(shared, (F.col("__id") == F.col("__winner")) & (F.col("__own") == F.col("__fp")))
    chosen = met.groupBy("__winner", "__fp").agg(
        F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.coalesce(text, F.lit(""))).alias("__best")
    )
    return kept.union(chosen.select("__best.*"))
