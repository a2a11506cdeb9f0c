"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments of equal length L; with the mean m and deviation s
of each segment, the squared distance of two vectors is at least

    sum over segments of  L * ((m_q - m_x)^2 + (s_q - s_x)^2)

and halving the segments only raises it.  Since |q - x|^2 = |q|^2 + |x|^2 - 2 q.x,
a lower bound of the distance is an upper bound of the inner product:
sum of L * (m_q m_x + s_q s_x).  Candidates are compared with a query coarse to
fine: what cannot reach the query's threshold drops out, and the survivors of the
finest level get their exact integer score.

The threshold is the k-th best score over a bounded set of pilot vectors, a score
that k vectors are known to reach.  The candidates are dealt out in slices; every
query goes to every slice (a stated query set against all rows, in blocks) and
keeps its best k there, and the best k over all slices are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medley.session import cut

LEVELS = (4, 16)  # segments, coarse to fine
PILOTS = 4096  # vectors of largest norm that give the first thresholds: at most so many are broadcast
SLICE_ROWS = 65_536  # candidates that one task holds
PAIRS_AT_ONCE = 4_000_000
DENSE = 0.02  # share of pairs left from which a whole product is cheaper than single ones


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component, as integers.

    Rows with a NULL id, a NULL vector or a NULL, NaN or infinite component take no
    part.  Repeated ids count once, with the vector that sorts first.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    sound = F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    )
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return (
        kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one integer matrix, shorter vectors filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a dot product of two rows
    bounds the inner product of the vectors from above."""
    pieces = np.array_split(np.arange(vectors.shape[1]), min(segments, max(1, vectors.shape[1])))
    out = []
    for piece in pieces:
        part = vectors[:, piece].astype(np.float64)
        root = np.sqrt(max(1, len(piece)))
        out += [part.mean(axis=1) * root, part.std(axis=1) * root] if len(piece) else []
    return np.stack(out, axis=1) if out else np.zeros((len(vectors), 1))


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best rows of each query: score down, id up."""
    order = np.lexsort((ids, -scores, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[place < k]


class Slice:
    """Candidates with their statistics, searched for blocks of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: tuple[int, ...]):
        self.ids, self.vectors = ids, vectors
        self.levels = levels
        self.stats = [statistics(vectors, n) for n in levels]
        self.floats = vectors.astype(np.float64)
        self.small = float(np.abs(vectors).max(initial=0)) * vectors.shape[1]

    def _products(self, queries: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        score = np.empty(len(q), np.int64)
        for i in range(0, len(q), PAIRS_AT_ONCE // 64):
            s = slice(i, i + PAIRS_AT_ONCE // 64)
            score[s] = np.einsum("ij,ij->i", queries[q[s]], self.vectors[c[s]])
        return score

    @staticmethod
    def _narrow(alive: np.ndarray, mine: np.ndarray, theirs: np.ndarray, need: np.ndarray) -> np.ndarray | None:
        """Clears the pairs whose product is below ``need``.  While many pairs are left one
        matrix product, which is returned, is cheaper than to look at them one by one."""
        if alive.mean() > DENSE:
            product = mine @ theirs.T
            alive &= product >= need
            return product
        q, c = np.nonzero(alive)
        for i in range(0, len(q), PAIRS_AT_ONCE // 16):
            s = slice(i, i + PAIRS_AT_ONCE // 16)
            out = np.einsum("ij,ij->i", mine[q[s]], theirs[c[s]]) < need[q[s], 0]
            alive[q[s][out], c[s][out]] = False
        return None

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        """(query index, candidate index, score) of each query's best k that reach its threshold."""
        found = []
        step = max(1, PAIRS_AT_ONCE // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            block = slice(at, at + step)
            need = floor[block, None]
            own = [statistics(queries[block], n) for n in self.levels]
            slack = 1e-6 * (1 + np.abs(need))  # bounds are rounded, scores are not
            alive = own[0] @ self.stats[0].T >= need - slack
            alive &= ids[block, None] != self.ids[None, :]
            for mine, theirs in zip(own[1:], self.stats[1:]):
                self._narrow(alive, mine, theirs, need - slack)
            # exact in floating point as long as every sum of products is below 2^53
            asked = queries[block]
            if self.small * float(np.abs(asked).max(initial=0)) < 2**53:
                score = self._narrow(alive, asked.astype(np.float64), self.floats, need)
                q, c = np.nonzero(alive)
                score = score[q, c].astype(np.int64) if score is not None else self._products(asked, q, c)
            else:
                q, c = np.nonzero(alive)
                score = self._products(asked, q, c)
                sure = score >= need[q, 0]
                q, c, score = q[sure], c[sure], score[sure]
            top = _best(q, self.ids[c], score, k)
            found.append((q[top] + at, c[top], score[top]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


LOWEST = -(2**62)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    levels: tuple[int, ...] = LEVELS,
    pilots: int = PILOTS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, vector of
    integers) that ``is_query`` selects, the k other rows of largest inner product, all if
    there are fewer; ties go to the smaller vec_id.  A shorter vector counts as filled
    up with zeros.  An empty table gives no rows."""
    vectors = cut(vectors)
    spark = vectors.sparkSession
    shape = vectors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("width")).first()
    width = max(1, shape["width"] or 1)
    slices = max(1, -(-shape["rows"] // slice_rows))
    norm = F.aggregate("vector", F.lit(0).cast("long"), lambda a, v: a + v * v)
    best = vectors.orderBy(norm.desc(), "vec_id").limit(pilots).toArrow()
    pilot = Slice(best.column("vec_id").to_numpy(), matrix(best.column("vector"), width), levels)
    shared = spark.sparkContext.broadcast((pilot.ids, pilot.vectors))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = shared.value
        for batch in batches:
            mine = batch.column(0).to_numpy(zero_copy_only=False)
            queries = matrix(batch.column(1), width)
            floor = np.full(len(mine), LOWEST)
            for at in range(0, len(mine), 256):
                block = slice(at, at + 256)
                scores = (queries[block].astype(np.float64) @ own.T.astype(np.float64)) if len(own) else np.zeros((0, 0))
                scores = np.where(mine[block, None] == ids[None, :], -np.inf, scores)
                if scores.shape[1] > k:
                    kth = np.partition(scores, -k, axis=1)[:, -k]
                    floor[block] = np.where(np.isfinite(kth), np.floor(np.nan_to_num(kth, neginf=0)) - 1, LOWEST)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], ["vec_id", "vector", "floor"])

    queries = cut(vectors.filter(is_query).mapInArrow(thresholds, "vec_id long, vector array<long>, floor long"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    dealt = vectors.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"),
        "vec_id",
        "vector",
        F.lit(None).cast("long").alias("floor"),
    ).union(queries.select(every, "vec_id", "vector", "floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidates of a slice come first and are held; its queries stream past them."""
        number, held, here = None, [], None
        for batch in batches:
            of = batch.column(0).to_numpy(zero_copy_only=False)
            for value in np.unique(of):
                rows = np.flatnonzero(of == value)
                part = batch.slice(rows[0], len(rows))
                if value != number:
                    number, held, here = value, [], None
                floor = part.column(3)
                own = part.filter(floor.is_null())
                if own.num_rows:
                    held.append((own.column(1).to_numpy(zero_copy_only=False), matrix(own.column(2), width)))
                asked = part.filter(floor.is_valid())
                if asked.num_rows and held:
                    here = here or Slice(*(np.concatenate(x) for x in zip(*held)), levels)
                    ids = asked.column(1).to_numpy(zero_copy_only=False)
                    q, c, score = here.search(
                        ids, matrix(asked.column(2), width), asked.column(3).to_numpy(zero_copy_only=False), k
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[q]), pa.array(here.ids[c]), pa.array(score)], ["query_id", "vec_id", "score"]
                    )

    partial = (
        dealt.repartition(max(slices, int(spark.conf.get("spark.sql.shuffle.partitions"))), "slice")
        .sortWithinPartitions("slice", F.col("floor").isNotNull())
        .mapInArrow(run, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
