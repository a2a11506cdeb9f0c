"""Mixture-controlled packing: deficit round-robin over source queues.

A source's documents, one after the other, are its queue, served in turns of
``TURN`` tokens.  A source earns credit in proportion to its target share and
takes its next turn when its credit covers half of it, so its deficit stays
within a turn and is carried from window to window.  A window is full after
``length / TURN`` turns.

The state of such a round-robin after any number of windows has a closed form:
turn k of a source falls due at time (k + 1/2) / rate, and all turns are served
in order of time.  So nothing is simulated in sequence: where a turn lands is the
number of turns, over all sources, that fall due before it.  Queues are cut into
turns inside each input partition, while the texts are encoded; the numbers of
turns per partition and source then shift each partition to its place, which
carries the deficits across partitions.  Token ids are never shuffled.  The
unfinished last turn of each partition and source cannot fill a slot; these share
the sequences after the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medley.llm.tokens import END_ID, encoder, vocabulary_file
from medley.session import cut

LENGTH = 2048
TURN = 128
PARTS = 64

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("source", pa.string()),
        ("part", pa.int64()),
        ("turn", pa.int64()),
        ("at", pa.int64()),
    ]
)


def turn_pieces(docs: DataFrame, vocabulary: str, turn: int = TURN) -> DataFrame:
    """Encodes every text and cuts it at the turns of its partition's queue of its source.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, source, part (the
    partition), turn (its number in the queue) and at (the piece's place in the turn).
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        part = TaskContext.get().partitionId()
        filled: dict[str | None, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = encode(text) + end
                total = len(data) // 4
                queue = filled.get(source, 0)
                start = 0
                while start < total:
                    at = (queue + start) % turn
                    stop = min(total, start + turn - at)
                    crc = zlib.crc32(data[4 * start : 4 * stop])
                    rows.append((doc_id, start, stop - start, crc, total, source, part, (queue + start) // turn, at))
                    start = stop
                filled[source] = queue + total
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*rows), PIECES)], schema=PIECES
                )

    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "source string, part long, turn long, at long"
    )
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return wanted.mapInArrow(run, schema)


def turns_due(time: np.ndarray, own: np.ndarray, turns: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """How many turns of all sources are served before the turn that falls due at ``time``
    in source ``own``; sources that fall due together go by their number."""
    before = np.zeros(len(time), np.int64)
    for s, (count, rate) in enumerate(zip(turns, rates)):
        k = np.clip(np.floor(time * rate - 0.5).astype(np.int64) - 1, 0, count)
        for _ in range(4):  # the estimate is at most a few turns low; due times themselves decide
            due = (k + 0.5) / rate
            k = np.where((k < count) & ((due < time) | ((due == time) & (s < own))), k + 1, k)
        before += k
    return before


def _tails(queues: DataFrame, turn: int, length: int, first: int) -> DataFrame:
    """(p, s, tail): where the unfinished turn of partition p and source s begins, counted in
    tokens from the first sequence.  They go by halving sizes into places of powers of two,
    which never cross the end of a sequence, and are then moved together.  Each group of
    ``PARTS`` partitions fills sequences of its own."""
    rest = F.expr(f"tokens - whole * {turn}")
    tails = queues.select(
        F.col("part").alias("p"), F.col("source").alias("s"), F.expr(f"part div {PARTS}").alias("group"), rest.alias("rest")
    ).filter("rest > 0")
    room = F.pow(F.lit(2), F.ceil(F.log2("rest"))).cast("long")
    order = [F.col("room").desc(), F.col("p"), F.col("s").isNull(), F.col("s")]
    before = Window.partitionBy("group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("room", room).withColumn(
        "sequence", F.expr("0L") + F.floor(F.coalesce(F.sum("room").over(before), F.lit(0)) / length)
    )
    inside = Window.partitionBy("group", "sequence").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("offset", F.coalesce(F.sum("rest").over(inside), F.lit(0)))
    groups = tails.groupBy("group").agg((F.max("sequence") + 1).alias("count"))
    ahead = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row for each PARTS partitions
    groups = groups.withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    return tails.join(groups, "group").select(
        "p", "s", ((F.lit(first) + F.col("ahead") + F.col("sequence")) * length + F.col("offset")).alias("tail")
    )


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    shares: dict[str | None, float] | None = None,
    length: int = LENGTH,
    turn: int = TURN,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, source, sequence_id, offset) per piece.

    Every row of ``docs`` is encoded (a NULL text as an empty one) and closed with
    END_ID; each of its ids lies in exactly one piece.  ``shares``: target share of
    each source in every window; by default its share of all tokens, with which all
    queues run dry together.  A source that runs dry earlier leaves its room to the
    others.  Repeated rows are packed as often as they occur, a NULL source is a
    source of its own, an empty table gives no rows.

    The totals by source reach the driver, one number for each source.
    """
    if turn & (turn - 1) or length % turn:
        raise ValueError("a turn is a power of two, and a window holds a whole number of turns")
    pieces = cut(turn_pieces(docs, vocabulary or vocabulary_file("byte_bpe_50k.json"), turn))
    queues = pieces.groupBy("part", "source").agg(F.sum("length").alias("tokens"))
    whole = F.expr(f"tokens div {turn}").alias("whole")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    queues = cut(queues.select("part", "source", "tokens", whole))
    totals = queues.groupBy("source").agg(F.sum("whole").alias("whole"), F.sum("tokens").alias("tokens")).collect()
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    known = [r for r in totals if r["whole"]]
    turns = np.array([r["whole"] for r in known], np.int64)
    wanted = [1.0 * r["tokens"] if shares is None else float(shares.get(r["source"], 0.0)) for r in known]
    floor = min([w for w in wanted if w > 0], default=1.0) * 1e-6
    rates = np.maximum(np.array(wanted, np.float64), floor)  # a source without a share is served last
    number = {r["source"]: i for i, r in enumerate(known)}
    full_turns = int(turns.sum())
    placed = cut(
        queues.withColumn("base", F.coalesce(F.sum("whole").over(earlier), F.lit(0)))
        .alias("q")
        .join(
            _tails(queues, turn, length, -(-full_turns * turn // length)).alias("e"),
            (F.col("q.part") == F.col("e.p")) & F.col("q.source").eqNullSafe(F.col("e.s")),
            "left",
        )
        .select("part", "source", "whole", "base", F.coalesce("tail", F.lit(0)).cast("long").alias("tail"))
    )
    joined = pieces.alias("a").join(
        placed.alias("b"), (F.col("a.part") == F.col("b.part")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            value = {c: column[c].to_numpy(zero_copy_only=False) for c in ("turn", "at", "length", "whole", "base", "tail")}
            source = column["source"].dictionary_encode()
            codes = np.array([number.get(s, 0) for s in source.dictionary.to_pylist()] + [number.get(None, 0)])
            own = codes[source.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
            ends = value["turn"] >= value["whole"]  # in the unfinished turn of its partition and source
            at = np.where(ends, value["tail"] + value["at"], 0)
            due = np.flatnonzero(~ends)
            if len(due):
                k = value["base"][due] + value["turn"][due]
                own_due = own[due]
                slot = turns_due((k + 0.5) / rates[own_due], own_due, turns, rates)
                at[due] = slot * turn + value["at"][due]
            kept = [column[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "source")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(at)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "source", "position"]
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, source string, position long"
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "a.source", "turn", "at", "whole", "base", "tail"]
    return (
        joined.select(columns)
        .mapInArrow(place, schema)
        .withColumns(
            {"sequence_id": F.expr(f"position div {length}"), "offset": F.expr(f"position % {length}")}
        )
        .drop("position")
    )
