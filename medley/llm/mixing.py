"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medley.llm.common import size_in_words
from medley.session import cut

HASH_BITS = 60
STEP_BITS = 12  # buckets per source and pass: 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def hash_of_id(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text: any engine can repeat them."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): the words of every row and its place in its source's order."""
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        size_in_words(F.col("text").cast("string")).alias("size"),
        hash_of_id(F.col("doc_id")).alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The sources, by code point and NULL last, weigh as ``weights`` says, repeating.
    ``share`` of all sizes is dealt out by weight; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight until none is above.
    That is one water level: with the sources ordered by how soon they fill, the
    first k are full and the rest stand at (budget - full) / (weight left).
    The windows see one row per source, not per document.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    )
    weighed = weighed.withColumn("room", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    stepped = weighed.withColumns(
        {
            "budget": F.sum("source_size").over(everything) * F.lit(share),
            "full": F.coalesce(F.sum("room").over(before), F.lit(0.0)),
            "left": F.sum("weight").over(after),
        }
    )
    stepped = stepped.withColumn("level", (F.col("budget") - F.col("full")) / F.col("left"))
    # the first source, in filling order, that does not fill fixes the level
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct(F.col("room") / F.col("weight"), "level"))).over(
        everything
    )["level"]
    return stepped.withColumn("height", level).select(
        "source", "source_size", F.least("room", F.coalesce(F.col("height") * F.col("weight"), F.col("room"))).alias("target")
    )


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): a row is taken ``whole`` times, and
    once more if its hash is less than ``below``.

    The part of the target beyond whole copies is the budget.  Sizes are summed by
    source and leading hash bits; the bucket in which the running sum passes the
    budget is the boundary.  Only boundary buckets are summed again, by the next
    bits, until each is down to rows of one hash, which are taken if that comes
    nearer to the budget than leaving them.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = goals.withColumn("whole", whole.cast("long")).withColumns(
        {
            "budget": F.col("target") - F.col("whole") * F.col("source_size"),
            "start": F.lit(0).cast("long"),  # first hash of the boundary bucket
            "taken": F.lit(0).cast("long"),  # words below it
        }
    )
    width = HASH_BITS
    done = None
    while True:
        width -= STEP_BITS
        step = 1 << width
        last = F.col("start") + F.lit((step << STEP_BITS) - 1)
        key = F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("r.h").between(F.col("start"), last)
        counted = (
            rows.alias("r")
            .join(state.alias("s"), key)
            .groupBy("s.source", F.expr(f"r.h - pmod(r.h, {step}L)").alias("bucket"))
            .agg(
                F.sum("size").alias("words"),
                F.min("h").alias("low"),
                F.max("h").alias("high"),
                *[F.first(F.col(f"s.{c}")).alias(c) for c in ("source_size", "target", "whole", "budget", "start", "taken")],
            )
        )
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) + F.col("taken")
        found = counted.withColumn("after", running).withColumn("before", F.col("after") - F.col("words"))
        # a bucket of one hash is a unit; any other is a boundary when the budget falls inside it
        inside = F.when(F.col("low") == F.col("high"), F.col("before") + F.col("after") > 2 * F.col("budget")).otherwise(
            F.col("after") > F.col("budget")
        )
        edge = F.min(F.when(inside, F.struct("bucket", "before", "low", "high"))).alias("edge")
        kept = [F.first(c).alias(c) for c in ("source_size", "target", "whole", "budget", "start")]
        edges = cut(found.groupBy("source").agg(edge, *kept))
        settled = edges.filter("edge is null or edge.low = edge.high").select(
            "source",
            "source_size",
            "target",
            "whole",
            F.coalesce(F.col("edge.low"), last + 1).alias("below"),
        )
        done = settled if done is None else done.union(settled)
        state = edges.filter("edge.low < edge.high").select(
            "source",
            "source_size",
            "target",
            "whole",
            "budget",
            F.col("edge.bucket").alias("start"),
            F.col("edge.before").alias("taken"),
        )
        if width == 0 or state.isEmpty():
            return done


def _copies(most: float, prefix: str = "") -> Column:
    whole, h, below = (F.col(prefix + c) for c in ("whole", "h", "below"))
    return F.least(whole + (h < below).cast("long"), F.lit(int(most)).cast("long"))


def _limits(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return cut(thresholds(rows, cut(targets(sizes, weights, share, most))))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    ``copies`` is how often the mix takes the row: the whole copies its source is due,
    and one more below the source's hash threshold.  The choice depends on the ids
    and sizes alone, so reruns agree; rows with the same id are taken alike.  NULL
    texts have size 0, NULL sources are one source, an empty table gives no rows.
    """
    rows = cut(measured(docs))
    limits = _limits(rows, weights, share, most)
    return (
        rows.alias("r")
        .join(limits.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")))
        .select(
            "doc_id",
            "r.source",
            "size",
            "source_size",
            "target",
            _copies(most).alias("copies"),
        )
    )


def take_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns."""
    limits = _limits(cut(measured(docs)), weights, share, most).select("source", "whole", "below")
    joined = docs.withColumns({"__h": hash_of_id(F.col("doc_id")), "__source": F.col("source").cast("string")}).join(
        limits.withColumnsRenamed({"source": "__of", "whole": "__whole", "below": "__below"}),
        F.col("__source").eqNullSafe(F.col("__of")),
    )
    return (
        joined.withColumn("__copies", _copies(most, "__"))
        .filter("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
        .select(docs.columns)
    )
