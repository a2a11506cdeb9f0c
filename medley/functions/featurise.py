"""Hook for user featurisers: list of texts in, one vector per text out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medley.session import cut


def text_key(text: Column | str) -> Column:
    """SHA-256 of a text: what vectors are joined by, so that no text is a join key."""
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256)


def featurise(df: DataFrame, text: str, fn: Callable[[list[str]], list]) -> tuple[DataFrame, DataFrame]:
    """(text_key, vec) of the distinct texts, and the quarantine (text_key, text, error).

    ``fn`` gets one Arrow batch of texts.  When it raises, the batch is retried
    text by text so that only the bad ones are quarantined.  Equal texts are
    featurised once, and the outcome is written before it is split in two, so
    ``fn`` runs once.  Join the vectors back on ``text_key`` of the text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = list(batch["text_key"]), list(batch["text"])
            try:
                rows = [(k, None, [float(x) for x in v], None) for k, v in zip(keys, fn(texts), strict=True)]
            except Exception:
                rows = []
                for k, t in zip(keys, texts):
                    try:
                        rows.append((k, None, [float(x) for x in fn([t])[0]], None))
                    except Exception as error:
                        rows.append((k, t, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["text_key", "text", "vec", "error"])

    keyed = df.filter(F.col(text).isNotNull()).select(text_key(text).alias("text_key"), F.col(text).alias("text"))
    distinct = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
    done = cut(distinct.mapInPandas(run, "text_key string, text string, vec array<double>, error string"))
    return (
        done.filter("error IS NULL").select("text_key", "vec"),
        done.filter("error IS NOT NULL").select("text_key", "text", "error"),
    )
