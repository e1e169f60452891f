"""Mode detection as a stream: a state for each conversation remembers its last tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_modes(tokens: DataFrame, pattern: str, width: int = 10, joiner: str = " ") -> DataFrame:
    """key, seq, token, starts and run of a stream of (key, seq, token): whether the last width tokens end with the pattern, and how many starts so far.

    The first token of a key is its prompt and never starts a run. Rows of a micro-batch are taken by seq; a state holds width tokens and two numbers.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, run, seen = state.get if state.exists else ([], 0, False)
        last, rows = list(last), []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            last = [*last, r.token][-width:]
            starts = seen and joiner.join(last).endswith(pattern)
            run, seen = run + starts, True
            rows.append((key[0], r.seq, r.token, starts, run))
        state.update((last, run, seen))
        yield pd.DataFrame(rows, columns=["key", "seq", "token", "starts", "run"])

    return tokens.groupBy("key").applyInPandasWithState(
        step, "key long, seq long, token string, starts boolean, run long", "last array<string>, run long, seen boolean", "append", "NoTimeout"
    )


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events of each key in tumbling windows, with a watermark for late ones. Timestamps without a zone are taken as UTC."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
