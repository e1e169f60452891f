"""Mode detection as a stream that survives disorder: tokens wait in a buffer until those before them have come, across micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that transformWithState needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = ["seq", "token", "starts", "run", "cursor"]


def _millis(at: pd.Series) -> list[int | None]:
    """Milliseconds since 1970 of times, None of nulls."""
    if at.dtype.kind != "M" or at.dt.tz is not None:
        return [None if pd.isna(x) else int(pd.Timestamp(x).timestamp() * 1000) for x in at]
    ms = at.to_numpy().astype("datetime64[ms]")
    return [None if null else x for null, x in zip(np.isnat(ms).tolist(), ms.astype(np.int64).tolist(), strict=True)]


class Detector(StatefulProcessor):
    """For each key: a value (the last width tokens, how far it has come, its timer) and a list of the tokens that wait, which is read and written as a whole: a call for each token would take far longer than the token.

    One timer for each key: at the time of the earliest waiting token, else when the key has been idle for long enough. It is set anew only to an earlier time; where it fires too soon it is set again.
    """

    def __init__(self, pattern: str, width: int, joiner: str, first: int, idle_ms: int):
        self.pattern, self.width, self.joiner, self.first, self.idle_ms = pattern, width, joiner, first, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "last array<string>, place long, run long, began long, next long, latest long, timer long, held long")
        self.waiting = handle.getListState("waiting", "seq long, token string, at long")

    def _load(self) -> dict:
        names = ("last", "place", "run", "began", "next", "latest", "timer", "held")
        s = dict(zip(names, self.at.get() if self.at.exists() else ([], 0, 0, None, self.first, None, None, 0), strict=True))
        s["last"] = list(s["last"])
        return s

    def _tell(self, s: dict, seq: int, token: str | None, rows: list) -> None:
        s["place"] += 1
        s["last"] = [*s["last"], token][-self.width :]
        starts = s["place"] > 1 and self.joiner.join(t for t in s["last"] if t is not None).endswith(self.pattern)
        if starts:
            s["run"], s["began"] = s["run"] + 1, s["place"]
        s["next"] = seq + 1
        rows.append((seq, token, starts, s["run"], None if s["began"] is None else s["place"] - s["began"]))

    def _save(self, s: dict, waiting: dict, watermark: int) -> None:
        times = [at for _, at in waiting.values() if at is not None]
        due = min(times) if times else max(s["latest"] if s["latest"] is not None else watermark, watermark) + self.idle_ms
        if s["timer"] is None or due < s["timer"]:
            if s["timer"] is not None:
                self.handle.deleteTimer(s["timer"])
            self.handle.registerTimer(due)
            s["timer"] = due
        s["held"] = len(waiting)
        self.at.update(tuple(s.values()))

    def _held(self, s: dict) -> dict:
        return {seq: (token, at) for seq, token, at in self.waiting.get()} if s["held"] else {}

    def _frame(self, key: tuple, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            frame = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
            frame.insert(0, "key", pd.Series([key[0]] * len(rows), dtype=object))
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, out = self._load(), []
        old = self._held(s)
        waiting = dict(old)
        for frame in rows:
            for seq, token, ms in zip(frame["seq"].tolist(), frame["token"].tolist(), _millis(frame["at"]), strict=True):
                token = None if token is None or token != token else token
                if ms is not None:
                    s["latest"] = ms if s["latest"] is None else max(s["latest"], ms)
                if seq is None or seq != seq or seq < s["next"] or seq in waiting:
                    out.append((None if seq is None or seq != seq else int(seq), token, None, None, None))
                else:
                    waiting[int(seq)] = (token, ms)
        while s["next"] in waiting:
            self._tell(s, s["next"], waiting.pop(s["next"])[0], out)
        self._swap(old, waiting)
        self._save(s, waiting, timerValues.getCurrentWatermarkInMs())
        yield from self._frame(key, out)

    def _swap(self, old: dict, new: dict) -> None:
        added = [(seq, *x) for seq, x in new.items() if seq not in old]
        if len(new) - len(added) == len(old):
            if added:
                self.waiting.appendList(added)
        elif new:
            self.waiting.put([(seq, *x) for seq, x in new.items()])
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, out = self._load(), []
        watermark = timerValues.getCurrentWatermarkInMs()
        old = self._held(s)
        waiting = dict(old)
        idle = s["latest"] is None or s["latest"] + self.idle_ms <= watermark
        due = [seq for seq, (_, at) in waiting.items() if idle or (at is not None and at <= watermark)]
        if due:
            for seq in sorted(x for x in waiting if x <= max(due)):
                self._tell(s, seq, waiting.pop(seq)[0], out)
            while s["next"] in waiting:
                self._tell(s, s["next"], waiting.pop(s["next"])[0], out)
        if idle:
            self.waiting.clear()
            self.at.clear()
        else:
            self._swap(old, waiting)
            s["timer"] = None
            self._save(s, waiting, watermark)
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


def ordered_modes(tokens: DataFrame, pattern: str, width: int = 10, joiner: str = " ", late: str = "10 minutes", idle: str = "1 day", first: int = 1) -> DataFrame:
    """key, seq, token, starts, run and cursor of a stream of (key, seq, token, at), as decode.mode_switch gives them of the whole table, in whatever order the tokens come.

    seq counts a key's tokens from first without gaps. A token is told once all before it have been; until then it waits in the state, where restarts find it again. The state of a key holds width tokens, a few
    numbers and what waits, never what has been told. When the watermark (late behind the latest at) passes the at of a waiting token, those missing before it are given up and it is told.
    A token that comes after that, or a second time, or has no seq, comes out at once with null starts, run and cursor; one behind the watermark (which begins at 1970) is dropped by Spark
    before it gets here.
    A key without new tokens for as long as idle tells what waits and forgets its state. A null at never falls behind. Null keys are one key; a null token counts as a place without text.
    The session that starts the stream must use the state store STORE.
    """
    spark = tokens.sparkSession
    idle_ms = int(spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {idle})").first()[0])
    kind = tokens.schema["key"].dataType.simpleString()
    rows = tokens.select("key", F.col("seq").cast("long").alias("seq"), "token", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Detector(pattern, width, joiner, first, idle_ms), f"key {kind}, seq long, token string, starts boolean, run long, cursor long", "Append", "EventTime")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what there is into Parquet files at path, then stop; the next run goes on where this one ended."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE[0])
    conf.set(*STORE)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(STORE[0], before)
