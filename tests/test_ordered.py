"""Mode detection over a stream whose tokens come in any order, against the batch form."""

import random

from pyspark.sql import functions as F

from factloom.operators import decode
from factloom.streaming import ordered

SCHEMA = "key long, seq long, token string, at timestamp"


def feed(spark, tmp_path, batches, **how):
    for rows in batches:
        spark.createDataFrame(rows, "key long, seq long, token string, at long").select("key", "seq", "token", F.timestamp_seconds(F.col("at") + 1000).alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        ordered.run_available(ordered.ordered_modes(source, "go", width=3, **how), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)


def test_shuffled_with_restarts(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, i, r.choice(["go", "x", "y", None]), i) for k in (1, 2, None) for i in range(1, 25)]
    r.shuffle(rows)
    got = feed(spark, tmp_path, [rows[:20], rows[20:50], rows[50:]], late="1 day")
    table = spark.createDataFrame(rows, "key long, seq long, token string, at long")
    want = decode.mode_switch(table, ["key"], "seq", "token", "go", 3).select("key", "seq", "token", "starts", "run", "cursor")
    assert got == sorted(map(tuple, want.collect()), key=str)


def test_gaps_repeats_and_idle_keys(spark, tmp_path):
    got = feed(spark, tmp_path, [
        [(1, 1, "a", 0), (1, 3, "go", 5), (2, 1, "b", 0), (2, 1, "again", 0), (2, None, "nowhere", 0)],  # seq 2 of key 1 is missing
        [(3, 1, "c", 100)],  # moves the watermark to 90 s for the next run: 3 is told without 2
        [(3, 2, "go", 101), (1, 2, "late but not too late", 95), (1, 5, "waits", 96)],
        [(3, 3, "d", 100_000)],  # keys 1 and 2 are idle then
        [(3, 4, "e", 100_001)],
    ], late="10 seconds", idle="1 hour")
    assert got == sorted([
        (1, 1, "a", False, 0, None), (1, 3, "go", True, 1, 0), (2, 1, "b", False, 0, None), (2, 1, "again", None, None, None), (2, None, "nowhere", None, None, None),
        (3, 1, "c", False, 0, None), (3, 2, "go", True, 1, 0), (1, 2, "late but not too late", None, None, None), (1, 5, "waits", False, 1, 1),
        (3, 3, "d", False, 1, 1), (3, 4, "e", False, 1, 2),
    ], key=str)


def test_waiting_tokens_are_kept_in_one_call():
    """However many tokens of a key wait, its state is read and written by a few calls (one for each token before)."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.held = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("get", "exists"):
                    return self.held is not None if name == "exists" else self.held if isinstance(self.held, tuple) else iter(self.held or [])
                if name == "appendList":
                    self.held = [*(self.held or []), *args[0]]
                elif name in ("put", "update"):
                    self.held = args[0]
                elif name == "clear":
                    self.held = None
                elif name == "getCurrentWatermarkInMs":
                    return 0
                else:
                    assert name in ("registerTimer", "deleteTimer")
            return call

    handle = State()
    handle.getValueState = handle.getListState = lambda *a: State()
    d = ordered.Detector("the", 10, " ", 1, 1000)
    d.init(handle)
    frame = lambda seqs: pd.DataFrame({"seq": seqs, "token": ["the"] * len(seqs), "at": pd.to_datetime([1_000_000] * len(seqs), unit="ms")})
    told = [list(d.handleInputRows((1,), iter([frame(list(seqs))]), State())) for seqs in (range(2, 600), range(601, 1000), [600], [1])]
    assert [len(x) for x in told] == [0, 0, 0, 1] and told[3][0]["seq"].tolist() == list(range(1, 1000))
    assert len(calls) < 50
