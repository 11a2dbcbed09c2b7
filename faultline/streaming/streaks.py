"""Failure streaks over a stream of runs: one state per key, streaks leave when a green closes them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "user_id bigint, streak_length bigint, first_red bigint, last_red bigint, prev_green bigint, next_green bigint"
STATE = "prev_green bigint, n bigint, first_red bigint, last_red bigint"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    green, n, first, last = state.get if state.exists else (None, 0, None, None)
    out = []
    for event, red in zip(rows["event_id"], rows["red"], strict=True):
        event = int(event)
        if red:
            first, last, n = first if n else event, event, n + 1
        else:
            if n:
                out.append((int(key[0]), n, first, last, green, event))
            green, n, first, last = event, 0, None, None
    state.update((green, n, first, last))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def closed_streaks(runs: DataFrame) -> DataFrame:
    """runs: user_id, ts, event_id, red. Rows of one key must come in order across triggers; within one they may not.

    What a key keeps is four numbers, however long its history.
    """
    return runs.groupBy("user_id").applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")


BUFFER = f"{STATE}, at array<bigint>, event array<bigint>, red array<boolean>"


def _ordered(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    green, n, first, last, *held = state.get if state.exists else (None, 0, None, None, [], [], [])
    rows = sorted({(int(t), int(e), bool(r)) for t, e, r in zip(*held, strict=True)} | {(int(t), int(e), bool(r)) for b in batches for t, e, r in zip(b["at"], b["event_id"], b["red"], strict=True)})
    safe = state.getCurrentWatermarkMs() * 1000
    out, ripe = [], sum(at < safe for at, _, _ in rows)
    for _, event, red in rows[:ripe]:
        if red:
            first, last, n = first if n else event, event, n + 1
        else:
            if n:
                out.append((int(key[0]), n, first, last, green, event))
            green, n, first, last = event, 0, None, None
    rows = rows[ripe:]
    state.update((green, n, first, last, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
    if rows:
        state.setTimeoutTimestamp(max(rows[0][0] // 1000 + 1, safe // 1000 + 1))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def closed_streaks_out_of_order(runs: DataFrame, delay: str) -> DataFrame:
    """closed_streaks of runs that come late by at most the delay, in any order, across triggers.

    Runs wait in their key's state until the watermark has passed them and are then taken in order, once each; the rows
    that a key holds are those of one delay. Runs later than the watermark are dropped by Spark.
    """
    timed = runs.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("user_id").applyInPandasWithState(_ordered, OUT, BUFFER, "append", "EventTimeTimeout")
