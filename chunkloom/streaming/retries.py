"""Structured Streaming: retry state per source, new work per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

STATE = "failures int, profile string"
OUT = "source string, failures int, wait_s long"


def step(failures: int, profile: str | None, outcome: str, profile_now: str | None, poll: int) -> tuple[int, int]:
    """Failures in a row and seconds to wait after one more attempt: 1, 2, 4 polls and so on, 60 at most; a changed profile counts anew, a success clears."""
    if outcome == "ok":
        return 0, 0
    before = failures if profile_now == profile else 0
    return before + 1, int(poll * min(2 ** min(before, 6), 60))


def retry_state(attempts: DataFrame, poll: int = 30) -> DataFrame:
    """source, failures, wait_s after each micro-batch. attempts: source, ts, outcome ('ok' or 'failed'), profile. A streaming table; finished batches are folded by state.backoff and timeline.islands."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, profile = state.get if state.exists else (0, None)
        wait = 0
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            failures, wait = step(failures, profile, row.outcome, row.profile, poll)
            profile = row.profile
        state.update((failures, profile))
        yield pd.DataFrame({"source": [key[0]], "failures": [failures], "wait_s": [wait]})

    return attempts.groupBy("source").applyInPandasWithState(update, OUT, STATE, "update", "NoTimeout")


def deliver(jobs: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, poll_s: int = 30) -> DataStreamWriter:
    """A writer that hands each micro-batch with its number to commit; commit must be idempotent for a number it has seen."""
    return jobs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, poll_s)} seconds")
