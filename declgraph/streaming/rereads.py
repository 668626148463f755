"""The usage log as a stream: repeated reads of a target within a gap, with state for each target."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import GAP_SECONDS
from ..sources.audit import SCHEMA


def read(spark: SparkSession, folder: str) -> DataFrame:
    """New log files of a folder as they come: target, label, at."""
    raw = spark.readStream.schema(SCHEMA).json(folder)
    rows = raw.where("path is not null").select(F.col("path").alias("target"), F.col("operation").alias("label"), F.try_to_timestamp("timestamp").alias("at"))
    return rows.where("at is not null").withWatermark("at", "10 minutes")


def pairs(events: DataFrame, gap: float = GAP_SECONDS) -> DataFrame:
    """target, before, after for each reread within the gap; a target's state is its last read and goes after the gap."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for r in rows.itertuples():
            now = r.at.timestamp()
            if last and last[0] != r.label and 0 <= now - last[1] <= gap:
                out.append((key[0], last[0], r.label))
            last = (r.label, now)
        state.update(last)
        state.setTimeoutTimestamp(int((last[1] + gap) * 1000) + 1 + max(0, state.getCurrentWatermarkMs() - int((last[1] + gap) * 1000)))
        yield pd.DataFrame(out, columns=["target", "before", "after"])

    return events.groupBy("target").applyInPandasWithState(step, "target string, before string, after string", "label string, at double", "append", GroupStateTimeout.EventTimeTimeout)
