"""Streams: histograms that grow, and recursive filters whose state is kept for each channel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_hist2d(stream: DataFrame, i: Column, j: Column) -> DataFrame:
    """(i, j, n) over all rows so far; write it in "complete" or "update" mode."""
    return stream.select(i.alias("i"), j.alias("j")).where("i is not null and j is not null").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def stream_window_mean(stream: DataFrame, ts: str, v: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Means over tumbling windows, closed once the watermark has passed them."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n"))


def stream_iir(stream: DataFrame, channel: str, t: str, v: str, gain: float, feedback: float) -> DataFrame:
    """(channel, t, filtered) of y = gain x + feedback y', the last y kept as state; rows of a batch go in order of t."""
    types = dict(stream.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else 0.0
        pdf = pd.concat(list(batches)).sort_values(t)
        out = []
        for x in pdf[v].to_numpy(float):
            y = gain * x + feedback * y
            out.append(y)
        state.update((float(y),))
        yield pd.DataFrame({channel: pdf[channel], t: pdf[t], "filtered": out})

    return stream.select(channel, t, v).groupBy(channel).applyInPandasWithState(run, f"{channel} {types[channel]}, {t} {types[t]}, filtered double", "y double", "append", GroupStateTimeout.NoTimeout)
