"""The failure counter as a stream: state for each source is the number of failures in a row and the last run counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "source long, run_id long, in_a_row int"
STATE = "n int, at timestamp, run_id long"


def in_a_row(failed: np.ndarray, before: int) -> np.ndarray:
    """Failures in a row up to each run, where `before` came before the first."""
    place = np.arange(len(failed))
    last = np.maximum.accumulate(np.where(failed, -1, place))  # the last success so far
    return np.where(last < 0, before + place + 1, place - last)


def stream_alerts(runs: DataFrame, threshold: int = 3) -> DataFrame:
    """Alerts of a stream of runs (source, run_id, run_at, failed): one at every `threshold` failures in a row.

    Runs count in the order of run_at and run_id within a batch. A run that comes late, after a newer one of its source was
    counted, doesn't count: what it would have changed has been told already.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, run_id = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(batches)).sort_values(["run_at", "run_id"])
        if at is not None:
            rows = rows[(rows.run_at > at) | ((rows.run_at == at) & (rows.run_id > run_id))]
        if not len(rows):
            return
        runs_in = in_a_row(rows.failed.to_numpy(bool), n)
        sent = rows.failed.to_numpy(bool) & (runs_in % threshold == 0)
        last = rows.iloc[-1]
        state.update((int(runs_in[-1]), last.run_at.to_pydatetime(), int(last.run_id)))
        yield pd.DataFrame({"source": key[0], "run_id": rows.run_id[sent], "in_a_row": threshold})

    own = runs.select(F.col("source").cast("long").alias("source"), "run_id", F.col("run_at").cast("timestamp").alias("run_at"), "failed")
    return own.groupBy("source").applyInPandasWithState(count, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_rates(runs: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Runs and failures of each source by tumbling windows of run_at; with a stream, rows later than `late` are left out and a
    window comes once it is over."""
    timed = runs.withColumn("run_at", F.col("run_at").cast("timestamp")).withWatermark("run_at", late)
    counts = timed.groupBy("source", F.window("run_at", window).alias("w")).agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"))
    return counts.select("source", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "n_failed")
