"""Streaming twins of the run folds: state by run in the state store, no watermark, output append-only by (run, sequence)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import BUDGET_SCHEMA, PROGRESS_SCHEMA, BudgetFold, ProgressFold


def progress_stream(signals: DataFrame, threshold: int = 3) -> DataFrame:
    """Decisions for a stream of signals; rows of one batch and run are taken in order of sequence."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = ProgressFold(threshold, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values("sequence")
        out = []
        for s in rows.to_dict("records"):
            out.append({"run_id": key[0], **fold.observe({k: None if isinstance(v, float) and v != v else v for k, v in s.items()})})
        state.update((json.dumps(fold.state),))
        yield pd.DataFrame(out, columns=["run_id", "sequence", "no_progress", "reason", "streak", "emit", "progress"])

    return signals.groupBy("run_id").applyInPandasWithState(step, PROGRESS_SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)


def budget_stream(events: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """The ledger after every action of a stream."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = BudgetFold(limits, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [{"run_id": key[0], **fold.apply(r.seq, r.action, r.reservation_id, json.loads(r.costs or "{}"))} for r in rows.itertuples(index=False)]
        state.update((json.dumps(fold.state),))
        yield pd.DataFrame(out, columns=["run_id", "seq", "action", "accepted", "refused_on", "committed", "reserved"])

    return events.groupBy("run_id").applyInPandasWithState(step, BUDGET_SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)


def append_trace(events: DataFrame, path: str, checkpoint: str, time: str | None = None, late: str = "1 day"):
    """Write a stream of trace events once each by event id, as JSON lines; returns the query, ended when the input is read.

    With `time` an id is remembered until the watermark is `late` behind it, so the state is bounded; without, for ever.
    """
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"]) if time else events.dropDuplicates(["event_id"])
    return once.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, kind: str) -> DataFrame:
    """Counts by tumbling window and kind with a watermark; an extension, the batch results have no late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).count()
