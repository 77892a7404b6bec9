"""Ordered-run operators: sequences, streaks, running budgets, and the folds that keep state over a run.

The folds (`ProgressFold`, `BudgetFold`) are plain Python objects with a small state; the batch twin replays a run in order, the
streaming twin keeps the same state in the state store (`strataforge.streaming.runs`).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROGRESS_SCHEMA = "run_id bigint, sequence bigint, no_progress boolean, reason string, streak int, emit boolean, progress boolean"
BUDGET_SCHEMA = "run_id bigint, seq bigint, action string, accepted boolean, refused_on string, committed string, reserved string"


def sequenced(df: DataFrame, run: str, order: list[str], out: str = "sequence") -> DataFrame:
    """A number from 1 within each run, in order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def last_streak(df: DataFrame, run: str, order: list[str], value: str) -> DataFrame:
    """(run, value, streak): the last value of each run and how many rows in a row have it at the end (gaps and islands)."""
    w = Window.partitionBy(run).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    islands = df.withColumn("_c", changed).withColumn("_island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = islands.groupBy(run, "_island").agg(F.first(value).alias("value"), F.count("*").alias("streak"))
    return own.groupBy(run).agg(F.max_by("value", "_island").alias("value"), F.max_by("streak", "_island").alias("streak"))


def stage_entries(df: DataFrame, run: str, order: list[str], stage: str) -> DataFrame:
    """(run, stage, entries): how often each stage is entered anew."""
    w = Window.partitionBy(run).orderBy(*order)
    entered = ~F.col(stage).eqNullSafe(F.lag(stage).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("_e", entered).where("_e").groupBy(run, stage).agg(F.count("*").alias("entries"))


def growth(df: DataFrame, run: str, order: list[str], value: Column) -> DataFrame:
    """Adds `grew`: the value is above every earlier one of its run; a first value counts only if positive."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(value).over(w)
    return df.withColumn("grew", F.when(before.isNull(), value > 0).otherwise(value > before))


def running_budget(df: DataFrame, run: str, order: list[str], cost: Column, limit: int) -> DataFrame:
    """Adds `spent` and `within`: the running cost of the run and whether it is within the limit."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).withColumn("within", F.col("spent") <= limit)


def paired_spans(df: DataFrame, span: str, time: str, started: Column) -> DataFrame:
    """(span, duration_ms) of spans with a start and an end, by one aggregation."""
    both = df.groupBy(span).agg(F.min(F.when(started, F.col(time))).alias("began"), F.max(F.when(~started, F.col(time))).alias("ended"))
    return both.where("began is not null and ended is not null").select(span, (F.expr("unix_micros(cast(ended as timestamp)) - unix_micros(cast(began as timestamp))") / 1000.0).alias("duration_ms"))


class ProgressFold:
    """Finds runs that get nowhere: repeated errors, resources, operations, re-entered stages, or no growth since the last progress.

    Of the window since the last progress only what the rules need is kept. Every different successful output is remembered for as long
    as the run lasts, as a digest of 8 bytes, since one seen before is no progress: that part of the state grows with the run's outputs.
    """

    COUNTS = ("artifact_count", "evidence_count", "completed_unit_count")

    def __init__(self, threshold: int = 3, state: dict | None = None):
        self.threshold = threshold
        self.state = state or {"most": {}, "outputs": [], "latch": None, "n": 0, "streaks": {}, "entries": {}, "stage": None}
        self.outputs = set(self.state["outputs"])

    def _progress(self, s: dict) -> bool:
        grew = False
        for name in self.COUNTS:
            now = s.get(name)
            if now is None or now != now:
                continue
            before = self.state["most"].get(name, -1)
            grew |= now > before and now > 0
            self.state["most"][name] = max(before, int(now))
        if s.get("successful") and s.get("output_hash"):
            digest = int.from_bytes(hashlib.blake2b(str(s["output_hash"]).encode(), digest_size=8).digest(), "big")
            if digest not in self.outputs:
                self.outputs.add(digest)
                self.state["outputs"].append(digest)
                grew = True
        return grew

    def observe(self, s: dict) -> dict:
        st = self.state
        quiet = {"sequence": s["sequence"], "no_progress": False, "reason": None, "streak": 0, "emit": False, "progress": False}
        if self._progress(s):
            st.update(latch=None, n=0, streaks={}, entries={}, stage=None)
            return quiet | {"progress": True}
        st["n"] += 1
        found = []
        operation = "|".join(str(s.get(k)) for k in ("stage", "operation", "tool_name", "normalized_arguments_hash")) if s.get("operation") else None
        for reason, key in (("SAME_ERROR_REPEAT", s.get("error_code")), ("SAME_RESOURCE_REPEAT", s.get("target_resource_hash")), ("SAME_OPERATION_REPEAT", operation)):
            last, count = st["streaks"].get(reason, (None, 0))
            count = 0 if key is None else count + 1 if key == last else 1
            st["streaks"][reason] = (key, count)
            if count >= self.threshold:
                found.append((reason, count, key))
        stage = s.get("stage")
        if stage is not None:
            if stage != st["stage"]:
                st["entries"][stage] = st["entries"].get(stage, 0) + 1
            if st["entries"].get(stage, 0) >= self.threshold:
                found.append(("STAGE_REENTRY_WITHOUT_PROGRESS", st["entries"][stage], stage))
        st["stage"] = stage
        if st["n"] >= self.threshold:
            found.append(("NO_ARTIFACT_GROWTH", st["n"], "none"))
        if not found:
            return quiet
        reason, count, key = found[0]
        identity = f"{reason}:{key}"
        emit, st["latch"] = identity != st["latch"], identity
        return quiet | {"no_progress": True, "reason": reason, "streak": count, "emit": emit}


class BudgetFold:
    """Reserve, commit and release of several cost dimensions at once: a reservation is taken wholly or refused.

    It is refused on the duration if that is used up, else on the first dimension, in name order, that can only be observed but has a limit,
    else on the first one, in name order, it would exceed.
    """

    def __init__(self, limits: dict[str, int | None], state: dict | None = None, observed: frozenset[str] = frozenset()):
        self.limits, self.state, self.observed = limits, state or {"committed": {}, "reserved": {}, "open": {}}, observed

    def preview(self, costs: dict[str, int], elapsed_ms: int | None = None) -> str | None:
        """The dimension a reservation would be refused on, or None."""
        st, most = self.state, self.limits.get("duration_ms")
        if most is not None and elapsed_ms is not None and elapsed_ms >= most:
            return "duration_ms"
        limited = [name for name in sorted(costs) if self.limits.get(name) is not None]
        return next((name for name in limited if name in self.observed), None) or next(
            (name for name in limited if st["committed"].get(name, 0) + st["reserved"].get(name, 0) + costs[name] > self.limits[name]), None
        )

    def apply(self, seq: int, action: str, reservation: str, costs: dict[str, int], elapsed_ms: int | None = None) -> dict:
        st, refused, accepted = self.state, None, True
        if action == "reserve":
            refused = self.preview(costs, elapsed_ms)
            accepted = refused is None
            if accepted and reservation in st["open"]:
                accepted = False
            if accepted:
                st["open"][reservation] = dict(costs)
                for name, cost in costs.items():
                    st["reserved"][name] = st["reserved"].get(name, 0) + cost
        elif reservation in st["open"]:
            held = st["open"].pop(reservation)
            for name, cost in held.items():
                st["reserved"][name] -= cost
            if action == "commit":
                for name, cost in (costs or held).items():
                    st["committed"][name] = st["committed"].get(name, 0) + cost
                    limit = self.limits.get(name)
                    if limit is not None and st["committed"][name] > limit:
                        refused = name
        else:
            accepted = False
        return {"seq": seq, "action": action, "accepted": accepted, "refused_on": refused, "committed": json.dumps(st["committed"], sort_keys=True), "reserved": json.dumps(st["reserved"], sort_keys=True)}


def replay_progress(df: DataFrame, threshold: int = 3) -> DataFrame:
    """Decisions for every signal (run_id, sequence, ...) in order of sequence.

    Rows are sorted within partitions and streamed, one run's state at a time, so a long run is never held in memory.
    """
    schema = PROGRESS_SCHEMA

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, None
        for frame in frames:
            out = []
            for s in frame.to_dict("records"):
                s = {k: None if isinstance(v, float) and v != v else v for k, v in s.items()}
                if s["run_id"] != now:
                    now, fold = s["run_id"], ProgressFold(threshold)
                out.append({"run_id": now, **fold.observe(s)})
            yield pd.DataFrame(out, columns=["run_id", "sequence", "no_progress", "reason", "streak", "emit", "progress"])

    return df.repartition("run_id").sortWithinPartitions("run_id", "sequence").mapInPandas(run, schema)


def replay_budget(df: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """The ledger after every action (run_id, seq, action, reservation_id, costs as JSON) in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.run_id != now:
                    now, fold = r.run_id, BudgetFold(limits)
                out.append({"run_id": now, **fold.apply(r.seq, r.action, r.reservation_id, json.loads(r.costs or "{}"))})
            yield pd.DataFrame(out, columns=["run_id", "seq", "action", "accepted", "refused_on", "committed", "reserved"])

    rows = df.select("run_id", "seq", "action", "reservation_id", "costs")
    return rows.repartition("run_id").sortWithinPartitions("run_id", "seq").mapInPandas(run, BUDGET_SCHEMA)


def progress_signals(events: DataFrame) -> DataFrame:
    """The signals of trace events (run_id, sequence, stage, operation, tool_name, error_code, status, input_summary, output_summary): hashes only
    where the summaries (maps of texts, the output's first) hold one, counts only where they are whole numbers."""
    both = F.map_concat(F.coalesce(F.map_filter("input_summary", lambda k, v: ~F.coalesce(F.map_contains_key("output_summary", k), F.lit(False))), F.create_map().cast("map<string,string>")), F.coalesce("output_summary", F.create_map().cast("map<string,string>")))
    rows = events.withColumn("_all", both)
    hashes = [F.when(F.lower(F.col("_all")[n]).rlike("^[0-9a-f]{64}$"), F.lower(F.col("_all")[n])).alias(n) for n in ("normalized_arguments_hash", "target_resource_hash", "output_hash")]
    counts = [F.when(F.col("_all")[n].rlike("^[0-9]+$"), F.col("_all")[n]).try_cast("bigint").alias(n) for n in ProgressFold.COUNTS]
    return rows.select("run_id", "sequence", "stage", "operation", "tool_name", "error_code", (F.col("status") == "SUCCESS").alias("successful"), *hashes, *counts)
