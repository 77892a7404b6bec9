"""Queries of ordered runs over the events table: a user is a run, event types are stages, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import runs as R

_ORDER = ["ts", "event_id"]


def _cents():
    return F.expr("cast(round(value * 100) as bigint)")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def run_sequence(spark: SparkSession, d: str) -> DataFrame:
    return R.sequenced(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", _ORDER).select("event_id", "user_id", "sequence")


def trace_pairing(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.expr("event_id div 2").alias("span_id"), "event_id", "ts")
    return R.paired_spans(rows, "span_id", "ts", F.col("event_id") % 2 == 0).select("span_id", F.round("duration_ms", 3).alias("duration_ms"))


def last_streaks(spark: SparkSession, d: str) -> DataFrame:
    return R.last_streak(_events(spark, d), "user_id", _ORDER, "event_type")


def stage_reentry(spark: SparkSession, d: str) -> DataFrame:
    return R.stage_entries(_events(spark, d), "user_id", _ORDER, "event_type")


def value_growth(spark: SparkSession, d: str) -> DataFrame:
    return R.growth(_events(spark, d), "user_id", _ORDER, F.col("value")).groupBy("user_id").agg(F.count_if("grew").alias("growth_events"), F.count("*").alias("events"))


def budget_running(spark: SparkSession, d: str) -> DataFrame:
    rows = R.running_budget(_events(spark, d), "user_id", _ORDER, _cents(), 50_000)
    return rows.select("event_id", "spent", "within")


def session_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = R.running_budget(_events(spark, d), "user_id", _ORDER, F.lit(1), 20)
    return rows.groupBy("user_id").agg(F.count_if("within").alias("allowed"), F.count_if(~F.col("within")).alias("refused"))


def audit_recent(spark: SparkSession, d: str) -> DataFrame:
    rows = R.sequenced(_events(spark, d).where("event_type = 'signup'"), "user_id", [F.desc("ts"), F.desc("event_id")], "nth")
    return rows.where("nth <= 5").select("user_id", "nth", "event_id")


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))
    return rows.where("k is not null").groupBy("k").agg(F.count("*").alias("events"))


def invalid_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that break a rule, each with the first rule it breaks."""
    rule = F.when(F.col("ts").isNull(), "no time").when(F.col("user_id").isNull(), "no run").when(F.get_json_object("props", "$.k").isNull(), "no property").when(F.col("value") < 0, "negative").when(F.col("value") < 1, "below one")
    return _events(spark, d).select("event_id", rule.alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def error_rates(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    return _events(spark, d).groupBy(hour.alias("hour")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))


def no_progress(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the progress detector; a purchase completes a unit, errors carry a code."""
    rows = R.sequenced(_events(spark, d), "user_id", _ORDER)
    done = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(R.Window.partitionBy("user_id").orderBy(*_ORDER).rowsBetween(R.Window.unboundedPreceding, 0))
    signals = rows.select(
        F.col("user_id").alias("run_id"), F.col("sequence").cast("bigint").alias("sequence"), F.col("event_type").alias("stage"), F.col("event_type").alias("operation"),
        F.when(F.col("event_type") == "error", F.lit("E1")).alias("error_code"), done.alias("completed_unit_count"),
    )
    return R.replay_progress(signals)


def budget_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of reservations; every third event of a run reserves, the next commits, the third releases nothing."""
    rows = R.sequenced(_events(spark, d), "user_id", _ORDER).withColumn("step", (F.col("sequence") - 1) % 3)
    events = rows.where("step < 2").select(
        F.col("user_id").alias("run_id"), F.col("sequence").cast("bigint").alias("seq"), F.when(F.col("step") == 0, "reserve").otherwise("commit").alias("action"),
        F.expr("cast((sequence - 1) div 3 as string)").alias("reservation_id"), F.when(F.col("step") == 0, F.to_json(F.struct(_cents().alias("cents"), F.lit(1).alias("calls")))).alias("costs"),
    )
    return R.replay_budget(events, {"cents": 100_000, "calls": 15})


QUERIES = {
    f.__name__: f
    for f in (run_sequence, trace_pairing, last_streaks, stage_reentry, value_growth, budget_running, session_budget, audit_recent, event_properties, invalid_events, error_rates, no_progress, budget_ledger)
}

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
SQL = {
    "run_sequence": f"SELECT event_id, user_id, row_number() {_W}) AS sequence FROM events",
    "trace_pairing": "SELECT event_id // 2 AS span_id, round((epoch_us(max(ts) FILTER (event_id % 2 = 1)) - epoch_us(min(ts) FILTER (event_id % 2 = 0))) / 1000.0, 3)::DOUBLE AS duration_ms FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 2 = 1) > 0 AND count(*) FILTER (event_id % 2 = 0) > 0",
    "last_streaks": f"""WITH c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) {_W}))::INT AS c FROM events), i AS (SELECT *, sum(c) {_W} ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT user_id, any_value(event_type) AS value, count(*) AS streak FROM i WHERE (user_id, island) IN (SELECT (user_id, max(island)) FROM i GROUP BY user_id) GROUP BY user_id""",
    "stage_reentry": f"SELECT user_id, event_type, count(*) AS entries FROM (SELECT *, event_type IS DISTINCT FROM lag(event_type) {_W}) AS e FROM events) WHERE e GROUP BY 1, 2",
    "value_growth": f"SELECT user_id, count(*) FILTER (value > coalesce(m, 0)) AS growth_events, count(*) AS events FROM (SELECT *, max(value) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) GROUP BY 1",
    "budget_running": f"SELECT event_id, sum(round(value * 100)::BIGINT) {_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS spent, sum(round(value * 100)::BIGINT) {_W} ROWS UNBOUNDED PRECEDING) <= 50000 AS within FROM events",
    "session_budget": f"SELECT user_id, count(*) FILTER (n <= 20) AS allowed, count(*) FILTER (n > 20) AS refused FROM (SELECT user_id, row_number() {_W}) AS n FROM events) GROUP BY 1",
    "audit_recent": "SELECT user_id, nth, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type = 'signup') WHERE nth <= 5",
    "event_properties": "SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS events FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL GROUP BY 1",
    "invalid_events": """SELECT rule, count(*) AS events, min(event_id) AS first_event FROM (SELECT event_id, CASE WHEN ts IS NULL THEN 'no time' WHEN user_id IS NULL THEN 'no run' WHEN json_extract_string(props, '$.k') IS NULL THEN 'no property' WHEN value < 0 THEN 'negative' WHEN value < 1 THEN 'below one' END AS rule FROM events) WHERE rule IS NOT NULL GROUP BY 1""",
    "error_rates": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
}
