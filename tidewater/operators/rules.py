"""Rules checked when they are loaded, and incremental passes above a stored cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from tidewater.operators import marts
from tidewater.plans import dialect

#: The shipped rules (fixed values). A condition that is null does not fire.
SHIPPED = [
    {"name": "hold-high-fraud-order", "trigger": "order_scored", "when": "model = 'fraud_risk' AND score >= threshold", "action": "hold_order_for_review", "tier": "approve"},
    {"name": "log-midband-bot-session", "trigger": "session_scored", "when": "model = 'bot_score' AND score >= 0.5 AND score < 0.7", "action": "log_event_note", "tier": "auto"},
    {"name": "retrain-on-critical-drift", "trigger": "drift_computed", "when": "status = 'critical'", "action": "retrain_model", "tier": "approve"},
    {"name": "propose-retention-offer-high-churn", "trigger": "churn_scored", "when": "model = 'churn_risk' AND score >= 0.70 AND risk_rank <= 20", "action": "propose_retention_offer", "tier": "approve"},
    {"name": "nudge-low-risk-churn", "trigger": "churn_scored", "when": "model = 'churn_risk' AND score < 0.30", "action": "log_retention_email", "tier": "auto"},
    {"name": "draft-po-on-demand-surge", "trigger": "forecast_updated", "when": "point_estimate > recent_avg * 1.2 AND point_estimate - recent_avg >= 5", "action": "draft_purchase_order", "tier": "approve"},
]


def check_rules(spark: SparkSession, rules: list[dict], events: dict[str, StructType], actions: set[str], automatic: set[str]) -> list[str]:
    """What is wrong with each rule (name, trigger, when, action, tier): an unknown
    trigger, field, action or tier, an action that may not run by itself, or a
    condition that is no Boolean Spark SQL expression over the event's fields."""
    wrong = []
    for r in rules:
        name = r.get("name", "?")
        if r.get("action") not in actions:
            wrong.append(f"{name}: unknown action")
        if r.get("tier") not in ("auto", "approve"):
            wrong.append(f"{name}: unknown tier")
        elif r["tier"] == "auto" and r.get("action") not in automatic:
            wrong.append(f"{name}: action may not run by itself")
        if r.get("trigger") not in events:
            wrong.append(f"{name}: unknown trigger")
            continue
        try:
            kind = spark.createDataFrame([], events[r["trigger"]]).select(F.expr(r["when"])).schema[0].dataType
            if not isinstance(kind, BooleanType):
                wrong.append(f"{name}: condition is not Boolean")
        except (PySparkException, KeyError):
            wrong.append(f"{name}: condition cannot be resolved")
    return wrong


def incremental_pass(rows: DataFrame, cursor_path: str, key: str, most: int, act: Callable[[DataFrame], None]) -> int:
    """Hand the next ``most`` rows above the stored cursor to ``act`` and move the
    cursor only after it succeeded; returns the cursor. ``act`` must be idempotent."""
    spark = rows.sparkSession
    try:
        cursor = spark.read.schema("cursor long").parquet(f"{cursor_path}/*").agg(F.max("cursor")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cursor = 0  # no pass has finished yet
    batch = rows.where(F.col(key) > cursor).orderBy(key).limit(most)
    high = batch.agg(F.max(key)).first()[0]
    if high is None:
        return cursor
    act(batch)
    spark.createDataFrame([(high,)], "cursor long").write.mode("overwrite").parquet(f"{cursor_path}/{high}")
    return high


def fire(events: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule, action, tier) beside the columns of every event that a rule fires on, in one pass over the events."""
    hits = [F.when((F.col("on_event") == r["trigger"]) & F.expr(r["when"]), F.struct(*[F.lit(r[k]).alias(n) for k, n in (("name", "rule"), ("action", "action"), ("tier", "tier"))])) for r in rules]
    return events.withColumn("_hit", F.explode(F.array_compact(F.array(*hits)))).select(*events.columns, "_hit.*")


def _events(d):
    """Events of scores, drift runs and forecasts, as one table with nulls where an event lacks a field."""
    none = "CAST(NULL AS DOUBLE) AS threshold, CAST(NULL AS BIGINT) AS risk_rank, CAST(NULL AS VARCHAR(10)) AS status, CAST(NULL AS DOUBLE) AS point_estimate, CAST(NULL AS DOUBLE) AS recent_avg"
    day = "CAST(CAST(predicted_at AS DATE) AS VARCHAR(10))"
    return f"""churn AS (SELECT id, score FROM preds WHERE model = 'signup'), ranked AS (SELECT id, score, risk_rank FROM ({marts._ranked(d, "churn", "score", "id", "risk_rank")}) t), coming AS ({marts._forecast(d, 1)}),
        ev AS (SELECT 'order_scored' AS on_event, CAST(id AS VARCHAR(20)) AS entity, 'fraud_risk' AS model, score, {none.replace("CAST(NULL AS DOUBLE) AS threshold", "9E-1 AS threshold")} FROM preds WHERE model = 'click'
        UNION ALL SELECT 'session_scored', CAST(id AS VARCHAR(20)), 'bot_score', score, {none} FROM preds WHERE model = 'view'
        UNION ALL SELECT 'churn_scored', CAST(id AS VARCHAR(20)), 'churn_risk', score, {none.replace("CAST(NULL AS BIGINT)", "risk_rank")} FROM ranked
        UNION ALL SELECT 'drift_computed', concat(model, '@', {day}), model, max(score), {none.replace("CAST(NULL AS VARCHAR(10))", "CASE WHEN max(score) > 0.2 THEN 'critical' WHEN max(score) >= 0.1 THEN 'warning' ELSE 'ok' END")} FROM preds GROUP BY model, {day}
        UNION ALL SELECT 'forecast_updated', category, 'forecast', CAST(NULL AS DOUBLE), {none.replace("CAST(NULL AS DOUBLE) AS point_estimate, CAST(NULL AS DOUBLE)", "CAST(orders_lag1 AS DOUBLE) AS point_estimate, orders_roll4_mean")} FROM coming)"""


def g04_six_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shipped rules propose on the events of the fixture."""
    return fire(dialect.run(lambda d: f"WITH {_events(d)} SELECT * FROM ev", spark, sf_dir), SHIPPED).select("rule", "action", "tier", "entity")


def _fired(d):
    part = lambda rule, action, tier, event, when: f"SELECT '{rule}' AS rule, '{action}' AS action, '{tier}' AS tier, entity FROM ev WHERE on_event = '{event}' AND {when}"
    return f"WITH {_events(d)} " + " UNION ALL ".join(
        [
            part("hold-high-fraud-order", "hold_order_for_review", "approve", "order_scored", "NOT score < threshold"),
            part("log-midband-bot-session", "log_event_note", "auto", "session_scored", "score * 1000 BETWEEN 500 AND 699.5"),
            part("retrain-on-critical-drift", "retrain_model", "approve", "drift_computed", "score > 0.2"),
            f"SELECT * FROM ({part('propose-retention-offer-high-churn', 'propose_retention_offer', 'approve', 'churn_scored', 'score >= 0.7')} ORDER BY score DESC, CAST(entity AS BIGINT) LIMIT 20) top",
            part("nudge-low-risk-churn", "log_retention_email", "auto", "churn_scored", "NOT score >= 0.3"),
            part("draft-po-on-demand-surge", "draft_purchase_order", "approve", "forecast_updated", "point_estimate - recent_avg > 0.2 * recent_avg AND point_estimate >= recent_avg + 5"),
        ]
    )


QUERIES = {"g04_six_rules": g04_six_rules}
ORACLE = {"g04_six_rules": dialect.oracle(_fired)}
PLANS: dict = {}
