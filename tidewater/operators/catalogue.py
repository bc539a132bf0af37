"""Named metrics, each with population, date field, aggregation and source label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dialect
from .evaluation import AUDIT, psi


@dataclass(frozen=True)
class Metric:
    population: str
    aggregate: str
    date_field: str | None = "d"
    grain: str = "order"
    source: str = "batch"

    def sql(self, d: dialect.Spark, name: str, low: str, high: str) -> str:
        """A population without a date field is taken whole."""
        population = self.population.format(psi=psi(d)) if "{" in self.population else self.population
        when = f" WHERE {self.date_field} BETWEEN DATE '{low}' AND DATE '{high}'" if self.date_field else ""
        return f"SELECT '{name}' AS metric, '{self.source}' AS source, CAST({self.aggregate} AS DOUBLE) AS value FROM {population}{when}"


def _scores(model: str, grain: str) -> Metric:
    mean = "CAST(sum(CAST(score AS DECIMAL(9,3))) AS DOUBLE) / nullif(count(*), 0)"
    return Metric(f"(SELECT CAST(predicted_at AS DATE) AS d, score FROM preds WHERE model = '{model}') t", mean, grain=grain, source="model")


_ACTIONS = f"(WITH {AUDIT}, s AS (SELECT action_id, max_by(transition, step) AS state FROM audit GROUP BY action_id) SELECT CAST(p.predicted_at AS DATE) AS d, s.state FROM s JOIN preds p ON p.id = s.action_id) t"
_MINUTES = "(SELECT CAST(ts AS DATE) AS d, date_trunc('minute', ts) AS m, event_type, user_id, event_id, CAST(CASE WHEN value > 0 THEN value ELSE 0 END AS DECIMAL(12,2)) AS pay, value FROM clicks) t"
_PAID = "event_type = 'purchase' AND value > 0"

METRICS = {
    "revenue": Metric("valid", "sum(pay)"),
    "orders": Metric("header", "count(DISTINCT order_id)"),
    "contributing_orders": Metric("valid", "count(DISTINCT order_id)"),
    "average_order_value": Metric("valid", "CAST(sum(pay) AS DOUBLE) / nullif(count(DISTINCT order_id), 0)"),
    "customers": Metric("header", "count(DISTINCT customer)", grain="customer"),
    "active_customers": Metric("(SELECT d, customer FROM header WHERE NOT is_lost) t", "count(DISTINCT customer)", grain="customer"),
    "delivered_orders": Metric("header", "count(DISTINCT CASE WHEN is_delivered THEN order_id END)"),
    "lost_orders": Metric("header", "count(DISTINCT CASE WHEN is_lost THEN order_id END)"),
    # the others of this kind are lists per category: ``metrics.top_categories``
    "top_categories": Metric("(SELECT v.d, l.category FROM lines l JOIN valid v ON l.order_id = v.order_id) t", "count(DISTINCT category)", grain="category"),
    "review_score": Metric("(SELECT h.d, r.avg_score FROM header h JOIN order_reviews r ON h.order_id = r.order_id) t", "CAST(sum(CAST(floor(avg_score * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / nullif(count(*), 0) / 10000"),
    "items_sold": Metric("items", "count(*)", date_field="shipped", grain="item"),
    "revenue_realtime": Metric(_MINUTES, f"CAST(sum(CASE WHEN {_PAID} THEN pay END) AS DOUBLE) / nullif(count(DISTINCT m), 0)", grain="minute", source="live_replay"),
    "orders_realtime": Metric(_MINUTES, f"CAST(count(DISTINCT CASE WHEN {_PAID} THEN event_id END) AS DOUBLE) / nullif(count(DISTINCT m), 0)", grain="minute", source="live_replay"),
    "active_sessions": Metric(f"(SELECT d, m, count(DISTINCT user_id) AS n FROM {_MINUTES} WHERE event_type IN ('view', 'click') GROUP BY d, m) b", "CAST(sum(n) AS DOUBLE) / nullif(count(*), 0)", grain="minute", source="live_replay"),
    "scored_events": Metric("preds", "count(*)", date_field="CAST(predicted_at AS DATE)", grain="prediction", source="model"),
    "forecast_revenue": _scores("purchase", "category"),
    "churn_risk": _scores("signup", "customer"),
    "fraud_risk": _scores("click", "order"),
    "bot_score": _scores("view", "session"),
    "governance_pending_actions": Metric(_ACTIONS, "count(CASE WHEN state = 'proposed' THEN 1 END)", grain="action", source="governance"),
    "governance_decided_actions": Metric(_ACTIONS, "count(CASE WHEN state <> 'proposed' THEN 1 END)", grain="action", source="governance"),
    "model_drift_psi": Metric("({psi} SELECT r, s FROM p) t", "floor(sum((s - r) * ln(s / r)) * 1000000 + 0.5) / 1000000", date_field=None, grain="feature", source="monitoring"),
    "model_backtest_reproduction": Metric("(SELECT CAST(predicted_at AS DATE) AS d, CAST(value AS DECIMAL(12,2)) AS a, CAST(id % 100 AS DECIMAL(12,2)) AS f FROM preds) t", "CAST(sum(abs(a - f)) AS DOUBLE) / nullif(CAST(sum(abs(a)) AS DOUBLE), 0)", grain="model", source="monitoring"),
}


def metric(spark: SparkSession, sf_dir: str, name: str, low: str, high: str) -> DataFrame:
    """One named metric between two dates, both included; an unknown name is a KeyError."""
    found = METRICS[name]
    return dialect.run(lambda d: found.sql(d, name, low, high), spark, sf_dir)


def total(found: DataFrame) -> DataFrame:
    """Sum of results of one source label; adding up two labels is refused when the plan runs."""
    mixed = F.coalesce(F.min("source") != F.max("source"), F.lit(False)) | (F.count_if(F.col("source").isNull()) > 0)
    return found.agg(mixed.alias("mixed"), F.sum("value").alias("value")).select(F.when(F.col("mixed"), F.raise_error(F.lit("results of different sources are not added"))).otherwise(F.col("value")).cast("double").alias("value"))


PLANS = {"k01_catalogue": lambda d: " UNION ALL ".join(m.sql(d, name, "1996-01-01", "2024-01-20") for name, m in METRICS.items())}
