import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql.types import StructType

from tests.test_plans import SF, duck, rows  # noqa: F401
from tidewater.operators import catalogue, rules
from tidewater.plans import dialect


def test_metrics_and_sources(spark):
    one = catalogue.metric(spark, SF, "orders", "1995-01-01", "2002-01-01")
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert [r.asDict() for r in one.collect()] == [{"metric": "orders", "source": "batch", "value": float(n)}]
    assert catalogue.total(one.union(one)).first()[0] == 2.0 * n
    with pytest.raises(Exception, match="different sources"):
        catalogue.total(one.union(catalogue.metric(spark, SF, "scored_events", "2024-01-01", "2024-02-01"))).collect()
    with pytest.raises(KeyError):
        catalogue.metric(spark, SF, "unknown", "1995-01-01", "2002-01-01")


@pytest.mark.parametrize("old", [[], [5.0, 5.01], [1.0, 2.0, 9e9], [-9e9, -0.01, 0.0, 0.01, None, 9e9], [7.77] * 30 + [9.0], "many"])
def test_drift_of_payments(spark, tmp_path, old):
    """Exact 1 % and 99 % points, and no task that holds every different payment, as Spark's percentile does."""
    rng = random.Random(1)
    old = [round(rng.choice([rng.uniform(0, 1e3), rng.gauss(0, 1e7), 42.0]), 2) for _ in range(3000)] if old == "many" else old
    new = [round(rng.uniform(-10, 50_000), 2) for _ in range(200)] + [5.0, 5.01, 7.77, 8.0]
    data = [(i, i, "F", x, dt.date(1996 if i < len(old) else 1999, 1, 1)) for i, x in enumerate([*old, *new])] + [(-1, 1, "F", 3.0, None)]
    spark.createDataFrame(data, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.metric(spark, str(tmp_path), "model_drift_psi", "1996-01-01", "2024-01-20")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(dialect.oracle(lambda d: catalogue.METRICS["model_drift_psi"].sql(d, "model_drift_psi", "1996-01-01", "2024-01-20"))).fetchall()
    assert [tuple(r) for r in got.collect()] == want
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_products_are_not_broadcast(spark, monkeypatch):
    plan = lambda d: "SELECT category, count(*) AS n FROM lines GROUP BY category"
    few = dialect.run(plan, spark, SF)
    monkeypatch.setattr(dialect, "MANY_PRODUCTS", 10)
    many = dialect.run(plan, spark, SF)
    assert sorted(many.collect()) == sorted(few.collect())
    assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString() and "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()


def test_rules(spark):
    events = {"score.churn": StructType.fromDDL("score double, entity string")}
    good = {"name": "a", "trigger": "score.churn", "when": "score >= 0.9 AND entity <> ''", "action": "note", "tier": "auto"}
    bad = [good | {"trigger": "x"}, good | {"when": "missing > 1"}, good | {"when": "score +"}, good | {"when": "score"}, good | {"action": "y"}, good | {"tier": "z"}, good | {"action": "hold"}]
    check = lambda r: rules.check_rules(spark, [r], events, {"note", "hold"}, {"note"})
    assert check(good) == [] and all(check(r) for r in bad)


def test_cursor_moves_only_on_success(spark, tmp_path):
    seen, rows = [], spark.range(1, 8)
    act = lambda batch: seen.extend(r[0] for r in batch.collect())

    def fail(batch):
        raise RuntimeError

    assert rules.incremental_pass(rows, str(tmp_path), "id", 3, act) == 3
    with pytest.raises(RuntimeError):
        rules.incremental_pass(rows, str(tmp_path), "id", 3, fail)
    assert [rules.incremental_pass(rows, str(tmp_path), "id", 3, act) for _ in range(3)] == [6, 7, 7]
    assert seen == [1, 2, 3, 4, 5, 6, 7]


def test_shipped_rules(spark, duck):  # noqa: F811
    got, want = rules.QUERIES["g04_six_rules"](spark, SF), duck.execute(rules.ORACLE["g04_six_rules"])
    columns = [c[0] for c in want.description]
    found = rows(got.columns, got.collect())
    assert sorted(got.columns) == sorted(columns) and found == rows(columns, want.fetchall()) and found


def test_shipped_rules_at_their_edges(spark):
    text = "on_event string, model string, score double, threshold double, risk_rank long, status string, point_estimate double, recent_avg double"
    data = [
        ("order_scored", "fraud_risk", 0.9, 0.9, None, None, None, None),
        ("order_scored", "fraud_risk", 0.99, None, None, None, None, None),  # no threshold: nothing fires
        ("session_scored", "bot_score", 0.7, None, None, None, None, None),
        ("session_scored", "bot_score", 0.5, None, None, None, None, None),
        ("churn_scored", "churn_risk", 0.7, None, 20, None, None, None),
        ("churn_scored", "churn_risk", 0.8, None, 21, None, None, None),
        ("drift_computed", "m", None, None, None, "warning", None, None),
        ("forecast_updated", "f", None, None, None, None, 15.0, 10.0),
        ("forecast_updated", "f", None, None, None, None, 14.9, 10.0),
        (None, "churn_risk", 0.1, None, 1, "critical", 99.0, 1.0),
    ]
    got = rules.fire(spark.createDataFrame(data, text), rules.SHIPPED)
    assert [(r["rule"], r["tier"]) for r in got.orderBy("rule").collect()] == [("draft-po-on-demand-surge", "approve"), ("hold-high-fraud-order", "approve"), ("log-midband-bot-session", "auto"), ("propose-retention-offer-high-churn", "approve")]
