"""Decisions, effects and checks against recursive SQL, and the cases that the fixture lacks."""

import datetime as dt

import pytest

from tests.test_plans import SF, duck, rows  # noqa: F401
from tidewater.operators import actions


@pytest.mark.parametrize("name", sorted(actions.QUERIES))
def test_action_query(spark, duck, name):  # noqa: F811
    got = actions.QUERIES[name](spark, SF)
    want = duck.execute(actions.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = rows(got.columns, got.collect())
    assert found and found == rows(columns, want.fetchall())


AT = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
COMMANDS = "seq long, action_id long, command string, actor string, reason string, at timestamp"


def test_a_batch_goes_on_where_the_last_ended(spark):
    queue = spark.createDataFrame([(1, "r", "e", "release_order", "approve", "k1", AT(0), "pending", 0), (2, "r", "f", "log_event_note", "auto", "k2", AT(0), "pending", 0), (3, "r", "g", "release_order", "auto", "k3", AT(0), "pending", 0)], actions.QUEUE)
    outcomes = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, True), (1, 2, False)], "action_id long, attempt int, ok boolean")
    say = lambda *c: spark.createDataFrame([(i, a, what, "me", None, AT(m)) for i, a, what, m in c], COMMANDS)
    audit, judged = actions.decide(queue, say((1, 1, "retry", 1), (2, 1, "approve", 2), (3, 1, "reject", 3), (4, 1, "retry", 4), (5, 2, "auto", 1), (6, 3, "auto", 1), (7, 9, "approve", 1), (8, None, "approve", 1), (9, 3, "wave", 1)), outcomes)
    assert {r["seq"]: r["why"] for r in judged.collect()} == {1: "not failed", 2: None, 3: "not pending", 4: None, 5: None, 6: "not on the allow list", 7: "unknown action", 8: "unknown action", 9: "unknown command"}
    log = actions.proposed(queue).unionByName(audit)
    now = actions.current(queue, log)
    assert {r["id"]: (r["status"], r["attempts"]) for r in now.collect()} == {1: ("failed", 2), 2: ("executed", 1), 3: ("pending", 0)}
    more, judged = actions.decide(now, say((10, 1, "approve", 5), (11, 1, "retry", 6), (12, 1, "retry", 7), (13, 3, "reject", 8)), outcomes)
    assert {r["seq"]: r["why"] for r in judged.collect()} == {10: "not pending", 11: None, 12: "not failed", 13: None}
    log = log.unionByName(more)
    assert {r["action_id"]: r["state"] for r in actions.states(log).collect()} == {1: "executed", 2: "executed", 3: "rejected"}
    assert actions.unapproved(log).collect() == []


def test_proposals(spark):
    new = "id long, rule string, entity string, action string, tier string, dedup_key string, created_at timestamp"
    queue = spark.createDataFrame([(1, "r", "a", "x", "approve", "k1", AT(0), "pending", 0), (2, "r", "b", "x", "approve", "k2", AT(0), "rejected", 0)], actions.QUEUE)
    offered = [(10, "r", "a", "x", "approve", "k10", AT(1)), (11, "r", "b", "x", "approve", "k2", AT(1)), (12, "r", "b", "x", "approve", "k12", AT(3)), (13, "r", "b", "x", "approve", "k13", AT(2)), (14, "r", None, "x", "approve", "k14", AT(1)), (15, "r", None, "x", "approve", "k15", AT(1)), (16, "q", "a", "x", "approve", "k16", AT(1)), (17, "q", "z", "x", "approve", "k16", AT(2))]
    assert sorted(r["id"] for r in actions.propose(spark.createDataFrame(offered, new), queue).collect()) == [13, 14, 15, 16]


def test_effects_are_applied_once(spark, tmp_path):
    schema = "action_id long, action string, entity string, at timestamp, score double, model string, category string, week date, quantity int, reason string"
    make = lambda i, action, entity, m, **more: (i, action, entity, AT(m), 0.5, more.get("model"), more.get("category"), more.get("week"), more.get("quantity"), "r")
    day = 24 * 60
    done = [make(1, "log_retention_email", "c", 0), make(2, "log_retention_email", "c", day - 1), make(3, "log_retention_email", "c", day), make(4, "propose_retention_offer", "c", 5), make(5, "hold_order_for_review", "o", 1), make(6, "release_order", "o", 2), make(7, "release_order", "never held", 2)]
    done += [make(8, "draft_purchase_order", None, 9, category="k", week=dt.date(2024, 1, 1), quantity=3), make(9, "draft_purchase_order", None, 8, category="k", week=dt.date(2024, 1, 1), quantity=4), make(10, "retrain_model", "x", 1, model="m"), make(11, "retrain_model", "x", 1), make(12, "log_event_note", None, 1)]
    effects = actions.Effects(spark, f"{tmp_path}/effects")
    for _ in range(2):
        effects.apply(spark.createDataFrame(done, schema))
    ids = lambda name: sorted(r["action_id"] for r in effects.table(name).collect())
    assert ids("retention_actions") == [1, 3, 4] and ids("purchase_orders") == [9] and ids("retrain_requests") == [10] and ids("event_log") == [12] and ids("order_flags") == [5, 6, 7]
    assert [(r["entity"], r["held"]) for r in effects.flags().collect()] == [("o", False)]
    effects.apply(spark.createDataFrame([make(20, "log_retention_email", "c", 2 * day - 1), make(21, "log_retention_email", "c", 2 * day), make(22, "hold_order_for_review", "o", 9)], schema))
    assert ids("retention_actions") == [1, 3, 4, 21] and [r["held"] for r in effects.flags().collect()] == [True]


def test_executions_meet_their_approvals_without_a_second_log(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    log = [(1, 1, at(1), 1, 0, "approved"), (1, 1, at(1), 1, 1, "executed"), (2, 1, at(2), 2, 0, "executed"), (2, 1, at(3), 3, 0, "approved"), (3, 0, at(1), 1, 0, "failed"), (None, 1, at(1), 1, 0, "approved"), (None, 1, at(2), 2, 0, "executed")]
    rows = spark.createDataFrame([(*r, "who", None) for r in log], "action_id long, phase int, at timestamp, seq long, k int, transition string, actor string, reason string")
    found = actions.unapproved(rows)
    assert {(r["action_id"], r["transition"]) for r in found.collect()} == {(2, "executed"), (3, "failed"), (None, "executed")}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
