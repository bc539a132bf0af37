"""Governed actions: proposals, a decision batch as a state machine, effects that are applied once, and checks.

A queue row is (id, rule, entity, action, tier, dedup_key, created_at, status, attempts); a command is (seq, action_id,
command, actor, reason, at); an outcome is (action_id, attempt, ok), and an attempt without one succeeded. Commands are
taken in order of (at, seq): only a pending action is approved or rejected, only an action of the auto tier on the allow-list
approves itself, only a failed execution is retried, and approval executes. Every command is either
in the audit log or refused with a reason. All of it is joins and windows by action: commands of one action are ordered by
one task, on disk if need be; none is held in memory as a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.landing import shared_path

#: Actions that may run by themselves, what approves an action, and the state after each transition.
AUTOMATIC = ("log_event_note", "log_retention_email")
APPROVALS = ("approved", "auto_approved")
AFTER = {"proposed": "pending", "approved": "approved", "auto_approved": "approved", "retrying": "approved", "rejected": "rejected", "executed": "executed", "failed": "failed"}
KEEP_S, STALE_S = 24 * 3600, 2 * 3600

QUEUE = "id long, rule string, entity string, action string, tier string, dedup_key string, created_at timestamp, status string, attempts int"
AUDIT = "action_id long, phase int, at timestamp, seq long, k int, transition string, actor string, reason string"


def propose(proposals: DataFrame, queue: DataFrame) -> DataFrame:
    """New queue rows of proposals (id, rule, entity, action, tier, dedup_key, created_at): each key once, and none where a pending
    action of the same rule and entity exists, or comes first among the new ones. No entity: keys only."""
    first = lambda rows, *keys: rows.groupBy(*keys).agg(F.min_by(F.struct(*proposals.columns), F.struct("created_at", "id")).alias("p")).select("p.*")
    fresh = first(proposals, "dedup_key").join(queue.select("dedup_key"), "dedup_key", "left_anti")
    named = first(fresh.where("entity IS NOT NULL"), "rule", "entity").join(queue.where("status = 'pending'").select("rule", "entity"), ["rule", "entity"], "left_anti")
    rows = named.unionByName(fresh.where("entity IS NULL"))
    return rows.select(*proposals.columns, F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def decide(queue: DataFrame, commands: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audit rows, every command with ``accepted`` and ``why``) of a batch of commands. ``queue``: as it was before."""
    bad = outcomes.where("NOT ok").join(queue.select(F.col("id").alias("action_id"), "attempts"), "action_id").where("attempt > attempts")
    place = F.row_number().over(Window.partitionBy("action_id").orderBy("attempt"))
    failures = bad.dropDuplicates(["action_id", "attempt"]).withColumn("_n", place).where("attempt - attempts = _n").groupBy("action_id").agg(F.count("*").alias("failures"))
    mine = queue.select(F.col("id").alias("_id"), "action", "tier", "status")
    known = commands.join(mine, F.col("action_id") == F.col("_id")).join(failures, "action_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    unknown = commands.join(mine, F.col("action_id") == F.col("_id"), "left_anti").withColumn("accepted", F.lit(False)).withColumn("why", F.lit("unknown action"))

    each, upto, turn = Window.partitionBy("action_id"), Window.partitionBy("action_id").orderBy("at", "seq"), F.struct("at", "seq")
    by_itself = (F.col("tier") == "auto") & F.col("action").isin(*AUTOMATIC)
    can = (F.col("status") == "pending") & (F.col("command").isin("approve", "reject") | ((F.col("command") == "auto") & by_itself))
    rows = known.withColumn("_first", F.min(F.when(can, turn)).over(each)).withColumn("_decides", F.coalesce(turn == F.col("_first"), F.lit(False)))
    rows = rows.withColumn("_approved", F.coalesce(F.max(F.when(F.col("_decides"), F.col("command") != "reject")).over(each), F.lit(False)))
    counts = (F.col("command") == "retry") & ((F.col("status") == "failed") | (F.col("_approved") & (turn > F.col("_first"))))
    rows = rows.withColumn("_retry", F.when(counts, F.sum(F.when(counts, 1).otherwise(0)).over(upto.rowsBetween(Window.unboundedPreceding, 0))))
    last = F.col("failures") + (F.col("status") == "failed").cast("int")
    accepted = F.when(F.col("command") == "retry", F.coalesce(F.col("_retry") <= last, F.lit(False))).otherwise(F.col("_decides"))
    why = F.when(F.col("command") == "retry", "not failed").when((F.col("command") == "auto") & (F.col("tier") != "auto"), "not auto tier").when((F.col("command") == "auto") & ~F.col("action").isin(*AUTOMATIC), "not on the allow list")
    why = why.when(F.col("command").isin("approve", "reject", "auto"), "not pending").otherwise("unknown command")
    rows = rows.withColumn("accepted", accepted).withColumn("why", F.when(~F.col("accepted"), why))

    done = F.when(F.when(F.col("command") == "retry", F.col("_retry") == last).otherwise(F.col("failures") == 0), "executed").otherwise("failed")
    step = F.when(F.col("command") == "reject", F.array(F.lit("rejected"))).when(F.col("command") == "retry", F.array(F.lit("retrying"), done)).when(F.col("command") == "auto", F.array(F.lit("auto_approved"), done)).otherwise(F.array(F.lit("approved"), done))
    audit = rows.where("accepted").select("action_id", F.lit(1).alias("phase"), "at", "seq", F.posexplode(step).alias("k", "transition"), "actor", "reason")
    return audit, rows.select(*commands.columns, "accepted", "why").unionByName(unknown)


def proposed(queue: DataFrame) -> DataFrame:
    """The first audit row of every action."""
    return queue.select(F.col("id").alias("action_id"), F.lit(0).alias("phase"), F.col("created_at").alias("at"), F.col("id").alias("seq"), F.lit(0).alias("k"), F.lit("proposed").alias("transition"), F.lit("playbook").alias("actor"), F.lit(None).cast("string").alias("reason"))


def _order() -> F.Column:
    return F.struct("phase", "at", "seq", "k")


def states(audit: DataFrame) -> DataFrame:
    """(action_id, state, attempts, changed_at): the audit log folded."""
    after = F.create_map(*[F.lit(x) for pair in AFTER.items() for x in pair])
    rows = audit.groupBy("action_id").agg(F.max_by(F.struct("transition", "at"), _order()).alias("last"), F.count_if(F.col("transition").isin("executed", "failed")).cast("int").alias("attempts"))
    return rows.select("action_id", after[F.col("last.transition")].alias("state"), "attempts", F.col("last.at").alias("changed_at"))


def current(queue: DataFrame, audit: DataFrame) -> DataFrame:
    """The queue with the states of the log: the queue that the next batch of decisions takes."""
    now = states(audit).select(F.col("action_id").alias("id"), F.col("state").alias("status"), "attempts")
    return queue.drop("status", "attempts").join(now, "id").select(*[f.split()[0] for f in QUEUE.split(", ")])


def unapproved(audit: DataFrame) -> DataFrame:
    """Executions without an earlier approval: there must be none. The log is read once: its rows meet their action's first approval in a window."""
    since = F.min(F.when(F.col("transition").isin(*APPROVALS), _order())).over(Window.partitionBy("action_id"))
    ran = audit.withColumn("_since", since).where(F.col("transition").isin("executed", "failed"))
    after = F.col("action_id").isNotNull() & F.coalesce(F.col("_since") < _order(), F.lit(False))
    return ran.where(~after).select("action_id", "at", "transition", "actor")


def by_status(queue: DataFrame, status: str | None = None, most: int = 50) -> DataFrame:
    """Actions of a status, newest first; pending ones oldest first."""
    rows = queue if status is None else queue.where(F.col("status") == status)
    order = ["created_at", "id"] if status == "pending" else [F.desc("created_at"), F.desc("id")]
    return rows.orderBy(*order).limit(most)


# --- effects ---------------------------------------------------------------------


def spaced(rows: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Rows in order of time per key, without those that come less than ``seconds`` after one that was kept; rows with
    ``kept`` stay in any case. A task reads its sorted rows one by one and holds the last time only."""
    columns = [*keys, at, "action_id", "kept"]
    schema = rows.select(*columns).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for part in parts:
            stays = []
            for *own, t, _, kept in part[columns].itertuples(index=False):
                if own != key:
                    key, last = own, None
                stay = bool(kept) or last is None or (t - last).total_seconds() >= seconds
                last = t if stay else last
                stays.append(stay)
            yield part[stays]

    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, at, F.desc("kept"), "action_id").mapInPandas(run, schema)


class Effects:
    """Tables that executed actions change, each written so that an action applied again writes nothing.

    ``executed`` rows: action_id, action, entity, at, score, model, category, week, quantity, reason. Only what an action adds to its
    table is appended; order flags are read newest first."""

    TABLES = {
        "order_flags": "action_id long, entity string, held boolean, reason string, at timestamp",
        "purchase_orders": "action_id long, category string, week date, quantity int, at timestamp",
        "retention_actions": "action_id long, entity string, kind string, status string, score double, at timestamp",
        "retrain_requests": "action_id long, model string, status string, at timestamp",
        "event_log": "action_id long, entity string, kind string, at timestamp",
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.TABLES[name])
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.root}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.table(name).columns).write.mode("append").parquet(f"{self.root}/{name}")

    def apply(self, executed: DataFrame) -> None:
        of = lambda *actions: executed.where(F.col("action").isin(*actions))
        new = lambda name, rows: rows.join(self.table(name).select("action_id"), "action_id", "left_anti")
        self._append("order_flags", new("order_flags", of("hold_order_for_review", "release_order").withColumn("held", F.col("action") == "hold_order_for_review").where("entity IS NOT NULL")))
        drafts = of("draft_purchase_order").where("category IS NOT NULL AND week IS NOT NULL").groupBy("category", "week").agg(F.min_by(F.struct("action_id", "quantity", "at"), F.struct("at", "action_id")).alias("p")).select("category", "week", "p.*")
        self._append("purchase_orders", drafts.join(self.table("purchase_orders").select("category", "week"), ["category", "week"], "left_anti"))
        kind = F.when(F.col("action") == "log_retention_email", "email").otherwise("offer")
        asked = of("log_retention_email", "propose_retention_offer").where("entity IS NOT NULL").withColumn("kind", kind).withColumn("status", F.when(F.col("kind") == "email", "logged").otherwise("proposed"))
        there = self.table("retention_actions")
        times = new("retention_actions", asked).select("entity", "kind", "at", "action_id", F.lit(False).alias("kept")).unionByName(there.select("entity", "kind", "at", "action_id", F.lit(True).alias("kept")))
        once = spaced(times, ["entity", "kind"], "at", KEEP_S).where("NOT kept").select("action_id")
        self._append("retention_actions", asked.join(once, "action_id", "left_semi"))
        self._append("retrain_requests", new("retrain_requests", of("retrain_model").where("model IS NOT NULL").withColumn("status", F.lit("pending"))))
        self._append("event_log", new("event_log", of("log_event_note").withColumn("kind", F.lit("info"))))

    def flags(self) -> DataFrame:
        """(entity, held, reason, set_at): the newest flag of every order; one that is only released is no flag."""
        newest = self.table("order_flags").groupBy("entity").agg(F.max_by(F.struct("held", "reason", "at"), F.struct("at", "action_id")).alias("f"), F.max("held").alias("_ever"))
        return newest.where("_ever").select("entity", "f.held", "f.reason", F.col("f.at").alias("set_at"))


def authorise(requests: DataFrame, queue: DataFrame, models: DataFrame, audit: DataFrame) -> DataFrame:
    """Retrain requests (request_id, action_id, model) with ``ok`` and ``why``: the action exists, retrains, was approved, and its
    model (of ``models``: action_id, target) is the request's."""
    approved = audit.where(F.col("transition").isin(*APPROVALS)).select(F.col("action_id").alias("_a")).distinct()
    rows = requests.join(queue.select(F.col("id").alias("_q"), "action"), F.col("action_id") == F.col("_q"), "left").join(approved, F.col("action_id") == F.col("_a"), "left").join(models.select(F.col("action_id").alias("_m"), "target"), F.col("action_id") == F.col("_m"), "left")
    why = F.when(F.col("_q").isNull(), "no such action").when(F.col("action") != "retrain_model", "not a retrain action").when(F.col("_a").isNull(), "not approved").when(~F.col("model").eqNullSafe(F.col("target")), "other model")
    return rows.select(*requests.columns, why.isNull().alias("ok"), why.alias("why"))


def interrupted(requests: DataFrame, now: F.Column, seconds: int = STALE_S) -> DataFrame:
    """Requests (status, started_at, ...) with those failed that have been running for longer than ``seconds``."""
    stale = (F.col("status") == "running") & (F.unix_micros("started_at") < F.unix_micros(now) - seconds * 1_000_000)
    return requests.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def dismiss(anomalies: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anomalies, refused commands): the first command (seq, anomaly_id, at) on an open anomaly dismisses it; others are refused."""
    mine = anomalies.select(F.col("anomaly_id").alias("_id"), "status")
    rows = commands.join(mine, F.col("anomaly_id") == F.col("_id"), "left")
    first = rows.where("status = 'open'").groupBy("anomaly_id").agg(F.min(F.struct("at", "seq")).alias("_first"))
    judged = rows.join(first.withColumnRenamed("anomaly_id", "_a"), F.col("anomaly_id") == F.col("_a"), "left")
    taken = F.coalesce(F.struct("at", "seq") == F.col("_first"), F.lit(False))
    refused = judged.where(~taken).select(*commands.columns, F.when(F.col("_id").isNull(), "unknown anomaly").otherwise("not open").alias("why"))
    out = anomalies.join(first.select(F.col("anomaly_id").alias("_a"), F.col("_first.at").alias("dismissed_at")), F.col("anomaly_id") == F.col("_a"), "left").drop("_a")
    return out.withColumn("status", F.when(F.col("dismissed_at").isNotNull(), "dismissed").otherwise(F.col("status"))), refused


# --- queries ----------------------------------------------------------------------

#: Rule, action, tier and condition (both engines) of the fixture's proposals.
_RULES = [
    ("hold-high-fraud-order", "hold_order_for_review", "approve", "event_type = 'click' AND s >= 900"),
    ("release-cleared-order", "release_order", "approve", "event_type = 'click' AND s < 300"),
    ("log-midband-bot-session", "log_event_note", "auto", "event_type = 'view' AND s >= 500 AND s < 700"),
    ("note-by-itself", "hold_order_for_review", "auto", "event_type = 'view' AND s >= 990"),
    ("propose-retention-offer", "propose_retention_offer", "approve", "event_type = 'signup' AND s >= 700"),
    ("nudge-low-risk-churn", "log_retention_email", "auto", "event_type = 'signup' AND s < 300"),
    ("retrain-on-critical-drift", "retrain_model", "approve", "event_type = 'error' AND s > 900"),
    ("draft-po-on-demand-surge", "draft_purchase_order", "approve", "event_type = 'purchase' AND s >= 800"),
]


def _offered(e: DataFrame) -> DataFrame:
    """What events propose."""
    rule = F.coalesce(*[F.when(F.expr(when), F.struct(F.lit(n).alias("rule"), F.lit(a).alias("action"), F.lit(t).alias("tier"))) for n, a, t, when in _RULES])
    return e.withColumn("r", rule).where("r IS NOT NULL").select(F.col("event_id").alias("id"), "r.*", F.col("user_id").cast("string").alias("entity"), F.concat_ws(":", "r.rule", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("dedup_key"), F.col("ts").alias("created_at"))


def _fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, queue, commands, outcomes): every event above may propose, commands something on action event_id // 3, and tells
    the outcome of one attempt of it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("s", F.pmod(F.col("event_id") * 7919, F.lit(1000)))
    queue = propose(_offered(e), spark.createDataFrame([], QUEUE))
    about = F.floor(F.col("event_id") / 3).cast("long")
    command = F.when(F.col("event_type").isin("click", "error"), "approve").when(F.col("event_type") == "view", "retry").when(F.col("event_type") == "signup", "auto").otherwise("reject")
    commands = e.select(F.col("event_id").alias("seq"), about.alias("action_id"), command.alias("command"), F.col("user_id").cast("string").alias("actor"), F.lit(None).cast("string").alias("reason"), F.col("ts").alias("at"))
    outcomes = e.select(about.alias("action_id"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), (F.col("value") > 20).alias("ok"))
    return e, queue, commands, outcomes


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, queue, commands, outcomes = _fixture(spark, sf_dir)
    return queue, proposed(queue).unionByName(decide(queue, commands, outcomes)[0])


HALF = "2024-01-15 00:00:00"


def _two_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queue after the proposals and decisions of the first half, new rows when all proposals are delivered, the first half again)."""
    e, _, commands, outcomes = _fixture(spark, sf_dir)
    offered, early = _offered(e), F.lit(HALF).cast("timestamp")
    queue = propose(offered.where(F.col("created_at") < early), spark.createDataFrame([], QUEUE))
    log = proposed(queue).unionByName(decide(queue, commands.where(F.col("at") < early), outcomes)[0])
    now = current(queue, log)
    return now, propose(offered, now)


def g06_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the queue by the batch that brought them; a key comes once, and a pending action keeps others of its rule and entity out."""
    first, second = _two_batches(spark, sf_dir)
    return first.select("dedup_key", F.lit(1).alias("batch")).unionByName(second.select("dedup_key", F.lit(2).alias("batch")))


def g07_one_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending actions after both batches: at most one of a rule and entity."""
    first, second = _two_batches(spark, sf_dir)
    return first.unionByName(second.select(*first.columns)).where("status = 'pending'").select("id", "rule", "entity")


def route(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Audit rows of pending actions of the auto tier: they approve themselves and run; others wait, and so does one that is not on the allow-list."""
    auto = queue.where("status = 'pending' AND tier = 'auto'").select(F.col("id").alias("seq"), F.col("id").alias("action_id"), F.lit("auto").alias("command"), F.lit("playbook-engine").alias("actor"), F.lit("allow-list auto tier").alias("reason"), F.col("created_at").alias("at"))
    return decide(queue, auto, outcomes)[0]


def g08_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, queue, _, outcomes = _fixture(spark, sf_dir)
    return states(proposed(queue).unionByName(route(queue, outcomes))).select("action_id", "state", "attempts")


def g10_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every command of the batch: accepted, or refused for a reason."""
    _, queue, commands, outcomes = _fixture(spark, sf_dir)
    return decide(queue, commands, outcomes)[1].select("seq", "action_id", "command", "accepted", "why")


def g11_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(_log(spark, sf_dir)[1]).select("action_id", "state", "attempts", "changed_at")


def g12_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of every action in order; the list of one action is held by a task."""
    rows = _log(spark, sf_dir)[1].groupBy("action_id").agg(F.array_sort(F.collect_list(F.struct("phase", "at", "seq", "k", "transition"))).alias("t"))
    return rows.select("action_id", F.array_join(F.transform("t", lambda x: x.transition), ",").alias("trace"))


def g13_unapproved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions without earlier approval, where actions whose id 7 divides were executed beside the rules, before anybody decided."""
    queue, audit = _log(spark, sf_dir)
    planted = proposed(queue).where("action_id % 7 = 0").withColumn("k", F.lit(1)).withColumn("transition", F.lit("executed")).withColumn("actor", F.lit("nobody"))
    return unapproved(audit.unionByName(planted)).select("action_id", "transition", "actor")


def _executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, queue, commands, outcomes = _fixture(spark, sf_dir)
    ran = decide(queue, commands, outcomes)[0].where("transition = 'executed'").select("action_id", "at")
    facts = e.select(F.col("event_id").alias("id"), (F.col("s") / F.lit(1000.0)).alias("score"), F.col("event_type").alias("model"), (F.col("user_id") % 25).cast("string").alias("category"), F.to_date(F.date_trunc("week", "ts")).alias("week"), F.greatest(F.ceil(F.col("value") - 20), F.lit(0)).cast("int").alias("quantity"))
    return ran.join(queue.select(F.col("id").alias("action_id"), "action", "entity", F.col("rule").alias("reason")), "action_id").join(facts, F.col("action_id") == F.col("id")).drop("id")


def g14_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What executed actions changed, after they were applied twice."""
    effects, executed = Effects(spark, shared_path(spark, "effects")), _executed(spark, sf_dir)
    effects.apply(executed)
    effects.apply(executed)
    text = lambda c: F.col(c).cast("string")
    row = lambda rows, effect, key, detail: rows.select(F.lit(effect).alias("effect"), key.alias("key"), detail.alias("detail"))
    out = row(effects.flags(), "flag", F.col("entity"), F.when(F.col("held"), F.col("reason")).otherwise("released"))
    out = out.unionByName(row(effects.table("purchase_orders"), "draft", F.concat_ws("@", "category", text("week")), text("quantity")))
    out = out.unionByName(row(effects.table("retention_actions"), "retention", text("action_id"), F.concat_ws(":", "entity", "kind", "status")))
    out = out.unionByName(row(effects.table("retrain_requests"), "retrain", text("action_id"), F.concat_ws(":", "model", "status")))
    return out.unionByName(row(effects.table("event_log"), "note", text("action_id"), F.concat_ws(":", "entity", "kind")))


def g15_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for action event_id // 3 of every error event, checked; those that run since before 2024-01-20 are failed."""
    e, queue, commands, outcomes = _fixture(spark, sf_dir)
    audit = decide(queue, commands, outcomes)[0]
    asked = e.where("event_type = 'error'").select(F.col("event_id").alias("request_id"), F.floor(F.col("event_id") / 3).cast("long").alias("action_id"), F.when(F.col("event_id") % 4 == 0, "view").otherwise("error").alias("model"), F.lit("running").alias("status"), F.col("ts").alias("started_at"))
    models = e.select(F.col("event_id").alias("action_id"), F.col("event_type").alias("target"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return interrupted(authorise(asked, queue, models, audit), now).select("request_id", "ok", "why", "status")


def a19_queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(_log(spark, sf_dir)[1]).groupBy("state").agg(F.count("*").alias("n"))


def l07_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 50 pending actions and the newest 20 failed ones."""
    now = current(*_log(spark, sf_dir))
    return by_status(now, "pending", 50).unionByName(by_status(now, "failed", 20)).select("id", "rule", "entity", "status")


def t18_dismissal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy hours are open anomalies, quiet ones closed; an event of a later day at the same hour dismisses the hour that its id points to."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    found = e.groupBy(hour.alias("h")).agg(F.count("*").alias("n")).select(F.col("h").cast("string").alias("anomaly_id"), F.when(F.col("n") > 20, "open").otherwise("closed").alias("status"))
    commands = e.where("event_type = 'error'").select(F.col("event_id").alias("seq"), (F.lit(473_352) + F.col("event_id") % 800).cast("string").alias("anomaly_id"), F.col("ts").alias("at"))
    rows, refused = dismiss(found, commands)
    return rows.select("anomaly_id", "status", "dismissed_at", F.lit(None).cast("long").alias("seq")).unionByName(refused.select("anomaly_id", F.col("why").alias("status"), F.lit(None).cast("timestamp").alias("dismissed_at"), "seq"))


QUERIES = {f.__name__: f for f in (g06_proposals, g07_one_open, g08_routing, g10_decisions, g11_state, g12_trace, g13_unapproved, g14_effects, g15_retrain, a19_queue_counts, l07_actions, t18_dismissal)}

_CASE = lambda i: "CASE " + " ".join(f"WHEN {r[3]} THEN '{r[i]}'" for r in _RULES) + " END"
#: The same machine one command at a time: a recursion over each action's commands.
_MACHINE = f"""RECURSIVE p AS (SELECT event_id AS id, {_CASE(0)} AS rule, {_CASE(1)} AS action, {_CASE(2)} AS tier, CAST(user_id AS VARCHAR) AS entity, ts FROM (SELECT *, (event_id * 7919) % 1000 AS s FROM events WHERE UNTIL)),
    queue AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule, entity ORDER BY ts, id) AS rn FROM p WHERE rule IS NOT NULL) WHERE rn = 1),
    cmd AS (SELECT event_id AS seq, event_id // 3 AS action_id, CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'approve' WHEN 'view' THEN 'retry' WHEN 'signup' THEN 'auto' ELSE 'reject' END AS command, ts AS tm, row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts, event_id) AS k FROM events WHERE UNTIL),
    res AS (SELECT event_id // 3 AS action_id, event_id % 3 + 1 AS attempt, value > 20 AS ok FROM events),
    run AS (SELECT id AS action_id, CAST(0 AS BIGINT) AS k, 'pending' AS state, CAST(0 AS BIGINT) AS attempts, ts AS tm, 'proposed' AS trace, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS command, true AS accepted, CAST(NULL AS VARCHAR) AS why FROM queue
        UNION ALL SELECT r.action_id, c.k,
            CASE WHEN NOT x.ok THEN r.state WHEN c.command = 'reject' THEN 'rejected' WHEN coalesce(o.ok, true) THEN 'executed' ELSE 'failed' END,
            r.attempts + CASE WHEN x.ok AND c.command <> 'reject' THEN 1 ELSE 0 END, CASE WHEN x.ok THEN c.tm ELSE r.tm END,
            r.trace || CASE WHEN NOT x.ok THEN '' WHEN c.command = 'reject' THEN ',rejected' ELSE CASE c.command WHEN 'approve' THEN ',approved' WHEN 'auto' THEN ',auto_approved' ELSE ',retrying' END || CASE WHEN coalesce(o.ok, true) THEN ',executed' ELSE ',failed' END END,
            c.seq, c.command, x.ok, CASE WHEN x.ok THEN NULL WHEN c.command = 'retry' THEN 'not failed' WHEN c.command = 'auto' AND q.tier <> 'auto' THEN 'not auto tier' WHEN c.command = 'auto' AND q.action NOT IN ('log_event_note', 'log_retention_email') THEN 'not on the allow list' ELSE 'not pending' END
        FROM run r JOIN cmd c ON c.action_id = r.action_id AND c.k = r.k + 1 JOIN queue q ON q.id = r.action_id LEFT JOIN res o ON o.action_id = r.action_id AND o.attempt = r.attempts + 1
        CROSS JOIN LATERAL (SELECT CASE c.command WHEN 'retry' THEN r.state = 'failed' WHEN 'auto' THEN r.state = 'pending' AND q.tier = 'auto' AND q.action IN ('log_event_note', 'log_retention_email') ELSE r.state = 'pending' END AS ok) x),
    fin AS (SELECT action_id, state, attempts, tm, trace FROM (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY k DESC) AS rn FROM run) WHERE rn = 1)"""
_RUN = _MACHINE.replace("UNTIL", "true")
_DONE = """done AS (SELECT r.action_id, r.tm, q.action, q.entity, q.rule, (q.id * 7919) % 1000 AS s, e.event_type, e.user_id, e.ts, e.value FROM run r JOIN queue q ON q.id = r.action_id JOIN events e ON e.event_id = q.id WHERE r.accepted AND r.command <> 'reject' AND r.trace LIKE '%,executed'),
    ask AS (SELECT action_id, entity, CASE action WHEN 'log_retention_email' THEN 'email' ELSE 'offer' END AS kind, tm, row_number() OVER (PARTITION BY entity, action ORDER BY tm, action_id) AS n FROM done WHERE action IN ('log_retention_email', 'propose_retention_offer')),
    keep AS (SELECT *, tm AS last, true AS stays FROM ask WHERE n = 1 UNION ALL SELECT a.*, CASE WHEN a.tm >= k.last + INTERVAL 24 HOUR THEN a.tm ELSE k.last END, a.tm >= k.last + INTERVAL 24 HOUR FROM keep k JOIN ask a ON a.entity = k.entity AND a.kind = k.kind AND a.n = k.n + 1)"""
_BATCHES = _MACHINE.replace("UNTIL", f"ts < TIMESTAMP '{HALF}'") + f""", every AS (SELECT event_id AS id, {_CASE(0)} AS rule, CAST(user_id AS VARCHAR) AS entity, ts FROM (SELECT *, (event_id * 7919) % 1000 AS s FROM events)),
    open_ AS (SELECT q.rule, q.entity FROM queue q JOIN fin f ON f.action_id = q.id WHERE f.state = 'pending'),
    later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule, entity ORDER BY ts, id) AS rn FROM every WHERE rule IS NOT NULL AND id NOT IN (SELECT id FROM queue)) WHERE rn = 1 AND (rule, entity) NOT IN (SELECT rule, entity FROM open_))"""
ORACLE = {
    "g06_proposals": f"WITH {_BATCHES} SELECT rule || ':' || entity || ':' || id AS dedup_key, 1 AS batch FROM queue UNION ALL SELECT rule || ':' || entity || ':' || id, 2 FROM later",
    "g07_one_open": f"WITH {_BATCHES} SELECT q.id, q.rule, q.entity FROM queue q JOIN fin f ON f.action_id = q.id WHERE f.state = 'pending' UNION ALL SELECT id, rule, entity FROM later",
    "g08_routing": f"WITH {_RUN} SELECT q.id AS action_id, CASE WHEN NOT (q.tier = 'auto' AND q.action IN ('log_event_note', 'log_retention_email')) THEN 'pending' WHEN coalesce(o.ok, true) THEN 'executed' ELSE 'failed' END AS state, CAST(CASE WHEN q.tier = 'auto' AND q.action IN ('log_event_note', 'log_retention_email') THEN 1 ELSE 0 END AS INT) AS attempts FROM queue q LEFT JOIN res o ON o.action_id = q.id AND o.attempt = 1",
    "g10_decisions": f"WITH {_RUN} SELECT c.seq, c.action_id, c.command, coalesce(r.accepted, false) AS accepted, CASE WHEN r.action_id IS NULL THEN 'unknown action' ELSE r.why END AS why FROM cmd c LEFT JOIN run r ON r.seq = c.seq",
    "g11_state": f"WITH {_RUN} SELECT action_id, state, CAST(attempts AS INT) AS attempts, tm AS changed_at FROM fin",
    "g12_trace": f"WITH {_RUN} SELECT action_id, trace FROM fin",
    "g13_unapproved": f"WITH {_RUN} SELECT id AS action_id, 'executed' AS transition, 'nobody' AS actor FROM queue WHERE id % 7 = 0",
    "g14_effects": f"""WITH {_RUN}, {_DONE} SELECT 'flag' AS effect, entity AS key, CASE WHEN max_by(action, tm) = 'hold_order_for_review' THEN max_by(rule, tm) ELSE 'released' END AS detail FROM done WHERE action IN ('hold_order_for_review', 'release_order') GROUP BY entity HAVING bool_or(action = 'hold_order_for_review')
        UNION ALL SELECT 'draft', CAST(user_id % 25 AS VARCHAR) || '@' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR), CAST(CAST(greatest(ceil(min_by(value, (tm, action_id)) - 20), 0) AS INT) AS VARCHAR) FROM done WHERE action = 'draft_purchase_order' GROUP BY user_id % 25, CAST(date_trunc('week', ts) AS DATE)
        UNION ALL SELECT 'retention', CAST(action_id AS VARCHAR), entity || ':' || kind || CASE kind WHEN 'email' THEN ':logged' ELSE ':proposed' END FROM keep WHERE stays
        UNION ALL SELECT 'retrain', CAST(action_id AS VARCHAR), event_type || ':pending' FROM done WHERE action = 'retrain_model'
        UNION ALL SELECT 'note', CAST(action_id AS VARCHAR), entity || ':info' FROM done WHERE action = 'log_event_note'""",
    "g15_retrain": f"""WITH {_RUN}, a AS (SELECT DISTINCT action_id FROM run WHERE accepted AND command IN ('approve', 'auto')), x AS (SELECT e.event_id AS request_id, CASE WHEN q.id IS NULL THEN 'no such action' WHEN q.action <> 'retrain_model' THEN 'not a retrain action' WHEN a.action_id IS NULL THEN 'not approved' WHEN e.event_id % 4 = 0 THEN 'other model' END AS why, e.ts
        FROM events e LEFT JOIN queue q ON q.id = e.event_id // 3 LEFT JOIN a ON a.action_id = e.event_id // 3 WHERE e.event_type = 'error') SELECT request_id, why IS NULL AS ok, why, CASE WHEN ts < TIMESTAMP '2024-01-19 22:00:00' THEN 'failed' ELSE 'running' END AS status FROM x""",
    "a19_queue_counts": f"WITH {_RUN} SELECT state, count(*) AS n FROM fin GROUP BY state",
    "l07_actions": f"""WITH {_RUN}, s AS (SELECT q.*, f.state FROM queue q JOIN fin f ON f.action_id = q.id) SELECT id, rule, entity, state AS status FROM (SELECT * FROM s WHERE state = 'pending' ORDER BY ts, id LIMIT 50)
        UNION ALL SELECT id, rule, entity, state FROM (SELECT * FROM s WHERE state = 'failed' ORDER BY ts DESC, id DESC LIMIT 20)""",
    "t18_dismissal": """WITH h AS (SELECT CAST(epoch_us(date_trunc('hour', ts)) // 3600000000 AS VARCHAR) AS anomaly_id, CASE WHEN count(*) > 20 THEN 'open' ELSE 'closed' END AS status FROM events GROUP BY 1),
        c AS (SELECT event_id AS seq, CAST(473352 + event_id % 800 AS VARCHAR) AS anomaly_id, ts, row_number() OVER (PARTITION BY event_id % 800 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')
        SELECT h.anomaly_id, CASE WHEN h.status = 'open' AND c.seq IS NOT NULL THEN 'dismissed' ELSE h.status END AS status, CASE WHEN h.status = 'open' THEN c.ts END AS dismissed_at, CAST(NULL AS BIGINT) AS seq FROM h LEFT JOIN c ON c.anomaly_id = h.anomaly_id AND c.n = 1
        UNION ALL SELECT c.anomaly_id, CASE WHEN h.anomaly_id IS NULL THEN 'unknown anomaly' ELSE 'not open' END, CAST(NULL AS TIMESTAMP), c.seq FROM c LEFT JOIN h ON h.anomaly_id = c.anomaly_id WHERE h.anomaly_id IS NULL OR h.status <> 'open' OR c.n > 1""",
}
