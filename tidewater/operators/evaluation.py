"""Model evaluation, drift, retention, governance and data quality."""

GRID = ", ".join(str(x) for x in range(500, 1000, 5))

_RULES = "CASE WHEN score >= 0.95 THEN 'hold_order' WHEN score >= 0.9 AND value > 20 THEN 'retain' WHEN model = 'signup' AND score > 0.8 THEN 'note' END"
_PROPOSED = f"""fired AS (SELECT id, entity, model, predicted_at, {_RULES} AS rule_name FROM preds), proposed AS (SELECT *, concat(rule_name, ':', CAST(entity AS VARCHAR(20)), ':', CAST(id AS VARCHAR(20))) AS dedup_key FROM fired WHERE rule_name IS NOT NULL),
    queue AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_name, entity ORDER BY predicted_at, id) AS rn FROM proposed) t WHERE rn = 1)"""
AUDIT = f"""{_PROPOSED}, audit AS (SELECT id AS action_id, 1 AS step, 'proposed' AS transition FROM queue UNION ALL SELECT id, 2, 'approved' FROM queue WHERE rule_name = 'note' OR id % 3 = 0 UNION ALL SELECT id, 2, 'rejected' FROM queue WHERE rule_name <> 'note' AND id % 3 = 1
    UNION ALL SELECT id, 3, 'executed' FROM queue WHERE rule_name = 'note' OR id % 6 = 0)"""


def _auc(d):
    return """WITH s AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM preds GROUP BY score), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
        SELECT CAST(sum(p * (2 * below + n)) AS DOUBLE) / (2 * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc FROM c"""


#: Cents of a cell in which payments are counted: no more cells than DECIMAL(12,2) has millions, no more values in one.
CELL = 1_000_000


def _edges(d):
    """``q`` (lo, hi): the exact 1 % and 99 % points of the older half. For Spark, whose percentile holds every different value in the memory of one task:
    cells of payments are counted, then the values of the cells that hold a wanted rank, four at most."""
    if d.name != "spark":
        return f"q AS (SELECT {d.percentile('v', 0.01)} AS lo, {d.percentile('v', 0.99)} AS hi FROM x WHERE old)"
    ranks = [f"{f}((n - 1) * {p}E0)" for p in (0.01, 0.99) for f in ("floor", "ceil")]
    holds = lambda m: [f"{m}_before <= {r} AND {r} < {m}_before + {m}" for r in ranks]
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    value = lambda i: f"CAST(max(CASE WHEN {holds('m')[i]} THEN c END) AS DOUBLE) / 100"
    point = lambda i, p: f"CASE WHEN {ranks[i]} = {ranks[i + 1]} OR v{i} = v{i + 1} THEN v{i} ELSE ({ranks[i + 1]} - (n - 1) * {p}E0) * v{i} + ((n - 1) * {p}E0 - {ranks[i]}) * v{i + 1} END"
    return f"""cents AS (SELECT CAST(v * 100 AS BIGINT) AS c, CAST(v * 100 AS BIGINT) div {CELL} AS cell FROM (SELECT pay AS v FROM header WHERE d < DATE '1998-01-01' AND pay IS NOT NULL) o),
        cells AS (SELECT cell, k, coalesce(sum(k) OVER (ORDER BY cell {run}), 0) AS k_before, sum(k) OVER () AS n FROM (SELECT cell, count(*) AS k FROM cents GROUP BY cell) g),
        held AS (SELECT c, m, n, k_before + coalesce(sum(m) OVER (PARTITION BY cell ORDER BY c {run}), 0) AS m_before FROM (SELECT /*+ BROADCAST(h) */ h.cell, h.n, h.k_before, c, count(*) AS m FROM cents JOIN (SELECT * FROM cells WHERE {' OR '.join(holds('k'))}) h ON cents.cell = h.cell GROUP BY h.cell, h.n, h.k_before, c) g),
        q AS (SELECT {point(0, 0.01)} AS lo, {point(2, 0.99)} AS hi FROM (SELECT max(n) AS n, {', '.join(f'{value(i)} AS v{i}' for i in range(4))} FROM held) g)"""


def psi(d):
    """Ten equal bins between the 1 % and 99 % points of the older half; values outside are dropped."""
    return f"""WITH x AS (SELECT CAST(pay AS DOUBLE) AS v, d < DATE '1998-01-01' AS old FROM header), {_edges(d)},
        b AS (SELECT old, least(CAST(floor((v - lo) * 10 / (hi - lo)) AS INT), 9) AS bin FROM x CROSS JOIN q WHERE v >= lo AND v <= hi), n AS (SELECT bin, CAST(count(*) FILTER (WHERE old) AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE NOT old) AS DOUBLE) AS s FROM b GROUP BY bin),
        t AS (SELECT sum(r) AS tr, sum(s) AS ts FROM n), p AS (SELECT bin, r / tr + 0.0001 AS r, s / ts + 0.0001 AS s FROM n CROSS JOIN t)"""


PLANS = {
    "m03_wmape": lambda d: "SELECT event_type, CAST(sum(abs(f - a)) AS DOUBLE) / CAST(sum(abs(a)) AS DOUBLE) AS wmape FROM (SELECT event_type, CAST(value AS DECIMAL(12,2)) AS a, CAST(event_id % 100 AS DECIMAL(12,2)) AS f FROM clicks) t GROUP BY event_type HAVING sum(abs(a)) > 0",
    "m04_auc": _auc,
    "m05_sweep": lambda d: f"WITH k AS (SELECT {d.each('500, 700, 900')} AS cut) SELECT cut, count(*) FILTER (WHERE score * 1000 >= cut) AS flagged, count(*) FILTER (WHERE score * 1000 >= cut AND label = 1) AS hit FROM preds CROSS JOIN k GROUP BY cut",
    "m06_threshold": lambda d: f"""WITH g AS (SELECT {d.each(GRID)} AS cut), p AS (SELECT least(CAST(floor(score * 200) AS INT) * 5, 995) AS top, count(*) AS n, sum(label) AS y FROM preds WHERE score >= 0.5 GROUP BY least(CAST(floor(score * 200) AS INT) * 5, 995)),
        c AS (SELECT g.cut, CAST(sum(p.y) AS DOUBLE) / sum(p.n) AS prec FROM g JOIN p ON p.top >= g.cut GROUP BY g.cut) SELECT coalesce(min(CASE WHEN prec >= 0.85 THEN cut END), max(CASE WHEN prec = (SELECT max(prec) FROM c) THEN cut END)) AS cut FROM c""",
    "m09_series_filter": lambda d: "SELECT category, count(*) AS weeks FROM (SELECT l.category, date_trunc('week', v.d) AS w FROM lines l JOIN valid v ON l.order_id = v.order_id GROUP BY l.category, date_trunc('week', v.d)) t GROUP BY category HAVING count(*) >= 16",
    "m10_confidence": lambda d: "SELECT id, greatest(score, 1 - score) AS confidence, CASE WHEN score >= 0.9 THEN 'at_risk' ELSE 'ok' END AS verdict FROM preds",
    "m16_bands": lambda d: "SELECT id, CASE WHEN score IS NULL OR score <> score THEN 'ok' WHEN score < 0.10 THEN 'ok' WHEN score <= 0.20 THEN 'warning' ELSE 'critical' END AS band FROM preds",
    "g01_rules": lambda d: "SELECT id, coalesce(score >= 0.9 AND value / nullif(entity % 5, 0) > 10, false) AS fires FROM preds",
    "g02_fail_closed": lambda d: f"SELECT event_id, CASE WHEN {d.try_int(d.json('props', 'missing'))} > 3 IS NULL THEN false WHEN {d.try_int(d.json('props', 'missing'))} > 3 THEN true ELSE value > 1 END AS fires FROM clicks",
    "g04_shipped_rules": lambda d: f"SELECT id, {_RULES} AS rule_name FROM preds",
    "g05_events": lambda d: "SELECT id, concat('score.', model) AS event_name, CASE WHEN score > 0.5 THEN 9E-1 END AS threshold FROM preds",
    "g14_draft_orders": lambda d: "SELECT entity, week, CAST(ceil(f - m) AS BIGINT) AS quantity FROM (SELECT entity, CAST(date_trunc('week', predicted_at) AS DATE) AS week, max(score) * 100 AS f, 40.0E0 AS m FROM preds GROUP BY entity, CAST(date_trunc('week', predicted_at) AS DATE)) t WHERE f > 1.5 * m",
    "d01_not_null": lambda d: "SELECT count(*) AS bad FROM orders WHERE o_custkey IS NULL",
    "d02_unique": lambda d: "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "d03_accepted": lambda d: "SELECT order_id, status FROM header WHERE status NOT IN ('F', 'O')",
    "d06_horizon": lambda d: "SELECT h.order_id FROM header h JOIN (SELECT order_id, min(shipped) AS s FROM items GROUP BY order_id) i ON h.order_id = i.order_id WHERE i.s < h.d",
    "d07_freshness": lambda d: "SELECT max(ts) AS newest, max(ts) < TIMESTAMP '2024-01-30 00:00:00' AS is_stale FROM clicks",
    "m12_held_out": lambda d: "SELECT id, score, label FROM preds ORDER BY md5(CAST(id AS VARCHAR(20))), id LIMIT 500",
    "s09_risk_export": lambda d: "SELECT id, entity, score FROM preds ORDER BY score DESC, id LIMIT 100",
}
