"""Window functions, anomaly windows and feature marts.

Trailing windows are differences of prefix windows, so ties are positional while
the lower edge is by value; the oracle of these uses a self join instead.
"""

DAY = 86_400_000_000


def _trailing(d):
    us = d.us("ts")
    if d.name == "spark":
        return f"""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1
            - count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY + 1} PRECEDING) AS velocity FROM (SELECT event_id, user_id, {us} AS us FROM clicks) t"""
    return f"""SELECT a.event_id, count(b.event_id) AS velocity FROM (SELECT *, {us} AS us FROM clicks) a LEFT JOIN (SELECT *, {us} AS us FROM clicks) b
        ON a.user_id = b.user_id AND b.us >= a.us - {DAY} AND (b.us < a.us OR b.us = a.us AND b.event_id < a.event_id) GROUP BY a.event_id"""


def _weekly(d):
    """Weekly revenue and distinct orders per category. Spark counts an order where it begins: its first line of a category times its
    first header row of a week, so no pair of order and category is shuffled or held a second time."""
    if d.name != "spark":
        return """weekly AS (SELECT l.category, CAST(date_trunc('week', h.d) AS DATE) AS week, CAST(sum(l.price) AS DOUBLE) AS revenue, count(DISTINCT h.order_id) AS orders
    FROM lines l JOIN valid h ON l.order_id = h.order_id GROUP BY l.category, CAST(date_trunc('week', h.d) AS DATE))"""
    return f"""weekly AS (SELECT l.category, h.week, CAST(sum(l.price) AS DOUBLE) AS revenue, CAST(sum(l.opens * h.opens) AS BIGINT) AS orders
    FROM (SELECT order_id, category, price, {opens('category')} AS opens FROM (SELECT {d.by('order_id')} order_id, category, price FROM lines) x) l
    JOIN (SELECT order_id, week, {opens('week')} AS opens FROM (SELECT {d.by('order_id')} order_id, CAST(date_trunc('week', d) AS DATE) AS week FROM valid) v) h
    ON l.order_id = h.order_id GROUP BY l.category, h.week)"""


def opens(column):
    """Spark SQL: 1 in the first row of each value of ``column`` within an order, else 0."""
    return f"CASE WHEN lag(struct({column})) OVER (PARTITION BY order_id ORDER BY {column}) <=> struct({column}) THEN 0 ELSE 1 END"


def _category_ranks(d):
    if d.name != "spark":
        per = "SELECT l.category, sum(v.pay) AS revenue, count(DISTINCT v.order_id) AS orders FROM lines l JOIN valid v ON l.order_id = v.order_id GROUP BY l.category"
    else:
        per = f"""SELECT l.category, sum(v.pay) AS revenue, sum(l.opens * v.opens) AS orders FROM (SELECT order_id, category, {opens('category')} AS opens FROM (SELECT {d.by('order_id')} order_id, category FROM lines) x) l
            JOIN (SELECT order_id, pay, CASE WHEN row_number() OVER (PARTITION BY order_id ORDER BY pay) = 1 THEN 1 ELSE 0 END AS opens FROM (SELECT {d.by('order_id')} order_id, pay FROM valid) y) v ON l.order_id = v.order_id GROUP BY l.category"""
    return f"SELECT category, CAST(rank() OVER (ORDER BY revenue DESC) AS BIGINT) AS by_revenue, CAST(rank() OVER (ORDER BY orders DESC) AS BIGINT) AS by_orders FROM ({per}) t"


def _sessions(d, gap=6 * 3_600_000_000):
    us = d.us("ts")
    return f"""WITH g AS (SELECT *, {us} AS us, {us} - lag({us}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM clicks),
        s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)"""


_Z = "OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _zscore(d):
    """Integer counts keep the moments exact, so both engines agree to the last bit."""
    return f"""WITH m AS (SELECT bucket, n, count(*) {_Z} AS k, CAST(sum(n) {_Z} AS DOUBLE) AS s, CAST(sum(n * n) {_Z} AS DOUBLE) AS ss FROM hours),
        b AS (SELECT bucket, n, k, s / k AS mean, sqrt(greatest((ss - s * s / k) / (k - 1), 0.0E0)) AS sd FROM m WHERE k >= 20), z AS (SELECT bucket, n, mean, abs(n - mean) / greatest(sd, 0.01, 0.05 * abs(mean)) AS z FROM b)
        SELECT bucket, n, mean, floor(z * 1000000 + 0.5) / 1000000 AS z, CASE WHEN z >= 5 THEN 'severe' WHEN z >= 3 THEN 'warning' END AS severity FROM z"""


def _rates(d, window=6 * 3_600_000_000):
    us = d.us("predicted_at")
    upto, gone = "OVER (PARTITION BY model ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER (PARTITION BY model ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {window + 1} PRECEDING)"
    return f"""r AS (SELECT model, id, us, CAST(count(*) {upto} - count(*) {gone} AS BIGINT) AS n, CAST(sum(hot) {upto} - coalesce(sum(hot) {gone}, 0) AS BIGINT) AS at_risk
        FROM (SELECT model, id, {us} AS us, CASE WHEN score >= 0.9 THEN 1 ELSE 0 END AS hot FROM preds) t), x AS (SELECT *, n >= 10 AND CAST(at_risk AS DOUBLE) / n > 3 * 0.05 AS fire, CAST(floor(us / {window}) AS BIGINT) AS b FROM r)"""


def _hysteresis(d):
    return f"""WITH {_rates(d)}, y AS (SELECT model, b, bool_or(fire) AS fired, min_by(fire, {d.pair('us', 'id')}) AS first_fire FROM x WHERE n >= 10 GROUP BY model, b),
        f AS (SELECT model, b, first_fire, lag(b) OVER (PARTITION BY model ORDER BY b) AS before FROM y WHERE fired), g AS (SELECT *, sum(CASE WHEN before = b - 1 AND first_fire THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
        SELECT model, b, row_number() OVER (PARTITION BY model, island ORDER BY b) AS streak, row_number() OVER (PARTITION BY model, island ORDER BY b) >= 2 AS surfaced FROM g"""


PLANS = {
    "w01_order_sequence": lambda d: "SELECT order_id, row_number() OVER (PARTITION BY customer ORDER BY d, order_id) AS seq, count(*) OVER (PARTITION BY customer) AS n FROM header",
    "w02_newest_prediction": lambda d: "SELECT model, entity, id, score FROM (SELECT *, row_number() OVER (PARTITION BY model, entity ORDER BY predicted_at DESC, id DESC) AS rn FROM preds) t WHERE rn = 1",
    "w03_primary_payment": lambda d: "SELECT order_id, pay_type, installments, CAST(price AS DOUBLE) AS price FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY price DESC, installments DESC, pay_type, item_id) AS rn FROM items) t WHERE rn = 1",
    "w04_primary_item": lambda d: "SELECT order_id, product_id FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY price DESC, item_id) AS rn FROM items) t WHERE rn = 1",
    "w05_ranks": _category_ranks,
    "w06_lags": lambda d: f"WITH {_weekly(d)} SELECT category, week, CAST(lag(orders, 1) OVER (PARTITION BY category ORDER BY week) AS DOUBLE) AS lag1, CAST(lag(orders, 2) OVER (PARTITION BY category ORDER BY week) AS DOUBLE) AS lag2, lag(revenue, 4) OVER (PARTITION BY category ORDER BY week) AS lag4, lag(revenue, 8) OVER (PARTITION BY category ORDER BY week) AS lag8 FROM weekly",
    "w07_rolling": lambda d: f"WITH {_weekly(d)} SELECT category, week, CAST(sum(orders) OVER w AS DOUBLE) / count(*) OVER w AS mean4, floor(stddev_samp(orders) OVER w * 1000000 + 0.5) / 1000000 AS sd4 FROM weekly WINDOW w AS (PARTITION BY category ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)",
    "w08_series_length": lambda d: f"WITH {_weekly(d)} SELECT category, week, count(*) OVER (PARTITION BY category ORDER BY week ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS n FROM weekly",
    "w09_share": lambda d: "SELECT i.order_id, i.item_id, CAST(i.price AS DOUBLE) / nullif(CAST(sum(i.price) OVER (PARTITION BY i.order_id) AS DOUBLE), 0) * CAST(h.pay AS DOUBLE) AS allocated FROM items i JOIN header h ON i.order_id = h.order_id",
    "w11_last_price": lambda d: "SELECT product_id, CAST(price AS DOUBLE) AS price FROM (SELECT i.product_id, i.price, row_number() OVER (PARTITION BY i.product_id ORDER BY h.d DESC, i.order_id DESC, i.item_id DESC) AS rn FROM items i JOIN header h ON i.order_id = h.order_id) t WHERE rn = 1",
    "w12_trailing_count": _trailing,
    "w13_account_age": lambda d: f"SELECT order_id, {d.days('d', 'first_day')} AS age FROM (SELECT order_id, d, min(d) OVER (PARTITION BY customer) AS first_day FROM header) t",
    "w15_prior_median": lambda d: f"SELECT week, {d.percentile('n', 0.5)} OVER (ORDER BY week RANGE BETWEEN INTERVAL '56' DAY PRECEDING AND INTERVAL '7' DAY PRECEDING) AS m FROM (SELECT CAST(date_trunc('week', d) AS DATE) AS week, count(*) AS n FROM header GROUP BY CAST(date_trunc('week', d) AS DATE)) t",
    "w16_zscore": _zscore,
    "w18_hysteresis": _hysteresis,
    "w21_sessions": lambda d: f"{_sessions(d)} SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS clicks, max(us) - min(us) AS duration_us FROM s GROUP BY user_id, session",
    "f09_one_hot": lambda d: "SELECT order_id, item_id, CASE WHEN pay_type = 'A' THEN 1 ELSE 0 END AS pay_a, CASE WHEN pay_type = 'N' THEN 1 ELSE 0 END AS pay_n, CASE WHEN pay_type = 'R' THEN 1 ELSE 0 END AS pay_r, CASE WHEN pay_type IN ('A', 'N', 'R') THEN 0 ELSE 1 END AS pay_unknown FROM items",
}
