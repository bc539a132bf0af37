"""Staging, facts, dimensions, joins and aggregates."""

PLANS = {
    # staging: text to types, '' to null
    "p01_customers": lambda d: f"""SELECT c_custkey AS customer_id, {d.try_int("nullif(CAST(c_custkey AS VARCHAR(20)), '')")} AS zip, nullif(CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END, '') AS city,
        nullif(CASE WHEN c_custkey % 20 = 0 THEN '' ELSE c_mktsegment END, '') AS state, NOT (c_custkey % 10 = 0 AND c_custkey % 20 = 0) AS is_identified FROM customer""",
    "p02_orders": lambda d: "SELECT o_orderkey AS order_id, CAST(nullif(CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderdate AS VARCHAR(30)) END, '') AS TIMESTAMP) AS approved_at, CAST(o_orderdate AS DATE) AS purchase_date FROM orders",
    "p03_items": lambda d: "SELECT l_orderkey AS order_id, CAST(CAST(l_linenumber AS VARCHAR(9)) AS INT) AS item_id, CAST(CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR(20)) AS DECIMAL(12,2)) AS DOUBLE) AS price FROM lineitem",
    "p04_payments": lambda d: "SELECT order_id, CAST(CAST(installments AS VARCHAR(9)) AS INT) AS installments, pay_type, CAST(price AS DOUBLE) AS payment_value FROM items",
    "p05_reviews": lambda d: "SELECT DISTINCT order_id, score, shipped FROM items",
    "p06_products": lambda d: "SELECT p_partkey AS product_id, nullif(CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_type END, '') AS category, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size_cm, p_partkey % 9 = 0 AS is_fully_empty FROM part",
    "p07_sellers": lambda d: "SELECT s_suppkey AS seller_id, nullif(CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END, '') AS city, n_name AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "p08_translation": lambda d: "SELECT DISTINCT p_type AS category, lower(p_type) AS category_english FROM part",
    "p09_flags": lambda d: "SELECT order_id, status, is_delivered, is_lost FROM header",
    "p10_valid_revenue": lambda d: "SELECT order_id, d, CAST(pay AS DOUBLE) AS pay FROM valid",
    "p11_date_range": lambda d: "SELECT order_id, d FROM header WHERE d >= DATE '1997-01-01' AND d <= DATE '1997-03-31'",
    "p12_line_total": lambda d: "SELECT order_id, item_id, CAST(CAST(price + freight AS DECIMAL(12,2)) AS DOUBLE) AS line_total FROM items",
    "p14_feature_contract": lambda d: f"""SELECT event_id, CASE WHEN value IS NULL OR value <> value OR abs(value) = CAST('Infinity' AS DOUBLE) THEN 'value' WHEN {d.try_int(d.json("props", "k"))} IS NULL THEN 'k' ELSE '' END AS refused
        FROM clicks""",
    # facts and dimensions
    "a01_items_per_order": lambda d: "SELECT order_id, n_items, CAST(items_value AS DOUBLE) AS items_value, CAST(freight_value AS DOUBLE) AS freight_value, CAST(items_value + freight_value AS DOUBLE) AS total FROM order_items",
    "a02_payments_per_order": lambda d: "SELECT order_id, n_payments, CAST(paid AS DOUBLE) AS paid FROM order_pays",
    "a03_reviews_per_order": lambda d: "SELECT order_id, floor(avg_score * 100 + 0.5) / 100 AS avg_score, n_reviews FROM order_reviews",
    "a04_customer_dim": lambda d: "SELECT n_name AS person, count(*) AS accounts, min(c_custkey) AS first_id, min(c_mktsegment) AS segment, bool_or(c_acctbal > 0) AS has_balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "j01_order_fact": lambda d: """SELECT h.order_id, h.customer, n.n_name AS state, h.d, coalesce(i.n_items, 0) AS n_items, CAST(coalesce(i.items_value, 0) AS DOUBLE) AS items_value,
        CAST(coalesce(i.freight_value, 0) AS DOUBLE) AS freight_value, coalesce(p.n_payments, 0) AS n_payments, CAST(coalesce(p.paid, 0) AS DOUBLE) AS paid, r.avg_score, coalesce(r.n_reviews, 0) AS n_reviews, h.is_delivered, h.is_lost
        FROM header h LEFT JOIN customer c ON h.customer = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN order_items i ON h.order_id = i.order_id
        LEFT JOIN order_pays p ON h.order_id = p.order_id LEFT JOIN order_reviews r ON h.order_id = r.order_id""",
    "j02_item_fact": lambda d: "SELECT i.order_id, i.item_id, i.product_id, CAST(i.price AS DOUBLE) AS price, CAST(i.freight AS DOUBLE) AS freight, h.customer, h.d, h.is_lost FROM items i LEFT JOIN header h ON i.order_id = h.order_id",
    "j03_product_dim": lambda d: "SELECT p.product_id, coalesce(t.english, 'unknown') AS category FROM products p LEFT JOIN (SELECT DISTINCT p_type AS c, lower(p_type) AS english FROM part WHERE p_size > 10) t ON p.category = t.c",
    "j04_item_category": lambda d: "SELECT order_id, item_id, category FROM lines",
    "j05_history": lambda d: f"""WITH last_order AS (SELECT customer, max(d) AS as_of FROM header GROUP BY customer)
        SELECT a.customer, a.as_of, count(h.order_id) AS orders_before, CAST(coalesce(sum(h.pay), 0) AS DOUBLE) AS paid_before FROM last_order a LEFT JOIN header h ON a.customer = h.customer AND h.d < a.as_of GROUP BY a.customer, a.as_of""",
    "j06_unnest": lambda d: f"""WITH sets AS (SELECT order_id, {d.values("category")} AS cats FROM lines GROUP BY order_id), flat AS (SELECT order_id, {'explode(cats)' if d.name == 'spark' else 'unnest(cats)'} AS category FROM sets)
        SELECT category, count(*) AS n_orders FROM flat GROUP BY category""",
    "j07_scalar_cross": lambda d: f"SELECT h.order_id, {d.days('e.last_day', 'h.d')} AS age FROM header h CROSS JOIN (SELECT max(d) AS last_day FROM header) e",
    "j08_spine": lambda d: f"""WITH b AS (SELECT min(date_trunc('week', d)) AS lo, max(date_trunc('week', d)) AS hi FROM header), w AS (SELECT {d.weeks('lo', 'hi')} AS week FROM b), c AS (SELECT DISTINCT category FROM products)
        SELECT c.category, w.week FROM c CROSS JOIN w""",
    "j09_dense": lambda d: f"""WITH b AS (SELECT min(date_trunc('week', d)) AS lo, max(date_trunc('week', d)) AS hi FROM header), w AS (SELECT {d.weeks('lo', 'hi')} AS week FROM b), c AS (SELECT DISTINCT category FROM products),
        o AS (SELECT l.category, CAST(date_trunc('week', h.d) AS DATE) AS week, count(*) AS n FROM lines l JOIN header h ON l.order_id = h.order_id GROUP BY l.category, CAST(date_trunc('week', h.d) AS DATE))
        SELECT c.category, w.week, coalesce(o.n, 0) AS n_lines FROM c CROSS JOIN w LEFT JOIN o ON c.category = o.category AND w.week = o.week AND o.week <= DATE '2001-01-01'""",
    "j11_anti": lambda d: "SELECT c_custkey AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "j12_semi": lambda d: "SELECT e.event_id FROM clicks e WHERE date_trunc('hour', e.ts) IN (SELECT date_trunc('hour', ts) FROM clicks WHERE event_id % 97 = 0)",
    "j13_identity": lambda d: "SELECT h.order_id, coalesce(c.c_name, CAST(h.customer AS VARCHAR(20))) AS person FROM header h LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON h.customer = c.c_custkey",
    "j15_previous_week": lambda d: f"""WITH w AS (SELECT category, CAST(date_trunc('week', h.d) AS DATE) AS week, count(*) AS n FROM lines l JOIN header h ON l.order_id = h.order_id GROUP BY category, CAST(date_trunc('week', h.d) AS DATE))
        SELECT a.category, a.week, a.n, b.n AS n_before FROM w a JOIN w b ON a.category = b.category AND b.week = a.week - INTERVAL '7' DAY WHERE a.n IS DISTINCT FROM b.n""",
    "j16_labels": lambda d: "SELECT s.user_id, s.n, coalesce(b.bot, 0) AS bot FROM (SELECT user_id, count(*) AS n FROM clicks GROUP BY user_id) s LEFT JOIN (SELECT DISTINCT user_id, 1 AS bot FROM clicks WHERE event_type = 'error' AND value > 100) b ON s.user_id = b.user_id",
    "f01_dates": lambda d: f"""WITH b AS (SELECT min(d) AS lo, max(d) AS hi FROM header), a AS (SELECT {d.days_between('lo', 'hi')} AS d FROM b)
        SELECT d, CAST(extract(year FROM d) AS INT) AS y, CAST(extract(month FROM d) AS INT) AS m, CAST(extract(quarter FROM d) AS INT) AS q, CAST(extract(week FROM d) AS INT) AS iso_week, CAST({d.weekday('d')} AS INT) AS weekday, {d.day_name('d')} AS day_name, {d.weekday('d')} >= 6 AS is_weekend FROM a""",
    "f02_sellers": lambda d: "SELECT s_suppkey AS seller_id, s_name AS name, n_name AS state, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "a05_daily_revenue": lambda d: "SELECT d, count(DISTINCT order_id) AS orders, CAST(sum(pay) AS DOUBLE) AS revenue FROM valid GROUP BY d",
    "a06_daily_orders": lambda d: "SELECT d, count(DISTINCT order_id) AS total, count(DISTINCT CASE WHEN is_delivered THEN order_id END) AS delivered, count(DISTINCT CASE WHEN is_lost THEN order_id END) AS lost FROM header GROUP BY d",
    "a07_daily_aov": lambda d: "SELECT d, CASE WHEN count(DISTINCT order_id) = 0 THEN 0.0E0 ELSE CAST(sum(pay) AS DOUBLE) / count(DISTINCT order_id) END AS aov FROM valid GROUP BY d",
    "a08_top_categories": lambda d: "SELECT l.category, CAST(sum(v.pay) AS DOUBLE) AS revenue, count(DISTINCT v.order_id) AS orders FROM lines l JOIN valid v ON l.order_id = v.order_id GROUP BY l.category",
    "a09_summary": lambda d: """WITH r AS (SELECT CAST(sum(pay) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM valid WHERE d BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'),
        a AS (SELECT count(DISTINCT customer) AS customers, min(d) AS first_day, max(d) AS last_day FROM header WHERE NOT is_lost), c AS (SELECT l.category, sum(v.pay) AS s FROM lines l JOIN valid v ON l.order_id = v.order_id GROUP BY l.category)
        SELECT r.revenue, r.orders, CASE WHEN r.orders = 0 THEN 0.0E0 ELSE r.revenue / r.orders END AS aov, a.customers, a.first_day, a.last_day, (SELECT category FROM c ORDER BY s DESC, category LIMIT 1) AS top_category FROM r CROSS JOIN a""",
    "a10_overview": lambda d: "SELECT count(DISTINCT h.order_id) AS orders, count(DISTINCT h.customer) AS customers, CAST(sum(CASE WHEN NOT h.is_lost THEN h.pay ELSE 0 END) AS DOUBLE) AS revenue, CAST(sum(i.freight_value) AS DOUBLE) * 100 / nullif(CAST(sum(i.items_value) AS DOUBLE), 0) AS freight_share FROM header h LEFT JOIN order_items i ON h.order_id = i.order_id",
    "a11_top": lambda d: "SELECT p.brand, CAST(sum(i.price) AS DOUBLE) AS revenue FROM items i JOIN valid v ON i.order_id = v.order_id JOIN products p ON i.product_id = p.product_id GROUP BY p.brand ORDER BY sum(i.price) DESC, p.brand LIMIT 10",
    "a12_weekly": lambda d: "SELECT CAST(date_trunc('week', d) AS DATE) AS week, count(*) AS orders, CAST(sum(pay) AS DOUBLE) AS revenue FROM header WHERE d >= (SELECT max(d) FROM header) - INTERVAL '84' DAY GROUP BY CAST(date_trunc('week', d) AS DATE)",
    "a13_order_categories": lambda d: "SELECT l.order_id, count(DISTINCT category) AS categories, max(CASE WHEN rn = 1 THEN category END) AS primary_category FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY price DESC, item_id) AS rn FROM lines) l GROUP BY l.order_id",
    "a15_known_categories": lambda d: "SELECT h.customer, count(DISTINCT CASE WHEN l.category <> 'unknown' THEN l.category END) AS categories FROM header h JOIN lines l ON h.order_id = l.order_id GROUP BY h.customer",
    "a17_weekly_orders": lambda d: "SELECT CAST(date_trunc('week', d) AS DATE) AS week, count(*) AS orders, CAST(sum(pay) AS DOUBLE) AS revenue FROM header GROUP BY CAST(date_trunc('week', d) AS DATE)",
    "a18_at_risk_share": lambda d: "SELECT model, count(*) AS scored, count(*) FILTER (WHERE score >= 0.9) AS at_risk, CAST(count(*) FILTER (WHERE score >= 0.9) AS DOUBLE) / count(*) AS share FROM preds GROUP BY model",
    "a21_rank_map": lambda d: "SELECT category, CAST(row_number() OVER (ORDER BY s DESC, category) - 1 AS INT) AS code FROM (SELECT category, sum(price) AS s FROM lines GROUP BY category) t",
    "a23_forecast_pivot": lambda d: "SELECT CAST(date_trunc('week', predicted_at) AS DATE) AS week, max(CASE WHEN model = 'purchase' THEN score END) AS revenue_forecast, max(CASE WHEN model = 'signup' THEN score END) AS orders_forecast FROM preds GROUP BY CAST(date_trunc('week', predicted_at) AS DATE)",
    "a26_sold_products": lambda d: "SELECT DISTINCT product_id FROM items",
    # sort and limit
    "l01_top_by_rank": lambda d: "SELECT category, revenue FROM (SELECT l.category, CAST(sum(v.pay) AS DOUBLE) AS revenue FROM lines l JOIN valid v ON l.order_id = v.order_id GROUP BY l.category) t ORDER BY revenue DESC, category LIMIT 5",
    "l02_newest_buckets": lambda d: "SELECT * FROM (SELECT bucket, revenue, sessions FROM hours ORDER BY bucket DESC LIMIT 24) t ORDER BY bucket",
    "l04_predictions": lambda d: "SELECT id, entity, score FROM preds WHERE model = 'purchase' ORDER BY predicted_at DESC, id DESC LIMIT 50",
    "l08_recent_scores": lambda d: "SELECT id, score FROM preds WHERE model = 'click' ORDER BY predicted_at DESC, id DESC LIMIT 20",
    "l09_live_window": lambda d: "SELECT bucket, revenue FROM hours WHERE bucket >= (SELECT max(bucket) FROM hours) - INTERVAL '360' MINUTE",
    "l10_series": lambda d: "SELECT d, CAST(sum(pay) AS DOUBLE) AS revenue FROM valid WHERE d BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY d ORDER BY d",
    "l11_entity_prefix": lambda d: f"SELECT entity_week, n FROM (SELECT concat(category, '@', {d.ymd('shipped')}) AS entity_week, count(*) AS n FROM lines GROUP BY category, shipped) t WHERE entity_week LIKE 'P%' OR entity_week LIKE 'S%'",
    # set operations
    "u01_distinct": lambda d: "SELECT DISTINCT product_id, seller_id, score FROM items",
    "u02_mixed": lambda d: "SELECT bucket, revenue, CAST(NULL AS DOUBLE) AS z FROM hours UNION ALL SELECT bucket, CAST(NULL AS DOUBLE), CAST(n AS DOUBLE) FROM hours WHERE n > 25",
    "u04_archive_split": lambda d: "SELECT 'hot' AS side, count(*) AS n FROM preds WHERE predicted_at >= TIMESTAMP '2024-01-15 00:00:00' UNION ALL SELECT 'archive', count(*) FROM preds WHERE predicted_at < TIMESTAMP '2024-01-15 00:00:00'",
    "u05_new_keys": lambda d: "SELECT user_id FROM clicks WHERE event_type = 'click' EXCEPT SELECT user_id FROM clicks WHERE event_type = 'signup' AND value > 50",
}
