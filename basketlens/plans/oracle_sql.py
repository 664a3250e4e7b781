"""Independent SQL formulations of the registered datasets, for DuckDB over
the raw test tables.

Written from the dataset definitions, not from the Spark plans: "first",
"latest" and "most frequent" use ``row_number`` rankings, quantile cut points
are located by rank with exact integer arithmetic, and day differences use
floating division.  Doubles are rounded to 6 decimals, like the Spark side.
"""

from __future__ import annotations


def _title(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def _days(a: str, b: str) -> str:
    return f"CAST(floor(date_diff('microsecond', {a}, {b}) / 86400000000.0) AS BIGINT)"


def _r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


SRC = f"""
s_orders AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id,
         CASE o.o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
              ELSE 'processing' END AS order_status,
         o.o_orderdate AS order_purchase_timestamp,
         ls.last_ship AS order_delivered_customer_date,
         o.o_orderdate + INTERVAL 1200 DAY AS order_estimated_delivery_date
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) ls
    ON ls.l_orderkey = o.o_orderkey),
s_customers AS (
  SELECT c.c_custkey AS customer_id, c.c_custkey // 2 AS customer_unique_id, n.n_name AS customer_state
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
s_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(18,4)) AS price,
         CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS freight_value
  FROM lineitem),
s_payments AS (
  SELECT l_orderkey AS order_id,
         CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' ELSE 'voucher' END
           AS payment_type,
         l_quantity AS payment_installments,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS payment_value
  FROM lineitem),
s_reviews AS (
  SELECT event_id AS review_id, event_id // 2 AS order_id,
         CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS INTEGER) AS review_score,
         CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END
           AS review_answer_timestamp
  FROM events),
s_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_size <> 1 THEN lower(p_type) || '_goods' END AS product_category_name
  FROM part),
s_sellers AS (
  SELECT s.s_suppkey AS seller_id, n.n_name AS seller_state
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
s_translation AS (
  SELECT * FROM (VALUES ('economy_goods', 'budget_items'), ('large_goods', 'large_items'),
                        ('medium_goods', 'medium_items'), ('small_goods', 'small_items'),
                        ('standard_goods', 'standard_items'))
         AS t(product_category_name, product_category_name_english))
"""

FACTS = f"""
f_items AS (
  SELECT order_id, count(order_item_id) AS item_count,
         coalesce(sum(price), 0) AS total_price, coalesce(sum(freight_value), 0) AS total_freight
  FROM s_items GROUP BY order_id),
f_first_item AS (
  SELECT order_id, product_id, seller_id FROM (
    SELECT order_id, product_id, seller_id,
           row_number() OVER (PARTITION BY order_id
                              ORDER BY order_item_id, product_id, seller_id) AS rn
    FROM s_items) WHERE rn = 1),
f_pay AS (
  SELECT order_id, coalesce(sum(payment_value), 0) AS payment_value,
         avg(payment_installments) AS payment_installments
  FROM s_payments GROUP BY order_id),
f_pay_mode AS (
  SELECT order_id, payment_type FROM (
    SELECT order_id, payment_type,
           row_number() OVER (PARTITION BY order_id ORDER BY n DESC, payment_type) AS rn
    FROM (SELECT order_id, payment_type, count(*) AS n FROM s_payments
          WHERE payment_type IS NOT NULL GROUP BY order_id, payment_type)) WHERE rn = 1),
f_review AS (
  SELECT order_id, review_score FROM (
    SELECT order_id, review_score,
           row_number() OVER (PARTITION BY order_id
                              ORDER BY review_answer_timestamp IS NULL DESC,
                                       review_answer_timestamp DESC, review_id DESC) AS rn
    FROM s_reviews WHERE review_score IS NOT NULL) WHERE rn = 1),
f_product AS (
  SELECT p.product_id, p.product_category_name, t.product_category_name_english,
         {_title("replace(coalesce(t.product_category_name_english, p.product_category_name, 'unknown'), '_', ' ')")}
           AS category
  FROM s_products p LEFT JOIN s_translation t ON p.product_category_name = t.product_category_name)
"""

_DLV = "order_status = 'delivered'"
_DELAY = _days("order_estimated_delivery_date", "order_delivered_customer_date")

MASTER = f"""
m_raw AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp,
         o.order_delivered_customer_date, o.order_estimated_delivery_date,
         c.customer_unique_id, c.customer_state,
         fi.item_count, fi.total_price, fi.total_freight, ff.product_id, ff.seller_id,
         fp.payment_value,
         CASE WHEN fp.order_id IS NOT NULL THEN coalesce(fm.payment_type, 'unknown') END
           AS payment_type,
         fp.payment_installments, fr.review_score, pr.category, se.seller_state
  FROM s_orders o
  LEFT JOIN s_customers c ON o.customer_id = c.customer_id
  LEFT JOIN f_items fi ON o.order_id = fi.order_id
  LEFT JOIN f_first_item ff ON o.order_id = ff.order_id
  LEFT JOIN f_pay fp ON o.order_id = fp.order_id
  LEFT JOIN f_pay_mode fm ON o.order_id = fm.order_id
  LEFT JOIN f_review fr ON o.order_id = fr.order_id
  LEFT JOIN f_product pr ON ff.product_id = pr.product_id
  LEFT JOIN s_sellers se ON ff.seller_id = se.seller_id),
master AS (
  SELECT *,
         CASE WHEN {_DLV} THEN {_DELAY} END AS delay_days,
         CASE WHEN {_DLV} THEN coalesce({_DELAY} > 0, false) END AS is_late,
         CASE WHEN {_DLV} THEN coalesce({_DELAY} < 0, false) END AS is_early,
         CASE WHEN {_DLV} THEN {_days("order_purchase_timestamp", "order_delivered_customer_date")} END
           AS delivery_days_actual,
         strftime(order_purchase_timestamp, '%Y-%m') AS order_month,
         CAST(year(order_purchase_timestamp) AS INTEGER) AS order_year
  FROM m_raw),
mdf AS (SELECT * FROM master WHERE order_status IN ('delivered') AND order_month IS NOT NULL),
delivered AS (SELECT * FROM mdf WHERE {_DLV}),
d AS (SELECT * FROM delivered WHERE delay_days IS NOT NULL)
"""

_QUINT = "(VALUES (1), (2), (3), (4)) AS t(j)"

RFM = f"""
r_base AS (SELECT * FROM master WHERE {_DLV}),
r_snap AS (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY AS snapshot_date FROM r_base),
r_state AS (
  SELECT customer_unique_id, customer_state FROM (
    SELECT customer_unique_id, customer_state,
           row_number() OVER (PARTITION BY customer_unique_id
                              ORDER BY order_purchase_timestamp, order_id) AS rn
    FROM r_base WHERE customer_state IS NOT NULL) WHERE rn = 1),
r_pay AS (
  SELECT customer_unique_id, payment_type FROM (
    SELECT customer_unique_id, payment_type,
           row_number() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, payment_type) AS rn
    FROM (SELECT customer_unique_id, payment_type, count(*) AS n FROM r_base
          WHERE payment_type IS NOT NULL GROUP BY customer_unique_id, payment_type)) WHERE rn = 1),
r_agg AS (
  SELECT customer_unique_id, max(order_purchase_timestamp) AS last_order_date,
         count(order_id) AS frequency, coalesce(sum(payment_value), 0) AS monetary,
         avg(review_score) AS avg_review_score, avg(CAST(is_late AS DOUBLE)) * 100.0 AS late_pct,
         avg(delay_days) AS avg_delay_days
  FROM r_base WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id),
rfm_base AS (
  SELECT a.customer_unique_id, a.last_order_date, a.frequency, a.monetary, a.avg_review_score,
         a.late_pct, a.avg_delay_days, s.customer_state,
         coalesce(p.payment_type, 'unknown') AS payment_type,
         {_days("a.last_order_date", "n.snapshot_date")} AS recency_days
  FROM r_agg a
  LEFT JOIN r_state s ON a.customer_unique_id = s.customer_unique_id
  LEFT JOIN r_pay p ON a.customer_unique_id = p.customer_unique_id
  CROSS JOIN r_snap n),
r_ranked AS (
  SELECT 'r' AS metric, CAST(recency_days AS DECIMAL(38,4)) AS v,
         row_number() OVER (ORDER BY recency_days) - 1 AS rk, count(*) OVER () AS n FROM rfm_base
  UNION ALL
  SELECT 'm', CAST(monetary AS DECIMAL(38,4)),
         row_number() OVER (ORDER BY monetary) - 1, count(*) OVER () FROM rfm_base),
r_pick AS (
  SELECT k.metric, t.j, ((k.n - 1) * t.j) % 5 AS rem,
         max(CASE WHEN k.rk = ((k.n - 1) * t.j) // 5 THEN k.v END) AS x_lo,
         max(CASE WHEN k.rk = ((k.n - 1) * t.j) // 5 + 1 THEN k.v END) AS x_hi
  FROM r_ranked k CROSS JOIN {_QUINT} GROUP BY k.metric, t.j, k.n),
r_edges AS (
  SELECT metric, j, 5 * x_lo + CASE WHEN rem = 0 THEN 0 ELSE (x_hi - x_lo) * rem END AS e5
  FROM r_pick),
r_cuts AS (
  SELECT {", ".join(f"max(CASE WHEN metric = '{p}' AND j = {j} THEN e5 END) AS {p}{j}_5"
                    for p in "rm" for j in range(1, 5))}
  FROM r_edges),
rfm_scored AS (
  SELECT b.*,
         CAST(CASE WHEN 5 * b.recency_days <= c.r1_5 THEN 5 WHEN 5 * b.recency_days <= c.r2_5 THEN 4
                   WHEN 5 * b.recency_days <= c.r3_5 THEN 3 WHEN 5 * b.recency_days <= c.r4_5 THEN 2
                   ELSE 1 END AS INTEGER) AS R,
         CAST(CASE WHEN b.frequency <= 1 THEN 1 WHEN b.frequency <= 2 THEN 2
                   WHEN b.frequency <= 3 THEN 3 WHEN b.frequency <= 5 THEN 4 ELSE 5 END AS INTEGER) AS F,
         CAST(CASE WHEN 5 * b.monetary <= c.m1_5 THEN 1 WHEN 5 * b.monetary <= c.m2_5 THEN 2
                   WHEN 5 * b.monetary <= c.m3_5 THEN 3 WHEN 5 * b.monetary <= c.m4_5 THEN 4
                   ELSE 5 END AS INTEGER) AS M
  FROM rfm_base b CROSS JOIN r_cuts c),
rfm AS (
  SELECT *, CAST(R AS VARCHAR) || CAST(F AS VARCHAR) || CAST(M AS VARCHAR) AS RFM_score,
         R + F + M AS RFM_total,
         CASE WHEN R >= 4 AND F >= 4 AND M >= 4 THEN 'Champions'
              WHEN R >= 3 AND F >= 3 AND M >= 3 THEN 'Loyal Customers'
              WHEN R >= 4 AND F <= 1 THEN 'New Customers'
              WHEN R >= 3 AND F <= 2 AND M <= 3 THEN 'Potential Loyalists'
              WHEN R <= 2 AND F >= 4 AND M >= 4 THEN 'Can''t Lose Them'
              WHEN R <= 2 AND F >= 3 AND M >= 3 THEN 'At Risk'
              WHEN R <= 3 AND F <= 2 AND M <= 3 THEN 'Hibernating'
              WHEN R = 1 AND F <= 2 AND M <= 2 THEN 'Lost'
              ELSE 'Hibernating' END AS Segment,
         CAST(recency_days > 180 AS INTEGER) AS is_churned
  FROM rfm_scored)
"""

FEATURES = ["recency_days", "frequency", "monetary", "avg_review_score", "late_pct",
            "avg_delay_days"]
# Must equal the literal model of the Spark side.
FIXED = ([1.5, -0.4, -0.3, -0.2, 0.35, 0.25], 0.1)

_COMPLETE = " AND ".join([f"{f} IS NOT NULL" for f in FEATURES] + ["is_churned IS NOT NULL"])


def _z(f: str) -> str:
    x = f"CAST({f} AS DOUBLE)"
    return (f"CASE WHEN s.std_{f} = 0 THEN {x} - s.mean_{f} "
            f"ELSE ({x} - s.mean_{f}) / s.std_{f} END")


_MARGIN = " + ".join([repr(FIXED[1])] + [f"{w!r} * z_{f}" for w, f in zip(FIXED[0], FEATURES)])

CHURN = f"""
c_cases AS (SELECT * FROM rfm WHERE {_COMPLETE}),
c_stats AS (
  SELECT {", ".join(f"avg(CAST({f} AS DOUBLE)) AS mean_{f}, stddev_pop(CAST({f} AS DOUBLE)) AS std_{f}"
                    for f in FEATURES)}
  FROM c_cases),
c_z AS (
  SELECT r.*, ({_COMPLETE}) AS complete, {", ".join(f"{_z(f)} AS z_{f}" for f in FEATURES)}
  FROM rfm r CROSS JOIN c_stats s),
c_class AS (SELECT is_churned, count(*) AS n FROM c_cases GROUP BY is_churned),
c_dealt AS (
  SELECT is_churned, want, (want * n) // total AS base, (want * n) % total AS rest
  FROM c_class CROSS JOIN (SELECT (sum(n) + 4) // 5 AS want, sum(n) AS total FROM c_class)),
c_sizes AS (
  SELECT is_churned,
         base + CAST(row_number() OVER (ORDER BY rest DESC, is_churned) <= want - sum(base) OVER () AS INTEGER) AS k
  FROM c_dealt),
c_split AS (
  SELECT customer_unique_id, is_churned,
         row_number() OVER (PARTITION BY is_churned ORDER BY md5(CAST(customer_unique_id AS VARCHAR))) <= k AS is_test
  FROM c_cases JOIN c_sizes USING (is_churned)),
c_test AS (
  SELECT CAST(c_z.is_churned AS DOUBLE) AS label,
         1.0 / (1.0 + exp(-({_MARGIN}))) AS p
  FROM c_z JOIN c_split USING (customer_unique_id) WHERE is_test),
per_class AS (
  SELECT CAST(CAST(k AS INTEGER) AS VARCHAR) AS class,
         CAST(count(*) FILTER (WHERE label = k AND (p > 0.5) = (k = 1)) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE (p > 0.5) = (k = 1)) AS DOUBLE) AS pred,
         CAST(count(*) FILTER (WHERE label = k) AS DOUBLE) AS act
  FROM c_test CROSS JOIN (VALUES (0.0), (1.0)) AS v(k) GROUP BY k),
class_metrics AS (
  SELECT class, act, coalesce(tp / nullif(pred, 0), 0.0) AS pr, coalesce(tp / nullif(act, 0), 0.0) AS rc,
         coalesce(2 * coalesce(tp / nullif(pred, 0), 0.0) * coalesce(tp / nullif(act, 0), 0.0)
                  / nullif(coalesce(tp / nullif(pred, 0), 0.0) + coalesce(tp / nullif(act, 0), 0.0), 0), 0.0) AS f1
  FROM per_class),
rfm_fixed AS (
  SELECT * EXCLUDE (complete, {", ".join(f"z_{f}" for f in FEATURES)}),
         CASE WHEN complete THEN 1.0 / (1.0 + exp(-({_MARGIN}))) ELSE 0.5 END AS churn_probability
  FROM c_z)
"""

_LEVELS = [SRC, FACTS, MASTER, RFM, CHURN]


def _with(level: int, body: str) -> str:
    return "WITH " + ",".join(_LEVELS[:level]) + "\n" + body


def _o(body): return _with(2, body)      # order facts
def _m(body): return _with(3, body)      # master and dashboard filters
def _c(body): return _with(4, body)      # customer table
def _x(body): return _with(5, body)      # fixed-model churn scores


_MASTER_COLS = ("order_id, customer_id, order_status, order_purchase_timestamp, "
                "order_delivered_customer_date, order_estimated_delivery_date, customer_unique_id, "
                "customer_state, item_count, " + _r("total_price") + " AS total_price, "
                + _r("total_freight") + " AS total_freight, product_id, seller_id, "
                + _r("payment_value") + " AS payment_value, payment_type, "
                + _r("payment_installments") + " AS payment_installments, review_score, category, "
                "seller_state, delay_days, is_late, is_early, delivery_days_actual")

_RFM_BASE_COLS = ("customer_unique_id, last_order_date, frequency, " + _r("monetary") + " AS monetary, "
                  + _r("avg_review_score") + " AS avg_review_score, " + _r("late_pct") + " AS late_pct, "
                  + _r("avg_delay_days") + " AS avg_delay_days, customer_state, payment_type, recency_days")


def _segment_churn(src: str) -> str:
    return f"""SELECT Segment, {_r("avg(CAST(is_churned AS DOUBLE)) * 100.0")} AS churn_rate,
       {_r("avg(late_pct)")} AS late_pct, {_r("avg(churn_probability)")} AS avg_churn_prob,
       count(customer_unique_id) AS customers
FROM {src} GROUP BY Segment"""


# Display order of the segments.
_DISPLAY = ("list_position(['Champions', 'Loyal Customers', 'New Customers', 'Potential Loyalists', 'At Risk', 'Can''t Lose Them', 'Hibernating', 'Lost'], "
            "Segment)")

_CENTROIDS = " UNION ALL ".join(
    f"""SELECT '{f.replace("_", " ").title()}' AS Feature, {_r(f"avg(z_{f}) FILTER (WHERE is_churned = 1) - avg(z_{f}) FILTER (WHERE is_churned = 0)")} AS Coefficient,
       CASE WHEN avg(z_{f}) FILTER (WHERE is_churned = 1) > avg(z_{f}) FILTER (WHERE is_churned = 0)
            THEN 'Increases churn risk' ELSE 'Reduces churn risk' END AS Impact
FROM c_z WHERE complete""" for f in FEATURES)


def _high_risk_raw(src: str) -> str:
    return f"""SELECT customer_unique_id, Segment, recency_days, frequency,
       CAST(monetary AS DOUBLE) AS monetary, avg_review_score, late_pct, churn_probability,
       CAST(row_number() OVER (ORDER BY churn_probability DESC, customer_unique_id) AS INTEGER) AS rank
FROM (SELECT * FROM {src} WHERE churn_probability > 0.7
      ORDER BY churn_probability DESC, customer_unique_id LIMIT 50)"""


def _high_risk(src: str) -> str:
    return f"""SELECT customer_unique_id, Segment, recency_days, frequency, {_r("monetary")} AS monetary,
       {_r("avg_review_score")} AS avg_review_score, {_r("late_pct")} AS late_pct,
       {_r("churn_probability")} AS churn_probability, rank
FROM ({_high_risk_raw(src)})"""


def _fmt_num(x: str, decimals: int) -> str:
    return f"format('{{:,.{decimals}f}}', CAST({x} AS DOUBLE))"


_STATE_SUMMARY = f"""
SELECT customer_state AS State, count(order_id) AS orders,
       {_r("coalesce(sum(payment_value), 0)")} AS revenue,
       {_r("CAST(sum(payment_value) AS DOUBLE) / count(payment_value)")} AS avg_revenue,
       {_r("avg(review_score)")} AS avg_review,
       {_r("avg(CAST(NOT coalesce(is_late, false) AS DOUBLE)) * 100.0")} AS on_time_rate,
       {_r("avg(delay_days)")} AS avg_delay
FROM delivered WHERE customer_state IS NOT NULL GROUP BY customer_state"""

_RFM_STATE = f"""
SELECT customer_state AS State, {_r("avg(RFM_total)")} AS avg_rfm,
       count(customer_unique_id) AS customers, {_r("avg(churn_probability)")} AS avg_churn
FROM rfm_fixed WHERE customer_state IS NOT NULL GROUP BY customer_state"""

_STATE_TABLE = f"""
SELECT s.*, r.avg_rfm, r.customers, r.avg_churn
FROM ({_STATE_SUMMARY}) s LEFT JOIN ({_RFM_STATE}) r ON s.State = r.State"""


SQL: dict[str, str] = {
    "items_by_order": _o(f"""
SELECT i.order_id, i.item_count, {_r("i.total_price")} AS total_price,
       {_r("i.total_freight")} AS total_freight, f.product_id, f.seller_id
FROM f_items i JOIN f_first_item f ON i.order_id = f.order_id"""),

    "payments_by_order": _o(f"""
SELECT p.order_id, {_r("p.payment_value")} AS payment_value,
       coalesce(m.payment_type, 'unknown') AS payment_type,
       {_r("p.payment_installments")} AS payment_installments
FROM f_pay p LEFT JOIN f_pay_mode m ON p.order_id = m.order_id"""),

    "latest_review_by_order": _o("""
SELECT o.order_id, r.review_score
FROM (SELECT DISTINCT order_id FROM s_reviews) o LEFT JOIN f_review r ON o.order_id = r.order_id"""),

    "product_category": _o("SELECT product_id, product_category_name, product_category_name_english, category FROM f_product"),

    "order_master": _m(f"SELECT {_MASTER_COLS} FROM master"),

    "csv_roundtrip_master": _m(f"""
SELECT order_id, order_status, delay_days, is_late, item_count, {_r("total_price")} AS total_price,
       CASE WHEN order_id % 20 < 2 AND payment_value IS NOT NULL THEN 0 ELSE {_r("payment_value")} END AS payment_value,
       CASE WHEN order_id % 20 < 3 AND payment_type IS NOT NULL THEN 'unknown' ELSE payment_type END AS payment_type,
       review_score, CASE WHEN customer_id % 20 >= 4 THEN customer_state END AS customer_state,
       CASE WHEN customer_unique_id IS NOT NULL THEN CAST(38 AS INTEGER) END AS note_length
FROM master"""),

    "delivery_metrics": _m("SELECT order_id, order_status, delay_days, is_late, is_early, delivery_days_actual FROM master"),

    "floor_days_events": f"""
SELECT e.event_id, {_days("x.first_ts", "e.ts")} AS days_since_first,
       {_days("x.last_ts", "e.ts")} AS days_from_last
FROM events e CROSS JOIN (SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events) x""",

    "timestamp_coerce": """
SELECT event_id, raw, try_strptime(raw, '%Y-%m-%d %H:%M:%S') AS parsed FROM (
  SELECT event_id,
         CASE WHEN event_type = 'error' THEN 'bad-' || CAST(event_id AS VARCHAR)
              WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d')
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw
  FROM events)""",

    "order_month_year": _m("SELECT order_id, order_month, order_year FROM master"),

    "delivery_log": _m(f"""
SELECT {_r("avg(CAST(NOT is_late AS DOUBLE)) * 100.0")} AS on_time_pct,
       {_r("avg(CASE WHEN is_late THEN delay_days END)")} AS avg_late_delay,
       count(*) AS delivered_orders
FROM master WHERE {_DLV}"""),

    "snapshot_date": _m(f"SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY AS snapshot_date FROM master WHERE {_DLV}"),

    "rfm_base": _c(f"SELECT {_RFM_BASE_COLS} FROM rfm_base"),

    "rfm_cutpoints": _c(f"""
SELECT (SELECT CAST(min(recency_days) AS DOUBLE) FROM rfm_base) AS r0,
       {", ".join(f"{_r(f'CAST(r{j}_5 AS DOUBLE) / 5')} AS r{j}" for j in range(1, 5))},
       (SELECT CAST(max(recency_days) AS DOUBLE) FROM rfm_base) AS r5,
       (SELECT {_r("min(monetary)")} FROM rfm_base) AS m0,
       {", ".join(f"{_r(f'CAST(m{j}_5 AS DOUBLE) / 5')} AS m{j}" for j in range(1, 5))},
       (SELECT {_r("max(monetary)")} FROM rfm_base) AS m5,
       (SELECT max(frequency) FROM rfm_base) AS max_frequency
FROM r_cuts"""),

    "recency_quantiles_sketch": _c(f"""
SELECT (SELECT CAST(min(recency_days) AS DOUBLE) FROM rfm_base) AS r0,
       {", ".join(f"{_r(f'CAST(r{j}_5 AS DOUBLE) / 5')} AS r{j}" for j in range(1, 5))},
       (SELECT CAST(max(recency_days) AS DOUBLE) FROM rfm_base) AS r5
FROM r_cuts"""),

    "monetary_quantiles_sketch": _c(f"""
SELECT (SELECT {_r("min(monetary)")} FROM rfm_base) AS m0,
       {", ".join(f"{_r(f'CAST(m{j}_5 AS DOUBLE) / 5')} AS m{j}" for j in range(1, 5))},
       (SELECT {_r("max(monetary)")} FROM rfm_base) AS m5
FROM r_cuts"""),

    "rfm_scored": _c(f"SELECT {_RFM_BASE_COLS}, R, F, M, RFM_score, RFM_total, Segment FROM rfm"),

    "segment_distribution": _c("""
SELECT Segment, count(*) AS Count, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       row_number() OVER (ORDER BY count(*) DESC, Segment) AS position
FROM rfm GROUP BY Segment"""),

    "filter_options": _m("""
SELECT DISTINCT kind, value FROM (
  SELECT 'state' AS kind, customer_state AS value FROM master
  UNION ALL SELECT 'month', order_month FROM master
  UNION ALL SELECT 'status', order_status FROM master) WHERE value IS NOT NULL"""),

    "filtered_orders": _m(f"""
SELECT order_id, customer_state, order_status, order_month, {_r("payment_value")} AS payment_value
FROM master
WHERE customer_state = 'NATION_7' AND order_status IN ('delivered', 'shipped')
  AND order_month BETWEEN '1996-01' AND '1998-12'"""),

    "sidebar_totals": _m("SELECT count(DISTINCT customer_unique_id) AS customers, count(DISTINCT order_id) AS orders FROM master"),

    "overview_kpis": _m(f"""
SELECT count(DISTINCT customer_unique_id) AS total_customers, count(DISTINCT order_id) AS total_orders,
       {_r(f"coalesce(sum(CASE WHEN {_DLV} THEN payment_value END), 0)")} AS total_revenue,
       {_r(f"CAST(sum(CASE WHEN {_DLV} THEN payment_value END) AS DOUBLE) / count(CASE WHEN {_DLV} THEN payment_value END)")} AS avg_order_value,
       {_r(f"avg(CASE WHEN {_DLV} THEN review_score END)")} AS avg_review,
       {_r(f"avg(CASE WHEN {_DLV} THEN CAST(NOT coalesce(is_late, false) AS DOUBLE) END) * 100.0")} AS on_time_rate,
       avg(CASE WHEN {_DLV} THEN review_score END) >= 4.0 AS review_ok,
       avg(CASE WHEN {_DLV} THEN CAST(NOT coalesce(is_late, false) AS DOUBLE) END) * 100.0 >= 90.0 AS on_time_ok
FROM mdf"""),

    "monthly_trend": _m(f"""
SELECT order_month, count(DISTINCT order_id) AS Orders, {_r("coalesce(sum(payment_value), 0)")} AS Revenue
FROM mdf GROUP BY order_month"""),

    "payment_mix": _m(f"""
SELECT {_title("replace(payment_type, '_', ' ')")} AS Type, count(*) AS Count,
       round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM mdf WHERE payment_type IS NOT NULL GROUP BY payment_type"""),

    "top_states_revenue": _m(f"""
SELECT customer_state AS State, {_r("coalesce(sum(payment_value), 0)")} AS Revenue
FROM delivered WHERE customer_state IS NOT NULL GROUP BY customer_state
ORDER BY coalesce(sum(payment_value), 0) DESC, State LIMIT 10"""),

    "segment_treemap": _c(f"""
SELECT Segment, count(customer_unique_id) AS Customers,
       {_r("CAST(sum(monetary) AS DOUBLE) / count(monetary)")} AS Avg_Revenue,
       {_r("avg(recency_days)")} AS Avg_Recency, {_r("avg(frequency)")} AS Avg_Freq,
       {_r("avg(avg_review_score)")} AS Avg_Review,
       {_r("avg(CAST(is_churned AS DOUBLE)) * 100.0")} AS Churn_pct
FROM rfm GROUP BY Segment"""),

    "segment_revenue_median": _c(f"""
SELECT {_r("quantile_cont(avg_revenue, 0.5)")} AS median_avg_revenue FROM (
  SELECT CAST(sum(monetary) AS DOUBLE) / count(monetary) AS avg_revenue FROM rfm GROUP BY Segment)"""),

    "customer_map_sample": _c(f"""
SELECT customer_unique_id, recency_days, {_r("monetary")} AS monetary, frequency, Segment
FROM rfm ORDER BY md5(CAST(customer_unique_id AS VARCHAR)) LIMIT 3000"""),

    "customer_map_sample_300": _c(f"""
SELECT customer_unique_id, recency_days, {_r("monetary")} AS monetary, frequency, Segment
FROM rfm ORDER BY md5(CAST(customer_unique_id AS VARCHAR)) LIMIT 300"""),

    "segment_profile": _c(f"""
SELECT Segment, count(customer_unique_id) AS Customers, {_r("avg(recency_days)")} AS Avg_Recency,
       {_r("avg(frequency)")} AS Avg_Frequency,
       {_r("CAST(sum(monetary) AS DOUBLE) / count(monetary)")} AS Avg_Revenue,
       {_r("avg(avg_review_score)")} AS Avg_Review, {_r("avg(late_pct)")} AS Late_Pct
FROM rfm GROUP BY Segment"""),

    "segment_profile_fmt": _c(f"""
SELECT Segment, {_fmt_num("count(customer_unique_id)", 0)} AS "Customers",
       CAST(round_even(avg(recency_days), 0) AS INTEGER) AS "Avg Recency (days)",
       {_r("round_even(avg(frequency), 2)")} AS "Avg Orders",
       'R$' || {_fmt_num("CAST(sum(monetary) AS DOUBLE) / count(monetary)", 2)} AS "Avg Revenue",
       {_r("round_even(avg(avg_review_score), 2)")} AS "Avg Review",
       CAST(CAST(round_even(avg(late_pct), 1) AS DOUBLE) AS VARCHAR) || '%' AS "Late Delivery %"
FROM rfm GROUP BY Segment"""),

    "rfm_total_hist": _c("""
SELECT RFM_total, count(*) AS customers, row_number() OVER (ORDER BY RFM_total) AS position
FROM rfm GROUP BY RFM_total"""),

    "rfm_total_median": _c(f"SELECT {_r('quantile_cont(RFM_total, 0.5)')} AS median_rfm_total FROM rfm"),

    "delivery_kpis": _m(f"""
SELECT {_r("avg(CAST(NOT is_late AS DOUBLE)) * 100.0")} AS on_time_pct,
       {_r("avg(CASE WHEN is_late THEN delay_days END)")} AS avg_delay,
       {_r("avg(CASE WHEN is_early THEN abs(delay_days) END)")} AS avg_early,
       count(*) AS delivered_orders,
       avg(CAST(NOT is_late AS DOUBLE)) * 100.0 >= 90.0 AS on_time_ok
FROM d"""),

    "delay_histogram": _m("""
SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w - 1 AS bin_end, Status, count(*) AS count
FROM (
  SELECT (d.delay_days - g.lo) // g.w AS bin, g.lo, g.w,
         CASE WHEN d.is_late THEN 'Late' ELSE 'On Time / Early' END AS Status
  FROM d CROSS JOIN (SELECT lo, CAST(ceil((hi - lo + 1) / 60.0) AS BIGINT) AS w
                     FROM (SELECT min(delay_days) AS lo, max(delay_days) AS hi FROM d)) g)
GROUP BY bin, lo, w, Status"""),

    "monthly_on_time": _m(f"""
SELECT order_month, {_r("avg(CAST(NOT is_late AS DOUBLE)) * 100.0")} AS on_time_rate
FROM d GROUP BY order_month"""),

    "worst_states": _m(f"""
SELECT customer_state, on_time_rate, orders FROM (
  SELECT customer_state, {_r("avg(CAST(NOT is_late AS DOUBLE)) * 100.0")} AS on_time_rate,
         avg(CAST(NOT is_late AS DOUBLE)) AS raw_rate, count(DISTINCT order_id) AS orders
  FROM d WHERE customer_state IS NOT NULL GROUP BY customer_state)
WHERE orders >= 180 ORDER BY raw_rate, customer_state LIMIT 15"""),

    "worst_categories": _m(f"""
SELECT category, avg_delay, late_orders FROM (
  SELECT category, {_r("avg(delay_days)")} AS avg_delay, avg(delay_days) AS raw_delay,
         count(DISTINCT order_id) AS late_orders
  FROM d WHERE is_late AND category IS NOT NULL GROUP BY category)
WHERE late_orders >= 10 ORDER BY raw_delay DESC, category LIMIT 15"""),

    "worst_categories_top3": _m(f"""
SELECT category, avg_delay, late_orders, row_number() OVER (ORDER BY raw_delay DESC, category) AS position
FROM (
  SELECT category, {_r("avg(delay_days)")} AS avg_delay, avg(delay_days) AS raw_delay,
         count(DISTINCT order_id) AS late_orders
  FROM d WHERE is_late AND category IS NOT NULL GROUP BY category)
WHERE late_orders >= 10 ORDER BY raw_delay DESC, category LIMIT 3"""),

    "churn_label": _c("SELECT customer_unique_id, recency_days, is_churned FROM rfm"),

    "churn_base_rate": _c(f"SELECT {_r('avg(CAST(is_churned AS DOUBLE)) * 100.0')} AS churn_rate FROM rfm"),

    "churn_features": _x(f"""
SELECT customer_unique_id, {", ".join(f"{_r(f'z_{f}')} AS z_{f}" for f in FEATURES)}, is_churned
FROM c_z WHERE complete"""),

    "churn_split": _x(f"""
SELECT customer_unique_id, is_test FROM c_split"""),

    "churn_split_sizes": _x("SELECT is_churned, is_test, count(*) AS rows FROM c_split GROUP BY ALL"),

    "churn_class_weights": _x(f"""
SELECT is_churned, count(*) AS rows,
       {_r("sum(count(*)) OVER () / (2.0 * count(*))")} AS weight
FROM c_split WHERE NOT is_test
GROUP BY is_churned"""),

    "churn_kpis_fixed": _x(f"""
SELECT {_r("avg(CAST(is_churned AS DOUBLE)) * 100.0")} AS churn_rate,
       count(*) FILTER (WHERE churn_probability > 0.7) AS high_risk_customers,
       count(*) FILTER (WHERE Segment = 'Champions') AS champions,
       avg(CAST(is_churned AS DOUBLE)) * 100.0 < 50.0 AS churn_ok
FROM rfm_fixed"""),

    "segment_churn_fixed": _x(_segment_churn("rfm_fixed")),
    "segment_churn_by_prob_fixed": _x(f"""
SELECT *, row_number() OVER (ORDER BY avg_churn_prob, Segment) AS position
FROM ({_segment_churn("rfm_fixed")})"""),

    "churn_scores_fixed": _x(f"""
SELECT customer_unique_id, Segment, is_churned, {_r("churn_probability")} AS churn_probability
FROM rfm_fixed"""),

    "churn_coefficients_centroid": _x(f"""
SELECT *, row_number() OVER (ORDER BY abs(Coefficient)) AS position FROM ({_CENTROIDS})"""),

    "coefficients_by_value_centroid": _x(f"""
SELECT *, row_number() OVER (ORDER BY Coefficient, Feature) AS position FROM ({_CENTROIDS})"""),

    "churn_fit_optimality": f"""
SELECT unnest([{", ".join(f"'{f}'" for f in ["intercept", *FEATURES])}]) AS parameter, 0.0::DOUBLE AS gradient""",

    "churn_box_fixed": _x(f"""
SELECT Segment, row_number() OVER (ORDER BY {_DISPLAY}) AS position,
       {_r("min(churn_probability)")} AS p_min,
       {_r("quantile_cont(churn_probability, 0.25)")} AS p_q1,
       {_r("quantile_cont(churn_probability, 0.5)")} AS p_median,
       {_r("quantile_cont(churn_probability, 0.75)")} AS p_q3,
       {_r("max(churn_probability)")} AS p_max
FROM rfm_fixed GROUP BY Segment"""),

    "high_risk_fixed": _x(_high_risk("rfm_fixed")),

    "high_risk_fmt_fixed": _x(f"""
SELECT rank, customer_unique_id AS "Customer ID", Segment, recency_days AS "Recency (days)",
       frequency AS "Orders", 'R$' || {_fmt_num("monetary", 2)} AS "Total Spend",
       {_r("round_even(avg_review_score, 2)")} AS "Avg Review",
       {_fmt_num("late_pct", 1)} || '%' AS "Late Delivery %",
       {_fmt_num("churn_probability * 100.0", 0)} || '%' AS "P(Churn)"
FROM ({_high_risk_raw("rfm_fixed")})"""),

    "state_summary": _m(_STATE_SUMMARY),

    "rfm_by_state": _x(_RFM_STATE),

    "state_table": _x(_STATE_TABLE),

    "top_20_states": _x(f"SELECT * FROM ({_STATE_TABLE}) ORDER BY revenue DESC, State LIMIT 20"),

    "states_by_on_time": _x(f"""
SELECT *, row_number() OVER (ORDER BY on_time_rate, State) AS position FROM ({_STATE_TABLE})"""),

    "state_table_fmt": _x(f"""
SELECT State, orders AS "Orders", 'R$' || {_fmt_num("revenue", 0)} AS "Total Revenue",
       'R$' || {_fmt_num("avg_revenue", 2)} AS "Avg Order Value",
       {_r("round_even(avg_review, 2)")} AS "Avg Review",
       {_fmt_num("on_time_rate", 1)} || '%' AS "On-Time Rate",
       {_r("round_even(avg_delay, 1)")} AS "Avg Delay (days)",
       {_r("round_even(avg_rfm, 2)")} AS "Avg RFM Score", customers AS "Customers",
       {_fmt_num("avg_churn * 100.0", 0)} || '%' AS "Avg Churn Risk"
FROM (
  SELECT s.State, s.orders, s.revenue, s.avg_revenue, s.avg_review, s.on_time_rate, s.avg_delay,
         r.avg_rfm, r.customers, r.avg_churn
  FROM (
    SELECT customer_state AS State, count(order_id) AS orders,
           CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS revenue,
           CAST(sum(payment_value) AS DOUBLE) / count(payment_value) AS avg_revenue,
           avg(review_score) AS avg_review,
           avg(CAST(NOT coalesce(is_late, false) AS DOUBLE)) * 100.0 AS on_time_rate,
           avg(delay_days) AS avg_delay
    FROM delivered WHERE customer_state IS NOT NULL GROUP BY customer_state) s
  LEFT JOIN (
    SELECT customer_state AS State, avg(RFM_total) AS avg_rfm, count(customer_unique_id) AS customers,
           avg(churn_probability) AS avg_churn
    FROM rfm_fixed WHERE customer_state IS NOT NULL GROUP BY customer_state) r
  ON s.State = r.State) st"""),

    "peak_month": _m("""
SELECT order_month, count(*) AS orders FROM mdf GROUP BY order_month
ORDER BY orders DESC, order_month LIMIT 1"""),

    "top_state_revenue_share": _m(f"""
SELECT State, {_r("revenue")} AS revenue, {_r("CAST(revenue AS DOUBLE) / CAST(total AS DOUBLE) * 100.0")} AS revenue_share_pct
FROM (SELECT customer_state AS State, coalesce(sum(payment_value), 0) AS revenue,
             sum(coalesce(sum(payment_value), 0)) OVER () AS total
      FROM delivered WHERE customer_state IS NOT NULL GROUP BY customer_state)
ORDER BY revenue DESC, State LIMIT 1"""),

    "dormant_share": _c(f"""
SELECT count(*) FILTER (WHERE Segment IN ('Lost', 'Hibernating')) AS dormant_customers,
       count(*) AS customers,
       {_r("avg(CAST(Segment IN ('Lost', 'Hibernating') AS DOUBLE)) * 100.0")} AS dormant_pct
FROM rfm"""),

    "delay_vs_review": _m(f"""
SELECT CASE WHEN is_late THEN 'Late' ELSE 'On Time / Early' END AS Status, count(order_id) AS orders,
       {_r("avg(review_score)")} AS avg_review, {_r("avg(delay_days)")} AS avg_delay,
       {_r("(SELECT corr(CAST(delay_days AS DOUBLE), CAST(review_score AS DOUBLE)) FROM d)")} AS delay_review_corr
FROM d GROUP BY 1"""),

    "churn_by_segment_and_late": _c(f"""
SELECT Segment, coalesce(late_pct > 0, false) AS had_late_delivery, count(customer_unique_id) AS customers,
       {_r("avg(CAST(is_churned AS DOUBLE)) * 100.0")} AS churn_rate,
       {_r("avg(CAST(NOT (is_churned = 1) AS DOUBLE)) * 100.0")} AS retained_pct
FROM rfm GROUP BY 1, 2"""),

    "churn_report_fixed": _x(f"""
SELECT class, {_r("precision")} AS precision, {_r("recall")} AS recall,
       {_r("f1_score")} AS f1_score, CAST(support AS BIGINT) AS support
FROM (
  SELECT k.class,
         CASE WHEN k.class IN ('0', '1') THEN coalesce(tp / nullif(pred, 0), 0.0) END AS precision,
         CASE WHEN k.class IN ('0', '1') THEN coalesce(tp / nullif(act, 0), 0.0) END AS recall,
         CASE WHEN k.class IN ('0', '1') THEN
              coalesce(2 * (tp / nullif(pred, 0)) * (tp / nullif(act, 0))
                       / nullif(coalesce(tp / nullif(pred, 0), 0.0) + coalesce(tp / nullif(act, 0), 0.0), 0), 0.0)
              WHEN k.class = 'accuracy' THEN (SELECT sum(tp) / sum(act) FROM per_class)
              ELSE f1 END AS f1_score,
         CASE WHEN k.class IN ('0', '1') THEN act ELSE (SELECT sum(act) FROM per_class) END AS support
  FROM (SELECT class, tp, pred, act, NULL AS f1 FROM per_class
        UNION ALL SELECT 'accuracy', NULL, NULL, NULL, NULL
        UNION ALL SELECT 'macro avg', NULL, NULL, NULL, NULL
        UNION ALL SELECT 'weighted avg', NULL, NULL, NULL, NULL) k)
WHERE class IN ('0', '1', 'accuracy')
UNION ALL
SELECT avg_kind AS class, {_r("precision")}, {_r("recall")}, {_r("f1_score")},
       CAST(support AS BIGINT) FROM (
  SELECT 'macro avg' AS avg_kind, avg(pr) AS precision, avg(rc) AS recall, avg(f1) AS f1_score,
         sum(act) AS support FROM class_metrics
  UNION ALL
  SELECT 'weighted avg', coalesce(sum(pr * act) / nullif(sum(act), 0), 0.0),
         coalesce(sum(rc * act) / nullif(sum(act), 0), 0.0),
         coalesce(sum(f1 * act) / nullif(sum(act), 0), 0.0), sum(act) FROM class_metrics)"""),

    "churn_auc_fixed": _x(f"""
SELECT {_r("(sum(CASE WHEN label = 1 THEN avg_rank END) - npos * (npos + 1) / 2.0) / (npos * (n - npos))")} AS auc,
       n AS test_rows, npos AS positives
FROM (
  SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS avg_rank,
         count(*) OVER () AS n, count(*) FILTER (WHERE label = 1) OVER () AS npos
  FROM c_test)
GROUP BY n, npos"""),
}

# The cube gives the same rows as the order master.
for _name in ("sidebar_totals", "overview_kpis", "monthly_trend", "payment_mix", "top_states_revenue", "delivery_kpis",
              "monthly_on_time", "worst_states", "worst_categories", "state_summary", "peak_month",
              "top_state_revenue_share"):
    SQL[f"{_name}_cube"] = SQL[_name]

_DEFAULT = "order_status IN ('delivered') AND order_month IS NOT NULL"


def _chosen(name: str, where: str) -> str:
    """A dataset under another choice of orders."""
    return SQL[name].replace(f"SELECT * FROM master WHERE {_DEFAULT}", f"SELECT * FROM master WHERE {where}")


SQL["overview_kpis_filtered"] = SQL["overview_kpis_filtered_cube"] = _chosen(
    "overview_kpis", "customer_state = 'NATION_7' AND order_status IN ('delivered', 'shipped') "
                     "AND order_month BETWEEN '1996-01' AND '1998-12'")
# A dataset has no row when its selection has none.
SQL["overview_kpis_no_orders"] = (
    _chosen("overview_kpis", f"customer_state = 'NOWHERE' AND {_DEFAULT}") + "\nHAVING count(*) > 0")
SQL["segment_profile_no_orders"] = (
    f"SELECT * FROM ({SQL['segment_profile']}) WHERE (SELECT count(*) FROM orders WHERE o_orderstatus = 'NOWHERE') > 0")
SQL["delivery_kpis_no_delay"] = (
    _chosen("delivery_kpis", "order_status IN ('shipped') AND order_month IS NOT NULL") + "\nHAVING count(*) > 0")
SQL["overview_kpis_no_delay"] = "SELECT total_customers, total_orders, total_revenue FROM (" + _chosen(
    "overview_kpis", "order_status IN ('shipped') AND order_month IS NOT NULL") + ")"
