"""DuckDB counterpart of the retail view, joined plainly row by row.

The checks deliberately do *not* use the per-order arithmetic of the library:
``m`` is the real many-to-many join, so agreement also proves that arithmetic.
"""

from __future__ import annotations

PRELUDE = """
WITH
o AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'canceled' END AS order_status,
    o_orderdate AS day, ts, approved, approved + to_days(CAST((o_orderkey*13)%10 AS INTEGER)) AS carrier,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 <> 0
      THEN ts + to_days(CAST((o_orderkey*17)%60 AS INTEGER)) + to_hours(CAST((o_orderkey*11)%24 AS INTEGER)) END AS delivered,
    o_orderdate + to_days(40) + to_hours(12) AS estimated
  FROM (SELECT *, ts + to_hours(CAST(o_orderkey%3 AS INTEGER)) AS approved
        FROM (SELECT *, o_orderdate + to_hours(CAST((o_orderkey*7)%24 AS INTEGER)) AS ts FROM orders))
),
of AS (
  SELECT *, floor((epoch(delivered) - epoch(ts)) / 86400)::bigint AS delivery_time,
    floor((epoch(estimated) - epoch(ts)) / 86400)::bigint AS estimated_delivery_time,
    floor((epoch(delivered) - epoch(estimated)) / 86400)::bigint AS delivery_delay,
    coalesce(floor((epoch(delivered) - epoch(estimated)) / 86400) <= 0, false) AS on_time,
    floor((epoch(carrier) - epoch(approved)) / 86400)::bigint AS processing_time,
    floor((epoch(carrier) - epoch(ts)) / 86400)::bigint AS fulfilment_time,
    strftime(ts, '%Y-%m') AS order_month,
    strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + to_days(6), '%Y-%m-%d') AS order_week,
    strftime(ts, '%Y-%m-%d') AS order_date,
    hour(ts)::bigint AS order_hour, (isodow(ts) - 1)::bigint AS order_dayofweek,
    year(ts)::bigint AS order_year, quarter(ts)::bigint AS order_quarter
  FROM o
),
i AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
    c / 100.0::double AS price, ((c * t + 50) // 100) / 100.0::double AS freight_value
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem)
),
p AS (
  SELECT o_orderkey AS order_id, 1 AS seq, o_orderpriority AS payment_type,
    CASE WHEN o_orderkey % 5 = 0 THEN (c * 6) // 10 ELSE c END / 100.0::double AS payment_value
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
  UNION ALL
  SELECT o_orderkey, 2, 'voucher', (c - (c * 6) // 10) / 100.0::double
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) WHERE o_orderkey % 5 = 0
),
r AS (
  SELECT o_orderkey AS order_id, (1 + (o_orderkey * 31 + n) % 5)::bigint AS review_score,
    o_orderdate + to_days(CAST(45 + n AS INTEGER)) AS created
  FROM orders, (VALUES (0), (1)) AS v(n)
  WHERE o_orderkey % 10 < 9 AND (n = 0 OR o_orderkey % 50 = 0)
),
pe AS (
  SELECT p_partkey AS product_id, p_brand AS product_category_name,
    CASE WHEN p_brand <> 'Brand#7' THEN 'cat_' || p_brand END AS category
  FROM part
),
s AS (SELECT s_suppkey AS seller_id, n_name AS seller_state FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, n_name AS customer_state
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
pop AS (SELECT n_name AS state, ((n_nationkey + 1) * 500000)::bigint AS population FROM nation WHERE n_name <> 'NATION_24'),
oc AS (SELECT of.*, customer_unique_id, customer_state FROM of LEFT JOIN c USING (customer_id)),
m AS (
  SELECT oc.*, i.product_id, i.seller_id, i.price, i.freight_value, pe.product_category_name, pe.category,
    s.seller_state, p.payment_type, p.payment_value, r.review_score
  FROM oc LEFT JOIN i USING (order_id) LEFT JOIN pe USING (product_id) LEFT JOIN s USING (seller_id)
    LEFT JOIN p USING (order_id) LEFT JOIN r USING (order_id)
),
p1 AS (SELECT order_id, min_by(payment_value, seq) AS first_payment FROM p GROUP BY 1),
r1 AS (SELECT order_id, min_by(review_score, created) AS first_score FROM r GROUP BY 1)
"""


def oracle(body: str, *ctes: str) -> str:
    """A complete statement: the shared views, further ``name AS (...)`` views, the query."""
    return PRELUDE + "".join(f",\n{c}" for c in ctes) + "\n" + body


def r4(x: str) -> str:
    """Round to four places by the same double arithmetic as the Spark side."""
    return f"(round_even(({x})::double * 10000 + 0.001, 0) / 10000)"


def money(x: str, where: str | None = None) -> str:
    """Aggregate: a sum of amounts of cents, exact and so free of the order of addition."""
    only = f" FILTER (WHERE {where})" if where else ""
    return f"(coalesce(sum(({x})::decimal(28,6)){only}, 0)::double)"


def mean(x: str) -> str:
    """Aggregate: mean of whole numbers."""
    return f"(sum({x})::double / count({x}))"


def pct(a: str, b: str) -> str:
    """Percentage that is 0 when the base is 0."""
    return f"(CASE WHEN ({b}) > 0 THEN ({a})::double / ({b}) * 100 ELSE 0.0 END)"


def n_orders(where: str | None = None) -> str:
    """Aggregate: distinct orders as bigint."""
    return "count(DISTINCT order_id)" + (f" FILTER (WHERE {where})" if where else "")


def quantile(values: str, n: str, q: float) -> str:
    """Linear-interpolated quantile of a sorted list column."""
    h = f"(({n} - 1) * {q!r}::double)"
    lo, hi = f"{values}[floor({h})::bigint + 1]", f"{values}[ceil({h})::bigint + 1]"
    return f"({lo} + ({hi} - {lo}) * ({h} - floor({h})))"
