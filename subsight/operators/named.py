"""Views and functions by name (V1, V2, U1, U2), for use from SQL.

``register`` makes the tables, the two views and the two functions known to a session:

    register(spark, tables)
    spark.sql("SELECT plan_name, count(*) FROM vw_active_subscriptions GROUP BY plan_name")
    spark.sql("SELECT calculate_revenue(TIMESTAMP_NTZ '2000-01-01', TIMESTAMP_NTZ '2000-12-31')")
    spark.sql("SELECT subscription_id, is_subscription_active(subscription_id, TIMESTAMP_NTZ '2001-08-15') FROM subscriptions")

All are temporary: views are the DataFrame operators' plans, and functions are SQL bodies that the
optimizer inlines, so filters and column pruning reach the scans, and ``is_subscription_active`` of a
column becomes a join with one aggregate instead of a query per row.

Spark takes a function's arguments for columns, so the date range of ``calculate_revenue`` is joined
(with one row for each distinct pair of arguments) rather than pushed down. Where the range is
known, ``spark.sql(REVENUE, {"date_from": ..., "date_to": ...})`` is the same statement with
parameters, and its range reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import views as V

TABLES = ("plans", "users", "subscriptions", "payments")

# the end of the range is a whole day, as in functions.dates.in_range
_SUM = """SELECT CAST(coalesce(sum(p.amount), 0) AS DECIMAL(18,2)) AS revenue FROM payments p
WHERE p.status = 'Completed' AND p.payment_date >= {0} AND p.payment_date < {1} + INTERVAL 1 DAY"""
REVENUE = _SUM.format("CAST(:date_from AS TIMESTAMP_NTZ)", "CAST(:date_to AS TIMESTAMP_NTZ)")
_REVENUE = """
CREATE OR REPLACE TEMPORARY FUNCTION calculate_revenue(date_from TIMESTAMP_NTZ, date_to TIMESTAMP_NTZ)
RETURNS DECIMAL(18,2)
RETURN """ + _SUM.format("date_from", "date_to")

# the time is compared outside the subquery, whose only link to the row is then an equality
_ACTIVE = """
CREATE OR REPLACE TEMPORARY FUNCTION is_subscription_active(id BIGINT, as_of TIMESTAMP_NTZ)
RETURNS BOOLEAN
RETURN coalesce((SELECT max(s.end_date) FROM subscriptions s WHERE s.subscription_id = id AND s.status = 'Active') > as_of, false)"""


def register(spark: SparkSession, t) -> None:
    """Register the tables ``plans users subscriptions payments``, the views
    ``vw_active_subscriptions`` and ``vw_user_payment_history`` and the
    functions above for this session; a second call replaces them."""
    for name in TABLES:
        getattr(t, name).createOrReplaceTempView(name)
    V.active_subscriptions(t.subscriptions, t.users, t.plans).createOrReplaceTempView("vw_active_subscriptions")
    V.user_payment_history(t.users, t.subscriptions, t.payments, t.plans).createOrReplaceTempView("vw_user_payment_history")
    spark.sql(_REVENUE)
    spark.sql(_ACTIVE)
