"""Registered scalar-function queries (X1-X23), exports (S4-S6) and C17."""

from pyspark.sql import functions as F

from ..functions import hmac as H
from ..functions import json as J
from ..functions import money as M
from ..functions import text as X
from ..functions.dates import add_days, lit_ts, remaining_days, renewal_end
from ..operators import listing as L
from ..operators import reports as R
from ..operators import webhooks as W
from .registry import AS_OF, HMAC_TEST_KEY, REPORT_FROM, REPORT_TO, query

_ASOF = f"TIMESTAMP '{AS_OF}'"
_REM = f"LEAST(GREATEST(date_diff('day', CAST({_ASOF} AS DATE), CAST(s.end_date AS DATE)), 0), p.duration_days)"


def prorata_sql(amount: str, rem: str, dur: str) -> str:
    return (f"CASE WHEN {dur} > 0 AND {rem} > 0 THEN CAST(((2 * CAST({amount} * 100 AS BIGINT) * {rem} + {dur}) "
            f"// (2 * {dur})) / 100.0 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END")


def currency_sql(x: str) -> str:
    """DuckDB form of the en-IN currency text (RE2 has no look-ahead, so the
    lakh groups are cut from the reversed head)."""
    s = f"CAST(CAST(abs({x}) AS DECIMAL(18,2)) AS VARCHAR)"
    whole = f"split_part({s}, '.', 1)"
    frac = f"split_part({s}, '.', 2)"
    head = f"left({whole}, length({whole}) - 3)"
    grouped = (f"CASE WHEN length({whole}) <= 3 THEN {whole} ELSE concat(ltrim(reverse(regexp_replace("
               f"reverse({head}), '(\\d\\d)', '\\1,', 'g')), ','), ',', right({whole}, 3)) END")
    return f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, '₹', {grouped}, '.', {frac})"


def _subs_plans(t):
    return t.subscriptions.join(t.plans.select("plan_id", "price", "duration_days"), "plan_id")


@query("plan_end_dates", """
SELECT s.subscription_id, s.start_date + CAST(p.duration_days AS INTEGER) * INTERVAL '1' DAY AS plan_end_date
FROM subscriptions s JOIN plans p ON s.plan_id = p.plan_id""")
def plan_end_dates(t):
    """Start + plan duration in days (time of day kept)."""
    return _subs_plans(t).select("subscription_id", add_days(F.col("start_date"), F.col("duration_days")).alias("plan_end_date"))


@query("remaining_days", f"""
SELECT s.subscription_id, CAST({_REM} AS INTEGER) AS remaining_days
FROM subscriptions s JOIN plans p ON s.plan_id = p.plan_id""")
def remaining_days_q(t):
    """Days left at as_of, between 0 and the plan duration."""
    return _subs_plans(t).select("subscription_id", remaining_days(F.col("end_date"), AS_OF, F.col("duration_days")).alias("remaining_days"))


@query("prorata_refund", f"""
SELECT s.subscription_id, {prorata_sql('p.price', _REM, 'p.duration_days')} AS refund_amount
FROM subscriptions s JOIN plans p ON s.plan_id = p.plan_id""")
def prorata_refund(t):
    """Price x remaining / duration, cents half away from zero."""
    sp = _subs_plans(t)
    rem = remaining_days(F.col("end_date"), AS_OF, F.col("duration_days"))
    return sp.select("subscription_id", M.prorata(F.col("price"), rem, F.col("duration_days")).alias("refund_amount"))


@query("refund_estimate", f"""
SELECT pm.payment_id, {prorata_sql('pm.amount', _REM, 'p.duration_days')} AS refund_estimate
FROM payments pm JOIN subscriptions s ON pm.subscription_id = s.subscription_id JOIN plans p ON s.plan_id = p.plan_id""")
def refund_estimate(t):
    """The same pro-rata maths on the amount paid."""
    sp = _subs_plans(t).select("subscription_id", "end_date", "duration_days")
    j = t.payments.select("payment_id", "subscription_id", "amount").join(sp, "subscription_id")
    rem = remaining_days(F.col("end_date"), AS_OF, F.col("duration_days"))
    return j.select("payment_id", M.prorata(F.col("amount"), rem, F.col("duration_days")).alias("refund_estimate"))


@query("renewal_end", f"""
SELECT s.subscription_id, GREATEST(s.end_date, {_ASOF}) + CAST(p.duration_days AS INTEGER) * INTERVAL '1' DAY AS renewal_end
FROM subscriptions s JOIN plans p ON s.plan_id = p.plan_id""")
def renewal_end_q(t):
    """max(end, as_of) + duration."""
    return _subs_plans(t).select("subscription_id", renewal_end(F.col("end_date"), AS_OF, F.col("duration_days")).alias("renewal_end"))


@query("default_end_date", """
SELECT s.subscription_id,
       COALESCE(CASE WHEN s.subscription_id % 4 = 0 THEN NULL ELSE s.end_date END,
                s.start_date + CAST(p.duration_days AS INTEGER) * INTERVAL '1' DAY) AS end_date
FROM subscriptions s JOIN plans p ON s.plan_id = p.plan_id""")
def default_end_date(t):
    """C17: a missing end date defaults to start + plan duration (every 4th row arrives without one)."""
    from ..operators.subscription_jobs import default_end_date as fill
    incoming = t.subscriptions.withColumn(
        "end_date", F.when(F.col("subscription_id") % 4 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("end_date")))
    return fill(incoming, t.plans).select("subscription_id", "end_date")


@query("log_text", """
SELECT log_id, concat('Seed log entry #', CAST(log_id AS VARCHAR), ' at ', strftime(log_date, '%Y-%m-%d %H:%M:%S')) AS log_text
FROM logs""")
def log_text(t):
    """CONVERT(VARCHAR(19), ts, 120) inside the seed log text."""
    return t.logs.select("log_id", X.render(X.TEMPLATES["seed_log"], log_id="log_id",
                                            log_date=X.datetime_text(F.col("log_date"))).alias("log_text"))


@query("notification_text", f"""
SELECT subscription_id, user_id, 'Email' AS type, 'Subscription Expired' AS subject,
       concat('Your subscription (ID ', CAST(subscription_id AS VARCHAR), ') has expired.') AS body,
       'Email: Subscription Expired' AS log_message
FROM subscriptions WHERE status = 'Active' AND end_date <= {_ASOF}""")
def notification_text(t):
    """Notification texts of the expiry job and the NotificationSent log text."""
    from ..operators.subscription_jobs import expire_due
    n = expire_due(t.subscriptions, AS_OF).notifications
    return n.select("subscription_id", "user_id", "type", "subject", "body",
                    X.notification_log_text(F.col("type"), F.col("subject")).alias("log_message"))


@query("churn_text", f"""
SELECT plan_id, concat(CAST(CAST(round(CAST(cancelled * 100.0 / total AS DECIMAL(20,6)), 2) AS DECIMAL(18,2)) AS VARCHAR), '%') AS churn_text
FROM (SELECT s.plan_id, COUNT(*) AS total, SUM(CASE WHEN s.status = 'Cancelled' THEN 1 ELSE 0 END) AS cancelled
      FROM subscriptions s JOIN plans p ON s.plan_id = p.plan_id GROUP BY s.plan_id)""")
def churn_text(t):
    """Churn as percent text with two digits, per plan."""
    m = R.plan_metrics(t.subscriptions, t.plans)
    return m.select("plan_id", M.percent_text(F.col("churn_rate")).alias("churn_text"))


@query("amount_text", f"""
SELECT payment_id, {currency_sql('amount')} AS amount_text FROM payments""")
def amount_text(t):
    """En-IN currency text of each payment."""
    return t.payments.select("payment_id", M.currency_inr(F.col("amount")).alias("amount_text"))


@query("outbox_payload", """
SELECT pm.payment_id,
       concat('{"UserId":', CAST(s.user_id AS VARCHAR), ',"SubscriptionId":', CAST(pm.subscription_id AS VARCHAR),
              ',"PaymentId":', CAST(pm.payment_id AS VARCHAR), ',"Amount":', CAST(CAST(pm.amount AS DECIMAL(18,2)) AS VARCHAR), '}') AS payload
FROM payments pm JOIN subscriptions s ON pm.subscription_id = s.subscription_id""")
def outbox_payload(t):
    """Outbox JSON payload per payment."""
    j = t.payments.join(t.subscriptions.select("subscription_id", "user_id"), "subscription_id")
    return j.select("payment_id", J.outbox_payload(F.col("user_id"), F.col("subscription_id"), F.col("payment_id"),
                                                   F.col("amount")).alias("payload"))


@query("webhook_parse", """
SELECT seq, json_valid(raw_payload) AS valid,
       CASE WHEN json_valid(raw_payload) THEN COALESCE(json_extract_string(raw_payload, '$.type'), '') ELSE '' END AS type,
       CASE WHEN json_valid(raw_payload) THEN json_extract_string(raw_payload, '$.transactionId') END AS transaction_id,
       CASE WHEN json_valid(raw_payload) THEN COALESCE(json_extract_string(raw_payload, '$.status'), 'Completed') ELSE 'Completed' END AS status,
       CASE WHEN json_valid(raw_payload) THEN COALESCE(CAST(json_extract(raw_payload, '$.amount') AS DECIMAL(18,2)), 0) ELSE 0 END AS amount,
       CASE WHEN json_valid(raw_payload) THEN CAST(json_extract(raw_payload, '$.userId') AS BIGINT) END AS user_id
FROM webhook_inbound""")
def webhook_parse(t):
    """Webhook body parse with defaults; invalid bodies flagged."""
    p = J.parse_webhook(F.col("raw_payload"))
    return t.webhook_inbound.select("seq", p["valid"].alias("valid"), p["type"].alias("type"),
                                    p["transaction_id"].alias("transaction_id"), p["status"].alias("status"),
                                    p["amount"].cast("decimal(18,2)").alias("amount"), p["user_id"].alias("user_id"))


@query("webhook_signature_check", """
SELECT seq, seq % 13 <> 0 AS signature_ok FROM webhook_inbound""")
def webhook_signature_check(t):
    """HMAC-SHA256 of each body against its signature header. Spark
    computes the real HMAC; the fixture forges every 13th signature, which
    is all the oracle needs to know."""
    w = W.signed_inbound(t, HMAC_TEST_KEY)
    return w.select("seq", H.signature_ok(F.col("raw_payload"), F.col("signature"), HMAC_TEST_KEY).alias("signature_ok"))


@query("export_plans_csv_line", """
SELECT plan_id, concat(CAST(plan_id AS VARCHAR), ',"', replace(name, '"', '""'), '",', CAST(price AS VARCHAR), ',',
       billing_cycle, ',', CAST(duration_days AS VARCHAR), ',', strftime(created_at, '%Y-%m-%d')) AS line
FROM plans WHERE name ILIKE '%red%' OR billing_cycle ILIKE '%red%'""")
def export_plans_csv_line(t):
    """CSV lines of the filtered plans (all of them, no 1000-row cap)."""
    from ..sources.sinks import plans_csv_lines
    return plans_csv_lines(L.plans_filtered(t.plans, search="red"))


@query("export_plans_csv", """
SELECT 'PlanId,Name,Price,BillingCycle,DurationDays,CreatedAt' AS line
UNION ALL
SELECT concat(CAST(plan_id AS VARCHAR), ',"', replace(name, '"', '""'), '",', CAST(price AS VARCHAR), ',',
       billing_cycle, ',', CAST(duration_days AS VARCHAR), ',', strftime(created_at, '%Y-%m-%d')) AS line
FROM plans""")
def export_plans_csv(t):
    """The CSV files of all plans, written and read back (each file's header counts once)."""
    from ..session import scratch_path
    from ..sources.sinks import write_plans_csv
    path = scratch_path(t.spark, "plans-csv")
    write_plans_csv(t.plans, path)
    return t.spark.read.text(path).select(F.col("value").alias("line")).distinct()


@query("export_plans_json", """
SELECT plan_id, concat('{"plan_id":', CAST(plan_id AS VARCHAR), ',"name":', to_json(name), ',"description":', to_json(description),
       ',"price":', CAST(price AS VARCHAR), ',"billing_cycle":', to_json(billing_cycle), ',"duration_days":',
       CAST(duration_days AS VARCHAR), ',"features":', to_json(features), ',"created_at":"',
       strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g'), '"}') AS json
FROM plans WHERE name ILIKE '%red%' OR billing_cycle ILIKE '%red%'""")
def export_plans_json(t):
    """JSON lines of the filtered plans, all nine columns."""
    from ..sources.sinks import json_lines
    return json_lines(L.plans_filtered(t.plans, search="red"), "plan_id")


@query("report_revenue_json", f"""
SELECT concat('{{"from":"{REPORT_FROM}T00:00:00.000","to":"{REPORT_TO}T00:00:00.000","totalRevenue":',
              CAST(CAST(COALESCE(SUM(amount), 0) AS DECIMAL(18,2)) AS VARCHAR), '}}') AS json
FROM payments WHERE status = 'Completed' AND payment_date >= TIMESTAMP '{REPORT_FROM} 00:00:00'
  AND payment_date < TIMESTAMP '{REPORT_TO} 00:00:00' + INTERVAL 1 DAY""")
def report_revenue_json(t):
    """Revenue report as a JSON object {from, to, totalRevenue}."""
    r = R.revenue(t.payments, REPORT_FROM, REPORT_TO)
    return r.select(F.to_json(F.struct(lit_ts(REPORT_FROM).alias("from"), lit_ts(REPORT_TO).alias("to"),
                                       F.col("revenue").alias("totalRevenue"))).alias("json"))


@query("duration_text", """
SELECT CAST(CAST(round(CAST(COALESCE(AVG(CAST(date_diff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) AS DOUBLE)), 0.0)
            AS DECIMAL(20,6)), 1) AS DECIMAL(18,1)) AS VARCHAR) AS avg_duration_text
FROM subscriptions""")
def duration_text(t):
    """Mean duration as text with one decimal ('0.0' format)."""
    a = R.avg_duration_days(t.subscriptions)
    return a.select(M.one_digit_text(F.col("avg_duration_days")).alias("avg_duration_text"))
