"""Declared schemas of the seven tables and the command inputs.

Column order and types are part of the contract: every job selects these
columns explicitly, never ``*``."""

from pyspark.sql import types as T

TS = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
TOTAL = T.DecimalType(18, 2)

# The enumerations of the reference's schema.
SUBSCRIPTION_STATUSES = ["Active", "Cancelled", "Expired"]
PAYMENT_STATUSES = ["Completed", "Failed", "Refunded"]
ROLES = ["Admin", "Subscriber"]
MAX_OUTBOX_ATTEMPTS = 5
OUTBOX_BATCH = 50
ERROR_TEXT_LIMIT = 1000


def _s(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


PLANS = _s(("plan_id", T.LongType(), False), ("name", T.StringType(), False),
           ("description", T.StringType(), True), ("price", MONEY, False),
           ("billing_cycle", T.StringType(), False), ("duration_days", T.IntegerType(), False),
           ("features", T.StringType(), True), ("created_at", TS, False),
           ("updated_at", TS, True))

USERS = _s(("user_id", T.LongType(), False), ("first_name", T.StringType(), False),
           ("last_name", T.StringType(), False), ("email", T.StringType(), False),
           ("phone", T.StringType(), True), ("address", T.StringType(), True),
           ("registration_date", TS, False), ("role", T.StringType(), False))

SUBSCRIPTIONS = _s(("subscription_id", T.LongType(), False), ("user_id", T.LongType(), False),
                   ("plan_id", T.LongType(), False), ("start_date", TS, False),
                   ("end_date", TS, False), ("renewal_date", TS, True),
                   ("status", T.StringType(), False), ("auto_renew", T.BooleanType(), False))

PAYMENTS = _s(("payment_id", T.LongType(), False), ("subscription_id", T.LongType(), False),
              ("amount", MONEY, False), ("payment_date", TS, False),
              ("payment_method", T.StringType(), True), ("transaction_id", T.StringType(), False),
              ("status", T.StringType(), False))

LOGS = _s(("log_id", T.LongType(), False), ("user_id", T.LongType(), True),
          ("action", T.StringType(), False), ("message", T.StringType(), True),
          ("log_date", TS, False))

OUTBOX = _s(("outbox_id", T.LongType(), False), ("type", T.StringType(), False),
            ("payload", T.StringType(), False), ("created_at", TS, False),
            ("processed_at", TS, True), ("attempts", T.IntegerType(), False),
            ("error", T.StringType(), True))

WEBHOOK_EVENTS = _s(("id", T.LongType(), False), ("event_id", T.StringType(), False),
                    ("signature", T.StringType(), True), ("raw_payload", T.StringType(), False),
                    ("received_at", TS, False), ("processed", T.BooleanType(), False))

WEBHOOK_IN = _s(("seq", T.LongType(), False), ("received_at", TS, False),
                ("client_key", T.StringType(), False), ("event_id", T.StringType(), True),
                ("signature", T.StringType(), True), ("raw_payload", T.StringType(), False))

LOG_MESSAGE = _s(("user_id", T.LongType(), True), ("action", T.StringType(), False),
                 ("message", T.StringType(), True), ("timestamp_utc", TS, False))

NOTIFICATION_MESSAGE = _s(("user_id", T.LongType(), True), ("type", T.StringType(), False),
                          ("subject", T.StringType(), False), ("body", T.StringType(), False),
                          ("timestamp_utc", TS, False))

# JSON bodies
WEBHOOK_BODY_DDL = ("type STRING, transactionId STRING, status STRING, amount DECIMAL(18,2), "
                    "userId BIGINT, subscriptionId BIGINT, paymentId BIGINT")
OUTBOX_PAYLOAD_DDL = "Type STRING, UserId BIGINT, SubscriptionId BIGINT, PaymentId BIGINT, Amount DECIMAL(18,2)"
