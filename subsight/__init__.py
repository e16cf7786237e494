"""Subscription analytics on Spark: reports, listings, change jobs, data
quality and streams over plans, users, subscriptions, payments, logs,
an outbox and payment webhooks, all written with the DataFrame API."""

__version__ = "0.1.0"
