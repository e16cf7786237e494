"""Filtered, searched, sorted and paged listings.

A page is ``orderBy(key, primary key).offset(o).limit(n)``, which Spark
runs as a per-partition top-(o+n) followed by one small merge
(TakeOrderedAndProject); the total is a separate count under the same
filter, never a global window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.dates import in_range


@dataclass(frozen=True)
class PageRequest:
    page: int = 1
    page_size: int = 10
    sort_by: str | None = None
    sort_dir: str | None = "desc"

    def validate(self) -> "PageRequest":
        if self.page < 1:
            raise ValueError("page must be >= 1")
        if not 1 <= self.page_size <= P.MAX_PAGE_SIZE:
            raise ValueError(f"page_size must be within 1..{P.MAX_PAGE_SIZE}")
        return self

    @property
    def ascending(self) -> bool:
        return (self.sort_dir or "desc").lower() == "asc"

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.page_size


def sort_column(whitelist: dict[str, str], default: str, sort_by: str | None) -> str:
    return whitelist.get((sort_by or "").lower(), default)


def page(df: DataFrame, sort_col: str, key: str, req: PageRequest) -> DataFrame:
    """One page, sorted on ``sort_col`` with the primary key as tie-breaker.

    NULL sorts lowest in both directions (first ascending, last descending)."""
    req.validate()
    c = F.col(sort_col)
    primary = c.asc_nulls_first() if req.ascending else c.desc_nulls_last()
    tie = F.col(key).asc() if req.ascending else F.col(key).desc()
    return df.orderBy(primary, tie).offset(req.offset).limit(req.page_size)


def page_after(df: DataFrame, sort_col: str, key: str, req: PageRequest, value, key_value) -> DataFrame:
    """The rows that follow the row with sort value ``value`` and key ``key_value``:
    keyset paging. A top-k of one page, however deep, where an offset sends
    all rows before the page to one task."""
    req.validate()
    c, k = F.col(sort_col), F.col(key)
    v = F.lit(value)
    if req.ascending:
        later = k > key_value
        beyond = c.isNotNull() | (c.isNull() & later) if value is None else (c > v) | ((c == v) & later)
    else:
        later = k < key_value
        beyond = c.isNull() & later if value is None else (c < v) | c.isNull() | ((c == v) & later)
    primary = c.asc_nulls_first() if req.ascending else c.desc_nulls_last()
    return df.where(F.coalesce(beyond, F.lit(False))).orderBy(primary, k.asc() if req.ascending else k.desc()).limit(req.page_size)


def position_index(df: DataFrame, sort_col: str, key: str, req: PageRequest, path: str) -> DataFrame:
    """The rows of a listing with their 0-based ``position`` in the request's
    order, stored at ``path`` sorted by it (in files of consecutive
    positions). Built once for a listing and an order, it serves every page:
    see :func:`page_at`."""
    from . import ids

    c, k = F.col(sort_col), F.col(key)
    order = [c.asc_nulls_first(), k.asc()] if req.ascending else [c.desc_nulls_last(), k.desc()]
    ids.positions(df, order, "position").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def page_at(index: DataFrame, req: PageRequest) -> DataFrame:
    """A page of any depth from a :func:`position_index`. The range of
    positions reaches the Parquet scan, which opens the files and row groups
    that hold it; only the page's own rows are sorted."""
    req.validate()
    p = F.col("position")
    return index.where((p >= req.offset) & (p < req.offset + req.page_size)).orderBy("position")


def page_info(total: DataFrame, req: PageRequest) -> DataFrame:
    """Page maths from a one-row ``total`` frame: pages = ceil(total/size)."""
    req.validate()
    size = F.lit(req.page_size)
    pages = F.ceil(F.col("total") / size).cast("bigint")
    return total.select(
        F.col("total"), F.lit(req.page).alias("page"), size.alias("page_size"),
        pages.alias("total_pages"), (F.lit(req.page) > 1).alias("has_previous"),
        (F.lit(req.page) < pages).alias("has_next"))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


# -- plans -------------------------------------------------------------------

PLAN_COLS = ["plan_id", "name", "description", "price", "billing_cycle", "duration_days",
             "features", "created_at", "updated_at"]


def plans_filtered(plans: DataFrame, search=None, billing_cycle=None) -> DataFrame:
    cond = (P.contains_any([F.col("name"), F.col("billing_cycle")], search)
            & P.equals_opt(F.col("billing_cycle"), billing_cycle))
    return plans.where(cond).select(*PLAN_COLS)


def plans_page(plans: DataFrame, req: PageRequest, search=None, billing_cycle=None) -> DataFrame:
    col = sort_column(P.PLAN_SORTS, P.PLAN_SORT_DEFAULT, req.sort_by)
    return page(plans_filtered(plans, search, billing_cycle), col, "plan_id", req)


def plans_all(plans: DataFrame) -> DataFrame:
    """Every plan, newest first (plan id breaks ties)."""
    return plans.select(*PLAN_COLS).orderBy(F.desc("created_at"), "plan_id")


# -- users -------------------------------------------------------------------

USER_COLS = ["user_id", "first_name", "last_name", "email", "phone", "address",
             "registration_date", "role"]


def users_filtered(users: DataFrame, search=None) -> DataFrame:
    cond = P.contains_any([F.col("email"), F.col("first_name"), F.col("last_name")], search)
    return users.where(cond).select(*USER_COLS)


def users_page(users: DataFrame, req: PageRequest, search=None) -> DataFrame:
    col = sort_column(P.USER_SORTS, P.USER_SORT_DEFAULT, req.sort_by)
    return page(users_filtered(users, search), col, "user_id", req)


# -- subscriptions -----------------------------------------------------------

SUBSCRIPTION_COLS = ["subscription_id", "user_id", "plan_id", "start_date", "end_date",
                     "renewal_date", "status", "auto_renew"]


def subscriptions_filtered(subscriptions: DataFrame, users: DataFrame, plans: DataFrame,
                           user_email=None, plan_id=None, status=None,
                           date_from=None, date_to=None) -> DataFrame:
    """Subscriptions with the user's e-mail and the plan name (inner joins),
    under optional e-mail search, plan, status and start-date range."""
    s = subscriptions.where(
        P.equals_opt(F.col("status"), status)
        & in_range(F.col("start_date"), date_from, date_to)
        & (F.lit(True) if plan_id is None else F.col("plan_id") == F.lit(plan_id)))
    u = users.select("user_id", F.col("email").alias("user_email"))
    u = u.where(P.contains_any([F.col("user_email")], user_email))
    pl = plans.select("plan_id", F.col("name").alias("plan_name"))
    return s.join(u, "user_id").join(pl, "plan_id").select(*SUBSCRIPTION_COLS, "user_email", "plan_name")


def subscriptions_page(subscriptions, users, plans, req: PageRequest, **filters) -> DataFrame:
    col = sort_column(P.SUBSCRIPTION_SORTS, P.SUBSCRIPTION_SORT_DEFAULT, req.sort_by)
    return page(subscriptions_filtered(subscriptions, users, plans, **filters), col, "subscription_id", req)


# -- payments ----------------------------------------------------------------

PAYMENT_COLS = ["payment_id", "subscription_id", "amount", "payment_date", "payment_method",
                "transaction_id", "status"]


def payments_filtered(payments: DataFrame, date_from=None, date_to=None, status=None) -> DataFrame:
    cond = in_range(F.col("payment_date"), date_from, date_to) & P.equals_opt(F.col("status"), status)
    return payments.where(cond).select(*PAYMENT_COLS)


def payments_page(payments: DataFrame, req: PageRequest, **filters) -> DataFrame:
    col = sort_column(P.PAYMENT_SORTS, P.PAYMENT_SORT_DEFAULT, req.sort_by)
    return page(payments_filtered(payments, **filters), col, "payment_id", req)


def payments_page_after(payments: DataFrame, req: PageRequest, value, payment_id: int, **filters) -> DataFrame:
    """The payments page that follows a given last row (keyset paging)."""
    col = sort_column(P.PAYMENT_SORTS, P.PAYMENT_SORT_DEFAULT, req.sort_by)
    return page_after(payments_filtered(payments, **filters), col, "payment_id", req, value, payment_id)


def payments_by_subscription(payments: DataFrame, keys: DataFrame) -> DataFrame:
    """Payments of a set of subscriptions, newest first (payment id breaks ties)."""
    return (payments.select(*PAYMENT_COLS).join(keys.select("subscription_id").distinct(), "subscription_id", "left_semi")
            .orderBy("subscription_id", F.desc("payment_date"), F.desc("payment_id")))
