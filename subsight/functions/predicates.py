"""Filter predicates shared by listings, reports and change jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schemas as S
from .dates import lit_ts

# Sort whitelists of the reference's listing screens.
# Each maps the accepted sort name (lower case) to a column; anything else
# falls back to the listed default.
PLAN_SORTS = {"name": "name", "price": "price", "createdat": "created_at"}
PLAN_SORT_DEFAULT = "created_at"
USER_SORTS = {"email": "email", "firstname": "first_name", "registrationdate": "registration_date"}
USER_SORT_DEFAULT = "registration_date"
SUBSCRIPTION_SORTS = {"startdate": "start_date", "enddate": "end_date", "status": "status"}
SUBSCRIPTION_SORT_DEFAULT = "start_date"
PAYMENT_SORTS = {"paymentdate": "payment_date", "amount": "amount", "status": "status"}
PAYMENT_SORT_DEFAULT = "payment_date"
MAX_PAGE_SIZE = 200

_ENUMS = {v.lower(): v for v in S.SUBSCRIPTION_STATUSES + S.PAYMENT_STATUSES + S.ROLES
          + ["Monthly", "Yearly"]}


def blank(value) -> bool:
    """C# IsNullOrWhiteSpace on a driver-side parameter."""
    return value is None or str(value).strip() == ""


def blank_col(c: Column) -> Column:
    """IsNullOrWhiteSpace as a column expression: any Unicode white space is blank."""
    return ~F.coalesce(c.rlike("(?U)\\S"), F.lit(False))


def equals_opt(col: Column, value, case_sensitive: bool = False) -> Column:
    """Optional equality filter: a blank value means no filter.

    Enumerated values are matched case-insensitively by canonicalising the
    parameter once on the driver, so the predicate stays a plain equality
    that reaches the Parquet scan."""
    if blank(value):
        return F.lit(True)
    if case_sensitive:
        return col == F.lit(value)
    canon = _ENUMS.get(str(value).lower())
    if canon is not None:
        return col == F.lit(canon)
    return F.lower(col) == F.lit(str(value).lower())


def contains_any(cols: list[Column], text, case_sensitive: bool = False) -> Column:
    """``c LIKE '%text%'`` OR-ed over columns; blank text means no filter.

    The text is not escaped: % and _ keep their wildcard meaning."""
    if blank(text):
        return F.lit(True)
    pattern = f"%{text}%"
    parts = [(c.like(pattern) if case_sensitive else c.ilike(pattern)) for c in cols]
    return reduce(lambda a, b: a | b, parts)


def strictly_active(status: Column, end: Column, as_of) -> Column:
    """Status Active and end date after as_of."""
    return (status == "Active") & (end > lit_ts(as_of))


def due_for_expiry(status: Column, end: Column, as_of) -> Column:
    return (status == "Active") & (end <= lit_ts(as_of))


def expired_like(status: Column, end: Column, as_of) -> Column:
    """Expired, or ended at/before as_of (cancelled rows count too)."""
    return (status == "Expired") | (end <= lit_ts(as_of))
