"""The seven tables, mapped from the driver's TPC-H-like Parquet files.

The mapping reads only the source columns it needs. By default each mapped
table is written once per application to the shared checkpoint folder
(range-clustered and sorted on its main date column, so Parquet statistics
skip the files and row groups a date filter excludes) and every query reads that stored copy - as a deployment
reads its stored tables - instead of re-running the mapping (for payments
an aggregation of lineitem) in every query. ``stored=False`` reads through
the mapping directly."""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S

BASE_DAY = "1995-01-01 00:00:00"


def ts_ntz(text: str) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.to_timestamp_ntz(F.lit(text))


def add_days(ts: Column, days) -> Column:
    """DATEADD(DAY, n, ts): keeps the time of day."""
    n = days if isinstance(days, Column) else F.lit(days)
    return F.timestamp_add("DAY", n, ts)


def padded(number: Column, width: int) -> Column:
    """A number as text, zero-padded to a width; longer numbers stay whole."""
    s = number.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


ROWS_PER_FILE = 4_000_000
# (application id, source folder, table) -> stored path
_STORED: dict[tuple[str, str, str], str] = {}


def _as_read(df: DataFrame, *order: Column) -> DataFrame:
    """The arrangement of a table that is not stored: none."""
    return df


class Tables:
    """Handles to every base table and the webhook landing rows."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.stored = stored

    def _table(self, name: str, build) -> DataFrame:
        """``build`` takes an arrangement and calls it with the source's rows and
        the order of the stored table (the column most filters use)."""
        if not self.stored:
            return build(_as_read)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        path = _STORED.get(key)
        if path is not None:
            try:
                return self.spark.read.parquet(path)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                path = None  # the stored copy is gone (folder cleaned): write it again
        if path is None:
            from ..session import scratch_path

            path = scratch_path(self.spark, f"table-{name}")
            # range-clustered on the order columns: each file holds one slice of
            # the date range, so a date filter skips whole files' row groups.
            # One range per core, or as many as the cluster's shuffles have
            # (set for its data size), an explicit count that AQE does not
            # merge away; the row cap per file bounds file size. The source's
            # narrow rows are shuffled and sorted, the texts made afterwards.
            slices = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

            def arrange(df: DataFrame, *order: Column) -> DataFrame:
                return df.repartitionByRange(slices, *order).sortWithinPartitions(*order)

            build(arrange).write.mode("errorifexists").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(path)

    TABLES = ("plans", "users", "subscriptions", "payments", "logs", "outbox", "webhook_inbound")

    def materialize(self, names=TABLES, threads: int = 4) -> "Tables":
        """Store the given tables now, several Spark jobs at a time (jobs
        submitted from separate driver threads run concurrently)."""
        from concurrent.futures import ThreadPoolExecutor

        from ..session import checkpoint_dir

        checkpoint_dir(self.spark)  # resolve the shared folder once, before the threads
        with ThreadPoolExecutor(max_workers=threads) as pool:
            list(pool.map(lambda n: getattr(self, n), names))
        return self

    def save(self, folder: str) -> str:
        """Write all seven tables under ``folder`` (one sub-folder each), for
        ``StoredTables`` to read in later applications."""
        for name in self.TABLES:
            getattr(self, name).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}")
        return folder

    def raw(self, name: str, *cols: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*cols) if cols else df

    @cached_property
    def plans(self) -> DataFrame:
        return self._table("plans", self._map_plans)

    def _map_plans(self, arrange=_as_read) -> DataFrame:
        p = self.raw("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
        monthly = (F.col("p_size") % 2) == 0
        return arrange(p, F.col("p_partkey")).select(
            F.col("p_partkey").cast("bigint").alias("plan_id"),
            F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"),
            F.concat("p_type", F.lit(" by "), "p_brand").alias("description"),
            F.col("p_retailprice").cast(S.MONEY).alias("price"),
            F.when(monthly, "Monthly").otherwise("Yearly").alias("billing_cycle"),
            F.when(monthly, 30).otherwise(365).alias("duration_days"),
            F.concat(F.lit('{"users":'), F.col("p_size").cast("string"), F.lit(',"support":"'),
                     F.lower("p_type"), F.lit('"}')).alias("features"),
            add_days(ts_ntz(BASE_DAY), (F.col("p_partkey") % 365).cast("int")).alias("created_at"),
            F.lit(None).cast(S.TS).alias("updated_at"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self._table("users", self._map_users)

    def _map_users(self, arrange=_as_read) -> DataFrame:
        c = self.raw("customer", "c_custkey", "c_name", "c_mktsegment")
        return arrange(c, F.col("c_custkey")).select(
            F.col("c_custkey").cast("bigint").alias("user_id"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("555"), padded(F.col("c_custkey"), 7))).alias("phone"),
            F.lit(None).cast("string").alias("address"),
            add_days(ts_ntz(BASE_DAY), (F.col("c_custkey") % 365).cast("int")).alias("registration_date"),
            F.when(F.col("c_custkey") % 10 == 0, "Admin").otherwise("Subscriber").alias("role"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self._table("subscriptions", self._map_subscriptions)

    def _map_subscriptions(self, arrange=_as_read) -> DataFrame:
        o = self.raw("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        part = self.raw("part", "p_partkey", "p_size")
        # The plan of an order is part number (order key mod number of parts);
        # the part count is a scalar subquery, so nothing goes through the driver.
        n_parts = part.select(F.count(F.lit(1))).scalar()
        o = o.withColumn("plan_key", F.col("o_orderkey") % n_parts)
        j = o.join(part, o["plan_key"] == part["p_partkey"], "inner")
        days = F.when(F.col("p_size") % 2 == 0, 30).otherwise(365)
        return arrange(j, F.col("o_orderdate"), F.col("o_orderkey")).select(
            F.col("o_orderkey").cast("bigint").alias("subscription_id"),
            F.col("o_custkey").cast("bigint").alias("user_id"),
            F.col("p_partkey").cast("bigint").alias("plan_id"),
            F.col("o_orderdate").alias("start_date"),
            add_days(F.col("o_orderdate"), days).alias("end_date"),
            F.lit(None).cast(S.TS).alias("renewal_date"),
            F.when(F.col("o_orderstatus") == "O", "Active")
             .when(F.col("o_orderstatus") == "F", "Expired").otherwise("Cancelled").alias("status"),
            ((F.col("o_orderkey") % 2) == 0).alias("auto_renew"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self._table("payments", self._map_payments)

    def _map_payments(self, arrange=_as_read) -> DataFrame:
        li = self.raw("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_returnflag")
        # (order, line) repeats in the source; one payment per pair. The least
        # flag matters as N, R or another: its rank among these, an int, keeps
        # the aggregate a hash aggregate (a string would sort all lines).
        flag = F.col("l_returnflag")
        rank = F.when(flag < "N", 0).when(flag == "N", 1).when(flag < "R", 2).when(flag == "R", 3).when(flag > "R", 4)
        g = li.withColumn("rank", rank).groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_extendedprice").alias("px"), F.min("l_shipdate").alias("shipped"),
            F.min("rank").alias("flag"))
        pid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return arrange(g, F.col("shipped"), pid).select(
            pid.cast("bigint").alias("payment_id"),
            F.col("l_orderkey").cast("bigint").alias("subscription_id"),
            F.col("px").cast(S.MONEY).alias("amount"),
            F.col("shipped").alias("payment_date"),
            F.when(F.col("l_linenumber") % 3 == 0, "PayPal").otherwise("Credit Card").alias("payment_method"),
            F.concat(F.lit("TXN-"), pid.cast("string")).alias("transaction_id"),
            F.when(F.col("flag") == 1, "Completed").when(F.col("flag") == 3, "Refunded")
             .otherwise("Failed").alias("status"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        return self._table("logs", self._map_logs)

    def _map_logs(self, arrange=_as_read) -> DataFrame:
        e = self.raw("events", "event_id", "user_id", "event_type", "ts")
        et = F.col("event_type")
        return arrange(e, F.col("ts"), F.col("event_id")).select(
            F.col("event_id").cast("bigint").alias("log_id"),
            F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id").cast("bigint")).alias("user_id"),
            F.when(et == "signup", "UserRegistered").when(et == "view", "UserLogin")
             .when(et == "click", "SubscriptionRenewed").when(et == "purchase", "PaymentProcessed")
             .otherwise("Exception").alias("action"),
            F.concat(F.lit("Seed log entry #"), F.col("event_id").cast("string")).alias("message"),
            F.col("ts").alias("log_date"),
        )

    @cached_property
    def outbox(self) -> DataFrame:
        return self._table("outbox", self._map_outbox)

    def _map_outbox(self, arrange=_as_read) -> DataFrame:
        e = self.raw("events", "event_id", "user_id", "event_type", "value", "ts")
        et = F.col("event_type")
        sid = F.col("event_id") % self.raw("orders").select(F.count(F.lit(1))).scalar()
        return arrange(e, F.col("ts"), F.col("event_id")).select(
            F.col("event_id").alias("outbox_id"),
            F.when(et == "purchase", "PaymentProcessed").when(et == "error", "PaymentRefunded")
             .otherwise("Notification.Email").alias("type"),
            F.concat(F.lit('{"UserId":'), F.col("user_id").cast("string"),
                     F.lit(',"SubscriptionId":'), sid.cast("string"),
                     F.lit(',"PaymentId":'), (sid * 10 + 1).cast("string"),
                     F.lit(',"Amount":'), F.col("value").cast(S.MONEY).cast("string"), F.lit("}")).alias("payload"),
            F.col("ts").alias("created_at"),
            F.when(F.col("event_id") % 3 == 0, F.timestamp_add("HOUR", F.lit(1), F.col("ts"))).alias("processed_at"),
            (F.col("event_id") % 7).cast("int").alias("attempts"),
            F.lit(None).cast("string").alias("error"),
        )

    @cached_property
    def webhook_inbound(self) -> DataFrame:
        return self._table("webhook_inbound", self._map_webhook_inbound)

    def _map_webhook_inbound(self, arrange=_as_read) -> DataFrame:
        """Inbound webhook requests (no signature yet: see webhooks.sign)."""
        e = self.raw("events", "event_id", "user_id", "event_type", "value", "ts")
        e = e.where(F.col("event_type").isin("purchase", "error"))
        refund = F.col("event_type") == "error"
        body = F.concat(
            F.lit('{"type":"'), F.when(refund, "payment.refunded").otherwise("payment.succeeded"),
            F.lit('","transactionId":"TXN-'), (F.col("event_id") % self.raw("orders").select(F.count(F.lit(1))).scalar() * 10 + 1).cast("string"),
            F.lit('","status":"'), F.when(refund, "Refunded").otherwise("Completed"),
            F.lit('","amount":'), F.col("value").cast(S.MONEY).cast("string"),
            F.lit(',"userId":'), F.col("user_id").cast("string"), F.lit("}"))
        return arrange(e, F.col("event_id")).select(
            F.concat(F.lit("evt-"), F.floor(F.col("event_id") / 2).cast("bigint").cast("string")).alias("event_id"),
            F.col("event_id").alias("seq"),
            F.col("ts").alias("received_at"),
            F.concat(F.lit("client-"), F.col("user_id").cast("string")).alias("client_key"),
            F.when(F.col("event_id") % 11 == 0, F.lit("{bad")).otherwise(body).alias("raw_payload"),
        )


class StoredTables:
    """The seven tables read from a folder of Parquet tables (``plans/``,
    ``users/``, ... as written by ``Tables.save`` or exported from the
    application's database), with their declared schemas. Every operator
    takes these DataFrames as it takes those of ``Tables``."""

    _SCHEMAS = {"plans": S.PLANS, "users": S.USERS, "subscriptions": S.SUBSCRIPTIONS, "payments": S.PAYMENTS,
                "logs": S.LOGS, "outbox": S.OUTBOX, "webhook_inbound": S.WEBHOOK_IN}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._SCHEMAS:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        # declared column order and types; a declared column the files do not
        # hold (a webhook landed without signature) reads as NULL
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in self._SCHEMAS[name].fields])

