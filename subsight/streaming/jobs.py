"""Stream jobs: logs (ST1), notifications (ST2), outbox (ST3), webhooks
(ST5) and rate limiting (ST6).

What a job must remember is keyed state in the state store
(``streaming.state``); each micro-batch is written to a folder of its own,
overwritten on replay. Passing the ``sink`` of an earlier run resumes it
from its checkpoint. Jobs run with ``trigger(availableNow=True)``, but for
the outbox, whose retries wait for processing-time timers."""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outbox as O
from ..operators import ratelimit as RL
from ..functions import hmac as H
from ..functions.predicates import blank_col
from ..operators import webhooks as W
from ..session import apply_settings, scratch_path
from ..sources import schemas as S
from . import state as K


def _sink_batch(sink: str, name: str, batch_id: int, df: DataFrame) -> None:
    """Write one micro-batch's output to its own folder; a replay of the
    batch id overwrites it (idempotent sink)."""
    df.write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")


def _missing(error: Exception) -> bool:
    """Whether a read failed because nothing was written there yet."""
    return any(x in str(error) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "Path does not exist"))


def _read_sink(spark: SparkSession, sink: str, name: str, schema) -> DataFrame:
    cols = [f.name for f in schema.fields]
    try:
        return spark.read.schema(schema).parquet(f"{sink}/{name}").select(*cols)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)


def _batch(spark: SparkSession, sink: str, name: str, batch_id: int) -> DataFrame | None:
    """What one earlier micro-batch wrote, or None where there is no such batch."""
    if batch_id < 0:
        return None
    try:
        return spark.read.parquet(f"{sink}/{name}/batch={batch_id}")
    except AnalysisException as e:
        if not _missing(e):
            raise
        return None


def _read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_foreach(spark: SparkSession, source_path: str, schema, name: str,
                handle: Callable[[DataFrame, int, str], None], files_per_trigger: int | None = None,
                sink: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None,
                conf: dict[str, str] | None = None) -> str:
    """readStream (files) -> transform -> foreachBatch(handle) with a
    checkpoint; returns the sink folder. Passing the ``sink`` of an earlier
    run resumes it: only files that run has not seen are processed.
    ``files_per_trigger`` bounds a micro-batch (by default nothing does);
    ``conf`` are settings for this query alone."""
    sink = sink or scratch_path(spark, f"sink-{name}")
    stream = _read_stream(spark, source_path, schema, files_per_trigger)
    if transform:
        apply_settings(spark)  # the state store
        stream = transform(stream)
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        # the query takes a copy of the settings with it
        q = (stream.writeStream.foreachBatch(lambda df, bid: handle(df, bid, sink))
             .option("checkpointLocation", f"{sink}/_checkpoint").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return sink


def _arrived(batch: DataFrame, sink: str, name: str, batch_id: int) -> DataFrame:
    """A micro-batch, written once and read again: every action on the batch
    itself would run its sources and state operators anew."""
    _sink_batch(sink, name, batch_id, batch)
    return batch.sparkSession.read.schema(batch.schema).parquet(f"{sink}/{name}/batch={batch_id}")


def logs_stream(spark: SparkSession, source_path: str, users: DataFrame,
                files_per_trigger: int | None = None) -> DataFrame:
    """ST1: append log messages; a message for an unknown user (the foreign
    key would refuse it) goes to a quarantine folder instead of being lost."""
    from ..sources.schemas import LOG_MESSAGE

    def handle(batch: DataFrame, bid: int, sink: str) -> None:
        known = users.select("user_id", F.lit(True).alias("_known"))
        j = batch.join(known, "user_id", "left")
        ok = F.col("user_id").isNull() | F.col("_known").isNotNull()
        _sink_batch(sink, "logs", bid, j.where(ok).drop("_known"))
        _sink_batch(sink, "quarantine", bid, j.where(~ok).drop("_known"))

    sink = run_foreach(spark, source_path, LOG_MESSAGE, "logs", handle, files_per_trigger)
    good = _read_sink(spark, sink, "logs", LOG_MESSAGE).withColumn("sink", F.lit("logs"))
    bad = _read_sink(spark, sink, "quarantine", LOG_MESSAGE).withColumn("sink", F.lit("quarantine"))
    return good.unionByName(bad)


def notifications_stream(spark: SparkSession, source_path: str, files_per_trigger: int | None = None) -> DataFrame:
    """ST2: deliver notifications (delivery itself is external) and append
    the NotificationSent log row for each."""
    from ..sources.schemas import LOG_MESSAGE, NOTIFICATION_MESSAGE

    def handle(batch: DataFrame, bid: int, sink: str) -> None:
        _sink_batch(sink, "logs", bid, O.notification_logs(batch))

    sink = run_foreach(spark, source_path, NOTIFICATION_MESSAGE, "notifications", handle, files_per_trigger)
    return _read_sink(spark, sink, "logs", LOG_MESSAGE)


def outbox_stream(spark: SparkSession, source_path: str, schema, users: DataFrame, as_of,
                  files_per_trigger: int | None = None, sink: str | None = None,
                  retry_after_ms: int = 2000, settle: bool = True) -> str:
    """ST3: dispatch new outbox rows, and failed ones again ``retry_after_ms``
    later until they are processed or out of attempts. Returns the sink;
    :func:`outbox_final` reads it.

    A batch writes its rows' state (C19) and the rows to retry. Those are the
    query's second source: they wait in keyed state for their timer, which
    lets them into a later batch. So a retry is a micro-batch of the query
    itself. A query that is stopped between attempts resumes with the rows
    still waiting, and a batch that is replayed writes its folders again:
    no notification is sent twice.

    Runs until no row waits; with ``settle=False`` only until the new rows
    have been dispatched once."""
    from ..sources.schemas import OUTBOX

    apply_settings(spark)
    sink = sink or scratch_path(spark, "sink-outbox")
    cols = [f.name for f in OUTBOX.fields]
    retries = f"{sink}/retries"
    spark.createDataFrame([], OUTBOX).write.mode("append").parquet(f"{retries}/none")  # a source must exist
    new = _read_stream(spark, source_path, schema, files_per_trigger).select(*cols, F.lit(False).alias("again"))
    failed = spark.readStream.schema(OUTBOX).option("recursiveFileLookup", "true").parquet(retries)
    waited = K.waiting_room(failed.select(*cols), "outbox_id", retry_after_ms).withColumn("again", F.lit(True))

    def handle(batch: DataFrame, bid: int) -> None:
        batch = batch.persist()
        try:
            if not batch.count():  # a count runs every partition of the state; idle batches leave no folder
                return
            rows = _arrived(batch, sink, "due", bid)
        finally:
            batch.unpersist()
        res = O.dispatch(rows.select(*cols), users, as_of)
        for name in ("outbox", "results", "notifications", "logs"):
            _sink_batch(sink, name, bid, res[name])
        left = O.pending(spark.read.schema(OUTBOX).parquet(f"{sink}/outbox/batch={bid}"))
        _sink_batch(sink, "retries", bid, left.select(*cols))

    q = (new.unionByName(waited).writeStream.foreachBatch(handle)
         .option("checkpointLocation", f"{sink}/_checkpoint").trigger(processingTime=POLL).start())
    first = None
    try:
        while not q.awaitTermination(timeout=0.2):  # a failed query raises here
            done = q.lastProgress  # of the last batch that is finished: a later one may be at work
            if done is None:
                continue
            if first is None:  # may be one that an earlier run planned, before the latest files came
                first = done["batchId"]
            if done["batchId"] > first and _drained(done) and not (settle and _waiting(spark, sink, done["batchId"])):
                break
    finally:
        q.stop()
    return sink


POLL = "200 milliseconds"  # the reference's pause between polls


def _drained(progress) -> bool:
    """Whether a batch found nothing new in the arrivals (timers alone make batches too)."""
    return progress is not None and all(
        x["startOffset"] == x["endOffset"] for x in progress["sources"] if not x["description"].endswith("/retries]"))


def _waiting(spark: SparkSession, sink: str, last_batch: int | None = None) -> int:
    """How many rows of an outbox stream wait for their next attempt after a batch (by default the last one)."""

    def count(name: str, condition: str) -> int:
        try:
            df = (spark.read.schema("attempts int, again boolean, batch int").option("basePath", f"{sink}/{name}")
                  .parquet(f"{sink}/{name}/batch=*").where(condition))
            return (df if last_batch is None else df.where(F.col("batch") <= last_batch)).count()
        except AnalysisException as e:
            if not _missing(e):
                raise
            return 0

    return count("retries", "true") - count("due", "again")


def outbox_final(spark: SparkSession, sink: str, name: str = "outbox") -> DataFrame:
    """Rows of the dispatcher that are settled: processed, or out of attempts
    (``name`` outbox or results); notifications and logs as they were sent."""
    df = spark.read.parquet(f"{sink}/{name}").drop("batch")
    if name == "outbox":
        return df.where(F.col("processed_at").isNotNull() | (F.col("attempts") >= S.MAX_OUTBOX_ATTEMPTS))
    if name == "results":
        return df.where((F.col("result") == "processed") | (F.col("attempts") >= S.MAX_OUTBOX_ATTEMPTS))
    return df


def ingest_batch(spark: SparkSession, payments: DataFrame, outbox: DataFrame,
                 secret: str) -> Callable[[DataFrame, int, str], None]:
    """ST5, one micro-batch of requests and the event ids that are new in it
    (:func:`with_new_ids`). The last outbox id comes from the batch before."""

    def handle(batch: DataFrame, bid: int, sink: str) -> None:
        rows = _arrived(batch, sink, "arrived", bid)
        requests = rows.where("NOT new_id").select(*[f.name for f in S.WEBHOOK_IN.fields])
        state = _batch(spark, sink, "last_id", bid - 1)
        box = outbox.select("outbox_id") if state is None else state.select("outbox_id")
        res = W.ingest(requests, payments, box, secret, new_event_ids=rows.where("new_id").select("event_id"))
        for name in ("events", "dispositions", "payment_updates", "outbox"):
            _sink_batch(sink, name, bid, res[name])
        written = spark.read.schema("outbox_id long").parquet(f"{sink}/outbox/batch={bid}")
        _sink_batch(sink, "last_id", bid, box.unionByName(written).agg(F.max("outbox_id").alias("outbox_id")))

    return handle


def with_new_ids(requests: DataFrame, secret: str) -> DataFrame:
    """A stream of requests, and one row (``new_id``) for each event id that
    an authenticated request brings for the first time. Ids are unique
    forever: they stay in the state store, keyed, and a batch looks up its
    own ids only."""
    authentic = requests.where(~blank_col(F.col("event_id")) & H.signature_ok(F.col("raw_payload"), F.col("signature"), secret))
    new = K.distinct_values(authentic, "event_id").dropDuplicates(["event_id"])
    return requests.withColumn("new_id", F.lit(False)).unionByName(new.withColumn("new_id", F.lit(True)), allowMissingColumns=True)


def webhooks_stream(spark: SparkSession, source_path: str, payments: DataFrame, outbox: DataFrame,
                    secret: str, sink: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """ST5: ingest each micro-batch (see :func:`ingest_batch`)."""
    from ..sources.schemas import WEBHOOK_IN

    sink = run_foreach(spark, source_path, WEBHOOK_IN, "webhooks", ingest_batch(spark, payments, outbox, secret),
                       files_per_trigger, sink=sink, transform=lambda s: with_new_ids(s, secret))
    return spark.read.parquet(f"{sink}/dispositions").drop("batch")


def webhook_stream_output(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """Another output of a webhook stream run: events, payment_updates or outbox."""
    return spark.read.parquet(f"{sink}/{name}").drop("batch")


def with_decisions(requests: DataFrame, window: str, permits: int, keep: str) -> DataFrame:
    """A stream of requests (seq, client_key, window_start), and one row with
    ``admitted`` for each request that the counter has decided."""
    w = requests.select("seq", "client_key", "received_at", RL.window_start(F.col("received_at"), window).alias("window_start"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = w.where(F.col("received_at").isNotNull()).select(
        "seq", "client_key", micros("window_start").alias("window_us"), micros("received_at").alias("micros"))
    decided = K.window_counter(timed, permits, keep)
    return w.drop("received_at").unionByName(decided, allowMissingColumns=True)


def limit_batch(batch: DataFrame, bid: int, sink: str) -> None:
    """ST6, one micro-batch: every request gets a decision. A request without
    a time belongs to no window and is rejected (``no_time``); one that the
    counter has not seen came after its window was closed (``late``)."""
    rows = _arrived(batch, sink, "arrived", bid)
    decided = rows.where(F.col("admitted").isNotNull()).select("seq", "admitted")
    all_ = rows.where(F.col("admitted").isNull()).drop("admitted").join(decided, "seq", "left")
    reason = (F.when(F.col("window_start").isNull(), "no_time").when(F.col("admitted").isNull(), "late")
              .when(~F.col("admitted"), "limit"))
    _sink_batch(sink, "decisions", bid, all_.select(
        "seq", "client_key", "window_start", F.coalesce("admitted", F.lit(False)).alias("admitted"),
        F.coalesce(reason == "late", F.lit(False)).alias("late"), reason.alias("reason")))


def rate_limit_stream(spark: SparkSession, source_path: str, window: str, permits: int,
                      keep: str = "1 day", files_per_trigger: int | None = None, sink: str | None = None) -> DataFrame:
    """ST6: fixed-window limiter over a stream. The state is one count for
    each (client, window). Windows that start more than ``keep`` before the
    newest one of the batches before are closed and leave the state. With
    one stateful operator, requests are late by the same watermark that
    closes windows; Spark's default, for several, lets late ones in for one
    batch more, after their window's count has gone."""
    from ..sources.schemas import WEBHOOK_IN

    sink = run_foreach(spark, source_path, WEBHOOK_IN, "ratelimit", limit_batch, files_per_trigger, sink=sink,
                       transform=lambda s: with_decisions(s, window, permits, keep),
                       conf={"spark.sql.streaming.statefulOperator.allowMultiple": "false"})
    return spark.read.parquet(f"{sink}/decisions").select("seq", "client_key", "window_start", "admitted", "reason")
