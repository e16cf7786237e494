"""Session helpers: the settings every job relies on, and the shared
checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the jobs assume. AQE re-plans joins from measured sizes (a
# shuffled side that turns out small becomes a broadcast), coalesces small
# shuffle partitions and splits skewed join partitions.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's partition also where what follows wants the key's rows
    # together and must shuffle once more (joins under an aggregate or a join)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # A union of joins is shuffled like any other rows. Spark 4.1 would take it
    # as partitioned like its parts and join it without a shuffle, but AQE merges
    # the partitions of each part by that part's own size, so they need not match.
    "spark.sql.unionOutputPartitioning": "false",
    # Broadcast only what is measured small: the planner's estimate first,
    # then AQE's runtime size of the shuffled side; beyond it a shuffle join.
    # Both sizes are of compressed columns or rows: keys take about a byte
    # each in a Parquet file and ten in a shuffle, but some sixty in the hash
    # table that the driver builds, and several joins build theirs at once.
    "spark.sql.autoBroadcastJoinThreshold": str(2 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(8 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    # keyed stream state on the executors' disks, with a change log in the checkpoint
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(master: str | None = None, app: str = "subsight",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session for tests, bench and local runs. On a cluster, pass no
    master and let spark-submit decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SQL_SETTINGS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_settings(spark)
    return spark


def apply_settings(spark: SparkSession) -> None:
    for k, v in SQL_SETTINGS.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # a locked conf on a managed cluster stays as it is
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or a directory already set
    on the context). Only in local mode with neither set - tests - a fresh
    temporary directory is made and registered; on a cluster that is an
    error."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            d = None
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach "
                               "(a machine-local temporary folder does not survive on a cluster)")
        d = tempfile.mkdtemp(prefix="subsight-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
