"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "vigilflow", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC time and a RocksDB state store.

    Shuffle partitions are left to the cluster's setting unless given, AQE
    coalesces them and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (single-machine tests) one temporary folder per application is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_ROOTS[application]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stored intermediate table, in the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(spark: SparkSession, df, eager: bool = True):
    """Reliable checkpoint of ``df`` in the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager)
