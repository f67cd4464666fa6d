"""Session settings the package relies on, and its scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; none of them needs a restart.
SETTINGS = {
    # Timestamps are UTC everywhere; naive and zoned columns then agree.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of voiding the event.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Keys that differ only in case collapse onto one map entry.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Custom stateful operators need a state store with column families.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def workspace(spark: SparkSession) -> str:
    """Folder of this application inside the cluster's shared checkpoint folder.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would vanish with its executor.
    """
    sc = spark.sparkContext
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir", None)
        or sc.getCheckpointDir()
    )
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="logweir-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/logweir-{sc.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, so that later reads
    neither repeat its plan nor depend on the executors that computed it."""
    workspace(df.sparkSession)
    return df.checkpoint()
