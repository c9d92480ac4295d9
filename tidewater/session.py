"""Session creation and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL defaults that suit both a laptop and a large cluster: adaptive
# execution re-plans joins from measured stage sizes, coalesces small shuffle
# partitions and splits skewed join partitions. Anything the launcher already
# set (spark-submit --conf, spark-defaults.conf) is left alone; on a busy
# cluster also consider coalescePartitions.parallelismFirst=false.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Parquet decompresses to several times its file size; scale file-based
    # size estimates so the static broadcast threshold is checked against an
    # upper bound of the in-memory size (estimates only, never results).
    "spark.sql.sources.fileCompressionFactor": "4.0",
}


def get_spark(app_name: str = "tidewater", conf: dict | None = None,
              master: str | None = None) -> SparkSession:
    """Create or reuse a session.

    The master is left to the launcher unless given. Explicit ``conf`` is
    applied at creation; ``DEFAULT_CONF`` then fills only runtime settings
    that neither ``conf`` nor the launcher set. A session that is already
    running keeps its settings; only ``conf`` is applied to it.
    """
    conf = dict(conf or {})
    running = SparkSession.getActiveSession() is not None
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if running:
        return spark
    launcher = spark.sparkContext.getConf()
    for key, value in DEFAULT_CONF.items():
        if key not in conf and not launcher.contains(key):
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when nothing is configured and driver and executors are one local
    process (tests) a private folder is made and registered, so that
    ``DataFrame.checkpoint()`` and our written tables land in one place. On a
    cluster such a folder would be another one on every machine: an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewater-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/tidewater/{name}-{uuid.uuid4().hex[:12]}"
