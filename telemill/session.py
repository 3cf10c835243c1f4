"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every telemill job relies on: UTC wall clock (timestamps are
# naive), AQE for runtime partition coalescing / skew splitting / broadcast
# conversion from measured sizes.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "telemill", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass the cluster's own builder settings."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder for checkpoints and persisted intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). ``fallback`` is only used when nothing is configured,
    which is the case in local tests; on a cluster the setting must name a
    shared file system.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    target = conf_dir or fallback
    if not target:
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def shared_folder(spark: SparkSession, name: str = "telemill") -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing, a session on one machine gets a temporary
    folder named in it; on a cluster that is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
        top = tempfile.mkdtemp(prefix="telemill-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
