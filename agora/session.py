"""Session construction and the checkpoint directory contract.

On a cluster the session is built by the caller; the library only *reads*
``spark.checkpoint.dir``.  A local directory is created only for local-mode
sessions (tests, bench), where it is the cluster-wide shared folder by
definition.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of keys beyond this many rows is joined by a shuffle instead of a broadcast.
MAX_BROADCAST_ROWS = 1_000_000

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", app: str = "agora", **conf) -> SparkSession:
    """A local-mode session for tests and benchmarks (UTC, AQE on, no UI)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, str(v))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    *and* the master is local do we create one (tests); on a cluster an unset
    directory is an error, since a machine-local folder would not survive an
    executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="agora-ckpt-", dir=os.environ.get("AGORA_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back, for results that several branches read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast hint on a materialised table of keys whose row count is within the bound; else the table as it is."""
    return F.broadcast(df) if df.count() <= (MAX_BROADCAST_ROWS if max_rows is None else max_rows) else df
