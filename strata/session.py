"""Session and shared-folder helpers.

Lineage cuts, streaming checkpoints and landing copies live in the shared
folder the cluster names in ``spark.checkpoint.dir``. Only when that setting
is absent (local tests, a laptop) is a folder of our own chosen and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strata") -> SparkSession:
    """A local session for tests and the bench (the cluster brings its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session; set one only if none is named."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured and sc is not None:
        configured = sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError(f"name a folder that all executors share in {CHECKPOINT_CONF}")
        # Unset in local mode: driver and tasks are one process, so a folder of our own will do.
        configured = tempfile.mkdtemp(prefix="strata-ckpt-")
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh, never reused folder under the shared root (one per run)."""
    root = shared_root(spark)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to a fresh table in the shared folder and read again.

    Cuts the lineage (a lost executor costs no recomputation of what came before) and gives
    what follows the table's true size.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
