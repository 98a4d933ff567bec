"""Session helpers.

The library never creates a cluster session on its own: jobs take the
``SparkSession`` they are given.  ``local_session`` is for tests and the bench
only.  ``ensure_checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session
(the shared folder a cluster names) and falls back to a fresh scratch folder
only on a local master, as in tests.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "outletlens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # No call-site capture per column expression: building a plan takes half the calls.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    Without ``spark.checkpoint.dir`` a scratch folder is made, but only where
    driver and executors share this machine (a ``local[...]`` master): on a
    cluster each executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="outletlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df, name: str):
    """Write ``df`` once as parquet under the checkpoint folder and read it back.

    This cuts lineage like ``checkpoint()`` but computes the input only once
    (a reliable ``checkpoint()`` runs its input twice: once to count, once to
    write).  Used for intermediates that are read more than once or whose
    recomputation must not change (row ids).  ``drop`` deletes them.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    # The schema is known: reading it back needs no footer-inference job.
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(spark: SparkSession, *tables) -> None:
    """Delete tables of ``materialize`` that nothing reads any more.

    Spark frees the shuffle files of finished jobs when the driver's garbage
    is collected, which a small driver may put off for long; it is asked for
    here.
    """
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # the JVM learns of Python's dropped references only after the first
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
