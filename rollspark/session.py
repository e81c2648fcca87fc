"""Session defaults that matter at scale.

The settings favour runtime re-planning (AQE) over hand tuning: partitions are
coalesced after a shuffle, skewed join partitions are split, and small join
sides are broadcast only after AQE has measured them.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rollspark") -> SparkSession:
    """Return (or create) a session with the defaults above.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # one JVM is driver and executors: give it the machine's memory
            # (PySpark's default is 1g); a cluster sets this in spark-submit
            builder = builder.config("spark.driver.memory", os.environ.get("ROLLSPARK_LOCAL_MEMORY", "16g"))
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is read from the session and used
    as is. Only when it is unset (local tests) a scratch folder is created.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="rollspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df, name: str = "materialized"):
    """Write ``df`` once as a parquet table under the shared checkpoint folder
    and return a scan of it: cuts lineage for operators that read their input
    several times. Unlike ``DataFrame.checkpoint()`` (which runs the plan once
    to count and again to write), the plan runs exactly once, and the files
    outlive any executor."""
    import uuid
    path = os.path.join(checkpoint_dir(df.sparkSession), "materialized", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
