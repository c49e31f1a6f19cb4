"""Session helpers.

Library operators never create sessions; they take DataFrames.  These helpers
are for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Session option: spread CPU-heavy per-row work over at least this many
# partitions.  Unset on a cluster, where scans already have many splits.
MIN_SCAN_PARTITIONS = "spark.tillroll.minScanPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over ``spark.tillroll.minScanPartitions`` partitions when set.

    Parquet files written as one row group scan as one task; before a
    CPU-heavy per-row expression (text scoring, CSV parsing) that leaves all
    but one core idle.  Left unset, this is the identity.
    """
    n = df.sparkSession.conf.get(MIN_SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tillroll") -> SparkSession:
    """A local session tuned for small inputs (tests, bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(MIN_SCAN_PARTITIONS, str(cpus if isinstance(cpus, int) else os.cpu_count()))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this must be set by the deployment to a shared filesystem.
    Only when it is unset (local tests) do we create a scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir() or None
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="tillroll-ckpt-")      # local runs and tests only
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back, in folders by the columns ``by``.

    Cuts lineage with a single job (a reliable ``checkpoint()`` of an
    unpersisted plan computes it twice: once to count, once to write).
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillroll-tables/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
