"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


# Suggested settings for a large cluster (passed at submit time; the code
# never forces them). Shuffle partitions start high and AQE coalesces them to
# ~256 MB; scan splits of 256 MB; skewed join partitions are split.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "floodlake", event_log_dir: str | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster the submitter's
    session is used instead and none of these settings are forced."""
    parts = shuffle_partitions or (8 if cores == "*" else max(int(cores), 1))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a single-machine master (``local[...]``: tests, a laptop) may run
    without it and then gets a scratch folder; on a cluster every executor
    would write to its own disk, so a missing setting is an error."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no JVM context (remote session): use the setting as is
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="floodlake-ckpt-")
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder, marked for
    removal when the application ends (results may still read it until then)."""
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", name, uuid.uuid4().hex)
    try:
        jvm = spark.sparkContext._jvm
    except Exception:  # noqa: BLE001 - remote session: the folder's own retention applies
        return path
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: later consumers start from this table (column pruning and
    filter pushdown included) instead of replaying the lineage, and the
    files survive the loss of any executor."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when nothing was written there yet;
    any other failure to read it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
