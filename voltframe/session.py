"""SparkSession construction and shared-folder settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Adaptive execution re-plans joins from runtime sizes
# (broadcast only below ``autoBroadcastJoinThreshold``), coalesces small shuffle
# partitions and splits skewed join partitions.
_CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def scale_conf(input_bytes: int, cores: int) -> dict[str, str]:
    """Sizing for a job reading ``input_bytes`` on ``cores`` executor cores.

    Scan splits of 256 MB; the initial shuffle partition count covers the input at
    ~256 MB per partition (at least 2 waves of the cluster's cores), and adaptive
    execution coalesces what turns out small at runtime. E.g. 100 TB on 8,000 cores:
    409,600 initial shuffle partitions, each task well inside executor memory.
    """
    parts = max(2 * cores, -(-input_bytes // TARGET_PARTITION_BYTES))
    return {
        "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * TARGET_PARTITION_BYTES),
    }


def get_session(
    master: str | None = None,
    app_name: str = "voltframe",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
    input_bytes: int | None = None,
    cores: int | None = None,
) -> SparkSession:
    """Return a session with the settings above.

    ``master`` is only applied when given (on a cluster the launcher decides). Either
    pass ``shuffle_partitions`` directly (local tests use the core count) or the expected
    ``input_bytes`` and ``cores`` to size partitions with :func:`scale_conf`.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_CORE_CONF)
    if input_bytes is not None and cores is not None:
        conf.update(scale_conf(input_bytes, cores))
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in conf.items():
        if not key.startswith("spark.ui") and not key.startswith("spark.driver"):
            try:
                spark.conf.set(key, value)
            except Exception:  # static conf already fixed by the launcher
                pass
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` as the cluster sets it. Where it is unset, a folder
    already given to ``setCheckpointDir`` is used; failing that, a session whose executors
    are threads of this process (``local[...]``, as in tests) gets a private folder, and
    any other session an error, because executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return shared
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voltframe-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for a written intermediate table."""
    return os.path.join(checkpoint_dir(spark), "tables", name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used where several branches of a plan consume the same expensive intermediate: the
    lineage is cut (a lost executor does not recompute it), and unlike an RDD checkpoint
    the Parquet copy keeps column pruning and filter pushdown for each consumer. A caller
    that has consumed the table frees it with :func:`drop_materialized`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`materialize`; nothing reads them any more.

    Only folders directly below the shared ``tables`` folder are deleted.
    """
    for df in tables:
        spark = df.sparkSession
        root = os.path.join(checkpoint_dir(spark), "tables")
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if os.path.basename(os.path.dirname(folder)) != "tables":
                raise ValueError(f"{folder} is not a table below {root}")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
