"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings that hold wherever the submit configuration says nothing else.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Only for a local session of our own: the test box.
LOCAL_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.driver.memory": "16g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app_name: str = "tallyspark",
              extra: dict | None = None, input_bytes: int | None = None) -> SparkSession:
    """Return (or create) a session. What the submit configuration sets is kept:
    shuffle, memory and broadcast sizes come from there, from ``input_bytes``
    (see :func:`cluster_conf`) or from an explicit argument, else from Spark."""
    local = bool(master and master.startswith("local"))
    conf = dict(LOCAL_CONF) if local else {}
    if input_bytes is not None:
        conf.update(cluster_conf(input_bytes))
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in (conf if local else extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in {**DEFAULT_CONF, **conf}.items():
        if k.startswith("spark.sql.") and not given.contains(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024,
                 executors_cores: int | None = None) -> dict:
    """Shuffle sizing for a large run: enough initial shuffle partitions that
    each holds about ``target_partition_bytes`` of input (so tasks fit in
    executor memory without spilling much), AQE left to coalesce small ones
    and split skewed ones. At 100 TB this gives ~400k initial partitions,
    coalesced at run time to what the shuffled (pre-aggregated) data needs."""
    n = max(200, -(-int(input_bytes) // target_partition_bytes))
    if executors_cores:
        n = max(n, 2 * executors_cores)
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 512 * 1024 * 1024)),
    }


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read back: cuts the lineage, survives the
    loss of executors, and what depends on a partitioning is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local-mode session
    without it (tests) gets a fresh scratch folder; on a cluster a missing
    setting is an error, never a machine-local folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="tallyspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d
