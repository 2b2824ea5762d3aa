"""Session construction and checkpoint handling."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC for epoch <-> timestamp, ANSI (the 4.x default) so bad
# casts fail loudly unless a try_* function is used, and AQE so join strategy, partition
# coalescing and skew splitting are decided from runtime statistics.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for the 100 TB target (~1000 executors): start shuffles wide and let AQE coalesce
# to ~256 MB partitions (sized by bytes, not by core count, on a shared cluster), split input
# files at 256 MB, split skewed join partitions above 512 MB, and allow runtime broadcasts of
# sides up to 64 MB (AQE measures them). Spark spills sorts, aggregations and joins itself
# once partitions are bounded like this.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # state that grows with the users belongs on disk, not on the executors' heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "reelsift", extra: dict | None = None, profile: str = "local") -> SparkSession:
    """Session with ``BASE_CONF``; ``profile="cluster"`` adds ``CLUSTER_CONF``. Settings the
    cluster already defines (for example ``spark.checkpoint.dir``) are left as they are."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, conf[k])
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; only when none is configured and the master is
    local (tests) create a scratch one. A cluster without ``spark.checkpoint.dir`` is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):  # executors would write to their own disks
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="reelsift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df, name: str = "cut"):
    """Cut lineage with a written table: ``df`` is written once as parquet into the shared
    checkpoint folder and read back (one job; survives executor loss). A reliable
    ``DataFrame.checkpoint`` would compute the lineage twice (once for the action, once for
    the checkpoint write) unless the data were cached first."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # known schema: no footer-inference job


def free(*tables: DataFrame, shuffles: bool = False) -> None:
    """Delete tables of :func:`cut_lineage` that nothing reads any more (only what stands below the
    checkpoint folder's tables is deleted). ``shuffles``: let Spark drop the files of finished plans too."""
    for df in tables:
        spark = df.sparkSession
        jvm, home = spark._jvm, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().equals(jvm.org.apache.hadoop.fs.Path(home)):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if shuffles:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()
