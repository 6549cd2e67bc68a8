"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on. AQE re-plans joins and
# coalesces / splits shuffle partitions at run time; the session time zone
# keeps timestamp rendering identical across executors.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpointed intermediate tables (block counts, tree lines, generated
    # templates) are removed from the shared folder once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state (X2 windows) in RocksDB: off-heap, spills to disk,
    # snapshots to the checkpoint location; survives large window state.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Shuffle files go at the end of the execution that wrote them.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(
    master: str | None = None,
    app_name: str = "logmold",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster, pass ``master=None`` and let spark-submit decide; size
    ``spark.sql.shuffle.partitions`` to the input (AQE coalesces down).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. In local mode, where one
    machine is all there is, a private folder is made if nothing is set;
    elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="logmold-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts
    the lineage, survives lost executors, and keeps column pruning. Only this write
    reads the shuffles that it made: they go with it, where the session allows that."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """After a step whose result is written: Spark drops the shuffles, broadcasts
    and checkpoints of earlier steps when the driver collects its garbage, which it
    may not do for long; its heap and the disks fill with what they leave until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logmold`` importable in the Python workers (only the
    ``mapInPandas`` generators run Python there).

    With a checkpoint folder on a local filesystem (local mode, tests) the
    package is zipped into it and added with ``addPyFile``; with remote
    storage the deployment ships it (``--py-files``) and nothing is done.
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    base = ensure_checkpoint_dir(spark)
    local = base[len("file:"):] if base.startswith("file:") else (base if "://" not in base else None)
    if local is None:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    os.makedirs(local, exist_ok=True)
    target = os.path.join(local, f"logmold-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as zf:
        for folder, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(id(sc))
