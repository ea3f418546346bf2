"""Session construction and the shared scratch location.

Library code never invents a machine-local folder on a cluster: every
persisted intermediate (stream sinks, checkpoints, snapshots) lives below
``spark.checkpoint.dir``, which the cluster names. Only a local-mode session
without that setting (tests, the bench) gets a fresh temporary folder.
"""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "berth") -> SparkSession:
    """Session for tests and the bench (local mode)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset.

    A cluster must name it (``spark.checkpoint.dir``); in local mode an unset
    value is replaced by a fresh temporary folder, as in tests.
    """
    sc = spark.sparkContext
    current = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) visible to every executor")
    path = tempfile.mkdtemp(prefix="berth-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set(_CHECKPOINT_KEY, path)
    return path


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unique folder below the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    # getCheckpointDir() returns a per-application child; keep our folders
    # next to it, one fresh folder per call so runs never collide.
    return os.path.join(base.rstrip("/"), "berth", purpose, uuid.uuid4().hex)


def release(spark: SparkSession) -> None:
    """Free the shuffle files of finished steps. Spark does so once the
    driver's JVM happens to collect their plans, which on a large heap may be
    never; until then they fill the executors' disks. Those of the step that
    just ended may go with the next call only."""
    gc.collect()  # Python's handles hold plans too
    spark.sparkContext._jvm.System.gc()


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``shared_dir`` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def partitions_of(df: DataFrame, rows: int) -> int:
    """So many partitions that each gets about ``rows`` rows of ``df``, and not
    fewer than the session's shuffles have. Counts the rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``berth`` importable in Python workers (pandas UDF closures refer
    to its functions): zip the package into the shared folder once per
    application and add it with ``addPyFile``."""
    sc = spark.sparkContext
    with _SHIP_LOCK:
        if sc.applicationId in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        target = shared_dir(spark, "pyfiles")
        local = target if "://" not in target else tempfile.mkdtemp(prefix="berth-zip-")
        os.makedirs(local, exist_ok=True)
        path = os.path.join(local, "berth.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
