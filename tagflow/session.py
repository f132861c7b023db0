"""Session helpers: build a local session for tests/bench and tune runtime SQL confs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL confs the operators rely on.  All are plain public Spark confs.
#  * AQE re-plans joins with real sizes (a broadcast is only chosen when the
#    measured side is small) and splits skewed shuffle partitions.
#  * requireAllClusterKeysForCoPartition=false lets a join on (doc_id, x) reuse
#    an existing hash partitioning on doc_id, so the token table is shuffled
#    once per pipeline instead of once per join.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    # a union of two doc-partitioned inputs must not claim their partitioning:
    # with co-partitioned joins that claim mismatches the union's partition count
    "spark.sql.unionOutputPartitioning": "false",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tagflow`` importable in Python workers (pandas UDFs, mapInPandas) with
    ``addPyFile``: the package's sources are zipped once per application and served
    to executors by the driver, whatever the workers' working directory is."""
    import zipfile

    import tagflow
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(tagflow.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="tagflow-code-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime confs the operators are designed for and ship the package (idempotent)."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tagflow") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_MADE: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table below the shared checkpoint folder; ``release`` deletes it."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    if spark.sparkContext.applicationId not in _MADE:
        atexit.register(_release_at_exit)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def kept_rdd(spark: SparkSession, rdd):
    """An RDD written once to the shared checkpoint folder, its partitions as they are; ``release`` deletes it."""
    checkpoint_dir(spark)
    rdd.checkpoint()
    rdd.foreachPartition(lambda _: None)
    if spark.sparkContext.applicationId not in _MADE:
        atexit.register(_release_at_exit)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(rdd.getCheckpointFile())
    return rdd


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table this job wrote (Hadoop FileSystem API, works on any shared store)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application.  Call it when no result that reads them is used any more
    (DataFrames are lazy, so the library can't know); it also runs when the driver's Python ends."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        delete_path(spark, path)
    return len(made)


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Without it a cluster raises.  Only in local mode, where driver and executors are one
    process, a fresh folder is made and registered if nothing is configured.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="tagflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf
