"""Session construction and cluster-safe defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings applied to every session we build.  Everything else is left to the
# cluster's spark-defaults so a production deployment keeps its own sizing.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "marquee") -> SparkSession:
    """A local session for tests and the bench (one JVM, ``cores`` threads)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must point at storage all executors share; it is
    respected as is, and a missing setting is an error there (a folder of one
    machine would hold only the rows written on that machine).  Only a local
    master without the setting (tests, the bench) gets a scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        require_local(spark.sparkContext.master)
        current = tempfile.mkdtemp(prefix="marquee-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if _checkpoint_dirs.get(spark.sparkContext.applicationId) != current:
        spark.sparkContext.setCheckpointDir(current)
        _checkpoint_dirs[spark.sparkContext.applicationId] = current
    return current


_checkpoint_dirs: dict[str, str] = {}


def require_local(master: str) -> None:
    """Raise unless ``master`` runs every task in this process."""
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder all executors share (master is {master})")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder under the shared checkpoint dir for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in the file system it names (any that Spark reads)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as Parquet into the shared checkpoint
    folder and reading it back.

    Unlike ``RDD.checkpoint`` this computes the plan once (no second pass to
    save), keeps column pruning and filter pushdown for readers, and survives
    executor loss because the files live on shared storage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_many(named: list[tuple[object, str]]) -> list:
    """:func:`materialize` for independent frames, written by concurrent
    Spark jobs (one driver thread each) instead of one after another."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, len(named))) as pool:
        return list(pool.map(lambda dn: materialize(dn[0], dn[1]), named))
