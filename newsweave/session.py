"""SparkSession factory, the tables that cut a lineage, and the spread of small inputs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "newsweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; on a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(named: str | None, master: str) -> str:
    """The folder that all executors share. Only a local master may do without one; on a cluster a machine's own folder
    would be written in parts that no other executor can read."""
    if named:
        return named
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "newsweave-checkpoints")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; only where it is unset, on a single machine, set
    a folder of our own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark.conf.get("spark.checkpoint.dir", None), sc.master))


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed with what is in it when the session's process ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, *over: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read back: cuts the lineage, survives the loss of executors, is
    computed once, and lets later steps read only the columns they need. over: written tables that nothing reads from
    here on, which are deleted at once; the rest goes when the session's process ends."""
    spark = df.sparkSession
    path = shared_path(spark, "t")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    for old in over:
        dropped(old)
    return out


cut = written


def dropped(df: DataFrame) -> None:
    """Delete a written table."""
    if path := getattr(df, "_written", None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; its folder goes with the cluster's
        pass


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for a costly pass over rows. Only an input of less than a
    split (spark.sql.files.maxPartitionBytes) a core is shuffled for it; a larger one stays as it was split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
