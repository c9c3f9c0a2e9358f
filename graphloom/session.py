"""Session set-up and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting that names a folder which the driver and all executors share.
SHARED = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session with the settings the operators expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is used only when that
    is unset and the session runs on one machine; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get(SHARED) or spark.conf.get(SHARED, None)
    if found:
        return found
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError(f"set {SHARED} to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files survive the loss of any executor, and later stages never repeat what made them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing is to read it again."""
    spark = df.sparkSession
    top = f"{shared_dir(spark).rstrip('/')}/tables/"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(top).toUri().getPath()):
            path.getFileSystem(conf).delete(path, True)
