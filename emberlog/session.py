"""Sessions, shared scratch space and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "emberlog") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``, removed when the application ends.

    Where that setting is absent, a session on one machine (tests, notebooks) gets a local temporary folder; on a
    cluster, where every executor would write to a disk of its own, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='emberlog-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        _on_exit(spark, base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _on_exit(spark, path)
    return path


def _on_exit(spark: SparkSession, path: str) -> None:
    """Have the folder made and removed with the driver's end, where the session has a driver of its own."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001 - a remote session keeps its folders
        return
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(conf)
    fs.mkdirs(to)
    fs.deleteOnExit(to)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, columns stay compressed."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)  # the folder is there, empty
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
