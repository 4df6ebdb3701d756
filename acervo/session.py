"""Session helpers: a local session for tests and bench, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Bytes of rows that Spark hands to a Python task at once.
ARROW_BYTES = 2 << 20


def local_session(cpus: int | str = "*", partitions: int = 8, name: str = "acervo") -> SparkSession:
    """A session for one machine (tests, bench). Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="acervo-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. A machine-local
    folder is used only where none is named and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="acervo-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def bound_batches(df: DataFrame) -> None:
    """Few bytes in an Arrow batch: a Python task holds some batches, in several forms, whatever the size of its partition."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, as a plain path means the cluster's default one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder as a table and go on from there.

    A written table outlives lost executors, is computed once however many
    branches read it, and each branch reads only the columns it needs.
    """
    path = shared_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
