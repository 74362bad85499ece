"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under the session's spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; a cluster has none
    that all its machines share, so it is an error there.
    """
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own[app] = tempfile.mkdtemp(prefix="echotrace-")
    return f"{found.rstrip('/')}/echotrace-{app}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application has written; results that still read them become invalid."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of stages whose result has been written."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
