"""Tables in the shared folder that come and go: listing, claiming and dropping paths by Spark's own file systems."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import shared_dir


def _at(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    fs, path = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _at(spark, path)
    return fs.exists(found)


def claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file, and say whether it was this call that made it: of several writers one succeeds.

    Distributed file systems make a file that must not exist in one step; on a
    local disk Hadoop looks first and makes it then, so Java's own call is used there.
    """
    fs, found = _at(spark, path)
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(found.getParent())
        return bool(spark.sparkContext._jvm.java.io.File(found.toUri().getPath()).createNewFile())
    try:
        fs.create(found, False).close()
    except Py4JJavaError as error:
        if fs.exists(found):
            return False
        raise error
    return True


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of our own that nothing reads any more."""
    fs, found = _at(spark, path)
    fs.delete(found, True)


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nobody else has."""
    return f"{shared_dir(spark).rstrip('/')}/orrery/{tag}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> DataFrame:
    """``df`` written and read back, which cuts its lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
