"""Tables in the folder that driver and executors share: what several later steps read is made once, and removed when nothing reads it any more."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(of: DataFrame | SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a local session gets a temporary one and a cluster an error."""
    spark = of.sparkSession if isinstance(of, DataFrame) else of
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(of: DataFrame | SparkSession, name: str) -> str:
    return f"{shared_dir(of)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = new_path(df, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing later reads."""
    for df in tables:
        remove(df.sparkSession, df._written_path)


def folder(path: str):
    """File system and path for tasks that read or write files themselves."""
    import re

    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")
