"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where the shared folder is a local one, Hadoop starts a chmod for every file, again after closing it and for its checksum file: three
#: processes a file, each of which is counted with all of the JVM's memory until it has a program of its own. Without checksum files it is one.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset on one machine (tests), a temporary one is set, on a cluster an error is raised."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        opt = jsc.getCheckpointDir()
        found = opt.get() if opt.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and any executor can reread it."""
    return cut_at(df, name, **options)[0]


def cut_at(df: DataFrame, name: str = "cut", **options: str) -> tuple[DataFrame, str]:
    """cut, with the path for remove(); options are those of the Parquet writer."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.options(**PLAIN_FILES, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of cut_at() that nothing will read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
