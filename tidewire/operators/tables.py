"""Tables in the folder that all executors share: what a loop or a reused result is written to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it (spark.checkpoint.dir). Only a session whose executors are threads
    of the driver gets one of its own where none is named; on a cluster that is an error, as every machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: what is used twice is written there")
        found = f"file://{tempfile.gettempdir()}/checkpoints/tidewire-{spark.sparkContext.applicationId}"
    return found


def write(df: DataFrame, name: str, by: list[str] | None = None, form: str = "parquet") -> str:
    """Write df to a new folder, one below it for each value of by, and return its path. The write's shuffle files, which nothing reads
    again, go with it; the session's setting for that is put back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by or []).format(form).save(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: the lineage ends there, and a lost executor loses nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
