"""Shared pieces: tables in the cluster's shared folder, row keys, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it (spark.checkpoint.dir). Only a session whose executors are threads
    of the driver gets one of its own where none is named; on a cluster that is an error, as every machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: what is used twice is written there")
        found = f"file://{tempfile.gettempdir()}/checkpoints/tidewire-{spark.sparkContext.applicationId}"
    return found


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there and a lost executor loses nothing. The write's shuffle
    files, which nothing reads again, go with it; the session's setting for that is put back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df with two more columns: name, a gapless number from 0 in each group in the given order, for few groups of any size, and the group's
    rows come back written (see materialise). Rows are range-sorted and counted by partition, so no task holds a group."""
    spark = df.sparkSession
    part, at, base, stand = fresh([*df.columns, name], "part", "at", "base", "stand")
    names, place = [*df.columns, part, at], df.columns.index(group)
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.schema], StructField(part, IntegerType()), StructField(at, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = batch.column(place)
            out = np.empty(batch.num_rows, np.int64)
            code = values.dictionary_encode()
            index = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for i in np.unique(index):
                where = np.flatnonzero(index == i)
                key = code.dictionary[int(i)].as_py() if i >= 0 else None
                out[where] = seen.get(key, 0) + np.arange(len(where))
                seen[key] = seen.get(key, 0) + len(where)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(out), mine, np.int32)), pa.array(out)], names=names)

    # equal rows are told apart by where they stand, so that many of them are no single range
    rows = df.withColumn(stand, F.monotonically_increasing_id())
    keys = [F.col(group), *order, F.col(stand)]
    rows = rows.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).drop(stand).mapInArrow(run, schema)
    rows = materialise(rows, "numbered")
    counts = rows.groupBy(group, part).agg(F.max(at).alias(base))
    before = F.coalesce(F.sum(F.col(base) + 1).over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_group, of_part = fresh(rows.columns, "group", "of")
    counts = counts.select(F.col(group).alias(of_group), F.col(part).alias(of_part), before.alias(base))
    near = F.col(group).eqNullSafe(F.col(of_group)) & (F.col(part) == F.col(of_part))
    # a row a partition, and one more a group
    return rows.join(F.broadcast(counts), near).select(*df.columns, (F.col(base) + F.col(at)).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """names, led by as many underscores as keep them apart from a caller's columns."""
    taken = {c.lower() for c in columns}
    lead = "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def text_key(text: str | Column) -> Column:
    """64-bit key of a text; rows with equal texts share it."""
    return F.xxhash64(text)


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (src, dst) long pairs as (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds: every round is two map-side-combined min
    aggregates and two joins on the node; hub nodes are skewed join keys, which AQE splits.
    Each round is written to the shared folder. Nodes without edges do not appear.
    """
    u, v = F.col("u"), F.col("v")
    now = (
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where(u != v).distinct()
    )
    now = materialise(now, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        large = materialise(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        old, now = now, materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).where(u != v).distinct(), "edges")
        discard(old, large)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(u.alias("node"), v.alias("root")).unionByName(now.select(v.alias("node"), v.alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """(rows, order-free checksum): equal when a round changed nothing."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(h, 24)), F.bit_xor(h)).first()
    return tuple(row)
