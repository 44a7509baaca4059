"""Derived tables that are made once and read again for as long as what they come from stays the same."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import shared_dir, write

Extent = tuple[float, float, float, float]  # south, west, north, east
ENTRIES = "name string, version string, scope string, sources string, south double, west double, north double, east double, made_at timestamp, place string"


def files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change) of every file at or below paths, by path; paths that are absent have none."""
    try:
        jvm = spark._jvm
    except Exception:  # a remote session
        jvm = None
    out: list[tuple[str, int, int]] = []
    if jvm is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        out = [(r[0], r[1], int(r[2].timestamp() * 1000)) for r in found.select("path", "length", "modificationTime").collect()]
        return sorted(out)
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            below = fs.listFiles(at, True)
            while below.hasNext():
                f = below.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes whenever a file of paths is added, removed, resized or written anew. Files whose names Spark skips do not count."""
    seen = [f for f in files(spark, paths) if not f[0].rsplit("/", 1)[-1].startswith(("_", "."))]
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


_known: dict[tuple, tuple[str, StructType]] = {}  # of this session: key, time and extent to the table's place and columns


def _inside(inner: Extent | None, outer: Extent | None) -> bool:
    if outer is None:
        return True
    return inner is not None and outer[0] <= inner[0] and outer[1] <= inner[1] and inner[2] <= outer[2] and inner[3] <= outer[3]


def entries(spark: SparkSession) -> DataFrame:
    """All tables made so far, one row each."""
    at = f"{shared_dir(spark)}/derived"
    return spark.read.schema(ENTRIES).parquet(at) if files(spark, [at]) else spark.createDataFrame([], ENTRIES)


def superseded(found: DataFrame) -> DataFrame:
    """Entries with a newer one of the same name, version and scope whose sources differ: their tables are of no more use."""
    newest = found.groupBy("name", "version", "scope").agg(F.max_by("sources", "made_at").alias("_now"))
    return found.join(newest, ["name", "version", "scope"]).where("sources <> _now").drop("_now")


def derived(
    spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame], version: str = "1", scope: str = "", extent: Extent | None = None, most_age_s: float | None = None,
    by: list[str] | None = None,
) -> tuple[DataFrame, bool]:
    """(table, whether it was there already): the stored table of this name if it was made by the same version, for the same scope, from sources
    whose files have not changed since, for an extent that covers the asked one (None: everywhere), and at most so long ago; otherwise what
    make returns, stored in the shared folder, by the values of the columns by, its last ones, and entered.

    The newest fitting table is taken. A table whose files are gone is made again. A table is entered after it is whole, so that readers never meet half of
    one; two sessions that make the same table at once enter both, and either serves. A source that changes while its table is made
    counts as changed: its files are looked at before."""
    key = (shared_dir(spark), name, version, scope, fingerprint(spark, sources))
    found = None
    for (*at, made, around), stored in reversed(_known.items()):
        if tuple(at) == key and _inside(extent, around) and _young(made, most_age_s) and files(spark, [stored[0]]):
            found = stored
            break
    if found is None:
        fit = entries(spark).where((F.col("name") == name) & (F.col("version") == version) & (F.col("scope") == scope) & (F.col("sources") == key[4]))
        for r in fit.orderBy(F.desc("made_at")).collect():  # few: one an extent
            around = None if r.south is None else (r.south, r.west, r.north, r.east)
            if _inside(extent, around) and _young(r.made_at, most_age_s) and files(spark, [r.place]):
                _known[(*key, r.made_at, around)] = found = r.place, spark.read.parquet(r.place).schema
                break
    if found is not None:
        return spark.read.schema(found[1]).parquet(found[0]), True
    table = make()
    place, now = write(table, name, by), dt.datetime.now()
    row = (name, version, scope, key[4], *(map(float, extent) if extent else (None,) * 4), now, place)
    spark.createDataFrame([row], ENTRIES).coalesce(1).write.mode("append").parquet(f"{shared_dir(spark)}/derived")
    _known[(*key, now, extent)] = place, table.schema
    return spark.read.schema(table.schema).parquet(place), False


def _young(made: dt.datetime, most_age_s: float | None) -> bool:
    return most_age_s is None or (dt.datetime.now() - made).total_seconds() <= most_age_s


def bucketed(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame], keys: list[str], buckets: int) -> DataFrame:
    """make's rows as a table of the session's catalog, in the shared folder, dealt into buckets by keys and sorted by them in each: tables with the same keys and number
    meet in a join without a shuffle, and a lookup reads one bucket. Made again when a file of sources changes. A bucket is one file."""
    table = f"{name}_{fingerprint(spark, sources)[:16]}_{buckets}"
    if not spark.catalog.tableExists(table):
        rows = make().repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:])
        rows.option("path", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}").saveAsTable(table)
    return spark.table(table)
