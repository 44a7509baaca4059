"""Datasets, logs, JSON and GeoJSON on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sets

VERSION = 1


def write_dataset(tables: dict[str, DataFrame], folder: str, scope: str) -> None:
    """One Parquet folder a table; the meta table is written last, so a dataset without one is no dataset, and says how many
    rows each table got."""
    spark = next(iter(tables.values())).sparkSession
    rows = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}")
        rows[name] = seen.get["n"]
    head = [(VERSION, scope, sorted(tables), rows)]
    spark.createDataFrame(head, "version int, scope string, tables array<string>, rows map<string, long>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def read_head(spark: SparkSession, folder: str) -> dict | None:
    rows = spark.read.parquet(f"{folder}/meta").collect()
    return rows[0].asDict() if rows else None


def read_dataset(spark: SparkSession, folder: str, scope: str) -> dict[str, DataFrame] | None:
    """The tables of a dataset; none if its version or scope is another's."""
    head = read_head(spark, folder)
    if not head or head["version"] != VERSION or head["scope"] != scope:
        return None
    return {name: spark.read.parquet(f"{folder}/{name}") for name in head["tables"]}


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(folder)


def append_log(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)


def read_log(spark: SparkSession, folder: str, key: list[str], version: str) -> DataFrame:
    """The log's last record of each key."""
    return sets.last_wins(spark.read.parquet(folder), key, version)


def compact_log(spark: SparkSession, folder: str, to: str, key: list[str], version: str, used: DataFrame) -> None:
    """The last record of each key that is still used, written to a new folder."""
    read_log(spark, folder, key, version).join(used.select(*key).distinct(), key, "left_semi").write.mode("overwrite").parquet(to)


def polygon_edges(spark: SparkSession, path: str) -> DataFrame:
    """(area, ring, lat1, lon1, lat2, lon2) of the polygons of a GeoJSON file: features, collections and single geometries."""
    point, shape = "array<array<double>>", "struct<type:string,coordinates:string,geometries:string>"
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"type string, coordinates string, geometries array<{shape}>, geometry {shape}, features array<struct<geometry:{shape}>>").alias("d"))
    own = F.array(F.struct(F.col("d.type").alias("type"), F.col("d.coordinates").alias("coordinates"), F.lit(None).cast("string").alias("geometries")))
    each = F.filter(F.concat(own, F.coalesce("d.geometries", F.array().cast(f"array<{shape}>")), F.array("d.geometry"), F.coalesce(F.transform("d.features", lambda f: f["geometry"]), F.array().cast(f"array<{shape}>"))), lambda g: g["type"].isin("Polygon", "MultiPolygon"))
    shapes = doc.select(F.posexplode(each).alias("s", "g"))
    polygons = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", f"array<{point}>"))).otherwise(F.from_json("g.coordinates", f"array<array<{point}>>"))
    rings = shapes.select("s", F.posexplode(polygons).alias("p", "rings")).select("s", "p", F.posexplode("rings").alias("ring", "pts"))
    area = F.dense_rank().over(Window.orderBy("s", "p"))
    pts = rings.withColumn("area", area).select("area", "ring", F.posexplode("pts").alias("n", "pt"))
    w = Window.partitionBy("area", "ring").orderBy("n")
    pts = pts.select("area", "ring", F.col("pt")[1].alias("lat1"), F.col("pt")[0].alias("lon1"), F.lead(F.col("pt")[1]).over(w).alias("lat2"), F.lead(F.col("pt")[0]).over(w).alias("lon2"))
    return pts.where("lat2 IS NOT NULL")
