"""Timetables: zip members as text, CSV tables by header, trips cut to an area, times filled, calendars expanded."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time
from ..functions.text import tidy_name
from ..operators import joins, sequences, sets
from ..operators.tables import materialise, write
from .store import open_file

DATASET_VERSION = 1
TABLES = {
    "stops": (["stop_id", "stop_name", "stop_lat", "stop_lon"], ["parent_station", "location_type", "platform_code"]),
    "routes": (["route_id", "route_type"], ["route_short_name", "route_long_name", "agency_id", "route_color", "route_text_color"]),
    "trips": (["trip_id", "route_id", "service_id"], ["trip_headsign"]),
    "stop_times": (["trip_id", "stop_id", "stop_sequence"], ["arrival_time", "departure_time", "stop_headsign", "pickup_type", "drop_off_type"]),
    "calendar": (["service_id", "start_date", "end_date", *sets.DAYS], []),
    "calendar_dates": (["service_id", "date", "exception_type"], []),
    "agency": (["agency_name"], ["agency_id"]),
}


def unzip(spark: SparkSession, path: str, lines: int = 50_000, only: str | None = None) -> DataFrame:
    """(file, part, text) of the text members of a zip file, or of one of them: the driver reads the directory alone, each member is a task that
    streams it and cuts it at line ends, so a row is at most so many lines, whatever the sizes of member and zip."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        names = [n for n in z.namelist() if not n.endswith("/") and only in (None, n)]

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["file"]:
                with open_file(path) as f, zipfile.ZipFile(f) as z, z.open(name) as raw:
                    text = io.TextIOWrapper(raw, "utf-8-sig", newline=None)
                    part = 0
                    while rows := [line for _, line in zip(range(lines), text, strict=False)]:
                        yield pd.DataFrame({"file": [name], "part": [part], "text": ["".join(rows)]})
                        part += 1

    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    return files.mapInPandas(members, "file string, part int, text string")


def unpack(spark: SparkSession, path: str, only: str | None = None) -> str:
    """Write the text members of a zip once, each as lines in the folder file=<member> of the folder that is returned: a member is unpacked by one
    task, as it can only be read from its start, but its lines are then read by as many tasks as their bytes ask for."""
    return write(unzip(spark, path, only=only).select("file", F.col("text").alias("value")), "unpacked", ["file"], "text")


def first_line(path: str, member: str) -> str | None:
    """The first line of a zip's member that is not empty; no more of it is unpacked than that takes."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        if member not in z.namelist():
            return None
        with z.open(member) as raw:
            return next((line for line in map(str.rstrip, io.TextIOWrapper(raw, "utf-8-sig", newline=None)) if line), None)


def read_table(spark: SparkSession, path: str, table: str, unpacked: str | None = None) -> DataFrame:
    """A table of a feed's zip (or of a folder of its .txt files) with the columns of TABLES as text, by name: any column order,
    a byte order mark, CRLF, quotes with doubled quotes and empty lines are read; a missing required column is an error, a
    missing optional one is empty. line grows with the row's place in the file. unpacked is the folder of unpack, if the zip was unpacked before."""
    needed, optional = TABLES[table]
    if path.endswith(".zip"):
        first = first_line(path, f"{table}.txt")
        if first is None:
            raise ValueError(f"{table}: empty")
        # a task's rows are of one stretch of the file, so the stretch's first byte and the row's place in it are in the file's order
        line = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows = spark.read.text(f"{unpacked or unpack(spark, path, f'{table}.txt')}/file={table}.txt").select(line.alias("line"), "value").where(F.rtrim("value") != "")
    else:
        rows = spark.read.option("lineSep", "\n").text(f"{path}/{table}.txt").withColumn("line", F.monotonically_increasing_id())
        rows = rows.select("line", F.regexp_replace("value", r"\r$|^﻿", "").alias("value")).where(F.col("value") != "")
        head = rows.orderBy("line").limit(1).select("value").first()
        if head is None:
            raise ValueError(f"{table}: empty")
        first = head[0]
    columns = [c.strip().strip('"').lstrip("﻿") for c in first.split(",")]
    missing = [c for c in needed if c not in columns]
    if missing:
        raise ValueError(f"{table}: missing column {missing[0]}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = rows.where(F.rtrim("value") != first.rstrip()).select("line", F.from_csv("value", schema, {"quote": '"', "escape": '"'}).alias("r"))
    return parsed.select("line", *[F.coalesce(f"r.{c}", F.lit("")).alias(c) if c in columns else F.lit("").alias(c) for c in [*needed, *optional]])


def import_feed(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> dict[str, DataFrame]:
    """stops, trips, stop_times and service_dates of the trips that touch the box (south, west, north, east): whole trips are kept,
    missing times filled, trips with times missing at an end dropped, parents of kept stops kept."""
    unpacked = unpack(spark, path) if path.endswith(".zip") else None
    table = lambda name: read_table(spark, path, name, unpacked)
    stops = table("stops").select(
        "stop_id", tidy_name(F.col("stop_name")).alias("name"), F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon"),
        F.nullif("parent_station", F.lit("")).alias("parent"), F.nullif("platform_code", F.lit("")).alias("platform"))
    stops = materialise(stops, "stops")
    inside = stops.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    times = table("stop_times").select(
        "trip_id", F.col("stop_sequence").cast("int").alias("stop_seq"), "stop_id",
        time.parse_time(F.col("arrival_time")).alias("arr_s"), time.parse_time(F.col("departure_time")).alias("dep_s"), F.nullif("stop_headsign", F.lit("")).alias("headsign"))
    times = joins.keep_groups_touching(times, "trip_id", inside, "stop_id")
    times = materialise(sequences.fill_times(times, ["trip_id"], "stop_seq", "arr_s", "dep_s"), "stop_times")  # read by all that follows
    trips = table("trips").join(times.select("trip_id").distinct(), "trip_id", "left_semi")
    trips = trips.join(table("routes").drop("line"), "route_id").select(
        "trip_id", "route_id", "service_id", F.nullif("trip_headsign", F.lit("")).alias("headsign"), F.col("route_type").cast("int").alias("route_type"), F.col("route_short_name").alias("short"))
    trips = materialise(trips, "trips")
    day = lambda c: F.to_date(c, "yyyyMMdd")
    weekly = table("calendar").select("service_id", day("start_date").alias("start_date"), day("end_date").alias("end_date"), *[F.col(d).cast("int").alias(d) for d in sets.DAYS])
    other = table("calendar_dates").select("service_id", day("date").alias("date"), F.col("exception_type").cast("int").alias("exception_type"), "line")
    used = trips.select("service_id").distinct()
    dates = sets.service_dates(weekly, other).join(used, "service_id", "left_semi")
    kept = joins.parent_closure(stops.select("stop_id", "parent"), "stop_id", "parent", times.select("stop_id").distinct())
    return {"stops": stops.join(kept, "stop_id", "left_semi"), "trips": trips, "stop_times": times.join(trips.select("trip_id"), "trip_id", "left_semi"), "service_dates": dates}
