"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "q10_departures", "q04_vehicles", "q20_stations", "q12_next_per_way", "q14_trip_detail", "j04_semi_join_pushdown", "j08_interval_stabbing", "j13_shared_ways",
    "w01_carry_forward", "w03_fill_times", "a02_dictionary_encode", "a01_calls_per_stop", "a12_agreed_delay", "u01_calendar_algebra", "q37_search_stops",
    "q35_share_delays", "w11_hourly_frequency", "a11_lines_components",
]


def feed(spark, folder: str) -> str:
    """The derived timetable as a feed's zip, its stops in the box of the import."""
    import zipfile

    from pyspark.sql import functions as F

    from tidewire.plans.transit import view

    clock = lambda c: F.format_string("%d:%02d:%02d", F.floor(F.col(c) / 3600).cast("int"), (F.floor(F.col(c) / 60) % 60).cast("int"), (F.col(c) % 60).cast("int"))
    trips = view(spark, SF_DIR, "dv_trips")
    tables = {
        "stops": view(spark, SF_DIR, "dv_stops").select("stop_id", F.col("name").alias("stop_name"), F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon")),
        "routes": trips.select(F.col("agency").alias("route_id"), F.lit(3).alias("route_type")).distinct(),
        "trips": trips.select("trip_id", F.col("agency").alias("route_id"), F.lit("s").alias("service_id")),
        "stop_times": view(spark, SF_DIR, "dv_stop_times").select("trip_id", "stop_id", F.col("pos").alias("stop_sequence"), clock("arr_s").alias("arrival_time"), clock("dep_s").alias("departure_time")),
        "calendar": spark.range(1).select(F.lit("s").alias("service_id"), F.lit("20240101").alias("start_date"), F.lit("20240131").alias("end_date"), *[
            F.lit(1).alias(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")]),
        "calendar_dates": spark.range(1).select(F.lit("s").alias("service_id"), F.lit("20240105").alias("date"), F.lit(2).alias("exception_type")),
    }
    path = os.path.join(folder, "feed.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            z.writestr(f"{name}.txt", df.toPandas().to_csv(index=False))
    return path


def import_time(spark) -> dict:
    """Seconds from a zip to its four tables, whole trips cut to a box."""
    import tempfile

    from tidewire.sources import gtfs

    with tempfile.TemporaryDirectory() as folder:
        path = feed(spark, folder)
        began = time.time()
        rows = {name: df.count() for name, df in gtfs.import_feed(spark, path, (49.0, 10.8, 49.05, 11.3)).items()}
        return {"seconds": round(time.time() - began, 3), "rows": rows}


def main() -> None:
    from pyspark.sql import SparkSession

    from tidewire.plans import QUERIES
    from tidewire.plans.transit import view

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("tidewire-bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    for name in ("dv_stop_times", "dv_trips", "dv_hops"):  # derived once and read back by the queries
        view(spark, SF_DIR, name)
    derivation = round(time.time() - began, 3)
    times, first = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the second is without compilation
            began = time.time()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name], first[name] = round(min(runs), 3), round(runs[0], 3)
    imported = import_time(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "first_runs": first, "derivation": derivation, "import_feed": imported}))
    spark.stop()


if __name__ == "__main__":
    main()
