"""Rasters, snapping to edges, global ranks, and the thinning of a zoomed-out map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, hashing
from .tables import materialise

HIGH, WIDE = 0.01, 0.015  # degrees of a raster cell
RANKS = 1 << 32
SCREEN = (1920, 1080)  # pixels
SQUARE = 32
ZOOM_MIN, ZOOM_ALL = 5, 12


def cells(points: DataFrame, *keep: str) -> DataFrame:
    out = points.select(*keep, F.floor(F.col("lat") / HIGH).alias("row"), F.floor(F.col("lon") / WIDE).alias("col"))
    return out if keep else out.distinct()


def spread(area: DataFrame, most: int) -> DataFrame:
    """(row, col, distance) of all cells at most most cells from the area, the distance counted over the eight neighbours."""
    steps = F.sequence(F.lit(-most), F.lit(most))
    out = area.select("row", "col", F.explode(steps).alias("dr")).select("row", "col", "dr", F.explode(steps).alias("dc"))
    return out.groupBy((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(
        F.min(F.greatest(F.abs("dr"), F.abs("dc"))).cast("long").alias("distance"))


def rasterise(edges: DataFrame) -> DataFrame:
    """(area, row, col) of cells whose middle is inside: every edge gives the columns it crosses a row's middle line at, and a
    cell is inside if an odd number of crossings lies to its west (holes work)."""
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    first, last = F.ceil(low / HIGH - 0.5), F.ceil(high / HIGH - 0.5) - 1
    rows = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    y = (F.col("row") + 0.5) * HIGH
    x = F.col("lon1") + (y - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) * (F.col("lon2") - F.col("lon1"))
    w = Window.partitionBy("area", "row").orderBy("x")
    runs = rows.select("area", "row", x.alias("x")).withColumns({"n": F.row_number().over(w), "to": F.lead("x").over(w)}).where("n % 2 = 1")
    start, stop = F.ceil(F.col("x") / WIDE - 0.5), F.ceil(F.col("to") / WIDE - 0.5) - 1
    return runs.where(start <= stop).select("area", "row", F.explode(F.sequence(start, stop)).alias("col")).distinct()


def snap(points: DataFrame, edges: DataFrame, radius_m: float, most: int) -> DataFrame:
    """The nearest edges (x1, y1, x2, y2) of each point (id, x, y) within radius_m, at most most. Edges stand in all grid cells
    of their box, points in theirs and the eight around; cells are as high as the radius."""
    high = radius_m / geo.METRES_PER_DEGREE
    wide = high / 0.342
    span = lambda a, b, size: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    there = edges.withColumn("_cy", F.explode(span("y1", "y2", high))).withColumn("_cx", F.explode(span("x1", "x2", wide)))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    asked = points.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near))
    asked = asked.withColumns({"_cy": F.floor(F.col("y") / high) + F.col("_dy"), "_cx": F.floor(F.col("x") / wide) + F.col("_dx")}).drop("_dy", "_dx")
    keys = [c for c in edges.columns if c not in ("x1", "y1", "x2", "y2")]
    met = asked.join(there, ["_cy", "_cx"]).drop("_cy", "_cx").dropDuplicates(["id", *keys])
    k = F.cos(F.radians("y"))
    ex, ey = (F.col("x2") - F.col("x1")) * k, F.col("y2") - F.col("y1")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - F.col("x1")) * k * ex + (F.col("y") - F.col("y1")) * ey) / (ex * ex + ey * ey)))
    dx, dy = (F.col("x1") + t * (F.col("x2") - F.col("x1")) - F.col("x")) * k, F.col("y1") + t * ey - F.col("y")
    out = met.withColumn("metres", F.sqrt(dx * dx + dy * dy) * geo.METRES_PER_DEGREE).where(F.col("metres") <= radius_m)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("metres", 3), *keys))
    return out.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def global_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank from 1 in the order: a range sort, numbers inside each range, and the ranges' sizes before it."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    before = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = before.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))  # a row a range
    return local.join(F.broadcast(before), "_p").withColumn("rank", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def rank_in_groups(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with at, their number from 0 in their group's order, for groups of any size: the rank among all rows less that of the
    group's first."""
    ranked = materialise(global_rank(rows, [group, *order]), "ranked")
    first = ranked.groupBy(group).agg(F.min("rank").alias("_first"))
    return ranked.join(first, group).withColumn("at", F.col("rank") - F.col("_first")).drop("_first", "rank")


def placed(vehicles: DataFrame) -> DataFrame:
    return vehicles.withColumns({"x": geo.mercator_x(F.col("lon")), "y": geo.mercator_y(F.col("lat"))})


def firsts(at: DataFrame, zoom: int, name: str) -> DataFrame:
    """at with name: whether a vehicle has the lowest rank of its kind in its square of the map at the zoom."""
    along = 512 * 2**zoom / SQUARE
    w = Window.partitionBy("mode", F.floor(F.col("x") * along), F.floor(F.col("y") * along)).orderBy("rank", "id")
    return at.withColumn(name, F.row_number().over(w) == 1)


def _busiest(by_cell: DataFrame, value: str, *group: str) -> DataFrame:
    """The most of value on any 2 x 2 cells: a cell's count stands for the four screens that hold it."""
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    s = by_cell.withColumn("_d", F.explode(four)).groupBy(*group, (F.col("cx") - F.col("_d.a")).alias("sx"), (F.col("cy") - F.col("_d.b")).alias("sy")).agg(F.sum(value).alias("n"))
    return s.groupBy(*group).agg(F.max("n").alias("most"))


def shares(vehicles: DataFrame, budget: int = 2500, few: int | None = None, steps: int = 10) -> DataFrame:
    """(zoom, mode, share): the largest common share with which no screen holds more than the budget, at least few of a kind on its
    busiest screen; no zoom shows a smaller share than the zoom before. The search halves over aggregates: each step is one
    scan of the counts by cell, kind and rank level, whose size is that of the map, not of the vehicles."""
    few = budget // 20 if few is None else few
    spark, at = vehicles.sparkSession, placed(vehicles)
    out, above = [], {}
    for zoom in range(ZOOM_ALL - 1, ZOOM_MIN - 1, -1):
        world = 512 * 2**zoom
        cx, cy = F.floor(F.col("x") * (world / (SCREEN[0] / 2))).alias("cx"), F.floor(F.col("y") * (world / (SCREEN[1] / 2))).alias("cy")
        level = F.floor(F.col("rank") / F.lit(RANKS >> steps)).alias("level")
        first = firsts(at, zoom, "first")
        n = materialise(first.groupBy("mode", cx, cy, "first", level).agg(F.count(F.lit(1)).alias("n")), "map")
        kinds = {r["mode"]: r["most"] for r in _busiest(n.groupBy("mode", "cx", "cy").agg(F.sum("n").alias("n")), "n", "mode").collect()}  # a row a kind
        found = dict.fromkeys(kinds, 1.0)
        whole = _busiest(n.groupBy("cx", "cy").agg(F.sum("n").alias("n")), "n").first()
        if whole and whole["most"] and whole["most"] > budget:
            low, high = 0, 1 << steps

            def of(step: int, kinds=kinds) -> dict:
                return {k: max(step / (1 << steps), few / m) if m > few else 1.0 for k, m in kinds.items()}

            while high - low > 1:
                middle = (low + high) // 2
                share = of(middle)
                shown = F.lit(False)
                for k, v in share.items():
                    shown = F.when(F.col("mode") == k, F.col("level") < v * (1 << steps)).otherwise(shown)
                got = _busiest(n.where(F.col("first") | shown).groupBy("cx", "cy").agg(F.sum("n").alias("n")), "n").first()
                low, high = (middle, high) if (got["most"] or 0) <= budget else (low, middle)
            found = of(low)
        above = {k: min(v, above.get(k, 1.0)) for k, v in found.items()}
        out += [(zoom, k, float(v)) for k, v in above.items()]
    return spark.createDataFrame(out, "zoom int, mode string, share double")


def thin_out(vehicles: DataFrame, part: DataFrame, zoom: float) -> DataFrame:
    """The vehicles a map at the zoom shows: of each kind its share by rank, the first of every square, and between whole zooms
    a part of the next zoom's firsts. Ranks are hashes, so what is shown stays shown."""
    level = max(ZOOM_MIN, int(zoom))
    quarter = int((zoom - level) * 4) / 4 if zoom > level else 0.0
    here = part.where(F.col("zoom") == level).select("mode", F.col("share").alias("_a"))
    then = part.where(F.col("zoom") == level + 1).select("mode", F.col("share").alias("_b"))
    of = here.join(then, "mode", "left").select("mode", F.when(F.col("_a") > 0, F.col("_a") * F.pow(F.coalesce("_b", F.lit(1.0)) / F.col("_a"), quarter)).otherwise(F.coalesce("_b", F.lit(1.0)) * quarter).alias("_s"))
    at = firsts(firsts(placed(vehicles), level, "_f"), level + 1, "_g")
    some = (4**quarter - 1) / 3 * RANKS
    extra = (hashing.mix(F.col("rank").bitwiseXOR(F.lit(0x9E3779B9))) < some) & F.lit(quarter > 0)
    shown = (F.col("_s") >= 1) | (F.col("rank") < F.col("_s") * RANKS) | F.col("_f") | (F.col("_g") & extra)
    return at.join(F.broadcast(of), "mode", "left").where(F.coalesce(shown, F.lit(True))).drop("x", "y", "_f", "_g", "_s")  # a row a kind
