"""Places, distances and curves as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320


def half_up(c: Column) -> Column:
    """The nearest whole number, halves towards the larger one."""
    return F.floor(c + F.lit(0.5))


def round5(c: Column) -> Column:
    return half_up(c * 1e5) / F.lit(1e5)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(east * east + (lat2 - lat1) * (lat2 - lat1)) * METRES_PER_DEGREE


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whole degrees clockwise from north."""
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return half_up((F.degrees(F.atan2(east, lat2 - lat1)) + 360) % 360).cast("int")


def mercator_x(lon: Column) -> Column:
    return (lon + 180) / 360


def mercator_y(lat: Column) -> Column:
    return (1 - F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) / F.pi()) / 2


def weigh(service: Column, km: Column) -> Column:
    """A place's service against its distance."""
    return service / F.pow(km + F.lit(0.1), 2)


def hilbert(x: Column, y: Column, bits: int = 26) -> Column:
    """Position along Hilbert's curve through a square of 2**bits: a fold over the bits from the highest."""
    side = F.lit(1 << bits).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("along"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(s: Column, b: Column) -> Column:
        right, up = F.getbit(s["x"], b).cast("long"), F.getbit(s["y"], b).cast("long")
        flip = (up == 0) & (right == 1)
        fx = F.when(flip, side - 1 - s["x"]).otherwise(s["x"])
        fy = F.when(flip, side - 1 - s["y"]).otherwise(s["y"])
        return F.struct(
            (s["along"] * 4 + (3 * right).bitwiseXOR(up)).alias("along"),
            F.when(up == 0, fy).otherwise(fx).alias("x"), F.when(up == 0, fx).otherwise(fy).alias("y"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["along"])


def curve_of(lat5: Column, lon5: Column) -> Column:
    """Position of a place in 1e-5 degrees along the curve; a place off the square is taken for its nearest."""
    top = F.lit((1 << 26) - 1)
    return hilbert(F.least(top, F.greatest(F.lit(0), lon5 + 18_000_000)), F.least(top, F.greatest(F.lit(0), lat5 + 9_000_000)))
