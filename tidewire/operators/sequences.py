"""Operators over ordered rows, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def carry_forward(rows: DataFrame, group: list[str], pos: str, arr: Column, dep: Column, reset: Column) -> DataFrame:
    """rows with arr_delay and dep_delay: the last known delay of the group is carried on; a reset row knows nothing and
    ends the carrying. Arrival: reported, else carried, else the departure's; departure: what is carried after the row."""
    order = Window.partitionBy(*group).orderBy(pos)
    out = rows.withColumns({"_a": arr, "_d": dep, "_x": reset}).withColumn("_g", F.sum(F.col("_x").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*group, "_g").orderBy(pos)
    seen = F.when(~F.col("_x"), F.coalesce("_d", "_a"))
    after = F.last(seen, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(seen, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumns({
        "dep_delay": F.when(~F.col("_x"), after),
        "arr_delay": F.when(~F.col("_x"), F.coalesce("_a", before, "_d")),
    }).drop("_a", "_d", "_x", "_g")


def clamp(rows: DataFrame, group: list[str], pos: str, arr: str, dep: str) -> DataFrame:
    """Times that never run backwards: running maxima in place of arr and dep."""
    run = Window.partitionBy(*group).orderBy(pos)
    top = F.max(F.greatest(arr, dep)).over(run.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max(F.greatest(arr, dep)).over(run.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({arr: F.greatest(F.col(arr), before), dep: top})


def fill_times(rows: DataFrame, group: list[str], pos: str, arr: str, dep: str) -> DataFrame:
    """Missing times from the other event of the stop, else evenly between the departure before and the arrival after
    (halves up); groups with a gap at an end are dropped."""
    w = Window.partitionBy(*group).orderBy(pos)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = rows.withColumns({"_a": F.coalesce(arr, dep), "_d": F.coalesce(dep, arr), "_n": F.row_number().over(w)})
    here = F.col("_a").isNotNull()
    x = x.withColumns({
        "_pd": F.last("_d", ignorenulls=True).over(back), "_pn": F.last(F.when(here, F.col("_n")), ignorenulls=True).over(back),
        "_na": F.first("_a", ignorenulls=True).over(on), "_nn": F.first(F.when(here, F.col("_n")), ignorenulls=True).over(on),
    })
    step = (F.col("_na") - F.col("_pd")) / (F.col("_nn") - F.col("_pn"))
    filled = geo.half_up(F.col("_pd") + step * (F.col("_n") - F.col("_pn"))).cast("int")
    whole = F.min((F.col("_pd").isNotNull() & F.col("_na").isNotNull()).cast("int")).over(Window.partitionBy(*group)) == 1
    x = x.withColumns({arr: F.when(here, F.col("_a")).otherwise(filled), dep: F.when(here, F.col("_d")).otherwise(filled), "_w": whole})
    return x.where("_w").drop("_a", "_d", "_n", "_pd", "_pn", "_na", "_nn", "_w")


def drop_repeats(rows: DataFrame, group: list[str], pos: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(pos))
    return rows.withColumn("_p", before).where(F.col("_p").isNull() | (F.col("_p") != F.col(value))).drop("_p")


def next_other(rows: DataFrame, group: list[str], pos: str, value: str) -> DataFrame:
    """rows with following: the first later value that differs; rows without a value have none and are passed over. Read from the end, a row that another
    value comes after holds that value, and the others hold what the row behind them does: one sort of the rows, and no join."""
    back = Window.partitionBy(*group).orderBy(F.desc(pos))
    v = F.col(value)
    x = rows.withColumn("_v", F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_v", F.when(F.col("_v") != v, F.col("_v")))
    held = F.last("_v", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("following", F.when(v.isNotNull(), held)).drop("_v")


def delta(rows: DataFrame, group: list[str], pos: str, value: str) -> DataFrame:
    return rows.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*group).orderBy(pos)), F.lit(0)))


def undelta(rows: DataFrame, group: list[str], pos: str, value: str) -> DataFrame:
    return rows.withColumn("value", F.sum(value).over(Window.partitionBy(*group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))


def span_of_day(rows: DataFrame, group: list[str], time: str) -> DataFrame:
    """(group, first, last) of cyclic days of 86,400 s: around the longest pause, the pause over midnight unless another is longer."""
    day = rows.select(*group, F.pmod(F.col(time), F.lit(86_400)).alias("t")).distinct()
    w = Window.partitionBy(*group).orderBy("t")
    x = day.withColumns({"before": F.lag("t").over(w)})
    gap = x.groupBy(*group).agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"),
        F.max_by(F.struct(F.col("t").alias("first"), F.col("before").alias("last")), F.when(F.col("before").isNotNull(), F.struct((F.col("t") - F.col("before")).alias("g"), (-F.col("t")).alias("o")))).alias("m"))
    inner = F.col("m.first") - F.col("m.last")
    longer = F.coalesce(inner > F.col("lo") + 86_400 - F.col("hi"), F.lit(False))
    first, last = F.when(longer, F.col("m.first")).otherwise(F.col("lo")), F.when(longer, F.col("m.last")).otherwise(F.col("hi"))
    return gap.select(*group, first.alias("first"), F.when(last < first, last + 86_400).otherwise(last).alias("last"))


def in_day(time: Column, first: Column) -> Column:
    return F.when(time < first, time + 86_400).otherwise(time)


def islands(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """(group, start, stop, n) of runs of consecutive whole numbers."""
    x = rows.select(*group, number).distinct()
    x = x.withColumn("_g", F.col(number) - F.row_number().over(Window.partitionBy(*group).orderBy(number)))
    return x.groupBy(*group, "_g").agg(F.min(number).alias("start"), F.max(number).alias("stop"), F.count(F.lit(1)).alias("n")).drop("_g")


def shared_lists(lists: DataFrame, key: str, values: str) -> DataFrame:
    """lists with id, the smallest key that has the same list. Lists meet by their 64-bit hash and are told apart by themselves, so two
    lists of one hash stay two; a sort compares hashes before lists."""
    x = lists.withColumn("_h", F.xxhash64(values))
    return x.withColumn("id", F.min(key).over(Window.partitionBy("_h", values))).drop("_h")


def dictionary_encode(rows: DataFrame, group: str, pos: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(dictionary, members): each distinct ordered list of values once, with the smallest group that has it as its id."""
    item = F.struct(F.col(pos), *values)
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("l")).select(group, F.transform("l", lambda s: F.struct(*[s[v].alias(v) for v in values])).alias("list"))
    members = shared_lists(lists, group, "list")
    book = lists.groupBy(F.xxhash64("list").alias("_h"), "list").agg(F.min(group).alias("id"), F.count(F.lit(1)).alias("n")).select("id", "list", "n")
    return book, members.select(group, "id")


def served_range(rows: DataFrame, group: list[str], pos: str, skipped: Column) -> DataFrame:
    """(group, first, last) without the skipped stops at either end; no row where all are skipped."""
    return rows.where(~skipped).groupBy(*group).agg(F.min(pos).alias("first"), F.max(pos).alias("last"))


def position_at(knots: DataFrame, group: list[str], t: str, now: Column, values: list[str], tie: str, at: str | None = None) -> DataFrame:
    """Values at now, in proportion between the knots around it (equal times in the order of tie); at the ends the end knots'. now is one time or, where at
    names a column for it, an array of distinct times: the knots are sorted once for all of them."""
    w = Window.partitionBy(*group).orderBy(t, tie)
    x = knots.select(*group, F.col(t).alias("_t"), *values, F.lead(t).over(w).alias("_u"), *[F.lead(v).over(w).alias(f"_{v}") for v in values], F.row_number().over(w).alias("_n"))
    here = lambda now: ((F.col("_t") <= now) & ((now < F.col("_u")) | F.col("_u").isNull())) | ((F.col("_n") == 1) & (now < F.col("_t")))
    if at is None:
        x, keys = x.where(here(now)), group
    else:
        x, keys = x.withColumn(at, F.explode(F.filter(now, here))), [*group, at]
        now = F.col(at)
    share = F.when((now < F.col("_t")) | F.col("_u").isNull() | (F.col("_u") == F.col("_t")), F.lit(0.0)).otherwise((now - F.col("_t")) / (F.col("_u") - F.col("_t")))
    return x.select(*keys, *[(F.col(v) + F.when(share == 0, F.lit(0.0)).otherwise((F.col(f"_{v}") - F.col(v)) * share)).alias(v) for v in values])
