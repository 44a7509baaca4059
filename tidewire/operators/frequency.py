"""How often departures leave, hour by hour: gaps by windows, beats by gaps and islands, words by one ordered fold over a day's hours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise

SHORT_WAIT, FEW = 15, 3  # minutes up to which a wait is said as such; departures an hour up to which they are counted
LEAST_HOURS = 3  # of a stretch
RUN = "struct<from:int,to:int,kind:string,low:int,high:int>"


def gaps(rows: DataFrame, group: list[str], day: str, minute: str) -> DataFrame:
    """(group, day, h, first, n, least, longest, before, closes, reaches, exact): what one day's departures say of an hour that they run through.

    The first of n departures; the least and longest wait after one (across the hour if there is none); before: the wait before each, if it is the
    same for all; then whether the wait after the hour's last is at most that (closes), or else would reach the hour's end (reaches), or is
    just that (exact). Days of one departure say nothing."""
    by_day = [*group, day]
    w = Window.partitionBy(*by_day).orderBy("m")
    x = rows.select(*by_day, F.col(minute).cast("int").alias("m")).where("m IS NOT NULL").distinct()
    x = x.withColumns({"back": F.col("m") - F.lag("m").over(w), "on": F.lead("m").over(w) - F.col("m"), "h": F.floor(F.col("m") / 60).cast("int")})
    x = x.where("back IS NOT NULL OR on IS NOT NULL")
    after = F.floor((F.col("m") + F.col("on")) / 60).cast("int")
    empty = x.where(after > F.col("h") + 1).select(*by_day, F.explode(F.sequence(F.col("h") + 1, after - 1)).alias("h"), "on")
    own = x.groupBy(*by_day, "h").agg(
        F.min("m").alias("first"), F.count(F.lit(1)).cast("int").alias("n"), F.min("on").alias("least"), F.max("on").alias("longest"), F.max("m").alias("m"), F.max_by("on", "m").alias("wait"),
        F.when((F.min("back") == F.max("back")) & (F.count("back") == F.count(F.lit(1))), F.min("back")).alias("before"))
    own = own.select(
        *by_day, "h", "first", "n", "least", "longest", "before", (F.col("wait") <= F.col("before")).alias("closes"),
        (F.col("m") + F.col("before") >= (F.col("h") + 1) * 60).alias("reaches"), (F.col("wait") == F.col("before")).alias("exact"))
    nothing = {"first": F.lit(None).cast("int"), "n": F.lit(0), "least": F.col("on"), "longest": F.col("on"), "before": F.lit(None).cast("int")} | {c: F.lit(False) for c in ("closes", "reaches", "exact")}
    return own.unionByName(empty.withColumns(nothing).drop("on"))


def _spread(hours: DataFrame, group: list[str], joins: str, forward: bool) -> DataFrame:
    """Hours without a beat next to a run of one take it over as far as each of them joins it without a break."""
    h = F.col("h") if forward else -F.col("h")
    w = Window.partitionBy(*group).orderBy(h).rowsBetween(Window.unboundedPreceding, 0)
    x = hours.withColumns({"_seed": F.last("beat", ignorenulls=True).over(w), "_run": F.count("beat").over(w)})
    breaks = F.col("beat").isNull() & ~F.coalesce((F.col("keeps") == F.col("_seed")) & F.col(joins), F.lit(False))
    run = Window.partitionBy(*group, "_run").orderBy(h).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("beat", F.when(F.max(breaks.cast("int")).over(run) == 0, F.col("_seed"))).drop("_seed", "_run")


def hours(rows: DataFrame, group: list[str], day: str, minute: str) -> DataFrame:
    """(group, h, beat, longest, kind, low, high): what all days of a group say of each hour that all of them run through.

    every: all waits are the same (beat), and several departures leave or the wait is in whole hours; none: no departure; atMost: more than FEW
    departures and waits up to SHORT_WAIT; perHour: the fewest and most departures. An hour that keeps the beat of the hours before or
    after it is on it too."""
    each = materialise(gaps(rows, group, day, minute), "gaps")
    span = each.groupBy(*group, day).agg(F.min("first").alias("m"), F.max("h").alias("b"))
    span = span.groupBy(*group).agg(F.max(F.ceil(F.col("m") / 60).cast("int")).alias("a"), F.min("b").alias("b"))
    x = each.groupBy(*group, "h").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("least").alias("least"), F.max("longest").alias("longest"),
        F.when((F.min("before") == F.max("before")) & (F.count("before") == F.count(F.lit(1))), F.min("before")).alias("keeps"),
        F.every("closes").alias("closes"), F.every(F.col("closes") | F.col("reaches")).alias("reaches"), F.every("exact").alias("exact"))
    x = x.join(span, group).where("h >= a AND h < b").drop("a", "b")
    regular = (F.col("least") == F.col("longest")) & ((F.col("low") > 1) | (F.col("longest") % 60 == 0))
    x = x.withColumn("beat", F.when(regular, F.col("longest")))
    later = F.lead("beat").over(Window.partitionBy(*group).orderBy("h"))
    x = x.withColumn("joins", F.col("closes") | (F.col("reaches") & ~later.eqNullSafe(F.col("keeps"))))
    x = _spread(_spread(x, group, "joins", True), group, "exact", False)
    on = F.col("beat").isNotNull()
    waits = (F.col("low") > FEW) & (F.col("longest") <= SHORT_WAIT)
    kind = F.when(on, "every").when(F.col("high") == 0, "none").when(waits, "atMost").otherwise("perHour")
    x = x.withColumns({"kind": kind, "longest": F.coalesce("beat", "longest")})
    said = {c: F.when(F.col("kind").isin("every", "atMost"), F.col("longest")).otherwise(F.col(c)) for c in ("low", "high")}
    return x.withColumns(said).select(*group, "h", "beat", "longest", "kind", "low", "high")


def _one(a: Column, b: Column) -> Column:
    """Whether a run and the hour after it say one thing: the same wait, nothing, or counts within one of each other."""
    waits = a["kind"].isin("every", "atMost") & b["kind"].isin("every", "atMost") & (a["low"] == b["low"])
    counts = (a["kind"] == "perHour") & (b["kind"] == "perHour") & ((a["low"] == 0) == (b["low"] == 0))
    counts &= F.greatest(a["high"], b["high"]) - F.least(a["low"], b["low"]) <= 1
    return waits | counts | ((a["kind"] == "none") & (b["kind"] == "none"))


def runs(said: DataFrame, group: list[str]) -> DataFrame:
    """(group, from, to, kind, low, high): hours in a row that say one thing. A run's counts widen as hours join it, so each
    hour is held against the run so far: a fold over the group's hours, which are those of a day."""
    hour = F.struct(F.col("h").alias("from"), (F.col("h") + 1).alias("to"), "kind", "low", "high").cast(RUN)

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        kind = F.when((last["kind"] == "every") & (x["kind"] == "atMost"), "atMost").otherwise(last["kind"])
        both = F.struct(
            last["from"].alias("from"), x["to"].alias("to"), kind.alias("kind"), F.least(last["low"], x["low"]).alias("low"), F.greatest(last["high"], x["high"]).alias("high")).cast(RUN)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))
        return F.when((F.size(done) > 0) & _one(last, x), joined).otherwise(F.concat(done, F.array(x)))

    lists = said.groupBy(*group).agg(F.array_sort(F.collect_list(hour)).alias("l"))
    folded = F.aggregate("l", F.array().cast(f"array<{RUN}>"), add)
    return lists.select(*group, F.inline(folded))


def one_word(found: DataFrame, scope: list[str], group: list[str]) -> DataFrame:
    """Runs of all groups of a scope, read together, say once an hour one way: where any counts it, every hour on the hour is
    counted too, and neighbours that then count the same are one run."""
    counted = F.max(((F.col("kind") == "perHour") & (F.col("low") == 1) & (F.col("high") == 1)).cast("int")).over(Window.partitionBy(*scope)) == 1
    turns = counted & (F.col("kind") == "every") & (F.col("low") == 60)
    x = found.withColumn("_t", turns)
    x = x.withColumns({"kind": F.when(F.col("_t"), "perHour").otherwise(F.col("kind")), **{c: F.when(F.col("_t"), 1).otherwise(F.col(c)) for c in ("low", "high")}}).drop("_t")
    w = Window.partitionBy(*group).orderBy("from")
    same = reduce(lambda a, b: a & b, [F.lag(c).over(w) == F.col(c) for c in ("kind", "low", "high")]) & (F.lag("to").over(w) == F.col("from")) & (F.col("kind") == "perHour")
    x = x.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return x.groupBy(*group, "_run", "kind", "low", "high").agg(F.min("from").alias("from"), F.max("to").alias("to")).select(*group, "from", "to", "kind", "low", "high")


def hourly(rows: DataFrame, group: list[str], day: str, minute: str) -> DataFrame:
    """(group, from, to, kind, low, high): how often departures leave on all days of a group, in runs of hours."""
    return one_word(runs(hours(rows, group, day, minute), group), group, group)


def stretches(said: DataFrame, group: list[str]) -> DataFrame:
    """(group, from, to, kind, n): the longest run of hours (the first of equals) that one beat, the shortest there is, holds for; if there is
    none, one longest wait up to SHORT_WAIT; of LEAST_HOURS and half the group's hours at least."""
    every = said.where("beat IS NOT NULL").select(*group, "h", F.col("beat").alias("n"), F.lit("every").alias("kind"))
    waits = said.where((F.col("longest") <= SHORT_WAIT) & (F.col("kind") != "perHour"))
    limits = said.where(F.col("longest") <= SHORT_WAIT).select(*group, F.col("longest").alias("n")).distinct()
    within = waits.join(limits, group).where("longest <= n").select(*group, "h", "n", F.lit("atMost").alias("kind"))
    by = [*group, "kind", "n"]
    x = every.unionByName(within)
    x = x.withColumn("_run", F.col("h") - F.row_number().over(Window.partitionBy(*by).orderBy("h")))
    x = x.groupBy(*by, "_run").agg(F.min("h").alias("from"), (F.max("h") + 1).alias("to")).drop("_run")
    need = said.groupBy(*group).agg(F.greatest(F.lit(LEAST_HOURS), F.count(F.lit(1)) / 2).alias("_need"))
    x = x.join(need, group).where(F.col("to") - F.col("from") >= F.col("_need"))
    order = [F.col("kind") == "atMost", F.col("n"), F.col("from") - F.col("to"), F.col("from")]
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_i = 1")
    return x.select(*group, "from", "to", "kind", "n")
