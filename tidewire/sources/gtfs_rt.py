"""Live messages: protobuf feeds as rows of trip updates and alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .store import asking, files_of, open_file, told

UPDATES = "trip_id string, start_date string, relation int, stop_seq int, stop_id string, arr_delay int, arr_time long, dep_delay int, dep_time long, stop_relation int, feed_ts long"
ALERTS = "trip_id string, stop_id string, title string, text string, severity int, periods array<struct<start:long,end:long>>"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: varints as numbers, length-delimited values as bytes; fixed-width values are skipped."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")


def signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def _event(data: bytes) -> tuple[int | None, int | None]:
    got = dict(fields(data))
    return (signed(got[1], 32) if 1 in got else None, signed(got[2], 64) if 2 in got else None)


def _update(data: bytes, stamp: int, wanted) -> list[tuple]:
    trip, stops = {}, []
    for n, v in fields(data):
        if n == 1:
            trip = dict(fields(v))
        elif n == 2:
            stops.append(v)
    head = (trip.get(1, b"").decode(), trip.get(3, b"").decode(), trip.get(4, 0))
    if wanted is not None and not wanted(*head[:2]):
        return []
    out = []
    for s in stops:
        got = dict(fields(s))
        arr, dep = _event(got[2]) if 2 in got else (None, None), _event(got[3]) if 3 in got else (None, None)
        out.append((*head, got.get(1), got[4].decode() if 4 in got else None, *arr, *dep, got.get(5, 0), stamp))
    return out or [(*head, *([None] * 6), None, stamp)]


def _said(data: bytes, language: str) -> str | None:
    """The text in the language, else the first."""
    each = [dict(fields(v)) for n, v in fields(data) if n == 1]
    fit = [t for t in each if t.get(2, b"").decode().lower().startswith(language)] or each
    return fit[0].get(1, b"").decode() if fit else None


def _alert(data: bytes, language: str, wanted=None) -> list[tuple]:
    periods, about, title, text, severity = [], [], None, None, None
    for n, v in fields(data):
        if n == 1:
            p = dict(fields(v))
            periods.append({"start": p.get(1, 0), "end": p.get(2, 0)})
        elif n == 5:
            e = dict(fields(v))
            trip = dict(fields(e[4])).get(1, b"").decode() if 4 in e else None
            about.append((trip, e[5].decode() if 5 in e else None))
        elif n == 10:
            title = v
        elif n == 11:
            text = v
        elif n == 14:
            severity = v
    if wanted is not None:
        about = [a for a in about if wanted(*a)]
    if not about:
        return []
    title, text = (None if v is None else _said(v, language) for v in (title, text))
    return [(*a, title, text, severity, periods) for a in about]


def _rows(content: bytes, part: int, language: str, wanted) -> Iterator[tuple]:
    """The rows of a message's trip updates (part 3) or alerts (part 5); wanted takes the trip and the date of an update, or the trip
    and the stop of what an alert is about, and drops it before the rest is decoded."""
    message = list(fields(content))
    stamp = next((dict(fields(v)).get(3, 0) for n, v in message if n == 1), 0)
    for n, v in message:
        if n == 2:
            for m, body in fields(v):
                if m == part:
                    yield from _update(body, stamp, wanted) if part == 3 else _alert(body, language, wanted)


def _decode(part: int, schema: str, language: str, wanted):
    names = [c.split(" ")[0] for c in schema.replace("array<struct<start:long,end:long>>", "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                out = pd.DataFrame(list(_rows(content, part, language, wanted)), columns=names)
                for c in ("relation", "stop_seq", "arr_delay", "dep_delay", "stop_relation", "severity"):
                    if c in out:
                        out[c] = out[c].astype("Int32")
                for c in ("arr_time", "dep_time", "feed_ts"):
                    if c in out:
                        out[c] = out[c].astype("Int64")
                yield out

    return run


def updates_of(messages: DataFrame, wanted=None) -> DataFrame:
    """The stop updates of messages (content); wanted(trip_id) drops a trip while it is decoded."""
    return messages.select("content").mapInPandas(_decode(3, UPDATES, "", wanted and (lambda trip, date: wanted(trip))), UPDATES)


def alerts_of(messages: DataFrame, language: str = "de") -> DataFrame:
    """A row for each trip or stop that an alert of messages (content) is about."""
    return messages.select("content").mapInPandas(_decode(5, ALERTS, language, None), ALERTS).withColumn("warning", F.coalesce(F.col("severity") >= 3, F.lit(False)))


class _File(InputPartition):
    def __init__(self, path: str | None):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: int, language: str, columns: tuple[str, ...], heads: tuple[str, str]):
        self.path, self.part, self.language, self.columns, self.heads = path, part, language, columns, heads
        self.asked: list[tuple[int, frozenset | str | None]] = []  # place in heads, and values, a prefix or (null) any value at all

    def takes(self, f: Filter) -> bool:
        """Whether the reader tests a filter: =, IN, a prefix and IS NOT NULL of the two columns that are decoded first."""
        column = getattr(f, "attribute", ())
        if len(column) != 1 or column[0] not in self.heads or not isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
            return False
        asked = None
        if isinstance(f, StringStartsWith):
            asked = f.value
        elif isinstance(f, (EqualTo, In)):
            asked = frozenset(f.value if isinstance(f, In) else [f.value]) - {None}
        self.asked.append((self.heads.index(column[0]), asked))
        return True

    def wanted(self, *head: str | None) -> bool:
        for i, asked in self.asked:
            value = head[i]
            if value is None or (isinstance(asked, str) and not value.startswith(asked)) or (isinstance(asked, frozenset) and value not in asked):
                return False
        return True

    def partitions(self) -> list[_File]:
        return [_File(f) for f in files_of(self.path)] or [_File(None)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path is None:
            return
        with open_file(partition.path) as f:
            content = f.read()
        names = [c.split(" ")[0] for c in PARTS[self.part][1].replace("array<struct<start:long,end:long>>", "x").split(", ")]
        places = [names.index(c) for c in self.columns]
        for row in _rows(content, self.part, self.language, self.wanted if self.asked else None):
            yield tuple([row[i] for i in places])


class _Pushed(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can test; gives back all others, which Spark applies."""
        for f in filters:
            if not self.takes(f):
                yield f


#: field of an entity: option, columns, and the two that are decoded before the rest
PARTS = {3: ("updates", UPDATES, ("trip_id", "start_date")), 5: ("alerts", ALERTS, ("trip_id", "stop_id"))}


class LiveSource(DataSource):
    """spark.read.format("gtfs_rt").option("part", "alerts").load(path): trip updates (UPDATES, unless told otherwise) or alerts (ALERTS) of the messages of a
    path, a file a task. What is asked of an update's trip and date, or of an alert's trip and stop (see trip_updates), drops it before the rest of it is
    decoded."""

    @classmethod
    def name(cls) -> str:
        return "gtfs_rt"

    def _part(self) -> int:
        return {name: n for n, (name, _, _) in PARTS.items()}[self.options.get("part", "updates")]

    def schema(self) -> str:
        return PARTS[self._part()][1]

    def reader(self, schema: T.StructType) -> _Reader:
        part = self._part()
        of = _Pushed if self.options.get("push") == "true" else _Reader
        reader = of(self.options["path"], part, self.options.get("language", "de"), tuple(schema.fieldNames()), PARTS[part][2])
        for f in told(self.options.get("asked", "")):
            if not reader.takes(f):
                raise ValueError(f"not tested by the reader: {f}")
        return reader


def trip_updates(spark: SparkSession, path: str, wanted=None, where: list[Filter] | None = None, push: bool = False) -> DataFrame:
    """The stop updates of the messages in path. The decoder tests where: =, IN, a prefix and IS NOT NULL of trip_id and start_date; any other
    filter is an error. With push, filters on the frame reach it too; such a frame is for one use (see asking). What only Python can tell is given as
    wanted(trip_id), without where and push."""
    if wanted is not None:
        if where or push:
            raise ValueError("wanted goes without where and push")
        return updates_of(spark.read.format("binaryFile").load(path), wanted)
    return asking(spark, LiveSource, where or [], push).load(path)


def alerts(spark: SparkSession, path: str, language: str = "de", where: list[Filter] | None = None, push: bool = False) -> DataFrame:
    """A row for each trip or stop that an alert in path is about; where and push as for trip_updates, of trip_id and stop_id."""
    rows = asking(spark, LiveSource, where or [], push).option("part", "alerts").option("language", language).load(path)
    return rows.withColumn("warning", F.coalesce(F.col("severity") >= 3, F.lit(False)))
