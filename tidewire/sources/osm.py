"""Map extracts: ways, nodes and boundaries of PBF files, read block by block where the blocks lie."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions import ways
from .gtfs_rt import fields
from .store import asking, open_file, told

KINDS = {
    "node": "id BIGINT, lat7 BIGINT, lon7 BIGINT",
    "way": "id BIGINT, refs ARRAY<BIGINT>, tags MAP<STRING, STRING>",
    "relation": "id BIGINT, tags MAP<STRING, STRING>, members ARRAY<STRUCT<kind: STRING, ref: BIGINT, role: STRING>>",
}
MEMBERS = "members ARRAY<STRUCT<kind: STRING, ref: BIGINT, role: STRING>>"
ALL = f"kind STRING, id BIGINT, lat7 BIGINT, lon7 BIGINT, refs ARRAY<BIGINT>, tags MAP<STRING, STRING>, {MEMBERS}"
OWN = ("kind", "id", "lat7", "lon7", "refs", "tags", "members")  # columns of elements; any other column of a schema is a tag
SORTED = b"Sort.Type_then_ID"
BLOCKS = 8  # blocks of a partition
KIND_FIELDS = {"node": 2, "way": 3, "relation": 4}  # of a block's groups
ORDER = ["node", "way", "relation"]  # of the kinds in a file that says it is sorted


def _blob(f, at: int, size: int) -> bytes:
    got = dict(fields(f.read_at(size, at)))
    return zlib.decompress(got[3]) if 3 in got else got[1]


def blobs(path: str) -> tuple[list[tuple[int, int]], bool]:
    """((offset, size) of the data blobs, whether the file says that it is sorted by type, then id): only headers are read."""
    out, is_sorted = [], False
    with open_file(path) as f:
        at, end = 0, f.size()
        while at < end:
            (n,) = struct.unpack(">i", f.read_at(4, at))
            head = dict(fields(f.read_at(n, at + 4)))
            if head[1] == b"OSMData":
                out.append((at + 4 + n, head[3]))
            else:
                features = list(fields(_blob(f, at + 4 + n, head[3])))
                is_sorted |= (4, SORTED) in features or (5, SORTED) in features
            at += 4 + n + head[3]
    return out, is_sorted


def kinds_of(raw: bytes) -> list[str]:
    """The kinds of elements that a block holds, in their order."""
    names = {1: "node", 2: "node", 3: "way", 4: "relation"}
    found = {names[n] for m, group in fields(raw) if m == 2 for n, _ in fields(group) if n in names}
    return [k for k in ORDER if k in found]


def ids_of(raw: bytes, kind: str) -> tuple[int, int] | None:
    """The first and the last id of a kind's elements in a block, without their tags and references."""
    first = last = None
    for m, group in fields(raw):
        for n, v in fields(group) if m == 2 else ():
            if n == KIND_FIELDS[kind]:
                found = dict(fields(v))[1]
                ends = (found, found)
                if kind == "node":
                    ids = running(found)
                    ends = (ids[0], ids[-1]) if ids else None
                if ends:
                    first, last = ends[0] if first is None else first, ends[1]
    return None if first is None else (first, last)


def span_of(path: str, spans: list[tuple[int, int]], kind: str, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
    """The blobs of a sorted file that may hold a kind, with ids from low to high: both ends of the range are found by halving, so about twice
    log2 of the blobs are read for the kind and as many for the ids, and all others are skipped unread."""
    with open_file(path) as f:
        seen: dict[int, int] = {}

        def holds(i: int, last: bool) -> int:
            """Place in ORDER of a blob's first or last kind."""
            key = 2 * i + last
            if key not in seen:
                found = kinds_of(_blob(f, *spans[i])) or ["relation"]
                seen[2 * i], seen[2 * i + 1] = ORDER.index(found[0]), ORDER.index(found[-1])
            return seen[key]

        def first(true, begin: int = 0, end: int = len(spans)) -> int:
            while begin < end:
                mid = (begin + end) // 2
                begin, end = (begin, mid) if true(mid) else (mid + 1, end)
            return begin

        want = ORDER.index(kind)
        start = first(lambda i: holds(i, True) >= want)
        stop = max(start, first(lambda i: holds(i, False) > want))

        ends: dict[int, tuple[int, int]] = {}

        def id_of(i: int, last: bool) -> int:
            """First or last id of the kind in a blob."""
            if i not in ends:
                ends[i] = ids_of(_blob(f, *spans[i]), kind)
            return ends[i][last]

        if low is not None:
            start = first(lambda i: id_of(i, True) >= low, start, stop)
        if high is not None:
            stop = first(lambda i: id_of(i, False) > high, start, stop)
    return spans[start:stop]


def packed(data: bytes) -> np.ndarray:
    """The numbers of a packed field: each byte's seven bits, shifted by its place in its number."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.empty(0, np.int64)
    starts = np.r_[0, np.flatnonzero(x < 0x80)[:-1] + 1]
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    return np.add.reduceat((x & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts).view(np.int64)


def running(data: bytes) -> list[int]:
    """A packed field of zigzag steps as running sums."""
    n = packed(data)
    return np.cumsum((n >> 1) ^ -(n & 1)).tolist()


class Wanted:
    """What of a block's elements is wanted: ids from low to high, in ids if given; with any of the keys, if there are keys; with all the tags of
    needed, each with one of its values or, if null, with any. columns are those that rows have."""

    def __init__(self, columns: tuple[str, ...] = OWN, keys: frozenset[str] = frozenset()):
        self.columns, self.keys = columns, keys
        self.low: int | None = None
        self.high: int | None = None
        self.ids: frozenset[int] | None = None
        self.needed: dict[str, frozenset[str] | None] = {}

    def narrow(self, low: int | None = None, high: int | None = None) -> None:
        if low is not None:
            self.low = low if self.low is None else max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)

    def need(self, tag: str, values: frozenset[str] | None = None) -> None:
        before = self.needed.get(tag)
        self.needed[tag] = before if values is None else values if before is None else before & values

    def has_id(self, i: int) -> bool:
        return (self.low is None or i >= self.low) and (self.high is None or i <= self.high) and (self.ids is None or i in self.ids)


def block_rows(raw: bytes, kind: str, wanted: Wanted) -> Iterator[tuple]:
    """Rows (wanted.columns) of one kind of an uncompressed block; groups of other kinds are passed over, and so are elements whose id or tags are
    not wanted, before their references are read. References and members are read only if they are columns. A node's own tags are not
    read: its tags are null."""
    raw_texts, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(raw):
        if n == 1:
            raw_texts = [s for _, s in fields(v)]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n == 19:
            lat0 = v
        elif n == 20:
            lon0 = v

    if not any(n == KIND_FIELDS[kind] for g in groups for n, _ in fields(g)):
        return
    columns = wanted.columns
    if kind == "node":
        if wanted.needed:
            return
        every = wanted.low is None and wanted.high is None and wanted.ids is None
        for group in groups:
            for n, v in fields(group):
                if n == 2:
                    got = dict(fields(v))
                    for i, lat, lon in zip(*[running(got[k]) for k in (1, 8, 9)], strict=True):
                        if every or wanted.has_id(i):
                            values = {"kind": kind, "id": i, "lat7": (lat0 + grain * lat) // 100, "lon7": (lon0 + grain * lon) // 100}
                            yield tuple([values.get(c) for c in columns])
        return

    texts = [s.decode() for s in raw_texts]
    any_of = {i for i, s in enumerate(texts) if s in wanted.keys}
    all_of = [{i for i, s in enumerate(texts) if s == k} for k in wanted.needed]
    if (wanted.keys and not any_of) or not all(all_of):
        return
    names = ["node", "way", "relation"]
    for group in groups:
        for n, v in fields(group):
            if n != KIND_FIELDS[kind]:
                continue
            got = dict(fields(v))
            if not wanted.has_id(got[1]):
                continue
            at = packed(got.get(2, b"")).tolist()
            if (wanted.keys and any_of.isdisjoint(at)) or any(one.isdisjoint(at) for one in all_of):
                continue
            tags = {texts[k]: texts[t] for k, t in zip(at, packed(got.get(3, b"")).tolist(), strict=True)}
            if any(values is not None and tags[k] not in values for k, values in wanted.needed.items()):
                continue
            values = {"kind": kind, "id": got[1], "tags": tags}
            if kind == "way" and "refs" in columns:
                values["refs"] = running(got.get(8, b""))
            if kind == "relation" and "members" in columns:
                values["members"] = [
                    {"kind": names[t], "ref": r, "role": texts[s]} for s, r, t in zip(packed(got.get(8, b"")).tolist(), running(got.get(9, b"")), packed(got.get(10, b"")).tolist(), strict=True)]
            yield tuple([values.get(c) if c in OWN else tags.get(c) for c in columns])


class _Part(InputPartition):
    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = spans


class _Reader(DataSourceReader):
    def __init__(self, path: str, kinds: frozenset[str], wanted: Wanted):
        self.path, self.kinds, self.wanted = path, kinds, wanted

    def takes(self, f: Filter) -> bool:
        """Whether the reader tests a filter: =, IN and comparisons of id, = and IN of kind, =, IN and IS NOT NULL of tag columns."""
        column = getattr(f, "attribute", (None, None))
        name = column[0] if len(column) == 1 else None
        values = frozenset(f.value if isinstance(f, In) else [f.value]) - {None} if isinstance(f, (EqualTo, In)) else None
        if name == "kind" and values is not None:
            self.kinds &= values
        elif name == "id" and values is not None:
            self.wanted.ids = values if self.wanted.ids is None else self.wanted.ids & values
            if self.wanted.ids:
                self.wanted.narrow(min(self.wanted.ids), max(self.wanted.ids))
        elif name == "id" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.wanted.narrow(low=f.value + isinstance(f, GreaterThan))
        elif name == "id" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.wanted.narrow(high=f.value - isinstance(f, LessThan))
        elif name is not None and name not in OWN and values is not None:
            self.wanted.need(name, values)
        elif name is not None and name not in OWN and isinstance(f, IsNotNull):
            self.wanted.need(name)
        else:
            return name in ("kind", "id") and isinstance(f, IsNotNull)
        return True

    def partitions(self) -> list[_Part]:
        kinds = [k for k in ORDER if k in self.kinds and not (k == "node" and self.wanted.needed)]
        if not kinds or self.wanted.ids == frozenset():
            return [_Part([])]
        spans, is_sorted = blobs(self.path)
        if is_sorted:
            spans = sorted({span for k in kinds for span in span_of(self.path, spans, k, self.wanted.low, self.wanted.high)})
        return [_Part(spans[i : i + BLOCKS]) for i in range(0, len(spans), BLOCKS)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open_file(self.path) as f:
            for at, size in partition.spans:
                raw = _blob(f, at, size)
                for kind in ORDER:
                    if kind in self.kinds:
                        yield from block_rows(raw, kind, self.wanted)


class _Pushed(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can test; gives back all others, which Spark applies."""
        for f in filters:
            if not self.takes(f):
                yield f


class OsmSource(DataSource):
    """spark.read.format("osm_pbf").load(path): all elements of an extract (ALL). What is asked of kind and id (see read) reaches the reader: blocks of a
    sorted file that hold neither the kinds nor the ids are not read. With .schema("id BIGINT, refs ARRAY<BIGINT>, highway STRING") columns that are not
    elements' own are tags, null where there is none; what is asked of them is tested before references are read.

    The option kind (node, way or relation) gives that kind with its own columns; keys, as "highway,railway", ways and relations with any
    of these tags; asked and push are set by read."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        kind = self.options.get("kind")
        return KINDS[kind] if kind else ALL

    def reader(self, schema: T.StructType) -> _Reader:
        keys = frozenset(k for k in self.options.get("keys", "").split(",") if k)
        kind = self.options.get("kind")
        of = _Pushed if self.options.get("push") == "true" else _Reader
        reader = of(self.options["path"], frozenset([kind] if kind else ORDER), Wanted(tuple(schema.fieldNames()), keys))
        for f in told(self.options.get("asked", "")):
            if not reader.takes(f):
                raise ValueError(f"not tested by the reader: {f}")
        return reader


def read(
    spark: SparkSession, path: str, kind: str | None = None, keys: list[str] | None = None, schema: str | None = None, where: list[Filter] | None = None, push: bool = False,
) -> DataFrame:
    """The elements of an extract, or of one kind of it (see OsmSource), that all filters of where hold for: =, IN and comparisons of id, = and IN of
    kind, =, IN and IS NOT NULL of tags that are columns; any other is an error. With push, filters on the frame reach the reader too; such a frame
    is for one use (see asking)."""
    source = asking(spark, OsmSource, where or [], push).option("keys", ",".join(keys or []))
    if kind:
        source = source.option("kind", kind)
    return (source.schema(schema) if schema else source).load(path)


WAY_KEYS = ["highway", "railway", "route", "aerialway"]


def networks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the networks of an extract's ways: (id, lat7, lon7) and (net, way, n, a, b, cost, direction, shared, main, speed).

    An edge joins neighbouring nodes of a way; a way is cut where a node is missing from the extract. A way is on its own network and, at
    SHARED_FACTOR times the cost, on those it is shared with. cost is in per cent; see ways.classify for the rest. Only nodes that edges
    use are looked up."""
    kept = read(spark, path, "way", WAY_KEYS).withColumn("way", ways.classify(F.col("tags"))).where("way IS NOT NULL")
    n = F.greatest(F.size("refs") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("refs", F.lit(1), n).alias("a"), F.slice("refs", F.lit(2), n).alias("b"))
    steps = kept.select("id", "way", F.posexplode(pairs).alias("n", "p")).select("id", "way", "n", "p.a", "p.b").where("a <> b")
    used = steps.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    nodes = read(spark, path, "node").join(used, "id", "left_semi")
    for end in ("a", "b"):
        steps = steps.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    own = F.array(F.struct(F.col("way.net").alias("net"), F.lit(False).alias("shared")))
    nets = F.concat(own, F.transform("way.shared", lambda x: F.struct(x.alias("net"), F.lit(True).alias("shared"))))
    cost = F.round(F.col("way.factor") * F.when(F.col("on.shared"), ways.SHARED_FACTOR).otherwise(1.0) * 100).cast("int")
    edges = steps.withColumn("on", F.explode(nets)).select(
        "on.net", F.col("id").alias("way"), "n", "a", "b", cost.alias("cost"), "way.direction", "on.shared", "way.main", "way.speed")
    return nodes, edges


def boundaries(spark: SparkSession, path: str, levels: list[str]) -> DataFrame:
    """(area, name, level, lat1, lon1, lat2, lon2): border edges of named administrative areas; relation, way and node meet by join."""
    named = [EqualTo(("boundary",), "administrative"), IsNotNull(("name",)), In(("admin_level",), tuple(levels))]
    areas = read(spark, path, "relation", schema=f"id BIGINT, boundary STRING, name STRING, admin_level STRING, {MEMBERS}", where=named)
    members = areas.select(F.col("id").alias("area"), "name", F.col("admin_level").cast("int").alias("level"), F.explode("members").alias("m")).where("m.kind = 'way'")
    ways = read(spark, path, "way", schema="id BIGINT, refs ARRAY<BIGINT>").select(F.col("id").alias("ref"), "refs")
    lines = members.select("area", "name", "level", F.col("m.ref").alias("ref")).join(ways, "ref")
    n = F.greatest(F.size("refs") - 1, F.lit(0))
    pairs = lines.select("area", "name", "level", F.explode(F.arrays_zip(F.slice("refs", F.lit(1), n).alias("a"), F.slice("refs", F.lit(2), n).alias("b"))).alias("p"))
    nodes = read(spark, path, "node").select("id", (F.col("lat7") / 1e7).alias("lat"), (F.col("lon7") / 1e7).alias("lon"))
    one = nodes.select(F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    two = nodes.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return pairs.select("area", "name", "level", "p.a", "p.b").join(one, "a").join(two, "b").drop("a", "b")
