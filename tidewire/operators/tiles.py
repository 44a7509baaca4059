"""Parts of a network that stand on their own: by tile with the tiles around it, or by any condition on nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile(lat: Column, lon: Column, degrees: float) -> Column:
    return F.struct(F.floor(lat / degrees).alias("ty"), F.floor(lon / degrees).alias("tx"))


def window(at: Column, reach: int) -> Column:
    """The tiles whose window a tile is in: itself and those up to reach rows and columns away."""
    steps = [F.struct((at["ty"] + dy).alias("ty"), (at["tx"] + dx).alias("tx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    return F.array(*steps)


def _with_ends(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """edges (a, b) whose two nodes are known, with _a and _b: what marks (id, _m) says of them."""
    for end in ("a", "b"):
        edges = edges.join(marks.select(F.col("id").alias(end), F.col("_m").alias(f"_{end}")), end)
    return edges


def parts(nodes: DataFrame, edges: DataFrame, degrees: float, reach: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (ty, tx, id, lat, lon, home, border) and edges (ty, tx, a, b) of the part of every tile of nodes (id, lat, lon) and edges (a, b); further
    columns of both stay.

    A tile's window is the tile and reach tiles around it. Its part has every edge with an end in the window, whole, and the nodes of these edges and
    of the window. home: the node is in the tile itself, which is so in one part alone; border: it is outside the window, so that edges may
    leave it that the part does not have. All other nodes have all their edges, so a way between nodes of a part that stays off its border is a way of the whole
    network, and the parts' edges together are all edges. Edges to a node that is missing are left out. A node without a place is in no part.

    An edge is copied to at most twice (2 reach + 1) squared tiles, by what its two nodes say, so nothing is grouped by tile and a crowded tile is no task of its
    own."""
    nodes = nodes.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_m", tile(F.col("lat"), F.col("lon"), degrees))
    ends = _with_ends(edges, nodes)
    copies = F.array_union(window(F.col("_a"), reach), window(F.col("_b"), reach))
    placed = ends.withColumn("_t", F.explode(copies))
    part_edges = placed.select("_t.ty", "_t.tx", *[c for c in edges.columns])
    # nodes outside a window that its edges reach: of an edge that leaves the window, the other end
    far = lambda one, other: F.transform(F.array_except(window(F.col(one), reach), window(F.col(other), reach)), lambda t: F.struct(F.col(other[1:]).alias("id"), t.alias("t")))
    out = ends.select(F.explode(F.concat(far("_a", "_b"), far("_b", "_a"))).alias("_o")).select("_o.id", F.col("_o.t").alias("_t")).distinct()
    own = nodes.withColumn("_t", F.explode(window(F.col("_m"), reach))).withColumn("border", F.lit(False))
    beyond = nodes.join(out, "id").withColumn("border", F.lit(True))
    plain = [c for c in nodes.columns if c != "_m"]
    columns = [F.col("_t.ty").alias("ty"), F.col("_t.tx").alias("tx"), *plain, (F.col("_t") == F.col("_m")).alias("home"), "border"]
    return own.select(*columns).unionByName(beyond.select(*columns)), part_edges


def part_of(nodes: DataFrame, edges: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ..., border) and edges of one part: every edge with an end that inside, a condition on a node's columns, holds for, and the nodes of these
    edges and of inside. border: inside does not hold for the node, so edges may leave it that the part does not have."""
    nodes = nodes.withColumn("_m", F.coalesce(inside, F.lit(False)))
    kept = _with_ends(edges, nodes).where("_a OR _b")
    used = kept.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("_u", F.lit(True))
    found = nodes.join(used, "id", "left").where("_m OR _u").withColumn("border", ~F.col("_m"))
    return found.select(*[c for c in nodes.columns if c != "_m"], "border"), kept.select(*edges.columns)
