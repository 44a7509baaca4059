"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one representative kept."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

SAMPLE_ROWS = 16_384  # about so many distinct vectors fit the centroids; all vectors are indexed and compared
MOST_CELLS = 16_384  # bounds the broadcast centroids: 8 MB at 64 dimensions
BLOCK = 8_192  # home rows of a tile, the unit of comparison
CELLS = 2_097_152  # entries of a product held at once, 8 MB of floats
SLACK = 1e-6  # of the bounds, above the rounding of doubles


def centroids(vectors: DataFrame, rows: int, cells: int, seed: int) -> np.ndarray:
    """Unit centroids by spherical k-means on a hash-chosen share of the vectors, about SAMPLE_ROWS of them."""
    share = min(1.0, SAMPLE_ROWS / rows)
    picked = vectors.where(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    longest = F.array_max(F.transform("vec", F.abs))
    picked = picked.select(array_to_vector(F.transform("vec", lambda x: x / longest)).alias("features"))
    model = KMeans(k=cells, distanceMeasure="cosine", initMode="random", maxIter=4, seed=seed).fit(picked)
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; scaled by their largest component first, as squares of very large or small ones are no doubles."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _slices(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def homes(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, near, v, m, vec): each vector with its nearest cell and its cosine with that cell's centre."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(2), dims)
            cell, best = np.zeros(len(x), np.int32), np.zeros(len(x))
            for part in _slices(len(x), len(centres)):
                near = x[part] @ centres.T
                cell[part] = near.argmax(axis=1)
                best[part] = near.max(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(best), *batch.columns], names=["cell", "near", "v", "m", "vec"])

    return vectors.select("v", "m", "vec").mapInArrow(run, f"cell int, near double, v long, m long, vec {dict(vectors.dtypes)['vec']}")


def tiles(centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first tile, number of tiles) of each cell: neighbouring cells share a tile of at most BLOCK vectors, a cell of more is dealt
    over tiles of its own. The cells are halved along their widest direction."""
    first, many = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    todo, n = [np.flatnonzero(sizes)], 0
    while todo:
        cells = todo.pop()
        total = sizes[cells].sum()
        if total <= BLOCK or len(cells) == 1:
            first[cells], many[cells] = n, -(-total // BLOCK)
            n += int(-(-total // BLOCK))
            continue
        c = centres[cells] - centres[cells].mean(axis=0)
        cells = cells[np.argsort(c @ np.linalg.eigh(c.T @ c)[1][:, -1], kind="stable")]
        cut = int(np.searchsorted(np.cumsum(sizes[cells]), total / 2)) + 1
        cut = min(cut, len(cells) - 1)
        todo += [cells[cut:], cells[:cut]]
    return first, many


def meetings(home: DataFrame, centres: np.ndarray, sizes: np.ndarray, lows: np.ndarray, threshold: float) -> DataFrame:
    """(i, j, on_left, v, m, vec): each vector in every pair of tiles i <= j in which it may have a link, on the side of its own tile.

    The bounds are exact. A vector linked with y is at most the threshold's angle away; one whose nearest centre is c lies on c's
    side of the bisector of c and y's own centre, and no farther from c than c's farthest home vector. So y skips a cell only
    if it is beyond that angle from the bisector, or from the ball around c; both sides of a link meet in the same pair of tiles.
    """
    dims = centres.shape[1]
    angle = math.acos(max(-1.0, min(1.0, threshold)))
    step = math.sin(angle) if threshold > 0 else 1.0
    first, many = tiles(centres, sizes)
    ball = np.cos(np.minimum(np.arccos(np.clip(lows, -1, 1)) + angle, math.pi))
    ball[sizes == 0] = 2.0  # no vector at home there
    n_tiles = int((first + many)[sizes > 0].max())
    long = np.einsum("ij,ij->i", centres, centres)
    # cells in the order of their tiles: a tile is reached if one of its cells is
    order = np.argsort(first, kind="stable")
    order = order[sizes[order] > 0]
    starts = np.flatnonzero(np.r_[True, np.diff(first[order]) > 0])
    tile, copies = first[order][starts], many[order][starts]
    spread = np.repeat(np.arange(len(tile)), copies)  # of each tile, its run of cells
    assert len(spread) == n_tiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, v = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = _unit(batch.column(4), dims)
            own = first[cell] + v % many[cell]
            for part in _slices(len(x), max(len(centres), n_tiles)):
                c = cell[part]
                near = x[part] @ centres.T
                apart = np.sqrt(np.maximum(long[c][:, None] + long[None, :] - 2 * centres[c] @ centres.T, 0))
                meets = near >= near[np.arange(len(c)), c][:, None] - step * apart - SLACK
                meets &= near >= ball - SLACK
                meets[np.arange(len(c)), c] = True
                at = np.logical_or.reduceat(meets[:, order], starts, axis=1)[:, spread]
                row, other = np.nonzero(at)
                mine = own[part][row]
                take = pa.array(row + part.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(mine, other).astype(np.int32)), pa.array(np.maximum(mine, other).astype(np.int32)), pa.array(mine <= other),
                     *[batch.column(i).take(take) for i in (2, 3, 4)]],
                    names=["i", "j", "on_left", "v", "m", "vec"],
                )

    return home.select("cell", "near", "v", "m", "vec").mapInArrow(run, f"i int, j int, on_left boolean, v long, m long, vec {dict(home.dtypes)['vec']}")


def _block(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v")
        same = rows["i"].iat[0] == rows["j"].iat[0]
        x = unit(np.stack(rows["vec"].to_numpy()))
        v, m, on_left = rows["v"].to_numpy(), rows["m"].to_numpy(), rows["on_left"].to_numpy()
        left, right = np.flatnonzero(on_left), np.flatnonzero(on_left if same else ~on_left)
        links, root = np.zeros(len(v)), np.arange(len(v))
        # floats find the candidates, doubles decide near the threshold
        rough, margin = x.astype(np.float32), 1e-6 + 2e-7 * x.shape[1]
        theirs = rough[right].T
        for part in _slices(len(left), len(right)):
            cosine = rough[left[part]] @ theirs
            a, b = np.nonzero(cosine >= threshold - margin)
            close = cosine[a, b] < threshold + margin
            a, b = left[part][a], right[b]
            keep = a != b
            near = np.flatnonzero(close & keep)
            for some in _slices(len(near), x.shape[1]):
                at = near[some]
                keep[at] = np.einsum("ij,ij->i", x[a[at]], x[b[at]]) >= threshold
            a, b = a[keep], b[keep]
            links += np.bincount(a, weights=m[b], minlength=len(v))
            if not same:
                links += np.bincount(b, weights=m[a], minlength=len(v))
            # components so far, joined by this part's links; a root is its component's first row
            p, q = root[a], root[b]
            p, q = p[p != q], q[p != q]
            low = np.arange(len(v))
            while len(p):
                both, before = np.minimum(low[p], low[q]), low.copy()
                np.minimum.at(low, p, both)
                np.minimum.at(low, q, both)
                low = low[low]
                if (low == before).all():
                    break
            root = low[root]
        out = pd.DataFrame({"v": v, "links": links.astype(np.int64), "root": v[root]})
        return out[out["links"] > 0]

    return run


def near_duplicates(
    df: DataFrame, key: str, vector: str, threshold: float = 0.95, seed: int = 11, cells: int | None = None,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of df: how many other rows have a cosine of threshold or more, the
    smallest key reachable over such links, and whether the row is its component's representative.

    Equal vectors are one row with a count from the start, so copies cost nothing and are never paired. The k-means cells
    (square root of the distinct vectors) are fitted on about SAMPLE_ROWS vectors; all vectors are assigned. Cells lie in tiles of
    BLOCK vectors, and each pair of tiles that may hold a link is a task of its own: every link is found once and counts for both
    ends. The bounds that leave out pairs of tiles are exact, so the result is, on any data; where vectors have no
    clusters, nothing can be left out, and every pair is compared. A task gives counts and the edges of its components (at most
    one a row), not pairs.

    Null, empty and zero vectors and vectors with null or non-finite components link with nothing and are kept. Vectors of
    different lengths never link. Null keys stand last: a component of null keys only has a null id. Repeated rows link with
    each other. An empty table gives an empty result. Other columns are ignored.
    """
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"  # no component loses digits
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("vec"))
    good = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    groups = rows.where(good).groupBy("vec").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("low"))
    groups = materialise(groups.withColumn("v", F.monotonically_increasing_id()), "vectors")
    found = None
    for dims, n in sorted(tuple(r) for r in groups.groupBy(F.size("vec")).count().collect()):  # one row a vector length
        part = groups.where(F.size("vec") == dims)
        k = cells or max(1, min(MOST_CELLS, math.isqrt(n)))
        centres = centroids(part, n, k, seed) if k > 1 else np.ones((1, dims)) / math.sqrt(dims)
        home = materialise(homes(part, centres), "homes")
        sizes, lows = np.zeros(len(centres), np.int64), np.ones(len(centres))
        for r in home.groupBy("cell").agg(F.count(F.lit(1)), F.min("near")).collect():  # one row a cell
            sizes[r[0]], lows[r[0]] = r[1], r[2]
        placed = meetings(home, centres, sizes, lows, threshold).withColumn("dims", F.lit(dims))
        found = placed if found is None else found.unionByName(placed)
    if found is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    pairs = found.groupBy("dims", "i", "j").applyInPandas(_block(threshold), "v long, links long, root long")
    pairs = materialise(pairs, "links")
    counts = pairs.groupBy("v").agg(F.sum("links").alias("links"))
    roots = components(pairs.select(F.col("v").alias("src"), F.col("root").alias("dst")))
    groups = (
        groups.join(counts, "v", "left").join(roots.withColumnRenamed("node", "v"), "v", "left")
        .select("vec", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "low", F.coalesce("root", "v").alias("root"))
    )
    lowest = groups.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = groups.join(lowest, "root").select("vec", "n_links", "component_id")
    out = rows.withColumn("_at", F.when(good, F.col("vec"))).join(groups.withColumnRenamed("vec", "_at"), "_at", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def op4(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings, "vec_id", "embedding", 0.95)


OP4_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM e
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), nz AS (SELECT * FROM ok WHERE n > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM nz a JOIN nz b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM e
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
