"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

HEX53 = 13  # hexadecimal digits of a hash that are used: 52 bits, exact in a double


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u)/weight for u in (0, 1) hashed from key and shard; the smallest score wins the record."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, HEX53), 16, 10).cast("double")
    return -F.log((h + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _winner(key: Column, weights: list[float]) -> Column:
    best = F.least(*[F.struct(_score(key, j, w).alias("s"), F.lit(j).alias("j")) for j, w in enumerate(weights)])
    return best["j"]


def shard(
    df: DataFrame, key: str, weights: list[float], grown: list[float] | None = None,
) -> DataFrame:
    """Add shard, slot (gapless from 0 within the shard) and, where grown is given, grown_shard.

    The shard depends on the key and the weights alone. A further shard takes records only into
    itself; a raised weight moves records only into that shard. Scores are narrow expressions. Slots follow
    the shard's order of key hashes, then of the other columns, by a range sort over all rows, so that no task holds a shard or
    all rows of a key.

    Null keys count as the text "null" and share a shard; repeated keys share a shard and get slots of
    their own; an empty table stays empty. Columns of df are kept; shard, slot and grown_shard replace
    columns of the same names.
    """
    if len(weights) < 2 or min([*weights, *(grown or [1])]) <= 0:
        raise ValueError("at least two shards, of positive weights")
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    out = df.drop("shard", "slot", "grown_shard")
    kept = out.columns
    out = out.withColumn("shard", _winner(k, weights))
    if grown is None:
        out = out.withColumn("grown_shard", F.lit(None).cast("int"))
    elif list(grown[: len(weights)]) == list(weights) and len(grown) == len(weights) + 1:
        # one more shard: the winner among the old ones is known, only the new score is compared
        old = F.element_at(F.array(*[_score(k, j, w) for j, w in enumerate(weights)]), F.col("shard") + 1)
        new = len(weights)
        out = out.withColumn("grown_shard", F.when(_score(k, new, grown[-1]) < old, F.lit(new)).otherwise(F.col("shard")))
    else:
        out = out.withColumn("grown_shard", _winner(k, grown))
    ties = [F.col(c) for c, t in df.select(*kept).dtypes if not t.startswith(("map", "variant"))]
    out = numbered(out, "shard", [F.md5(k.cast("binary")), *ties], "slot")
    return out.select(*kept, "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op3(docs: DataFrame, shards: int = 40) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shard(rows, "doc_id", [1.0] * shards, [1.0] * (shards + 1))

