"""Resampling of documents towards a target's distribution of hashed n-grams, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = {"n_features", "weight", "score", "rank"}
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """The words of a text, lower-cased in A-Z only: runs of digits, letters and all that is not ASCII; none of a null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(0)), F.array().cast("array<string>"))


def ngrams(words: Column, n: int) -> Column:
    """All runs of 1 to n consecutive words, joined by one space, with repeats."""
    parts = [words]
    for k in range(2, n + 1):
        # a run's words side by side, each from a list that begins one later
        length = F.greatest(F.size(words) - (k - 1), F.lit(0))
        names = [f"w{i}" for i in range(k)]
        runs = F.arrays_zip(*[F.slice(words, i + 1, length).alias(w) for i, w in enumerate(names)])
        parts.append(F.transform(runs, lambda r: F.concat_ws(" ", *[r[w] for w in names])))  # noqa: B023
    return F.concat(*parts) if n > 1 else words


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(df: DataFrame, text: str, n: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket. Summed where the rows lie before the shuffle of at most one row
    a bucket and task."""
    return df.select(F.explode(ngrams(words_of(text), n)).alias("f")).groupBy(bucket_of(F.col("f"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str, n: int, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 * ln of its smoothed share of the target over that of docs)."""
    s, t = (bucket_counts(x, text, n, buckets) for x in (docs, target))
    both = s.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(t.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    held = both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    held = materialise(held.coalesce(1), "gains")  # a row a bucket, whatever the input
    total = held.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return held.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # one row


def resample(docs: DataFrame, target: DataFrame, key: str, text: str, n: int = 1, buckets: int = 10_000, least: int = 20, share: tuple[int, int] = (10, 100), seed: str = "2024") -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of docs; rank, from 1, for the share of the documents of at least so many words
    that resembles target's texts most, with noise seeded by key; null for all others.

    Features are exploded where the texts are read, counted by bucket, and each joined with its bucket's gain: a table of buckets rows, broadcast
    as its size is this parameter. Features sum up to their document before the shuffle, which sees one narrow row a document. Ranks come from a range
    sort: each range's place in it plus the rows of the ranges before.

    A null or wordless text has no features and weight 0; a null key is hashed as an empty one. Equal scores are ordered by key, nulls first, then by
    n_features; rows equal in all of them are exchangeable. Repeated rows count as often as they occur. Only key and text of docs are read, so other
    columns may have any name; a key named as one of the results comes back led by an underscore. Empty docs give no rows; an empty target makes all buckets' counts t zero.
    """
    spark = docs.sparkSession
    gain = F.broadcast(gains(docs.select(F.col(text).alias("text")), target.select(F.col(text).alias("text")), "text", n, buckets))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("words", words_of("text"))
    features = rows.select("row", "key", F.size("words").alias("n_words"), F.explode_outer(ngrams(F.col("words"), n)).alias("f"))
    known = features.select("row", "key", "n_words", bucket_of(F.col("f"), buckets).alias("bucket")).join(gain, "bucket", "left")
    sums = known.groupBy("row").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    of = F.greatest(F.col("n_features"), F.lit(1).cast("long"))
    weight = F.expr("div(sum - pmod(sum, of), of)")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4_294_967_296.0)))
    scored = sums.withColumn("of", of).select("row", "key", "n_features", (F.col("n_words") >= least).alias("in"), weight.alias("weight"), noise.alias("noise"))
    scored = scored.select("row", "key", "n_features", "in", "weight", (F.col("weight") + F.col("noise")).alias("score"))
    scored = materialise(scored, "scores")  # narrow rows; sampled for the ranges, then sorted
    order = [F.desc("in"), F.desc("score"), F.asc("key"), F.asc("n_features"), F.asc("row")]
    placed = scored.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = placed.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND((1 << 33) - 1))
    placed = materialise(placed, "placed")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("in").alias("eligible"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    quota = F.expr(f"div({share[0]} * eligible, {share[1]})")
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("eligible").over(whole).alias("eligible"))
    parts = parts.select("part", "base", quota.alias("quota"))
    rank = F.col("base") + F.col("at") + 1
    out = placed.join(F.broadcast(parts), "part")  # a row a partition
    name = f"_{key}" if key.lower() in RESULT else key
    return out.select(F.col("key").alias(name), "n_features", "weight", "score", F.when(rank <= F.col("quota"), rank).alias("rank"))


def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark, "doc_id", "text", 1, 10_000, 20, (10, 100), "2024")


OP12_SQL = r"""
WITH RECURSIVE steps(n, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS f FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
words AS (SELECT f, hex(f) AS x FROM (SELECT f FROM dw UNION SELECT f FROM bw)),
hashed AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM words, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (f) GROUP BY ALL),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (f) GROUP BY ALL),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN hashed USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT d.doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= 10 * (SELECT count(*) FROM z WHERE words >= 20) // 100 THEN k END AS rank FROM z
"""
