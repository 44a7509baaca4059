"""Exact Jaccard join of word-shingle sets with prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, shuffle_partitions, text_key
from .shingles import WordHashes, scramble, shingle_sets

SLICE, SLICE_TOKENS = 4_000, 1_000_000  # documents and tokens that travel together, about
SLICE_BYTES = 6_000_000  # of text of such a slice, about
HOT = 32  # texts from which on the order of tokens tells no frequencies apart
BUCKET_BYTES = 8_000_000  # of text whose tokens one bucket holds, about
FAN = 256  # slices whose tokens are merged before a bucket gets them
PAIRED = 32  # holders of a prefix token up to which they are paired
BLOCK_TOKENS = 400_000  # tokens of a part of a verified block, about
ORDERS = (0x5BD1E9955BD1E995, 0xC2B2AE3D27D4EB4F)  # salts of the hash orders besides the frequency order


def _needed(n, num: int, den: int):
    """Tokens that a set of n must share with any set it links with."""
    return -(-num * n // den)


ROWS = "bucket int, refs binary, counts binary, tokens binary"


def _packed(to: np.ndarray, ref: np.ndarray, token: np.ndarray, kind: str) -> Iterator[tuple]:
    if not len(to):
        return
    order = np.lexsort((ref, to))
    to, ref, token = to[order], ref[order], token[order]
    at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    for lo, hi in zip(at, [*at[1:], len(to)], strict=True):
        r, c = np.unique(ref[lo:hi], return_counts=True)
        yield int(to[lo]), r.tobytes(), c.astype("<u4").tobytes(), token[lo:hi].astype(kind).tobytes()


def _rows_of(ref: np.ndarray, token: np.ndarray, buckets: int, held: int) -> list[tuple]:
    """Rows for (key, bucket << 32 | token) pairs: a token that held or more texts here hold goes to its bucket alone, and to its texts'
    homes, which are buckets -1 - (key mod buckets), as hot."""
    order = np.sort(token)
    each = order[held - 1 :][order[held - 1 :] == order[: len(order) - held + 1]] if len(order) >= held else order[:0]
    each = each[np.r_[True, each[1:] != each[:-1]]] if len(each) else each
    del order
    hot = np.isin(token, each)
    out = list(_packed(-1 - ref[hot] % buckets, ref[hot], token[hot], "<i8"))
    cuts = np.flatnonzero(np.r_[True, each[1:] >> 32 != each[:-1] >> 32]) if len(each) else each
    out += [(int(x[0] >> 32), b"", b"", (x & 0xFFFFFFFF).astype("<u4").tobytes()) for x in np.split(each, cuts[1:]) if len(x)]
    token, ref = token[~hot], ref[~hot]
    return out + list(_packed(token >> 32, ref, token & 0xFFFFFFFF, "<u4"))


def _ship(k: int, buckets: int, held: int, docs: int):
    """The tokens of slices of texts, in rows of four kinds. To a token's bucket: (keys, counts, tokens) of the texts that hold its
    tokens, and of tokens that held or more texts of the slice hold the tokens alone. To a text's home: its set size, and its hot
    tokens. So no bucket gets more than held keys a token and slice."""
    names = ["bucket", "refs", "counts", "tokens"]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def rows_of(refs: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
        sizes = np.array([len(s) for s in sets], np.int64)
        home = refs % buckets
        out = [(-1 - int(b), refs[home == b].tobytes(), sizes[home == b].astype("<u4").tobytes(), b"") for b in np.unique(home)]
        token = np.concatenate(sets)
        token = ((token >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | token & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return out + _rows_of(np.repeat(refs, sizes), token, buckets, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, sets, tokens = WordHashes(), {}, [], 0

        def flush() -> pa.RecordBatch:
            rows = rows_of(np.array(list(seen), np.int64), sets)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                new = {r: t for r, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if r not in seen}
                found = shingle_sets(list(new.values()), k, words)
                seen |= dict.fromkeys(new)
                sets += found
                tokens += sum(map(len, found))
                if len(sets) >= docs or tokens >= SLICE_TOKENS:
                    yield flush()
                    seen, sets, tokens = {}, [], 0
        if sets:
            yield flush()

    return run, ROWS


def _join(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


SIZES, HELD_HOT = -1, -2  # what a row for a home holds, in place of a bucket


def _holders(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hot tokens, tokens, their holders) of a bucket's rows, each holder of a token once: a copy that another slice sent too sent
    the same tokens but those hot there, which are hot here."""
    alone = rows["refs"].map(len) == 0
    hot, rows = np.unique(_join(rows["tokens"][alone], "<u4")), rows[~alone]
    refs, tokens = np.repeat(_join(rows["refs"], "<i8"), _join(rows["counts"], "<u4").astype(np.int64)), _join(rows["tokens"], "<u4")
    order = np.lexsort((refs, tokens))
    tokens, refs = tokens[order], refs[order]
    once = np.r_[True, (tokens[1:] != tokens[:-1]) | (refs[1:] != refs[:-1])] if len(tokens) else np.zeros(0, bool)
    return hot, tokens[once], refs[once]


def _merged(buckets: int, held: int):
    """A bucket's rows from FAN slices as those of one slice."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        b = int(rows["bucket"].iloc[0])
        hot, tokens, refs = _holders(rows)
        out = [(b, b"", b"", hot.tobytes())] if len(hot) else []
        out += _rows_of(refs, b << 32 | tokens.astype(np.int64), buckets, held)
        return pd.DataFrame(out, columns=["bucket", "refs", "counts", "tokens"])

    return run, ROWS


def _frequencies(buckets: int, most: int):
    """Of a token bucket, the tokens that two or more texts hold, with their frequency up to most, sent back by text."""
    columns = ["home", "bucket", "refs", "counts", "tokens", "dfs"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        b = int(rows["bucket"].iloc[0])
        if b < 0:
            plain = rows["tokens"].map(len) == 0
            out = [(-1 - b, kind, b"".join(r["refs"]), b"".join(r["counts"]), b"".join(r["tokens"]), b"") for kind, r in ((SIZES, rows[plain]), (HELD_HOT, rows[~plain])) if len(r)]
            return pd.DataFrame(out, columns=columns)
        hot, tokens, refs = _holders(rows)
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        n = np.diff(np.r_[starts, len(tokens)])
        df = np.minimum(np.repeat(n, n), most)
        df[np.isin(tokens, hot)] = most
        shared = df > 1
        tokens, refs, df = tokens[shared], refs[shared], df[shared].astype("<u2")
        home = refs % buckets
        order = np.lexsort((refs, home))
        tokens, refs, df, home = tokens[order], refs[order], df[order], home[order]
        out, found = [], np.unique(home)
        for h, lo, hi in zip(found.tolist(), np.searchsorted(home, found), np.searchsorted(home, found, "right"), strict=True):
            r, c = np.unique(refs[lo:hi], return_counts=True)
            out.append((h, b, r.tobytes(), c.astype("<u4").tobytes(), tokens[lo:hi].tobytes(), df[lo:hi].tobytes()))
        return pd.DataFrame(out, columns=columns)

    return run, "home int, bucket int, refs binary, counts binary, tokens binary, dfs binary"


def _prefixes(num: int, den: int, most: int):
    """(ref, n, prefix): the shared tokens among the first n - needed + 1 in the order of rising frequency; null
    if there is none, as then the set links with no other. Tokens of one text only come first in that order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sized = rows["bucket"] == SIZES
        ref, at = np.unique(_join(rows["refs"][sized], "<i8"), return_index=True)
        n = _join(rows["counts"][sized], "<u4").astype(np.int64)[at]
        holder, token, df = [], [], []
        for hot in (False, True):
            rest = rows[~sized & ((rows["bucket"] == HELD_HOT) == hot)]
            counts = _join(rest["counts"], "<u4").astype(np.int64)
            holder.append(np.repeat(np.searchsorted(ref, _join(rest["refs"], "<i8")), counts))
            if hot:
                token.append(_join(rest["tokens"], "<i8"))
                df.append(np.full(len(token[-1]), most))
            else:
                low = _join(rest["tokens"], "<u4").astype(np.int64)
                token.append(low | np.repeat(rest["bucket"].to_numpy().astype(np.int64), [len(t) // 4 for t in rest["tokens"]]) << 32)
                df.append(_join(rest["dfs"], "<u2").astype(np.int64))
        holder, token, df = np.concatenate(holder), np.concatenate(token), np.concatenate(df)
        order = np.lexsort((token, df, holder))
        holder, token = holder[order], token[order]
        once = np.r_[True, (token[1:] != token[:-1]) | (holder[1:] != holder[:-1])] if len(token) else np.zeros(0, bool)
        holder, token = holder[once], token[once]
        have = np.bincount(holder, minlength=len(ref))
        starts = np.cumsum(have) - have
        take = np.minimum((n - _needed(n, num, den) + 1) - (n - have), have)
        prefix = [token[s : s + t] if t > 0 else None for s, t in zip(starts, take, strict=True)]
        return pd.DataFrame({"ref": ref, "n": n, "prefix": prefix})

    return run, "ref long, n long, prefix array<long>"


def _first(tokens: np.ndarray, salt: int, n: int) -> np.ndarray:
    """The first n tokens in a hash order, sorted by that hash."""
    with np.errstate(over="ignore"):
        return np.sort(np.partition(scramble(tokens ^ np.uint64(salt)), n - 1)[:n])


def _orders(k: int, num: int, den: int):
    """(ref, tokens, one, two): a text's set, and its prefixes under the hash orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), k, words)
            first = [[_first(s, salt, len(s) - _needed(len(s), num, den) + 1).view(np.int64) for s in sets] for salt in ORDERS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), *[pa.array(f, pa.list_(pa.int64())) for f in first]], names=["ref", "tokens", "one", "two"])

    return run, "ref long, tokens binary, one array<long>, two array<long>"


def _hits(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of each of others are in the sorted array own."""
    sizes = np.array([len(o) for o in others])
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
    return np.add.reduceat((own[at] == joined).astype(np.int64), np.cumsum(sizes) - sizes)


def _verify(num: int, den: int):
    """Links between the left and right documents of a block, as a spanning forest (at most one edge a document).

    A pair is a candidate if its frequency-order prefixes share a token; it goes on if its sizes allow a link and its
    prefixes under every hash order share a token too; then the whole sets are intersected. Pairs that found
    links connect already are passed over.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ref", ignore_index=True)
        ref, left, right = rows["ref"].to_numpy(), rows["on_left"].to_numpy(), rows["on_right"].to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        n = np.array([len(s) for s in sets])
        keep = n - _needed(n, num, den) + 1
        orders = [[_first(s, salt, p) for s, p in zip(sets, keep, strict=True)] for salt in ORDERS]
        prefix = [np.asarray(p, np.int64) for p in rows["prefix"]]
        at_right = np.flatnonzero(right)
        owner = np.repeat(at_right, [len(prefix[i]) for i in at_right])
        token = np.concatenate([prefix[i] for i in at_right]) if len(at_right) else np.empty(0, np.int64)
        by = np.argsort(token, kind="stable")
        owner, token = owner[by], token[by]
        group = np.arange(len(ref))
        edges = []
        for i in np.flatnonzero(left):
            lo, hi = np.searchsorted(token, prefix[i]), np.searchsorted(token, prefix[i], "right")
            spans = [owner[a:b] for a, b in zip(lo, hi, strict=True) if a < b]
            if not spans:
                continue
            j = np.unique(np.concatenate(spans))
            j = j[(group[j] != group[i]) & ~(left[j] & right[i] & (j < i))]
            j = j[den * np.minimum(n[j], n[i]) >= num * np.maximum(n[j], n[i])]
            for order in orders:
                if len(j):
                    j = j[_hits(order[i], [order[x] for x in j]) > 0]
            if not len(j):
                continue
            both = _hits(sets[i], [sets[x] for x in j])
            for x in j[den * both >= num * (n[i] + n[j] - both)]:
                if group[x] != group[i]:
                    edges.append((ref[i], ref[x]))
                    group[group == group[x]] = group[i]
        return pd.DataFrame(edges, columns=["src", "dst"]).astype("int64")

    return run, "src long, dst long"


def jaccard_join(df: DataFrame, key: str, text: str, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id) for every row of df. Two rows link if den * intersection >= num * union of their
    distinct k-word shingles; component_id is the smallest key reachable over links, the own key included.

    Equal texts are one set from the start. Token buckets count frequencies and tell each set which of its tokens others hold;
    a set whose frequency-order prefix holds none of them is out. A token that many texts of a slice hold is counted by its
    slices and goes to its bucket without them, and slices are merged by FAN before a bucket gets them, so a token that a third
    of the corpus holds is no group of that size.

    The holders of a prefix token are candidate pairs, and pairs go on if their sizes allow a link and their prefixes under both hash
    orders meet too. Of a prefix token with more than PAIRED holders no pairs are made: its holders are tied to the smallest of them.
    What is tied or paired forms blocks, and blocks are verified in tasks of two parts of about BLOCK_TOKENS tokens, by the same
    filters, then by whole sets. A block yields a spanning forest, so neither copies nor near copies are expanded into all pairs. Keys
    of texts and tokens are 64-bit hashes; a token bucket tells apart 32 bits of them, which can add a candidate, never lose one.

    Null texts and texts without words have no shingles and link with nothing. Texts of any length are taken whole. Null keys stand
    last; a component of null keys has a null id. Repeated rows link with each other. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = df.sparkSession
    worded = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    rows = df.select(F.col(key).alias("id"), F.when(worded, text_key(F.col(text))).alias("ref"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 2 * max(shuffle_partitions(spark), -(-size // (2 * BUCKET_BYTES)))
    docs = rows.where("ref IS NOT NULL").select("ref", "text")
    shipped = docs.mapInArrow(*_ship(k, buckets, HOT, SLICE))
    if size > FAN * SLICE_BYTES:
        shipped = materialise(shipped.withColumn("fan", F.pmod(F.xxhash64("refs", "tokens"), F.lit(-(-size // (FAN * SLICE_BYTES))))), "shipped")
        merged = shipped.where("bucket >= 0").groupBy("bucket", "fan").applyInPandas(*_merged(buckets, HOT))
        shipped = merged.unionByName(shipped.where("bucket < 0").drop("fan"))
    sets = shipped.groupBy("bucket").applyInPandas(*_frequencies(buckets, HOT))
    sets = materialise(sets.groupBy("home").applyInPandas(*_prefixes(num, den, HOT)), "sets")
    held = sets.where("prefix IS NOT NULL").select("ref", "n", F.explode("prefix").alias("token"))
    tied = held.groupBy("token").agg(F.min("ref").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    held = materialise(held.join(tied, "token"), "held")
    hubs = held.where((F.col("c") > PAIRED) & (F.col("ref") != F.col("hub"))).select(F.col("ref").alias("src"), F.col("hub").alias("dst")).distinct()
    few = held.where(F.col("c") <= PAIRED).groupBy("token").agg(F.collect_list(F.struct("ref", "n")).alias("all"))  # PAIRED at most
    two = few.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.ref < b.ref")
    sizes = den * F.least("a.n", "b.n") >= num * F.greatest("a.n", "b.n")
    pairs = materialise(two.where(sizes).select(F.col("a.ref").alias("src"), F.col("b.ref").alias("dst")).distinct(), "pairs")
    hubs = materialise(hubs, "hubs")
    asked = pairs.unionByName(hubs).select(F.explode(F.array("src", "dst")).alias("ref")).distinct()
    # copies meet where they are read; asked has each key once, and an inner join stays above the aggregate, whatever its size
    texts = docs.groupBy("ref").agg(F.first("text").alias("text")).join(asked, "ref")
    texts = materialise(texts.mapInArrow(*_orders(k, num, den)), "texts")
    for end in ("src", "dst"):
        pairs = pairs.join(texts.select(F.col("ref").alias(end), F.struct("one", "two").alias(f"of_{end}")), end)
    meet = F.arrays_overlap("of_src.one", "of_dst.one") & F.arrays_overlap("of_src.two", "of_dst.two")
    blocks = components(pairs.where(meet).select("src", "dst").unionByName(hubs))
    blocks = blocks.withColumnsRenamed({"node": "ref", "root": "block"}).join(sets.select("ref", "n", "prefix"), "ref")
    blocks = materialise(blocks, "blocks")
    parts = blocks.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).cast("int").alias("nb"))
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, 2 * total // BLOCK_TOKENS)  # small blocks are verified several in a task
    unit = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.col("block"))
    mine = blocks.join(parts, "block").select("ref", "prefix", "nb", unit.alias("unit"), F.pmod(F.xxhash64("ref"), F.col("nb")).cast("int").alias("i"))
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    places = F.transform(every, lambda j: F.struct(
        F.least(F.col("i"), j).alias("a"), F.greatest(F.col("i"), j).alias("b"), (F.col("i") <= j).alias("on_left"), (F.col("i") >= j).alias("on_right")))
    mine = mine.join(texts.select("ref", "tokens"), "ref").select("ref", "prefix", "tokens", (F.col("nb") == 1).alias("small"), "unit", F.inline(places))
    edges = mine.groupBy("small", "unit", "a", "b").applyInPandas(*_verify(num, den))
    roots = components(materialise(edges, "links")).withColumnRenamed("node", "ref")
    known = sets.select("ref", "n").join(roots, "ref", "left").select("ref", "n", F.coalesce("root", "ref").alias("root"))
    lowest = rows.where("ref IS NOT NULL").groupBy("ref").agg(F.min("id").alias("low"))
    known = materialise(known.join(lowest, "ref"), "known")
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "root").select("ref", F.col("n").alias("n_shingles"), "component_id")
    return rows.select("id", "ref").join(known, "ref", "left").select(
        F.col("id").alias(key),
        F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.col("ref").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op5(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs, "doc_id", "text", 4, 85, 100)


def sql(k: int, num: int, den: int) -> str:
    """(doc_id, n_shingles, component_id) in DuckDB's SQL, by comparing all documents that share a shingle."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * shared >= {num} * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
