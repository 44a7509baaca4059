"""Context-tree weighting of bytes: Krichevsky-Trofimov estimates of all context depths, mixed, learnt from a whole corpus."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, materialise
from .shingles import WordHashes

DEPTH = 5  # bytes of the longest context
END = 10  # a line feed: no word holds it
END_WORD = 0x0E5D  # the end's key among the word hashes
CHUNK_BYTES = 32_000_000  # of text that asks for its contexts together, about
PART_BYTES = 1_000_000  # of text that is worked on at once
PACK = 1_000_000  # values on their way back that are packed together, about
GRAM, WORD_KEY, DOC = 0, 1, 2  # kinds of rows, in the order in which a chunk reads them
LOG_HALF = math.log(0.5)
SPACES = re.compile(rb"[\x20\x09-\x0D]")
BITS = range(8)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series eight steps further up."""
    low = np.ones_like(x)
    for i in range(8):
        low *= x + i
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(low)


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a bit sequence with n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


# ---- from texts to bytes in their contexts


class Part:
    """About PART_BYTES of texts: pieces of bytes with the DEPTH bytes before each, their words, and the row each comes from."""

    def __init__(self):
        self.rows, self.pads, self.bodies, self.words, self.size = [], [], [], [], 0

    def add(self, row: int, pad: bytes, body: bytes, words: list[bytes]) -> None:
        self.rows.append(row)
        self.pads.append(pad)
        self.bodies.append(body)
        self.words.append(words)
        self.size += len(body)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, number of keys of each piece). A key holds, from its highest byte down, the DEPTH bytes before a byte, the
        nearest first, and that byte."""
        sizes = np.array([len(b) for b in self.bodies], np.int64)
        joined = np.frombuffer(b"".join([x for pair in zip(self.pads, self.bodies, strict=True) for x in pair]), np.uint8).astype(np.int64)
        n = len(joined) - DEPTH
        key = np.zeros(n, np.int64)
        for back in range(1, DEPTH + 1):
            key <<= 8
            key |= joined[DEPTH - back : DEPTH - back + n]
        key <<= 8
        key |= joined[DEPTH:]
        # positions of the next piece's pad are no predictions
        real = np.ones(len(joined), bool)
        starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
        for i in range(DEPTH):
            real[starts + i] = False
        return key[real[DEPTH:]], sizes


def pieces(text: bytes | None) -> Iterator[tuple[bytes, bytes, list[bytes]]]:
    """(bytes before, bytes, words) of a text's pieces. A text's bytes are its words, lower-cased in A-Z, with single spaces between,
    and an end; before it stand ends. Texts of more than PART_BYTES are cut at white space."""
    pad, at, text = bytes([END]) * DEPTH, 0, text or b""
    first = True
    while True:
        cut = len(text)
        if cut - at > PART_BYTES:
            space = SPACES.search(text, at + PART_BYTES)
            cut = space.start() if space else cut
        words = text[at:cut].lower().split()
        body = b" ".join(words) if first or not words else b" " + b" ".join(words)
        first = first and not words
        if cut == len(text):
            yield pad, body + bytes([END]), words
            return
        if body:
            yield pad, body, words
            pad = (pad + body)[-DEPTH:]
        at = cut


def parts(texts: Iterator[tuple[int, bytes | None]]) -> Iterator[Part]:
    part = Part()
    for row, text in texts:
        for piece in pieces(text):
            part.add(row, *piece)
            if part.size >= PART_BYTES:
                yield part
                part = Part()
    if part.rows:
        yield part


def _tokens(part: Part, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of keys of each piece) of the words, and of the end with a text's last piece."""
    last = np.array([b[-1] == END for b in part.bodies])
    h, counts = words.of_words(part.words)
    sizes = counts + last
    keys = np.empty(int(sizes.sum()), np.int64)
    inner = np.ones(len(keys), bool)
    inner[(np.cumsum(sizes) - 1)[last]] = False
    keys[inner], keys[~inner] = h.view(np.int64), END_WORD
    return keys, sizes


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(keys)
    return found, np.bincount(codes, learn, len(found)).astype(np.int64)


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return [(keys, np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64))]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct keys of bytes and words with their counts in its training texts."""
    words, now, found = WordHashes(), None, {GRAM: [], WORD_KEY: []}

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, have in found.items():
            if have:
                keys, n = _summed(have)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), x, np.int32)) for x in (now, kind)] + [pa.array(keys), pa.array(n)], names=["chunk", "kind", "key", "n"])
                found[kind] = []

    for chunk, _, rows in runs(batches):
        if chunk != now:
            yield from flush()
            now = chunk
        learn = ~rows.column("held_out").to_numpy(zero_copy_only=False)
        for part in parts((i, x.as_py()) for i, x in enumerate(rows.column("text"))):
            mine = learn[part.rows].astype(float)
            for kind, (keys, sizes) in ((GRAM, part.grams()), (WORD_KEY, _tokens(part, words))):
                found[kind].append(_counted(keys, np.repeat(mine, sizes)))
                if len(found[kind]) > 8:
                    found[kind] = _summed(found[kind])
    yield from flush()


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(chunk, kind, rows) of runs of rows whose first two columns are the same."""
    for batch in batches:
        if batch.num_rows:
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1]), True])
            for a, b in pairwise(cuts):
                yield int(chunk[a]), int(kind[a]), batch.slice(a, b - a)


# ---- the trees, one depth at a time: a row for each context and byte in it


def columns(name: str) -> list[str]:
    """A column for each of a byte's eight binary decisions, the highest bit first."""
    return [f"{name}{i}" for i in BITS]


NODE_COLUMNS = ["ctx", "byte", "n", *columns("own"), *columns("share"), *columns("ln")]
NODES = "ctx long, byte int, n long, " + ", ".join(f"{c} double" for c in NODE_COLUMNS[3:])


def nodes_of(ctx: np.ndarray, byte: np.ndarray, n: np.ndarray, below: list[np.ndarray] | None) -> list[np.ndarray]:
    """Of whole contexts' rows in order: for each bit of a row's byte the node's own estimate of it, that estimate's weight against the
    children's, and (in the node's first row, 0 in its others) ln of the weighted probability of all that the node saw.
    below holds that of the children, in any rows of their node; None at the deepest contexts."""
    own, share, ln = [], [], []
    new, n = np.r_[True, ctx[1:] != ctx[:-1]], n.astype(float)
    for i in BITS:
        head = byte >> (8 - i)
        first = new.copy()
        first[1:] |= head[1:] != head[:-1]
        starts, node = np.flatnonzero(first), np.cumsum(first) - 1
        bit = byte >> (7 - i) & 1
        total, ones = np.add.reduceat(n, starts), np.add.reduceat(n * bit, starts)
        mine = kt_block(total - ones, ones)
        mixed = mine if below is None else LOG_HALF + np.logaddexp(mine, np.add.reduceat(below[i], starts))
        own.append((np.where(bit == 1, ones[node], (total - ones)[node]) + 0.5) / (total[node] + 1))
        share.append(np.exp((mine if below is None else LOG_HALF + mine) - mixed)[node])
        row = np.zeros(len(byte))
        row[starts] = mixed
        ln.append(row)
    return [*own, *share, *ln]


def _nodes(deepest: bool):
    """nodes_of over rows sorted by context; a context's rows, 256 at most, are held back until they are complete."""

    def done(x: list[np.ndarray]) -> pa.RecordBatch:
        got = nodes_of(*x[:3], None if deepest else x[3:])
        return pa.RecordBatch.from_arrays([*map(pa.array, x[:3]), *map(pa.array, got)], names=NODE_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            x = [c.to_numpy() for c in batch.columns]
            x = x if rest is None else [np.concatenate(p) for p in zip(rest, x, strict=True)]
            if len(x[0]):
                cut = np.searchsorted(x[0], x[0][-1])
                if cut:
                    yield done([c[:cut] for c in x])
                rest = [c[cut:] for c in x]
        if rest is not None:
            yield done(rest)

    return run


def predictions(counts: DataFrame) -> DataFrame:
    """(key, value) of (key, n): log10 of the mixed probability of every key's byte in its context.

    Counts and ln of weighted probabilities go up the tree as sums, level by level; estimates and weights come down it by joins. The unit of
    work is a context, which has 256 bytes at most, however often it occurs."""
    rows = counts.select(F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(255).cast("int").alias("byte"), "n")
    tree = {}
    for depth in range(DEPTH, -1, -1):
        nodes = rows.repartition("ctx").sortWithinPartitions("ctx", "byte").mapInArrow(_nodes(depth == DEPTH), NODES)
        tree[depth] = materialise(nodes, f"nodes{depth}")
        sums = [F.sum(c).alias(c) for c in ("n", *columns("ln"))]
        rows = tree[depth].groupBy(F.shiftright("ctx", 8).alias("ctx"), "byte").agg(*sums)
    # a: what the shallower estimates have decided; b: the weight left for the deeper ones
    own, share, a, b = ([F.col(c) for c in columns(x)] for x in ("own", "share", "a", "b"))
    path = tree[0].select("ctx", "byte", *[(share[i] * own[i]).alias(f"a{i}") for i in BITS], *[(1 - share[i]).alias(f"b{i}") for i in BITS])
    for depth in range(1, DEPTH + 1):
        path = tree[depth].withColumn("above", F.shiftright("ctx", 8)).join(path.withColumnRenamed("ctx", "above"), ["above", "byte"])
        if depth < DEPTH:
            path = path.select("ctx", "byte", *[(a[i] + b[i] * share[i] * own[i]).alias(f"a{i}") for i in BITS], *[(b[i] * (1 - share[i])).alias(f"b{i}") for i in BITS])
    value = sum((F.log10(a[i] + b[i] * own[i]) for i in BITS), F.lit(0.0))
    out = materialise(path.select(F.shiftleft("ctx", 8).bitwiseOR(F.col("byte").cast("long")).alias("key"), value.alias("value")), "values")
    discard(*tree.values())
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, kind, key, value) as few long rows a chunk and kind; about PACK of them are held."""
    names, have, size = ["chunk", "kind", "keys", "values"], [], 0

    def flush() -> pa.RecordBatch:
        chunk, kind, key, value = (np.concatenate(x) for x in zip(*have, strict=True))
        order = np.lexsort((key, kind, chunk))
        chunk, kind, key, value = chunk[order], kind[order], key[order], value[order]
        starts = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])])
        cuts = pa.array(np.r_[starts, len(key)], pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (key, value)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array(kind[starts]), *lists], names=names)

    for batch in batches:
        have.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= PACK:
            yield flush()
            have, size = [], 0
    if size:
        yield flush()


def _score(total: int, kinds: int):
    """Rows of a chunk's documents with their sums: base is the unigram score of the words and end, score the mixed byte score."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "train_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, read, index = WordHashes(), None, {GRAM: [], WORD_KEY: []}, {}
        for chunk, kind, rows in runs(batches):
            if chunk != now:
                now, read, index = chunk, {GRAM: [], WORD_KEY: []}, {}
            if kind != DOC:
                read[kind].append([rows.column(c).flatten().to_numpy() for c in ("keys", "values")])
                continue
            if not index:
                for k, have in read.items():
                    keys, values = (np.concatenate(x) for x in zip(*have, strict=True))
                    index[k] = (pd.Index(keys), values)
                read = {}
            size = rows.num_rows
            tokens, known, n_bytes, base, score = (np.zeros(size) for _ in range(5))
            for part in parts((i, x.as_py()) for i, x in enumerate(rows.column("text"))):
                at = np.array(part.rows)
                key, sizes = part.grams()
                value = index[GRAM][1][index[GRAM][0].get_indexer(key)]
                n_bytes += np.bincount(at, sizes, size)
                score += np.bincount(np.repeat(at, sizes), value, size)
                key, sizes = _tokens(part, words)
                c = index[WORD_KEY][1][index[WORD_KEY][0].get_indexer(key)]
                tokens += np.bincount(at, sizes, size)
                known += np.bincount(np.repeat(at, sizes), c > 0, size)
                base += np.bincount(np.repeat(at, sizes), np.log10((c + 0.1) / (total + 0.1 * (kinds + 1))), size)
            counts = [pa.array(x.astype(np.int64)) for x in (tokens, known)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), *counts, pa.array(base), pa.array(score), pa.array(n_bytes.astype(np.int64)), pa.array(np.full(size, total))],
                names=names)

    return run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, train_tokens long"


def score_texts(df: DataFrame, key: str, text: str, folds: int = 10) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of df.

    The model learns from the rows whose crc32(key) mod folds is not 0: a context tree over the DEPTH bytes before each bit of
    a text, every node a Krichevsky-Trofimov estimate, mixed with weight 1/2 against its children. What is scored is the text's
    words, lower-cased in A-Z, with single spaces between, and an end: score is the log10 probability of these bytes, base_score
    the add-0.1 unigram score of its words and end.

    Texts are dealt to chunks of about CHUNK_BYTES by hash. A chunk sends each distinct byte context and word it holds once, with
    its count, so what travels is a fraction of the text and grows with it; the values come back to the chunks that asked, and a chunk
    streams its texts past them. No task and no broadcast holds the model: the tree is built a depth at a time in groups of
    one context.

    Null and empty texts are an end alone. Long texts are worked on in pieces. Null keys hash as the empty text and are held out with
    their fold. Repeated rows count each time. With no training row every estimate is 1/2, and the formula gives every token the same
    share. An empty table gives an empty result. Other columns are ignored.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), (crc_mod(key, folds) == 0).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    chunks = max(1, -(-size // CHUNK_BYTES))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(DOC).alias("kind"), "doc_id", "held_out", "text")
    gathered = rows.repartitionById(chunks, "chunk").mapInArrow(_gather, "chunk int, kind int, key long, n long")
    gathered = materialise(gathered, "gathered")
    counts = gathered.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    words = materialise(counts.where(F.col("kind") == WORD_KEY), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    grams = predictions(counts.where(F.col("kind") == GRAM).select("key", "n"))
    values = grams.select(F.lit(GRAM).alias("kind"), "key", "value").unionByName(words.select("kind", "key", F.col("n").cast("double").alias("value")))
    known = gathered.select("chunk", "kind", "key").join(values, ["kind", "key"]).select("chunk", "kind", "key", "value")
    known = materialise(known.mapInArrow(_packed, "chunk int, kind int, keys array<long>, values array<double>"), "known")
    discard(gathered, grams, words)
    both = known.unionByName(rows, allowMissingColumns=True)
    out = both.repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(*_score(total, kinds))
    return out.select(
        F.col("doc_id").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


def op9(docs: DataFrame) -> DataFrame:
    return score_texts(docs, "doc_id", "text", 10)
