"""Packing of token sequences along a space-filling curve over projected document vectors."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

DIMS, BITS = 4, 15  # 60 bits of a key
BUCKETS = 512  # of the hashed term vector
CACHE = 150_000  # encoded chunks and pieces in a worker's memory, each twice at most; forgetting them changes no result


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, d) with coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest square to the finest
        low = q - 1
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[d - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


_BUCKET = (np.arange(1 << 16, dtype=np.int64) * 2_654_435_761 >> 7) % BUCKETS


def curve_points(ids: list[np.ndarray], projection: np.ndarray) -> np.ndarray:
    """Term counts hashed to BUCKETS, damped, scaled to length 1, projected, and squashed to the integer grid."""
    vectors = np.zeros((len(ids), BUCKETS))
    for row, x in zip(vectors, ids, strict=True):
        row[:] = np.bincount(_BUCKET[x], minlength=BUCKETS)
    np.log1p(vectors, out=vectors)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    z = vectors @ projection
    return np.minimum((1 << BITS) / (1 + np.exp(-1.702 * z)), (1 << BITS) - 1).astype(np.int64)


_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")  # what the fast path takes: ASCII text and the letters of Latin-1
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")  # the tokenizer's own split, on those characters
_SHOWN = {b: chr(256 + n) for n, b in enumerate([*range(33), *range(127, 161), 173])}  # how byte-level BPE writes bytes


class _Remembered(dict):
    """Results by key in two generations: what was asked for in the present or the last one is found again."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.compute(key)
        self[key] = ids
        return ids

    def trim(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class _Pieces(_Remembered):
    """Ids of lower-cased pieces that the tokenizer's BPE model gets one by one."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model

    def compute(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()


class Encoder(_Remembered):
    """Token ids of whole texts as 16-bit numbers. Texts of plain letters skip the tokenizer's normaliser, which leaves them
    as they are but for case, and are split into its pieces; other texts go chunk by chunk (it merges nothing across a space or
    a line end) through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.pieces = _Pieces(self.tokenizer)

    def compute(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(chunk.lower())))
        return array("H", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        self.trim()
        self.pieces.trim()
        if _PLAIN.fullmatch(text):
            return self.compute(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def tokenise(df: DataFrame, tokenizer: str, end_id: int, seed: int) -> DataFrame:
    """(doc_id, text) to (rid, doc_id, n, key, ids): rid is unique, ids are 16-bit little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, projection = Encoder(tokenizer), _projection(seed)
        end = np.array([end_id], "<u2").tobytes()
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encoder.encode(t or "") + end for t in part.column(1).to_pylist()]
                key = hilbert_key(curve_points([np.frombuffer(x, "<u2") for x in ids], projection))
                n = np.array([len(x) // 2 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + len(ids))), part.column(0).cast(pa.int64()), pa.array(n), pa.array(key), pa.array(ids, pa.binary())],
                    names=["rid", "doc_id", "n", "key", "ids"],
                )
                rid += len(ids)

    return df.mapInArrow(run, "rid long, doc_id long, n long, key long, ids binary")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column(1)],
            names=["rid", "part", "local", "n"],
        )
        at = int(ends[-1]) if len(ends) else at


def pack(df: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, seed: int = 7) -> DataFrame:
    """Pieces of the documents of df (doc_id long, text string) packed into sequences of length tokens.

    Documents are ordered along the Hilbert curve (ties by row), laid end to end, and cut every length tokens: only the
    last sequence of all has padding. Row lengths are range-sorted without their ids; each range sums its lengths, the
    ranges' sums (one number a partition) give every document its global start, and a document is cut by arithmetic,
    so no task sees more than its share, whatever the keys (rows of equal keys are spread by row number).

    Null and empty texts are the end id alone; null and repeated doc_ids stay rows of their own; other columns are
    ignored; an empty table gives no pieces. Texts of any length are encoded whole.
    """
    spark = df.sparkSession
    rows = materialise(tokenise(df.select(F.col("doc_id").cast("long"), "text"), tokenizer, end_id, seed), "tokens")
    order = rows.select("rid", "n", "key").repartitionByRange(shuffle_partitions(spark), "key", "rid")
    order = order.sortWithinPartitions("key", "rid").select("rid", "n")
    order = materialise(order.mapInArrow(_places, "rid long, part int, local long, n long"), "places")
    base = order.groupBy("part").agg(F.sum("n").alias("s"))
    base = base.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"))
    start = order.join(F.broadcast(base), "part").select("rid", (F.col("base") + F.col("local")).alias("at"))  # a row a partition

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, ids, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                i = 0
                while i < len(x):
                    seq, off = divmod(at + i, length)
                    piece = x[i : i + length - off]
                    out.append((doc, i, len(piece), zlib.crc32(piece.tobytes()), len(x), seq, off))
                    i += len(piece)
            if out:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.select("rid", "doc_id", "ids").join(start, "rid").select("doc_id", "ids", "at").mapInArrow(cut, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path(), 4096, 2)
