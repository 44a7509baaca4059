"""Alignment of two tokenizers' tokens of the same texts, and how often each pair of ids ends together in the corpus."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

HOT = 1 << 16  # id pairs whose counts are broadcast
CHUNK = 1 << 20  # bytes of texts that are aligned at once
_LATIN = 0x250  # below it, both forms of the byte-level tokenizer split a text alike


class ByteLevel:
    """Ids and bytes of the byte-level tokenizer. Where its ids follow the order of its merges, texts of Latin letters go to a faster library with the same
    vocabulary and the same split of such texts."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for entry, at in vocabulary.items():
            self.bytes[at] = entry.encode() if entry in special else bytes(byte_of[c] for c in entry)
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        ids = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in self.whole.get_added_tokens_decoder()}
        self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ids == sorted(ids) else None

    def encode(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or ord(max(text)) < _LATIN):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and bytes of the piece tokenizer."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The group of each token, the A tokens' first: components, numbered in byte order, of the graph that links tokens whose byte ranges
    overlap. Token ranges lie end to end from 0 in both lists and cover the same bytes.

    Every stretch between two neighbouring ends of either list lies in one token of each, which is an edge. Edges are united by hooking
    roots on smaller roots and halving the paths, for all edges at once, until none is left between two roots."""
    cuts = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts) + len(a_ends)
    root = np.arange(len(a_ends) + len(b_ends))
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_edges = low < high
        if not open_edges.any():
            break
        np.minimum.at(root, high[open_edges], low[open_edges])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = a[open_edges], b[open_edges]
    return (np.cumsum(root == np.arange(len(root))) - 1)[root]  # roots are A tokens, so their order is the bytes'


def align(a_ids: np.ndarray, b_ids: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A places, B places) of token lists over the same bytes: members of a group are linked where
    their ranges end together, which only its last ones do."""
    a_ends, b_ends = np.cumsum(a_len[a_ids]), np.cumsum(b_len[b_ids])
    group = groups_of(a_ends, b_ends)
    of_a, of_b = group[: len(a_ids)], group[len(a_ids) :]
    _, i, j = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    same = of_a[i] == of_b[j]
    return of_a, of_b, i[same], j[same]


def _links(a_path: str, b_path: str):
    """(doc_id, text) to a row a document: its tokens' and groups' numbers, the hash of its groups, its links as a_id << 16 | b_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_tok, b_tok = ByteLevel(a_path), Pieces(b_path)
        a_len, b_len = (np.array([len(x) for x in t.bytes], np.int64) for t in (a_tok, b_tok))
        if max(len(a_len), len(b_len)) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        # how an id is written: inside its list, at the end of A's, at the end of B's
        written = [f"{i}{c}" for c in ",|;" for i in range(max(len(a_len), len(b_len)))]
        size = len(written) // 3
        row = TaskContext.get().partitionId() << 33

        def part(keys: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal row
            a_all, b_all, led = [], [], []
            for text, b in zip(texts, b_tok.encode(texts), strict=True):
                data = (" " + text).encode()
                a = a_tok.encode(" " + text) if text else []
                good = bool(text) and b"".join(map(a_tok.bytes.__getitem__, a)) == data == b"".join(map(b_tok.bytes.__getitem__, b))
                a_all.append(a if good else [])
                b_all.append(b if good else [])
            n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in (a_all, b_all))
            a_ids, b_ids = (np.fromiter(chain.from_iterable(y), np.int64, int(n.sum())) for y, n in ((a_all, n_a), (b_all, n_b)))
            of_a, of_b, i, j = align(a_ids, b_ids, a_len, b_len)
            n_groups_before = np.concatenate([[0], of_a + 1])[np.concatenate([[0], np.cumsum(n_a)])]  # documents end with a group
            a_before, b_before = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
            # all tokens as written: group by group, A's before B's
            total = int(of_a[-1]) + 1 if len(of_a) else 0
            a_count, b_count = np.bincount(of_a, minlength=total), np.bincount(of_b, minlength=total)
            codes = np.empty(len(a_ids) + len(b_ids), np.int64)
            codes[np.arange(len(a_ids)) + (np.cumsum(b_count) - b_count)[of_a]] = a_ids + size * np.diff(of_a, append=-1).astype(bool)
            codes[np.arange(len(b_ids)) + np.cumsum(a_count)[of_b]] = b_ids + 2 * size * np.diff(of_b, append=-1).astype(bool)
            pairs = (a_ids[i] << 16) | b_ids[j]
            n_links = np.searchsorted(i, a_before)
            for k in range(len(texts)):
                words = codes[a_before[k] + b_before[k] : a_before[k + 1] + b_before[k + 1]].tolist()
                led.append(hashlib.sha256("".join(map(written.__getitem__, words))[:-1].encode()).hexdigest() if words else "")
            out = [
                pa.array(np.arange(row, row + len(texts))), pa.array(keys, pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(np.diff(n_groups_before)), pa.array(np.diff(n_links)),
                pa.array(led, pa.string()), pa.ListArray.from_arrays(pa.array(n_links, pa.int32()), pa.array(pairs.astype(np.uint32).view(np.int32))),
            ]
            row += len(texts)
            return pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

        for batch in batches:
            keys, texts, held = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > CHUNK:
                    yield part(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield part(keys, texts)

    return run




def align_corpus(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of docs (doc_id long, text string).

    documents: a row a document with doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. pairs: (a_id, b_id, n, best) with how
    many links of the corpus hold the two ids, and whether none of b_id's pairs has more.

    Texts are encoded once, where they are read; their links are written as ints. Pairs are counted before their shuffle. Back at the documents,
    the counts of the most frequent pairs are broadcast (those above the smallest power of two that HOT pairs at most reach), so that no frequent pair
    is a join key; the links of all others meet theirs in a shuffled join.

    Texts that are null, empty or whose tokens do not give back the text have no tokens: zeros and an empty hash. Null and repeated ids stay rows
    of their own; other columns are ignored; an empty table gives no rows."""
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>"
    rows = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_links(a_path, b_path), schema), "links")
    counted = rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    ids = [F.shiftrightunsigned("pair", 16).alias("a_id"), F.col("pair").bitwiseAND(0xFFFF).alias("b_id")]
    counted = materialise(counted.select("pair", *ids, "n"), "pairs")
    most = F.broadcast(counted.groupBy("b_id").agg(F.max("n").alias("most")))  # a row an id of B
    pairs = counted.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))
    sizes = dict(counted.groupBy((F.length(F.bin("n")) - 1).alias("p")).agg(F.count(F.lit(1))).collect())  # a row a power of two
    least, held = 64, 0
    for p in sorted(sizes, reverse=True):
        held += sizes[p]
        if held > HOT:
            break
        least = p
    hot = F.col("n") >= F.lit(1 << least if least < 63 else (1 << 63) - 1)
    links = rows.select("row", F.explode("links").alias("pair"))
    near = links.join(F.broadcast(pairs.where(hot).select("pair", "n", "best")), "pair", "left")  # HOT rows at most
    known = near.where("n IS NOT NULL").groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    rare = near.where("n IS NULL").select("row", "pair").join(pairs.where(~hot).select("pair", "n", "best"), "pair")
    rare = rare.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    sums = known.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    found = rows.drop("links").join(sums, "row", "left")
    found = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return found, pairs.drop("pair")


def op11(docs: DataFrame) -> DataFrame:
    from public_tokenizers import path

    return align_corpus(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))[0]
