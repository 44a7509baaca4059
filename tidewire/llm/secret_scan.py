"""Secrets in texts: known patterns, and probabilistic automata inferred from the credentials that these patterns label."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST = 16  # characters of a candidate
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
SAMPLE, LONGEST = 1000, 128  # labelled values a kind that automata are fitted on, and their characters
FEWEST = 20  # labelled values that tell a kind's format
ALPHA = 0.05  # of the tests that two states are compatible
BACK = 1000.0  # pairs that single characters' shares count for in the background, so that characters which are rare there stay unlikely after each other
MARGIN = 40.0  # bits by which the format must beat the background
SLACK = 0.5  # bits a character that a candidate may stay behind the least likely labelled value

_INDEX = np.zeros(256, np.int64)  # of a byte among SYMBOLS, from 1; 0 elsewhere
_INDEX[np.frombuffer(SYMBOLS, np.uint8)] = np.arange(1, len(SYMBOLS) + 1)
_WIDTH = len(SYMBOLS) + 1


def base_spans(text: bytes) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, value) of the known patterns' matches, as bytes, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found, key=lambda s: (s[0], s[2]))]


class Automaton:
    """A probabilistic automaton over bytes: counts of arrivals, ends and steps of each state."""

    def __init__(self):
        self.n: list[int] = []
        self.ends: list[int] = []
        self.step: list[dict[int, int]] = []
        self.times: list[dict[int, int]] = []
        self.floor = -math.inf

    def add_state(self) -> int:
        self.n.append(0)
        self.ends.append(0)
        self.step.append({})
        self.times.append({})
        return len(self.n) - 1

    @classmethod
    def infer(cls, values: Iterable[bytes], alpha: float = ALPHA) -> Automaton:
        """The automaton of labelled values: their prefix tree, whose states are merged in breadth-first order with the first kept state
        of which no test at level alpha can tell them, in ends, in steps, and so on down the tree."""
        tree = cls()
        tree.add_state()
        total = 0
        for value in values:
            total += 1
            at = 0
            tree.n[0] += 1
            for c in value:
                tree.times[at][c] = tree.times[at].get(c, 0) + 1
                at = tree.step[at].setdefault(c, len(tree.n))
                if at == len(tree.n):
                    tree.add_state()
                tree.n[at] += 1
            tree.ends[at] += 1
        if total:
            tree._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        return tree

    def _apart(self, x: int, n: int, y: int, m: int, bound: float) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            n, m = self.n[a], self.n[b]
            if self._apart(self.ends[a], n, self.ends[b], m, bound):
                return False
            for c in self.times[a].keys() | self.times[b].keys():
                if self._apart(self.times[a].get(c, 0), n, self.times[b].get(c, 0), m, bound):
                    return False
            todo += [(self.step[a][c], s) for c, s in self.step[b].items() if c in self.step[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to what is reached from a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for c, s in self.step[b].items():
                self.times[a][c] = self.times[a].get(c, 0) + self.times[b][c]
                if c in self.step[a]:
                    todo.append((self.step[a][c], s))
                else:
                    self.step[a][c] = s

    def _merge(self, bound: float) -> None:
        kept = [0]
        settled = {0}
        while True:
            # the first step out of the kept states, in the order in which these were kept, that leads to a tree
            edge = next(((a, c) for a in kept for c in sorted(self.step[a]) if self.step[a][c] not in settled), None)
            if edge is None:
                break
            a, c = edge
            b = self.step[a][c]
            for k in kept:
                if self._alike(k, b, bound):
                    self.step[a][c] = k
                    self._fold(k, b)
                    break
            else:
                kept.append(b)
                settled.add(b)
        place = {s: i for i, s in enumerate(kept)}
        self.n, self.ends, self.times = [self.n[s] for s in kept], [self.ends[s] for s in kept], [self.times[s] for s in kept]
        self.step = [{c: place[t] for c, t in self.step[s].items()} for s in kept]

    def bits(self, value: bytes) -> float:
        """log2 of the value's probability; a step that no labelled value took counts half a time and leads back to the start."""
        out, at = 0.0, 0
        for c in value:
            out += math.log2((self.times[at].get(c, 0) or 0.5) / (self.n[at] + 0.5 * _WIDTH))
            at = self.step[at].get(c, 0)
        return out + math.log2((self.ends[at] + 0.5) / (self.n[at] + 0.5 * _WIDTH))


class Grammar:
    """The automata of the kinds, and a background of what characters follow each other in the corpus."""

    def __init__(self, labelled: dict[str, list[bytes]], pairs: np.ndarray):
        self.automata: dict[str, Automaton] = {}
        for kind, values in sorted(labelled.items()):
            if len(values) >= FEWEST:
                found = self.automata[kind] = Automaton.infer(values)
                found.floor = min(found.bits(v) / len(v) for v in values) - SLACK
        single = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * _WIDTH)
        self.background = np.log2((pairs + BACK * single) / (pairs.sum(axis=1, keepdims=True) + BACK))
        self.known: dict[bytes, str | None] = {}

    def kind_of(self, value: bytes) -> str | None:
        """The kind whose automaton finds the value as likely as its labelled values, and likelier by MARGIN bits than the background."""
        if value not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            index = np.concatenate([[0], _INDEX[np.frombuffer(value, np.uint8)], [0]])
            plain = float(self.background[index[:-1], index[1:]].sum())
            scores = [(bits, kind) for kind, a in self.automata.items() if (bits := a.bits(value)) - plain >= MARGIN and bits / len(value) >= a.floor]
            self.known[value] = max(scores)[1] if scores else None
        return self.known[value]

    def spans(self, text: bytes, base: list[tuple[int, int, str, bytes]]) -> list[tuple[int, int, str]]:
        """(start, end, kind) of candidates outside the known patterns' matches whose format is that of a kind."""
        out: list[tuple[int, int, str]] = []
        if not self.automata:
            return out
        i, until = 0, 0  # matches that begin before the candidate's end, and the last end among them
        for m in _CANDIDATE.finditer(text):
            while i < len(base) and base[i][0] < m.end():
                until = max(until, base[i][1])
                i += 1
            if until > m.start():
                continue
            whole = m[0].rstrip(b".")  # the end of a sentence
            for skip in (0, whole.rstrip(b"=").find(b"=") + 1):  # all of it, or what a name and an equals sign lead
                value = whole[skip:]
                if len(value) >= LEAST and (kind := self.kind_of(value)):
                    out.append((m.start() + skip, m.start() + len(whole), f"like_{kind}"))
                    break
        return out


def _points(text: bytes) -> np.ndarray | None:
    """Code points before each byte; None where a byte is a code point."""
    if text.isascii():
        return None
    return np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])


def said(spans: list[tuple], points: np.ndarray | None) -> str:
    return ",".join(f"{k}:{a if points is None else points[a]}:{b if points is None else points[b]}" for a, b, k, *_ in spans)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, h, value, n): a task's labelled values of smallest hash, SAMPLE a kind at most, and its counts of character pairs as kind 'pair'."""
    held: dict[str, dict[bytes, int]] = {k: {} for k in KINDS}
    pairs = np.zeros(_WIDTH * _WIDTH, np.int64)

    def smallest(kind: str) -> dict[bytes, int]:
        return dict(sorted(held[kind].items(), key=lambda x: (x[1], x[0]))[:SAMPLE])

    for batch in batches:
        for text in batch.column(0):
            data = (text.as_py() or "").encode()
            codes = _INDEX[np.frombuffer(data, np.uint8)]
            for a, b, kind, value in base_spans(data):
                codes[a:b] = 0
                if len(value) <= LONGEST:
                    held[kind][value] = xxhash.xxh3_64_intdigest(value) >> 1
                    if len(held[kind]) > 2 * SAMPLE:
                        held[kind] = smallest(kind)
            pairs += np.bincount(np.concatenate([[0], codes]) * _WIDTH + np.concatenate([codes, [0]]), minlength=len(pairs))
    rows = [(kind, h, value, 0) for kind in KINDS for value, h in smallest(kind).items()]
    rows += [("pair", i, b"", int(pairs[i])) for i in np.flatnonzero(pairs).tolist()]
    if rows:
        kinds, hashes, values, counts = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(hashes, pa.int64()), pa.array(values, pa.binary()), pa.array(counts, pa.int64())], names=["kind", "h", "value", "n"])


def infer(docs: DataFrame, text: str, labelled: DataFrame | None = None) -> Grammar:
    """The grammar of docs: for each kind an automaton from at most SAMPLE distinct values of at most LONGEST bytes, those of smallest hash, that
    the known patterns label in all texts; and counts of character pairs outside of them over all texts. labelled (kind string, value string) adds labelled
    values, under the same bound. A kind with fewer than FEWEST of them gets none. Only these bounded pieces reach the driver: SAMPLE values a kind, and a count for each pair of characters."""
    found = materialise(docs.select(text).mapInArrow(_gather, "kind string, h long, value binary, n long"), "labels")
    values = found.where("kind <> 'pair'").select("kind", "h", "value")
    names = list(KINDS)
    if labelled is not None:
        value = F.col("value").cast("binary")
        own = labelled.select("kind", F.shiftrightunsigned(F.xxhash64("value"), 1).alias("h"), value.alias("value")).where(F.length("value").between(1, LONGEST))
        names += [r[0] for r in own.select("kind").distinct().collect() if r[0] is not None and r[0] not in names]  # few by nature: formats
        values = values.unionByName(own)
    values = values.groupBy("kind", "value").agg(F.min("h").alias("h"))
    sample = {k: [bytes(r[0]) for r in values.where(F.col("kind") == k).orderBy("h", "value").select("value").limit(SAMPLE).collect()] for k in names}
    pairs = np.zeros(_WIDTH * _WIDTH)
    for at, n in found.where("kind = 'pair'").groupBy("h").agg(F.sum("n")).collect():  # a row a pair of characters at most
        pairs[at] = n
    return Grammar(sample, pairs.reshape(_WIDTH, _WIDTH))


def scan(docs: DataFrame, key: str, text: str, grammar: Grammar) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs: how often each known pattern occurs in the whole text, the hash of
    their spans, and all spans, those of the grammar's automata among them as like_<kind>.

    Spans are kind:start:end in code points, by start, then kinds as listed, then like_ kinds, joined by commas. Null and empty texts have none: empty
    spans and the hash of an empty string. Null and repeated keys stay rows of their own; a key of any name keeps it, led by underscores
    where it is one of the results'. An empty table gives no rows. Texts are read where they lie; nothing is shuffled."""
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    out = fresh(names, key)[0] if key.lower() in names else key
    kind_of_key = dict(docs.dtypes)[key]
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[Counter] = []
            hashes, spans = [], []
            for value in batch.column(1):
                data = (value.as_py() or "").encode()
                base = base_spans(data)
                more = grammar.spans(data, base)
                points = _points(data) if base or more else None
                counts.append(Counter(s[2] for s in base))
                hashes.append(hashlib.sha256(said(base, points).encode()).hexdigest())
                both = sorted([*[s[:3] for s in base], *more], key=lambda s: (s[0], order.get(s[2], len(order)), s[2], s[1]))
                spans.append(said(both, points))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=[out, *names])

    return docs.select(key, text).mapInArrow(run, f"`{out}` {kind_of_key}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op13(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scan(docs, "doc_id", "text", infer(docs, "text"))
