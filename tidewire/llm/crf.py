"""Language labels of words by a linear-chain conditional random field, for code-switched text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod

BUCKETS = 1 << 16  # of the hashed features
CACHE = 150_000  # words whose scores a worker remembers; forgetting them changes no result
ROWS_PER_LANGUAGE = 400  # labelled documents that the field is fitted on, at most
ROW_CHARS = 16_384  # of a longer document, a run of so many characters is fitted on
RUN, CONTEXT = 20_000, 200  # words of a longer text that are labelled together, and words on either side that they are labelled with
LETTERS = re.compile(r"[^\W\d_]+")
LEXICON_SHARE, LEXICON_LEAST = 0.8, 3


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. Numbers that are no digits (fractions, exponents, Roman numerals) are no letters."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for w in found for letters, run in groupby(w, str.isalpha) if letters]


def word_features(word: str) -> list[int]:
    """Hashed affixes of 1 to 3 letters and n-grams of 2 and 3 letters, with the word's ends marked."""
    w = f"^{word}$"
    said = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3)]
    said += [f"2{w[i : i + 2]}" for i in range(len(w) - 1)] + [f"3{w[i : i + 3]}" for i in range(len(w) - 2)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in said]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals (n, t, states), expected moves (states, states)) of sequences padded to t. Every step is scaled to sum 1."""
    n, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a, step = np.empty((n, t, k)), np.exp(moves)
    now = e[:, 0] * np.exp(start)
    a[:, 0] = now / now.sum(axis=1, keepdims=True)
    for i in range(1, t):
        now = (a[:, i - 1] @ step) * e[:, i]
        a[:, i] = now / now.sum(axis=1, keepdims=True)
    b, expected = np.ones((n, k)), np.zeros((k, k))
    out = np.empty((n, t, k))
    for i in range(t - 1, -1, -1):
        live = i < lengths
        b[i == lengths - 1] = 1.0
        g = a[:, i] * b
        out[:, i] = np.where(live[:, None], g / g.sum(axis=1, keepdims=True), 0)
        if i:
            eb = e[:, i] * b
            joint = a[:, i - 1][:, :, None] * step[None] * eb[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += joint[live].sum(axis=0)
            b = eb @ step.T
            b /= b.sum(axis=1, keepdims=True)
    return out, expected


class Field:
    """The fitted field: languages, feature weights (BUCKETS, languages), lexicon weights, start and move scores."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights, self.lexical = np.zeros((BUCKETS, k)), np.zeros((k + 1, k))
        self.start, self.moves = np.zeros(k), np.zeros((k, k))

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features joined, number of each word's features, each word's lexicon entry)."""
        each = [word_features(w) for w in words]
        sizes = np.array([len(x) for x in each])
        return np.array([f for x in each for f in x], np.int64), sizes, np.array([self.lexicon.get(w, len(self.languages)) for w in words])

    def scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty((0, len(self.languages)))
        joined, sizes, lex = self.rows(words)
        return np.add.reduceat(self.weights[joined], np.cumsum(sizes) - sizes) + self.lexical[lex]


def fit(texts: list[str], labels: list[str], seed: int = 5, sequences: int = 2_400, length: int = 48, epochs: int = 6) -> Field | None:
    """A field fitted on code-switched sequences: runs of 4 to 24 words of documents of random languages laid end to end, every
    word labelled with its document's language. Gradient steps with per-weight rates over mini-batches."""
    docs = [(words_of(t), lang) for t, lang in zip(texts, labels, strict=True)]
    docs = [(w, lang) for w, lang in docs if w]
    languages = sorted({lang for _, lang in docs})
    if not languages:
        return None
    counts: dict[str, Counter] = {lang: Counter() for lang in languages}
    for w, lang in docs:
        counts[lang].update(w)
    size = {lang: max(1, sum(c.values())) for lang, c in counts.items()}
    lexicon = {}
    for i, lang in enumerate(languages):
        for w, c in counts[lang].items():
            rates = [counts[x][w] / size[x] for x in languages]
            if c >= LEXICON_LEAST and rates[i] >= LEXICON_SHARE * sum(rates):
                lexicon[w] = i
    field = Field(languages, lexicon)
    rng, k = np.random.default_rng(seed), len(languages)
    by_lang = [[w for w, lang in docs if lang == x] for x in languages]
    vocabulary: dict[str, int] = {}
    words, truth = np.zeros((sequences, length), np.int64), np.zeros((sequences, length), np.int64)
    for s in range(sequences):
        at = 0
        while at < length:
            lang = int(rng.integers(k))
            doc = by_lang[lang][int(rng.integers(len(by_lang[lang])))]
            n = min(int(rng.integers(4, 25)), length - at, len(doc))
            first = int(rng.integers(len(doc) - n + 1))
            words[s, at : at + n] = [vocabulary.setdefault(w, len(vocabulary)) for w in doc[first : first + n]]
            truth[s, at : at + n] = lang
            at += n
    joined, sizes, lex = field.rows(list(vocabulary))
    starts = np.cumsum(sizes) - sizes
    params = [field.weights, field.lexical, field.start, field.moves]
    seen = [np.full_like(p, 1e-8) for p in params]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(sequences), max(1, sequences // 80)):
            w, y = words[part], truth[part]
            used, at = np.unique(w, return_inverse=True)
            at = at.reshape(w.shape)
            feats = np.concatenate([joined[starts[u] : starts[u] + sizes[u]] for u in used])
            cuts = np.cumsum(sizes[used]) - sizes[used]
            e = np.add.reduceat(field.weights[feats], cuts) + field.lexical[lex[used]]
            marginal, expected = forward_backward(e[at], np.full(len(w), length), field.start, field.moves)
            wrong = np.eye(k)[y] - marginal
            per_word = np.stack([np.bincount(at.ravel(), wrong[:, :, c].ravel(), len(used)) for c in range(k)], axis=1)
            per_feature = np.repeat(per_word, sizes[used], axis=0)
            touched, slot = np.unique(feats, return_inverse=True)
            grads = [
                (touched, np.stack([np.bincount(slot, per_feature[:, c], len(touched)) for c in range(k)], axis=1)),
                (slice(None), np.stack([np.bincount(lex[used], per_word[:, c], k + 1) for c in range(k)], axis=1)),
                (slice(None), wrong[:, 0].sum(axis=0)),
                (slice(None), np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k) - expected),
            ]
            for p, g2, (where, g) in zip(params, seen, grads, strict=True):
                g = g / len(part) - 1e-5 * p[where]
                g2[where] += g * g
                p[where] += 0.2 * g / np.sqrt(g2[where])
    return field


class Scored(dict):
    """Word to row of a growing score table; the rows of new words are computed together."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.table, self.new = field, np.empty((0, len(field.languages))), []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def forget(self) -> None:
        if len(self) > CACHE:
            self.clear()
            self.table = np.empty((0, self.table.shape[1]))

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the table rows of its words, valid until forget()."""
        out = []
        for t in texts:
            words = words_of(t)
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        if self.new:
            self.table = np.concatenate([self.table, *[self.field.scores(self.new[i : i + 20_000]) for i in range(0, len(self.new), 20_000)]])
            self.new = []
        return out


def label(field: Field, scored: Scored, texts: list[str]) -> list[tuple[str, float, float]]:
    """(language, its mean marginal over the text's words, mean of the words' largest marginals) of whole texts; und where a text
    has no letters. Texts of more than RUN words are labelled in runs, each within CONTEXT words of its surroundings."""
    scored.forget()
    rows = scored.rows(texts)
    k = len(field.languages)
    sums, best = np.zeros((len(texts), k)), np.zeros(len(texts))
    runs = []  # (text, its words from, to, of which the inner ones count from, to)
    for i, r in enumerate(rows):
        for at in range(0, len(r), RUN):
            low, high = max(0, at - CONTEXT), min(len(r), at + RUN + CONTEXT)
            runs.append((i, low, high, at - low, min(at + RUN, len(r)) - low))
    runs.sort(key=lambda x: x[2] - x[1])
    at = 0
    while at < len(runs):
        end = at + 1  # of like length together: the padding stays small
        while end < len(runs) and end - at < 512 and (end - at + 1) * (runs[end][2] - runs[end][1]) <= 200_000:
            end += 1
        part = runs[at:end]
        lengths = np.array([high - low for _, low, high, _, _ in part])
        padded = np.zeros((len(part), lengths[-1], k))
        for r, (i, low, high, _, _) in enumerate(part):
            padded[r, : lengths[r]] = scored.table[rows[i][low:high]]
        marginal = forward_backward(padded, lengths, field.start, field.moves)[0]
        top = marginal.max(axis=2)
        for r, (i, _, _, a, b) in enumerate(part):
            sums[i] += marginal[r, a:b].sum(axis=0)
            best[i] += top[r, a:b].sum()
        at = end
    out = []
    for i, r in enumerate(rows):
        if len(r):
            c = int(sums[i].argmax())
            out.append((field.languages[c], float(min(1.0, sums[i, c] / len(r))), float(min(1.0, best[i] / len(r)))))
        else:
            out.append(("und", 0.0, 0.0))
    return out


class Letters:
    """How letters follow each other in each language: shares of trigrams within words, backed by bigrams and single letters."""

    BACK = 10.0  # how often the shorter context's shares count for
    SHARE = 0.25  # of the usual bits a letter, what a text in one of the languages has at least

    def __init__(self, texts: list[str], langs: list[str]):
        lowered = [t.lower() for t in texts]
        counts = Counter(c for t in lowered for c in t if c.isalpha())
        total = sum(counts.values())
        kept = sorted(c for c, n in counts.items() if n >= total * 1e-5)
        self.size = len(kept) + 2  # 0: between words, 1: any other letter; -1: a digit
        self.of = np.fromiter(((1 if chr(i).isalpha() else -chr(i).isdigit()) for i in range(1 << 16)), np.int32, 1 << 16)
        for i, c in enumerate(kept):
            if ord(c) < 1 << 16:
                self.of[ord(c)] = i + 2
        v, tables = self.size, []
        for lang in sorted(set(langs)):
            codes = np.maximum(self.codes(" ".join(t for t, x in zip(lowered, langs, strict=True) if x == lang)), 0)
            three = np.bincount((np.where(codes[1:-1] > 0, codes[:-2], 0) * v + codes[1:-1]) * v + codes[2:], minlength=v**3).reshape(v, v, v).astype(float)
            two, one = three.sum(axis=0), three.sum(axis=(0, 1))
            for n in (three, two, one):
                n[..., 0] = 0  # only letters are told
            share = (one + 0.5 * (np.arange(v) > 0)) / (one.sum() + 0.5 * (v - 1))
            share = (two + self.BACK * share) / (two.sum(axis=1, keepdims=True) + self.BACK)
            share = (three + self.BACK * share) / (three.sum(axis=2, keepdims=True) + self.BACK)
            with np.errstate(divide="ignore"):
                tables.append(np.log2(share * (v - 1)).ravel())
        self.gain = np.stack(tables, axis=1).astype(np.float32)  # bits over letters drawn at random
        found = [bits / n for bits, n in map(self._bits, texts) if n]
        self.usual = float(np.median(found)) if found else 0.0

    def codes(self, lowered: str) -> np.ndarray:
        """Letters and digits of a text between two breaks on either side."""
        points = np.frombuffer(f"  {lowered}  ".encode("utf-32-le"), np.uint32)
        return self.of[points] if points.max() < 1 << 16 else np.where(points < 1 << 16, self.of[np.minimum(points, (1 << 16) - 1)], 0)

    def _bits(self, text: str) -> tuple[float, int]:
        """(bits, letters) of a text's words, each in the language it fits best."""
        codes = self.codes(text.lower())
        here = np.flatnonzero(codes > 0)
        if not len(here):
            return 0.0, 0
        if (codes < 0).any():
            filled = np.flatnonzero(codes)
            first = np.flatnonzero(np.diff(filled, prepend=-2) > 1)
            plain = np.repeat(np.minimum.reduceat(codes[filled], first) > 0, np.diff(first, append=len(filled)))
            if plain.any():
                here = filled[plain]
            codes = np.maximum(codes, 0)
        before = codes[here - 1]
        gain = self.gain[(np.where(before > 0, codes[here - 2], 0) * self.size + before) * self.size + codes[here]]
        words = np.flatnonzero(np.diff(here, prepend=-2) > 1)
        return float(np.add.reduceat(gain, words, dtype=np.float64).max(axis=1).sum()), len(here)

    def evidence(self, text: str) -> float:
        """Bits by which the text's letters are likelier in the languages' words than drawn at random, less SHARE of what a text of the labelled ones
        usually has; 0 without letters. Words with digits count only where there are no others."""
        bits, n = self._bits(text)
        return bits - self.SHARE * self.usual * n


def training_rows(df: DataFrame, key: str, text: str, lang: str, folds: int, held: int) -> DataFrame:
    """At most ROWS_PER_LANGUAGE labelled rows of every language, those of the smallest hashes of key and text, outside the held fold; of a
    text of more than ROW_CHARS characters, a run of so many from a place that its hash says. Rows of equal key and text count once; rows that share
    only their key are told apart."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where((crc_mod("id", folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("r", F.shiftrightunsigned(F.xxhash64("id", "text"), 1))
    told = rows.select("lang", "r").distinct()
    count = F.broadcast(told.groupBy("lang").agg(F.count(F.lit(1)).alias("c")))  # a row a language
    # the hashes are spread evenly: four times as many as are wanted lie below this bound, or all
    few = told.join(count, "lang").where(F.shiftrightunsigned("r", 43) * F.col("c") <= F.lit((1 << 20) * 4 * ROWS_PER_LANGUAGE))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("r"))
    last = few.withColumn("n", rank).where(F.col("n") <= ROWS_PER_LANGUAGE).groupBy("lang").agg(F.max("r").alias("last"))
    near = rows.join(F.broadcast(last), "lang").where(F.col("r") <= F.col("last")).dropDuplicates(["lang", "r"])  # a row a language
    start = F.pmod(F.xxhash64("id", "r"), F.greatest(F.char_length("text") - ROW_CHARS, F.lit(0)) + 1).cast("int") + 1
    run = F.substring(F.col("text"), start, F.lit(ROW_CHARS))
    return near.select("lang", run.alias("text"), "r", "id")


def languages(df: DataFrame, key: str, text: str, lang: str, folds: int = 4, held: int = 2, evidence: bool = False) -> DataFrame:
    """df with held_out, lang_pred, score, certainty and, where it is asked for, evidence.

    The field is fitted on a bounded sample (ROWS_PER_LANGUAGE rows a language, of each ROW_CHARS characters; rows of the held
    fold and without a label never); it labels the words of every whole text, and the text gets the language of the
    largest mean marginal, its score. certainty is the mean of the words' largest marginals: high also where a text's words
    are of several languages. evidence: the bits by which the text's words are likelier in the languages (of the same sample) than letters drawn
    at random, less a quarter of the usual; negative for random letters and other scripts. Only the text decides. Rows are labelled where they are scanned: no shuffle.

    Null texts and texts without letters are und with score, certainty and evidence 0; without labelled rows all are. Null keys hash as the empty text. Rows
    repeated get equal results; ties go to the first language by name; an empty table stays empty; columns of df named like the
    results are replaced.
    """
    sample = sorted(tuple(r) for r in training_rows(df, key, text, lang, folds, held).select(
        "lang", "r", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text").collect())  # bounded by the constants above
    field = fit([r[3] for r in sample], [r[0] for r in sample])
    letters = Letters([r[3] for r in sample], [r[0] for r in sample]) if field and evidence else None
    names = [c for c in df.columns if c not in {"held_out", "lang_pred", "score", "certainty", "evidence"}]
    base = df.select(*names).withColumn("held_out", crc_mod(key, folds) == held)
    out_names, at = [*base.columns, "lang_pred", "score", "certainty", *(["evidence"] if evidence else [])], base.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", lang_pred string, score double, certainty double" + (", evidence double" if evidence else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scored(field) if field else None
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = label(field, scored, texts) if field else [("und", 0.0, 0.0)] * len(texts)
            more = [pa.array([f[0] for f in found], pa.string()), *[pa.array([f[i] for f in found], pa.float64()) for i in (1, 2)]]
            if evidence:
                more.append(pa.array([letters.evidence(t) if letters else 0.0 for t in texts], pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=out_names)

    return base.mapInArrow(run, schema)


def op10(docs: DataFrame) -> DataFrame:
    return languages(docs.select("doc_id", "text", "lang"), "doc_id", "text", "lang").select("doc_id", "held_out", "lang_pred", "score")
