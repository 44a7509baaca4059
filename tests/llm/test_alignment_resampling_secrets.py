"""Tokenizer alignment, importance resampling and secret scans against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import alignment, importance, secret_scan

from .conftest import text_of

ODD = ["<|endoftext|> <s> </s> <unk> <0x41>", "  two  blanks ", "a▁b", "naïve café, déjà vu — 東京 😀😀 é", "\n\n\ttabs\r\n", "x", "'s 't I'LL we've", "１２３ ＡＢ", "the " * 3000, "€" * 500]


def same(rows, expected):
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, expected))


# --- alignment ---


def plain_alignment(texts):
    from public_tokenizers import path
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    docs, counts = [], Counter()
    for text in texts:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(back[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_tok.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            docs.append(([], [], []))
            continue
        ends = [{}, {}]
        for which, tokens in enumerate((a_bytes, b_bytes)):
            at = 0
            for n, x in enumerate(tokens):
                at += len(x)
                ends[which][at] = n
        groups, i, j = [], 0, 0
        links = []
        for at in sorted(ends[0].keys() & ends[1].keys()):
            n, m = ends[0][at] + 1, ends[1][at] + 1
            groups.append((a[i:n], b[j:m]))
            links.append((a[n - 1], b[m - 1]))
            i, j = n, m
        counts.update(links)
        docs.append((a, b, list(zip(groups, links, strict=True))))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, groups in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for (x, y), _ in groups)
        links = [link for _, link in groups]
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


@pytest.mark.parametrize("hot", [alignment.HOT, 8, 0])
def test_alignment_is_that_of_plain_loops(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "CHUNK", 2000)
    rng = random.Random(3)
    texts = [None, "", *ODD, *(text_of(i) for i in range(25)), *(["same text again"] * 40)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD7FF), 32])) for _ in range(40)) for _ in range(30)]
    rows = [(None if i == 5 else i % 60, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_links int").repartition(5)
    found = alignment.op11(docs).collect()
    same(found, [(k, *x) for (k, _, _), x in zip(rows, plain_alignment(texts), strict=True)])
    assert alignment.op11(docs.where("false")).collect() == []


def test_groups_are_the_components_of_overlaps():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, 12)), n)) for _ in range(2))
        found = alignment.groups_of(a, b)
        common = np.intersect1d(a, b)
        assert found.tolist() == [*np.searchsorted(common, a).tolist(), *np.searchsorted(common, b).tolist()]


def test_pairs_are_counted(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the the")], "doc_id long, text string")
    pairs = alignment.align_corpus(docs, *map(__import__("public_tokenizers").path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))[1]
    assert sorted((r.n, r.best) for r in pairs.collect()) == [(1, True), (3, True)]


# --- resampling ---


def plain_resampling(docs, target, n, buckets, least, share):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)}
    out = []
    for key, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    inside = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1]))
    ranks = {id(x): i + 1 for i, x in enumerate(inside[: share[0] * len(inside) // share[1]])}
    return [(*x[:4], ranks.get(id(x))) for x in out]


@pytest.mark.parametrize(("n", "buckets", "least", "share"), [(1, 10_000, 20, (10, 100)), (2, 97, 3, (50, 100)), (3, 10, 1, (1, 1))])
def test_resampling_is_the_plain_one(spark, docs, n, buckets, least, share):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1, "Ünïcode ÄÖ Σ’s 123-abc_DEF\x00x\x7fy"), (7, text_of(5, 30_000)), (8, "A" * 50_000)]
    rows += [(500, text_of(500))] * 30
    target = [text_of(900), None, "", text_of(3)]
    found = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), "doc_id", "text", n, buckets, least, share)
    same(found.collect(), plain_resampling(rows, target, n, buckets, least, share))


def test_resampling_of_nothing(spark, docs):
    none = docs.where("false")
    assert importance.op12(none, docs).collect() == []
    assert importance.op12(docs, none).count() == docs.count()
    assert importance.resample(docs.withColumn("rank", F.col("doc_id")), none, "rank", "text").columns[0] == "_rank"


def test_resampling_prefers_the_target(spark):
    rows = [(i, " ".join(f"{'law' if i % 2 else 'sea'}{(i * j) % 50}" for j in range(30))) for i in range(400)]
    target = [(" ".join(f"law{j}" for j in range(50)),)] * 20
    drawn = importance.op12(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "text string")).where("rank IS NOT NULL").collect()
    assert len(drawn) == 40
    assert sum(r.doc_id % 2 for r in drawn) >= 36


# --- secrets ---


def plain_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def key_of(seed):
    rng = random.Random(seed)
    return "xk_" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789abcdefghijk") for _ in range(28))


def test_secrets_of_known_patterns_and_learned_formats(spark, docs):
    hexes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(300 + i, f'{text_of(i, 20)} é API_KEY: "{key_of(i)}" ende {hexes[i]} ') for i in range(60)]
    rows += [(400, "token=token:abcdefg"), (401, "ſecret = abcdefgh"), (402, "AKIA" + "A1" * 8), (403, "AKIA" + "A" * 15), (404, "passwd:'x' token = \"" + hexes[1] + '"'), (405, f"password={hexes[2]}" * 300)]
    bare = [(500 + i, f"{text_of(i, 20)} ü {key_of(1000 + i)}. {text_of(i + 1, 5)}") for i in range(40)]
    clean = [(600 + i, f"{text_of(i, 30)} Donaudampfschifffahrtsgesellschaft state-of-the-art-technology /usr/local/share/dictionary {'abcdefghij' * 3} 20240131123059000001") for i in range(40)]
    frame = spark.createDataFrame(rows + bare + clean, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(4)
    found = secret_scan.op13(frame).collect()
    plain = Counter()
    for k, t in rows + bare + clean:
        base = plain_base(t)
        plain[k, sum(x.startswith("assign") for x in base), sum(x.startswith("access") for x in base), sum(x.startswith("hex") for x in base), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base)] += 1
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(x for x in r.spans.split(",") if not x.startswith("like_"))) for r in found)
    assert got == plain
    texts = dict(bare)
    for r in found:
        more = [x.split(":") for x in r.spans.split(",") if x.startswith("like_")]
        if r.doc_id in texts:
            assert [texts[r.doc_id][int(a) : int(b)] for _, a, b in more] == [key_of(1000 + r.doc_id - 500)]
        else:
            assert more == [], r.doc_id
    assert secret_scan.op13(frame.where("false")).collect() == []


def test_labels_from_elsewhere_and_any_key_name(spark):
    labelled = spark.createDataFrame([("jwt", "ey" + key_of(i)[3:] + "." + key_of(i + 1)[3:]) for i in range(50)] + [("jwt", None), (None, "x")], "kind string, value string")
    docs = spark.createDataFrame([*(("b", text_of(i)) for i in range(40)), ("a", "see ey" + key_of(90)[3:] + "." + key_of(91)[3:]), ("a", None), (None, "")], "spans string, text string")
    found = [r for r in secret_scan.scan(docs, "spans", "text", secret_scan.infer(docs, "text", labelled)).collect() if r["_spans"] != "b" or r["spans"]]
    assert sorted((r["_spans"] or "", r["spans"]) for r in found) == [("", ""), ("a", ""), ("a", "like_jwt:4:63")]


def test_automata_merge_states_that_cannot_be_told_apart():
    rng = random.Random(1)
    loop = secret_scan.Automaton.infer(["".join(rng.choice("ab") for _ in range(rng.randrange(5, 40))).encode() for _ in range(500)])
    assert len(loop.n) <= 12  # a loop, with what the least length needs
    turns = secret_scan.Automaton.infer([b"ab" * rng.randrange(1, 30) for _ in range(500)])
    assert turns.bits(b"ab" * 10) > turns.bits(b"ba" * 10) + 20
    assert turns.n[0] >= 500
    assert secret_scan.Automaton.infer([]).n == [0]
