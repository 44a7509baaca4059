"""Each operator against a plain version of itself, and over nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import html
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import crf, ctw, html_text, line_dedup, media, mixing, ngram_join, packing, sharding, vectors
from tidewire.llm.queries import QUERIES

from .conftest import DOCS, text_of

SF = "/root/testdata/sf0.001"


def empty(docs):
    return docs.where("false")


# ---- 1

def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        got = html_text.common_lines(a, b)
        it = iter(b)
        assert len(got) == plain_lcs(a, b) and all(a[i] in it for i in got)


def test_pages_without_article_lose_their_template(spark):
    page = "<html><body><div>Acme Corp</div><div>Home of %s</div><p>%s text &amp; more\n here</p><div>All rights kept</div></body></html>"
    rows = [(i, f"http://a.example/{d}/{i}.html", page % (i, f"own {i} of this page")) for i, d in enumerate(["x", "x", "y"])]
    rows += [(9, None, None), (10, "", "<p>only"), (11, "http://b.example/", ""), (11, "http://b.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("old") for c in ("text", "gone", "k", "row", "span", "rank", "lines")})
    out = html_text.extract(pages, "page_id", "url", "html")
    got = [(r.page_id, r.text) for r in out.collect()]
    assert out.count() == 7 and out.columns.count("text") == 1 and {r.gone for r in out.collect()} == {"old"}
    assert dict(got)[1] == "Home of 1 own 1 of this page text & more here" and dict(got)[9] == "" and dict(got)[10] == "only"
    assert html_text.extract(pages.where("false"), "page_id", "url", "html").count() == 0


def test_articles_lose_what_all_pages_around_share(spark):
    page = "<article><p>Read more at Acme</p><p>%s</p></article>"
    rows = [(i, f"http://a.example/{i:03}", page % text_of(i, 9)) for i in range(40)]
    rows += [(100 + i, f"http://b.example/{i:03}", page % text_of(7, 9)) for i in range(40)]  # copies of one article
    rows += [(200 + i, f"http://c.example/{i:03}", page % text_of(200 + i, 9)) for i in range(5)]  # too few witnesses
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html").collect()}
    assert all(got[i] == text_of(i, 9) for i in range(40))
    assert all(got[100 + i] == "Read more at Acme " + text_of(7, 9) for i in range(40))
    assert all(got[200 + i] == "Read more at Acme " + text_of(200 + i, 9) for i in range(5))


def plain_neighbours(rows, reach):
    """Each page's nearest by common path among reach on either side of it in its host's order."""
    by_host = defaultdict(list)
    for h, p, k in sorted(rows):
        by_host[h].append((p, k))
    out = {}
    for found in by_host.values():
        for i, (p, k) in enumerate(found):
            near = []
            for j in range(len(found)):
                if j != i and abs(j - i) <= reach:
                    a, b = p.split("/"), found[j][0].split("/")
                    near.append((-len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b, strict=False)))), abs(j - i), j))
            out[k] = [found[j][1] for *_, j in sorted(near)[:reach]]
    return out


@pytest.mark.parametrize("span", [7, 512])
def test_pages_are_compared_with_the_nearest_urls(spark, monkeypatch, span):
    monkeypatch.setattr(html_text, "SPAN", max(span, html_text.REACH))
    rng = random.Random(8)
    pages, meta = [], []
    for i in range(90):
        h, p = f"h{min(i % 5, 2)}.example", "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + f"/{i}"
        lines = [f"shared line {x} here" for x in range(8) if rng.random() < 0.6] + [text_of(i, 30)]
        pages.append((i, f"http://{h}{p}", "".join(f"<div>{x}</div>" for x in lines)))
        meta.append((h, p, i, lines))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), "page_id", "url", "html").collect()}
    near = plain_neighbours([(h, p, i) for h, p, i, _ in meta], html_text.REACH)
    of = {i: lines for *_, i, lines in meta}
    for i, lines in of.items():
        votes = Counter(x for j in near[i] for x in set(of[j]) & set(lines))
        assert got[i] == " ".join(x for x in lines if 2 * votes[x] < len(near[i]) or not near[i]), i


def test_article_without_the_parts_around_and_in_it():
    page = """<body><header>Top</header><nav><a>Menu</a></nav><div class="cookie-banner">We use</div><main><h1>T</h1><p>a <b>b</b>c<br>d
    <form>mail</form><script>if (a<b) "</p>"</script><div class='ad-slot'>buy</div><ul><li>x<li>y</ul><section id=comments>nice</section></main><footer>&copy;</footer>"""
    assert html_text.main_text(page, []) == "T a bc d x y"


@pytest.mark.parametrize(("page", "want"), [
    ("<div class='layout with-sidebar'><div class='no-sidebar has-banner'><article>in it</article></div></div>", "in it"),
    ("<form id='aspnetForm'><div>menu</div><article><p>in a form</p></article></form>", "in a form"),
    ("<form id='aspnetForm'><p>all in a form</p><select><option>x</select></form>", "all in a form"),
    ("<main><h2 id='related-work'>Related</h2><section id='legal-history'>law</section><div class='side effects'>effects</div><p id=social-impact>us", "Related law effects us"),
    ("<div class=sidebar><article>teaser</article></div><main>text</main>", "text"),
    ("<div class=sidebar><article>alone</article></div>", "alone"),
    ("<div id=comments><article>a reader</article></div><p>text</p>", "text"),
    ("<a href=/x/>link <b>b</a> text", "link b text"),
    ("<div/>one<div hidden>two</div>", "one"),
    ("<main><article>a</article><div class=promo><article>teaser</article></div></main>", "a"),
    ("<p>one<table><tr><td>a<td>b</table></p>two", "one a b two"),
    ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p", ""),
])
def test_odd_pages(page, want):
    assert html_text.main_text(page, None) == want


def test_deep_pages_take_linear_time():
    import time

    page = "<div><p>x" * 60_000 + "</div>" * 60_000
    start = time.time()
    assert html_text.main_text(page, None).count("x") == 60_000 and time.time() - start < 10


def plain_article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", inner))).strip()


def test_articles_of_the_tables(spark):
    got = {r.page_id: r.text for r in QUERIES["op1_nearest_url_text"](spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got[p.page_id] == plain_article(p.html)


def test_articles_of_the_tables_without_their_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    got = {r.page_id: r.text for r in html_text.op1(bare).collect()}
    right = [got[p.page_id] == plain_article(p.html) for p in pages.collect()]
    assert sum(right) >= 0.98 * len(right)


# ---- 2

def test_curve_passes_every_point_by_single_steps():
    grid = np.array(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).T
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_packing_holds_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()) if len(ids) < 64 else None)] += 1
    pieces = packing.pack(docs, packing.tokenizer_path(), 64, 2).collect()
    ids_of = defaultdict(list)
    for r in rows:
        ids_of[r.doc_id].append(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    for p in pieces:
        assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in ids_of[p.doc_id])
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
    for n, s in enumerate(sorted(by_seq)):
        at = 0
        for off, length in sorted(by_seq[s]):
            assert off == at
            at += length
        assert at == 64 or n == len(by_seq) - 1
    got = Counter()
    total = sum(p.length for p in pieces)
    for p in pieces:
        if p.start == 0:
            got[(p.doc_id, p.doc_tokens)] += 1
    assert got == Counter((d, n) for (d, n, _), c in want.items() for _ in range(c)) and total == sum(n * c for (_, n, _), c in want.items())
    assert packing.pack(empty(docs), packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["Don't WE'LL 'sx 12ab", "ÀÉ ß <|endoftext|>x", "é é Σας 日本 ²µ ﬁ", "a\x1cb \x00", "", " \n\t\r "])
def test_encoder_is_the_tokenizer(text):
    e = packing.Encoder(packing.tokenizer_path())
    assert np.frombuffer(e.encode(text), "<u2").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# ---- 3

def plain_shard(key, n):
    def score(j):
        h = int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16)
        return -math.log((h + 0.5) / 2**52)

    return min(range(n), key=lambda j: (score(j), j))


def test_shards(spark, docs):
    rows = sharding.op3(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        key = "null" if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (plain_shard(key, 40), plain_shard(key, 41)) and r.grown_shard in (r.shard, 40)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert r.size == len(b) + 16 and r.text_crc32 == zlib.crc32(b)
    assert sharding.op3(empty(docs)).count() == 0


INNER = ("__h", "__e", "__id", "__ref", "_k", "_part", "_at", "_base", "_of", "_group", "_stand", "row", "ref", "id", "gone", "doc", "h", "span", "upto", "digest", "_digest", "_epochs", "_rest", "_span")


def with_clashes(df):
    return df.select(*df.columns, *[F.lit(f"own {c}").alias(c) for c in INNER if c not in df.columns])


def test_columns_of_the_caller_stay_theirs(spark, docs):
    df = with_clashes(docs.select("doc_id", "text", "lang", "source"))
    for out in (sharding.shard(df, "doc_id", [1.0] * 4, [1.0] * 5), line_dedup.dedup_lines(df, "doc_id", "text"),
                mixing.mix(df, "doc_id", mixing.n_words(), {"lang": F.col("lang"), "source": F.col("source")}, {}, 0.9, 1, content="text"),
                crf.languages(df, "doc_id", "text", "lang")):
        rows = out.select(*INNER).distinct().collect()
        assert len(rows) == 1 and all(rows[0][c] == f"own {c}" for c in INNER)


def test_slots_of_one_key_are_spread(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), F.lit(1).alias("v"))
    rows = sharding.shard(df, "k", [1.0] * 5).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 3000 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weights_draw_in_proportion(spark):
    n = Counter(r.shard for r in sharding.shard(spark.range(6000), "id", [1.0, 2.0, 3.0]).collect())
    assert abs(n[2] / 6000 - 0.5) < 0.03 and abs(n[0] / 6000 - 1 / 6) < 0.03


# ---- 4

def plain_links(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for a, b in itertools.combinations(range(len(good)), 2):
        x, y = good[a][1], good[b][1]
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
            links[a].add(b)
            links[b].add(a)
    return good, links


@pytest.mark.parametrize("block", [7, 2048])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = [(n, [float(x) for x in base[n % 12] + rng.normal(size=16) * (0.02 if n < 60 else 0.6)]) for n in range(140)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, []), (204, [0.0] * 16), (205, [float("nan")] * 16), (206, [None] * 16), (207, [1.0, 2.0]), (208, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("cell", F.lit(1))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {r.vec_id: r for r in vectors.op4(df).collect()}
    good, links = plain_links(rows, 0.95)
    assert len(got) == len(rows)
    seen = {}
    for a in range(len(good)):
        group, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - group:
                group.add(b)
                todo.append(b)
        seen[good[a][0]] = min(good[b][0] for b in group)
    for a, (i, _) in enumerate(good):
        assert got[i].n_links == len(links[a]) and got[i].component_id == seen[i] and got[i].kept == (i == seen[i])
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (202, 203, 204, 205, 206))
    assert vectors.op4(df.where("false")).count() == 0


def test_vectors_of_doubles(spark):
    rows = [(1, [1e39, 1.0]), (2, [1e39, 1.0]), (3, [1e-60, 0.0]), (4, [1e-60, 0.0]), (5, [1e-200, 1e-201]), (6, [1e300, 1e299]), (7, [0.0, 5e-324]), (8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").unionByName(spark.range(100, 130).select(F.col("id").alias("vec_id"), F.array(-F.col("id") * 1.0, F.lit(1.0)).alias("embedding")))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.op4(df).collect()}
    assert [got[i] for i in range(1, 9)] == [(5, 1)] * 6 + [(1, 7)] * 2


def test_vector_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    _, links = plain_links(rows, 0.95)
    got = sum(r.n_links for r in QUERIES["op4_vector_near_dedup"](spark, "/root/testdata/sf0.01").collect())
    assert got >= 0.99 * sum(map(len, links.values()))


@pytest.mark.parametrize("rank", [4, 64])
def test_every_link_counts_for_both_ends(spark, monkeypatch, rank):
    monkeypatch.setattr(vectors, "BLOCK", 200)
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(900, rank)) @ rng.normal(size=(rank, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    step = rng.normal(size=base.shape)
    step -= (step * base).sum(axis=1, keepdims=True) * base
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    x = np.concatenate([base, base + step * np.tan(np.arccos(rng.uniform(0.951, 0.97, size=(900, 1))))]).astype(np.float32).astype(float)
    got = {r.vec_id: r for r in vectors.op4(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    low = np.arange(len(x))
    while True:
        after = np.minimum(low, np.where(hit, low, len(x)).min(axis=1))
        if (after == low).all():
            break
        low = after
    assert hit.sum() >= 1800
    assert [got[i].n_links for i in range(len(x))] == hit.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == low.tolist()


# ---- 5

def plain_jaccard(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return Counter((rows[i][0], len(sets[i]), min([x for x in low[find(i)] if x is not None], default=None)) for i in range(len(rows)))


@pytest.mark.parametrize(("block", "paired"), [(300, 2), (300, 32), (400_000, 32)])
def test_jaccard_join(spark, docs, monkeypatch, block, paired):
    if block == 300:
        monkeypatch.setattr(ngram_join, "HOT", 4)
        monkeypatch.setattr(ngram_join, "SLICE", 16)
        monkeypatch.setattr(ngram_join, "FAN", 2)
        monkeypatch.setattr(ngram_join, "SLICE_BYTES", 6_000)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    rng = random.Random(5)
    chain = [text_of(500, 80).split()]
    for _ in range(25):
        w = list(chain[rng.randrange(len(chain))])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        chain.append(w)
    every = "every text of these slices says so at its end"
    chain += [[*text_of(700 + i, 4 + i % 40).split(), *every.split()] for i in range(80)]  # tokens in every slice
    more = spark.createDataFrame([(1000 + i, " ".join(w)) for i, w in enumerate(chain)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    rows = [tuple(r) for r in df.collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op5(df).collect())
    assert got == plain_jaccard(rows, 4, 85, 100)
    assert ngram_join.op5(empty(docs)).count() == 0


# ---- 6

def test_patience_keeps_anchors_in_order():
    later, earlier = [1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 8, 4, 5, 6]
    assert line_dedup.patience(later, earlier) == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)]


def test_line_dedup(spark):
    p, q, r = (text_of(i, 55) for i in (1, 2, 3))
    rows = [(1, f"head one\n{p}\n{q}\ntail"), (2, f"{q}\nmiddle words of two are here\n{p}"), (3, f"own text of three\n{r}\n  {p} \n{p}"), (4, r), (5, "clean and alone"), (5, "clean and alone"), (6, None), (7, ""), (None, q), (8, "tail\nhead one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed_lines", F.lit("x")).withColumn("gone", F.lit(1))
    out = [(x.doc_id, x.text, x.removed_lines) for x in line_dedup.dedup_lines(df, "doc_id", "text").collect()]
    got = {d: t for d, t, _ in out}
    assert len(out) == len(rows)
    assert got[1] == rows[0][1] and got[2] == "middle words of two are here" and got[3] == f"own text of three\n{r}" and got[4] == ""
    assert got[5] == "clean and alone" and got[6] is None and got[7] == "" and got[None] == "" and got[8] == "tail\nhead one"
    assert line_dedup.dedup_lines(df.where("false"), "doc_id", "text").count() == 0


def test_every_line_survives_once(spark, docs):
    before = {h for r in docs.collect() for h in (r.text or "").split("\n") if h.strip()}
    after = {h for r in line_dedup.dedup_lines(docs, "doc_id", "text").collect() for h in (r.text or "").split("\n") if h.strip()}
    assert before == after


def test_blocks_of_short_lines_that_stand_alone_before(spark):
    verse = [f"{a} {b} of {a}" for a in ("stone", "tree", "lamp", "glass") for b in ("red", "blue", "green")]
    long = "a line of six words here"
    rows = [(i, f"own words of document number {i}\n{x}") for i, x in enumerate([*verse, long])]
    rows += [(20, "\n".join(["text of twenty comes here first", *verse, "", long, "short end"])), (30, "\n".join(["thirty", "", *verse, "last words"]))]
    rows += [(31, f"short end\n\n{long}\nshort end\nmore"), (32, "\n".join([*verse[:1], "x", *verse[5:7]])), (33, "\n\t\n".join(verse[:2])), (34, "\n \n".join(verse[:2]))]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert out[20].text == rows[13][1]  # its lines stand elsewhere, but each on its own
    assert out[30].text == "thirty\n\nlast words" and out[30].removed_lines == len(verse)
    assert out[31].text == "short end\n\nmore" and out[32].text == f"{verse[0]}\nx"
    assert out[33].text == rows[-2][1] and out[34].text == rows[-1][1]


def plain_gone(later, earlier):
    """Line numbers of later that are in blocks of the two texts, by quadratic alignment: a table of the longest common subsequence that
    may only take lines which both texts hold, repeated on the rest."""
    one, two = ([(i, x.strip(" "), len(x.split())) for i, x in enumerate(t.split("\n")) if x.strip(" ")] for t in (later, earlier))
    both = {x for _, x, _ in one} & {x for _, x, _ in two}
    one, two = [x for x in one if x[1] in both], [x for x in two if x[1] in both]
    gone = set()
    while one:
        table = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
        for i in reversed(range(len(one))):
            for j in reversed(range(len(two))):
                table[i][j] = 1 + table[i + 1][j + 1] if one[i][1] == two[j][1] else max(table[i + 1][j], table[i][j + 1])
        i = j = 0
        match = []
        while i < len(one) and j < len(two):
            if one[i][1] == two[j][1]:
                match.append((i, j))
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
        if not match:
            return gone
        blocks = [[match[0]]]
        for x, y in match[1:]:
            i, j = blocks[-1][-1]
            if one[x][0] - one[i][0] > line_dedup.GAP + 1 or two[y][0] - two[j][0] > line_dedup.GAP + 1:
                blocks.append([])
            blocks[-1].append((x, y))
        for block in blocks:
            if sum(one[x][2] for x, _ in block) >= (5 if len(block) > 1 else line_dedup.LONE_WORDS):
                gone |= {one[x][0] for x, _ in block}
        taken = {x for x, _ in match}
        one = [x for n, x in enumerate(one) if n not in taken]
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_blocks_against_quadratic_alignment_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") + str(rng.randrange(9)) for _ in range(rng.choice([2, 4, 6, 7, 14]))) for _ in range(80)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(70)
            part = pool[at : at + rng.randrange(1, 8)]
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = f"edited {rng.random()}"
            text += rng.choice([part, part, [f"own {d} {rng.random()} words of it"], [""], [rng.choice(pool)]])
        rows.append((d, "\n".join(text)))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    right = over = under = 0
    for d, t in rows:
        want = set().union(*[plain_gone(t, u) for e, u in rows[:d]]) if d else set()
        kept = [x for i, x in enumerate(t.split("\n")) if i not in want]
        over += sum((Counter(kept) - Counter(got[d].text.split("\n"))).values())
        under += sum((Counter(got[d].text.split("\n")) - Counter(kept)).values())
        right += len(want)
    assert right > 150 and over <= 0.03 * right and under <= 0.05 * right, (right, over, under)


def test_alignment_decides_and_not_the_lines(spark):
    """Texts where deleting every line, or run of lines, that an earlier text holds is wrong."""
    a, b, c, d = (f"this is line {x} of the early text" for x in ("alpha", "beta", "gamma", "delta"))
    rows = [(1, "\n".join(["start", a, "x one", b, "y one", c, "z one", d]))]
    rows += [(2, "\n".join(["first", a, "x two", b, "y two", c, "z two", d]))]  # every other line edited: one passage, no two of its lines in a row
    rows += [(3, f"what comes here is all of a third text\n{c}\nand it goes on with more words of its own\nand more\nand more again\nand so on\n{a}")]  # two lines recur, far apart and turned
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {1: rows[0][1], 2: "first\nx two\ny two\nz two", 3: rows[2][1]}


def test_a_passage_of_many_documents_is_no_hot_partner(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PARTNERS", 10)
    shared = "\n".join(f"line {i} of a passage in all texts" for i in range(5))
    rows = [(i, f"text {i}\n{shared}\nend {i}") for i in range(200)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {0: rows[0][1], **{i: f"text {i}\nend {i}" for i in range(1, 200)}}


def test_a_block_whose_lines_stand_elsewhere_first(spark):
    rows = [(1, "one two three\nown words of the first document"), (2, "four five six\nown words of the second document"), (3, "third text is here now\none two three\nfour five six"),
            (4, "fourth text is here now\none two three\nfour five six")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "fourth text is here now"}


def test_long_documents_of_many_lines(spark):
    lines = [f"line number {i} of a long document" for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["head of the second document", *lines, "tail"]))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1].text == rows[0][1] and got[2].text == "head of the second document\ntail" and got[2].removed_lines == 20_000


# ---- 7

def plain_budget(tree, budget, weights):
    """Water filling by small steps of the level, from the root down."""
    names = sorted({k[0] for k in tree})
    cap = {n: sum(v for k, v in tree.items() if k[0] == n) for n in names}
    share, full = {}, set()
    while True:
        free = [n for n in names if n not in full]
        left = budget - sum(cap[n] for n in full)
        total = sum(weights.get(n, 1.0) for n in free)
        over = [n for n in free if cap[n] <= left * weights.get(n, 1.0) / total]
        if not over:
            share = {n: cap[n] if n in full else left * weights.get(n, 1.0) / total for n in names}
            break
        full |= set(over)
        if len(full) == len(names):
            share = dict(cap)
            break
    if len(next(iter(tree))) == 1:
        return {(n,): share[n] for n in names}
    out = {}
    for n in names:
        below = {k[1:]: v for k, v in tree.items() if k[0] == n}
        out |= {(n, *k): v for k, v in plain_budget(below, share[n], weights).items()}
    return out


def test_budgets_fill_siblings_first(spark):
    tree = {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 40, ("b", "z"): 30, ("c", "x"): 1000}
    weights = {"a": 3.0, "b": 5.0, "x": 4.0}
    leaves = spark.createDataFrame([(*k, v) for k, v in tree.items()], "p string, q string, tokens long")
    got = {(r.p, r.q): r.target for r in mixing.budgets(leaves, ["p", "q"], {"p": weights, "q": weights}, F.lit(600), 1).collect()}
    want = plain_budget(tree, 600, weights)
    assert sum(got.values()) == 600 and all(abs(got[k] - want[k]) <= 1.5 for k in tree)


def test_mix(spark, docs):
    out = mixing.op7(docs).collect()
    assert out and all(r.copies >= 1 for r in out)
    assert mixing.op7(empty(docs)).count() == 0
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    assert sum(r.n_tokens * r.copies for r in out) <= 0.6 * total + 1


def test_mix_takes_seeded_prefixes(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60) if rng.random() < 0.8 else None, text_of(i % 70, rng.randrange(1, 9)), rng.choice("ab"), rng.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p string, q string")
    out = mixing.mix(df, "doc_id", mixing.n_words(), {"p": F.col("p"), "q": F.col("q")}, {"p": {"a": 3.0}}, 0.5, 2, 9, content="text")
    got = Counter((r.doc_id, r.text, r.p, r.q, r.copies) for r in out.collect())
    tree = Counter()
    for _, t, p, q in rows:
        tree[(p, q)] += len(t.split())
    leaves = spark.createDataFrame([(*k, v) for k, v in tree.items()], "p string, q string, tokens long")
    target = {(r.p, r.q): r.target for r in mixing.budgets(leaves, ["p", "q"], {"p": {"a": 3.0}}, F.lit(sum(tree.values()) // 2), 2).collect()}
    want = Counter()
    for leaf, tokens in tree.items():
        whole, rest = divmod(target[leaf], tokens)
        by_hash = defaultdict(list)
        for d, t, p, q in rows:
            if (p, q) == leaf:
                key = f"9:{whole}:{'null' if d is None else d}:{hashlib.md5(t.encode()).hexdigest()}"
                by_hash[hashlib.md5(key.encode()).hexdigest()].append((d, t))
        taken = 0
        for h in sorted(by_hash):
            taken += sum(len(t.split()) for _, t in by_hash[h])
            copies = whole + (taken <= rest)
            for d, t in by_hash[h]:
                want[(d, t, *leaf, copies)] += copies > 0
    assert got == +want and want


# ---- 8

def png() -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def box(kind, data):
    return struct.pack(">I", 8 + len(data)) + kind + data


MP4 = box(b"ftyp", b"isom\0\0\2\0isomiso2") + box(b"free", b"") + box(b"moov", b"x" * 20) + box(b"mdat", b"frames")
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 6) + b"WEBP" + b"VP8 " + struct.pack("<I", 5) + b"abcde\0"


def ogg(pages):
    out = b""
    for n, p in enumerate(pages):
        head = b"OggS\0" + bytes([(n == 0) * 2 + (n == len(pages) - 1) * 4]) + b"\0" * 16
        body = bytes([len(p) // 255 + 1]) + b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) + p
        out += head + struct.pack("<I", media.crc(head + bytes(4) + body, media.CRC32, 32)) + body
    return out


def flac(frames, known=True):
    info = b"\0" * 10 + ((len(frames) * 192 if known else 0) | 44100 << 44).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC" + b"\x00\0\0\x22" + info + b"\x81\0\0\4pads"
    for n, body in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, n])
        head += bytes([media.crc(head, media.CRC8, 8)])
        out += head + body + struct.pack(">H", media.crc(head + body, media.CRC16, 16))
    return out


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0\x3b"


def bmp(width=1, height=1):
    return b"BM" + struct.pack("<IIII", 54 + 4 * height, 0, 54, 40) + struct.pack("<iiHHI", width, height, 1, 24, 0) + b"\0" * (20 + 4 * height)


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04\0\0\x12\xff\x00\x34\xff\xd0\x11\xff\xd9"
FORMS = {
    "image/png": png(), "image/gif": gif(), "image/bmp": bmp(), "image/jpeg": JPEG, "image/webp": WEBP, "audio/wav": media.to_wav(b"ab"),
    "audio/flac": flac([b"one", b"two" * 9]), "audio/ogg": ogg([b"a" * 300, b"b"]), "video/mp4": MP4,
}


@pytest.mark.parametrize("kind", FORMS)
def test_every_format_is_confirmed_with_its_length_and_refused_when_cut(kind):
    signatures, data = media.automaton(), FORMS[kind]
    assert media.sniff_bytes(data, signatures)[0] == kind
    padded = b"some text " + data
    # nothing says where a container ends that goes on in boxes of its kinds, so what follows is no such box
    assert media.sniff_bytes(padded + b" and more text", signatures)[1] == [(kind, 10, len(data))]
    for cut in range(1, len(data)):
        got = media.sniff_bytes(data[:cut], signatures)
        assert got[0] is None or (kind == "video/mp4" and cut >= data.index(b"mdat") - 4), cut
    assert media.sniff_bytes(data + data, signatures)[1][:1] == [(kind, len(data), len(data))] or kind == "video/mp4"


def test_media_of_unknown_length_or_wrong_sums():
    signatures = media.automaton()
    assert media.sniff_bytes(flac([b"one", b"two"], known=False), signatures)[0] == "audio/flac"
    broken = bytearray(flac([b"one", b"two"]))
    broken[-4] ^= 1
    assert media.sniff_bytes(bytes(broken), signatures) == (None, [])
    assert media.sniff_bytes(bmp(width=9)[:58], signatures)[0] is None and media.sniff_bytes(gif().replace(b"\x2c\0\0", b"\x2c\1\0"), signatures)[0] is None
    inside = box(b"ftyp", b"isom\0\0\2\0isomiso2") + box(b"moov", b"") + box(b"mdat", png())
    assert media.sniff_bytes(inside, signatures) == ("video/mp4", [("image/png", len(inside) - len(png()), len(png()))])


def test_scans_of_many_restarts_take_linear_time():
    import time

    start = time.time()
    data = b"\xff\xd8" + b"\xff\xda\x00\x04\0\0" * 50_000 + b"\xff\xd9"
    assert media.sniff_bytes(data, media.automaton())[0] in (None, "image/jpeg") and time.time() - start < 5


def plain_sniff(data):
    """Every position against every signature."""
    found, whole = [], None
    for at in range(len(data)):
        for magic, offset, kind in media.SIGNATURES:
            if data[at + offset : at + offset + len(magic)] == magic and (n := media.VALIDATORS[kind](memoryview(data), at)):
                kind = media.RIFF_TYPES[data[at + 8 : at + 12]] if kind == "riff" else kind
                if at:
                    found.append((kind, at, n))
                else:
                    whole = whole or kind
    return whole, sorted(found)


def test_sniffing_against_every_position():
    rng, signatures = random.Random(9), media.automaton()
    for _ in range(60):
        parts = [rng.choice([*FORMS.values(), b"BM", b"RIFF", b"\xff\xd8\xff", b"OggS", b"plain words ", bytes(rng.randrange(256) for _ in range(20))]) for _ in range(rng.randrange(1, 6))]
        data = b"".join(p[: len(p) - rng.choice([0, 0, 1])] for p in parts)
        kind, inside = media.sniff_bytes(data, signatures)
        assert (kind, sorted(inside)) == plain_sniff(data)


def test_sniff_corrects_and_carves(spark):
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0\x3b"
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + struct.pack("<IIHHI", 1, 1, 1, 24, 0) + b"\0" * 24
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04\0\0\x12\xff\x00\x34\xff\xd9"
    rows = [("image/gif", png()), ("image/png", png()), ("text/plain", b"xx" + png() + b"yy" + gif), ("a", bytes(bmp)), ("a", jpeg), (None, media.to_wav(b"ab")), ("a", b"BM and RIFF and \x89PNG\r\n\x1a\n"), ("a", None), ("a", b"")]
    df = spark.createDataFrame([(i, k, bytearray(b) if b is not None else None) for i, (k, b) in enumerate(rows)], "i long, declared string, data binary").withColumn("detected", F.lit(1))
    got = {r.i: r for r in media.sniff(df, "data", "declared", carve=True).collect()}
    assert [(got[i].detected, got[i].corrected) for i in range(9)] == [
        ("image/png", True), ("image/png", False), ("text/plain", False), ("image/bmp", True), ("image/jpeg", True), ("audio/wav", True), ("a", False), ("a", False), ("a", False)]
    assert [bytes(b) for b in got[2].carved] == [png(), gif] and not got[6].embedded
    broken = png()[:-6] + b"x" + png()[-5:]
    assert media.sniff_bytes(broken, media.automaton()) == (None, [])


def test_stored_texts_come_back(spark, docs):
    texts = Counter()
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        texts[(r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    rows = media.op8(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == texts
    assert all(r.feature.startswith("audio/wav;corrected=1") and r.media_bytes == r.payload_bytes + 44 for r in rows)
    assert media.op8(empty(docs)).count() == 0


# ---- 9

def plain_tree(texts, depth):
    """Counts of all nodes and their weighted probabilities, recursively."""
    n = defaultdict(lambda: [0, 0])
    for t in texts:
        s = bytes([ctw.END]) * depth + t + bytes([ctw.END])
        for i in range(depth, len(s)):
            bits = 1
            for b in range(7, -1, -1):
                bit = s[i] >> b & 1
                for d in range(depth + 1):
                    n[(s[i - d : i][::-1], bits)][bit] += 1
                bits = bits << 1 | bit
    below = defaultdict(set)
    for ctx, bits in n:
        if ctx:
            below[(ctx[:-1], bits)].add(ctx)
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)
    weighted = {}
    for ctx, bits in sorted(n, key=lambda k: -len(k[0])):
        own = kt(n[(ctx, bits)])
        if len(ctx) == depth:
            weighted[(ctx, bits)] = own
        else:
            rest = sum(weighted[(c, bits)] for c in below[(ctx, bits)])
            top = max(own, rest)
            weighted[(ctx, bits)] = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(rest - top))

    def score(t):
        s, total = bytes([ctw.END]) * depth + t + bytes([ctw.END]), 0.0
        for i in range(depth, len(s)):
            bits = 1
            for b in range(7, -1, -1):
                bit, p = s[i] >> b & 1, None
                for d in range(depth, -1, -1):
                    k = (s[i - d : i][::-1], bits)
                    c = n.get(k, [0, 0])
                    own = (c[bit] + 0.5) / (sum(c) + 1)
                    if p is None:
                        p = own
                    else:
                        w = math.exp(math.log(0.5) + kt(c) - weighted[k]) if k in weighted else 0.5
                        p = w * own + (1 - w) * p
                total += math.log10(p)
                bits = bits << 1 | bit
        return total

    return score


def test_context_trees(spark, docs):
    df = docs.where("doc_id IS NULL OR doc_id <> 108")
    rows = df.select("doc_id", "text").collect()
    words = [(r.doc_id, [w.decode() for w in (r.text or "").encode().lower().split()]) for r in rows]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    learn = [w for d, w in words if not out(d)]
    score = plain_tree([" ".join(w).encode() for w in learn], ctw.DEPTH)
    c = Counter(x for w in learn for x in [*w, ""])
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), out(d), len(w) + 1, sum(c[x] > 0 for x in [*w, ""]), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, ""]), 6), round(score(" ".join(w).encode()), 6)) for d, w in words)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ctw.op9(df).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4
    assert ctw.op9(empty(docs)).count() == 0


def test_model_is_a_distribution(spark):
    part = next(ctw.parts(enumerate([b"abab ba", b"abba"])))
    keys, _ = part.grams()
    asked = np.unique(np.r_[keys, (keys[0] >> 8 << 8) + np.arange(256)])
    counts = spark.createDataFrame([(int(k), int((keys == k).sum())) for k in asked], "key long, n long")
    p = {r.key: r.value for r in ctw.predictions(counts).collect()}
    assert len(p) == len(asked) and abs(sum(10 ** p[int(k)] for k in asked if k >> 8 == keys[0] >> 8) - 1) < 1e-9


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_pieces_of_a_text_are_its_bytes(monkeypatch, size):
    monkeypatch.setattr(ctw, "PART_BYTES", size)
    for text in (b"", b" ", b"a", b" A  bc\td\ne ", text_of(4).encode(), b"x" * 40, b"\n\n ab   "):
        got = list(ctw.pieces(text))
        words = text.lower().split()
        whole = b" ".join(words) + bytes([ctw.END])
        assert b"".join(b for _, b, _ in got) == whole and [w for _, _, x in got for w in x] == words
        at = 0
        for pad, body, _ in got:
            assert pad == (bytes([ctw.END]) * ctw.DEPTH + whole)[at : at + ctw.DEPTH]
            at += len(body)


def test_model_beats_words_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op9_context_tree_scoring"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# ---- 10

def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    scores, start, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got, expected = crf.forward_backward(scores, np.array([4, 2]), start, moves)
    wanted = np.zeros((3, 3))
    for s, n in ((0, 4), (1, 2)):
        weight, marginal = 0.0, np.zeros((n, 3))
        pairs = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            w = math.exp(start[path[0]] + sum(scores[s, i, x] for i, x in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            weight += w
            for i, x in enumerate(path):
                marginal[i, x] += w
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w
        assert np.allclose(got[s, :n], marginal / weight) and (got[s, n:] == 0).all()
        wanted += pairs / weight
    assert np.allclose(expected, wanted)


def test_languages_of_held_out_texts(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op10_crf_language"](spark, d).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in spark.read.parquet(f"{d}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_text_and_odd_rows(spark, docs):
    out = {(r.doc_id, r.text): r for r in crf.languages(docs, "doc_id", "text", "lang").collect()}
    assert len([1 for r in out.values() if r.lang_pred == "und"]) == 4  # null, empty, white space, digits
    assert crf.languages(empty(docs), "doc_id", "text", "lang").count() == 0
    odd = spark.createDataFrame([(1, "² ½ Ⅷ 12"), (2, "x²"), (3, "日本")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    odd = docs.select("doc_id", "text", "lang").where("doc_id < 30").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r.doc_id: r.lang_pred for r in crf.op10(odd).collect()}
    assert got[1001] == "und" and got[1002] != "und" and got[1003] != "und"
    field = crf.fit(["der hund und die katze " * 6, "the dog and the cat are " * 6], ["de", "en"], sequences=200)
    marginal = crf.forward_backward(field.scores("der hund und die the dog and the".split())[None], np.array([8]), field.start, field.moves)[0][0]
    assert [field.languages[i] for i in marginal.argmax(axis=1)] == ["de"] * 4 + ["en"] * 4


def test_long_texts_are_labelled_in_runs(monkeypatch):
    field = crf.fit(["der hund und die katze " * 6, "the dog and the cat are " * 6], ["de", "en"], sequences=200)
    text = " ".join(random.Random(4).choices(["der hund und die katze", "the dog and the cat are"], k=900))
    whole = crf.label(field, crf.Scored(field), [text, "dog"])
    monkeypatch.setattr(crf, "RUN", 500)
    parts = crf.label(field, crf.Scored(field), [text, "dog"])
    assert [x[0] for x in whole] == [x[0] for x in parts] and np.allclose([x[1:] for x in whole], [x[1:] for x in parts])


def test_languages_of_long_labelled_texts_are_learnt(spark):
    rows = [(i, f"{w} " * 20_000, lang) for i, (w, lang) in enumerate([("ñandú qué", "es"), ("über straße", "de")] * 6)]
    got = crf.op10(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got)


def test_documents_schema():
    assert DOCS.count(",") == 4


@pytest.mark.parametrize("shared", [1, 3, 4, 8, 9])  # ids of the folds that are learned from
def test_a_language_whose_rows_share_an_id_is_learned(spark, shared):
    german = [(shared, text_of(i, 12, "der hund und die katze mit haus baum wolke".split()), "de") for i in range(1500)]
    english = [(1000 + i, text_of(i, 12, "the dog and cat with house tree cloud".split()), "en") for i in range(1500)]
    found = crf.op10(spark.createDataFrame(german + english, "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in found.where(f"doc_id in ({shared}, 1003, 1004)").collect()} == {shared: "de", 1003: "en", 1004: "en"}


def test_levels_of_any_name(spark):
    df = spark.createDataFrame([(i, f"a b c {i}", f"x{i % 3}", f"y{i % 2}") for i in range(60)], "doc_id long, text string, cap string, tokens string")
    weights = {"cap": {"x0": 3.0}, "tokens": {"y0": 2.0}}
    one = mixing.mix(df, "doc_id", mixing.n_words(), {"cap": F.col("cap"), "tokens": F.col("tokens"), "_w": F.lit("z")}, weights, 0.5, 1)
    two = mixing.mix(df, "doc_id", mixing.n_words(), {"p": F.col("cap"), "q": F.col("tokens"), "r": F.lit("z")}, {"p": weights["cap"], "q": weights["tokens"]}, 0.5, 1)
    assert one.columns == ["doc_id", "text", "cap", "tokens", "_w", "n_tokens", "copies"]
    assert sorted(one.select("doc_id", "cap", "tokens", "copies").collect()) == sorted(two.select("doc_id", "p", "q", "copies").collect())
    with pytest.raises(ValueError):
        mixing.mix(df, "doc_id", mixing.n_words(), {"copies": F.col("cap")}, {}, 0.5, 1)
