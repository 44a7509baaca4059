"""Line dedup by pairwise alignment: shared rare lines pair documents, patience diff aligns them, and aligned common
blocks are deleted from the later document."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_key

LAST = (1 << 63) - 1
SALTS = 16  # parts of the holders of a line
PARTNERS = 1000  # later documents for each copy of a first holder's lines
GAP = 2  # lines between two aligned ones of a block, in either document
LONE_WORDS = 12  # of a line that goes on its own
WINDOW = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by their first number) whose second numbers rise."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tops, y)
        back.append(at[i - 1] if i else -1)
        if i == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[i], at[i] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(later: list[int], earlier: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in later, in earlier) of equal lines: lines unique in both are anchors, their longest rising
    run is kept, and equal lines next to an anchor join it."""
    one, two = Counter(later), Counter(earlier)
    where = {h: i for i, h in enumerate(earlier) if two[h] == 1}
    anchors = _longest_rise([(i, where[h]) for i, h in enumerate(later) if one[h] == 1 and h in where])
    found: dict[int, int] = {}
    edge_l, edge_e = -1, -1
    for n, (i, j) in enumerate(anchors):
        if i <= edge_l or j <= edge_e:
            continue
        a, b = i, j
        while a - 1 > edge_l and b - 1 > edge_e and later[a - 1] == earlier[b - 1]:
            a, b = a - 1, b - 1
        stop_l, stop_e = anchors[n + 1] if n + 1 < len(anchors) else (len(later), len(earlier))
        c, d = i, j
        while c + 1 < stop_l and d + 1 < stop_e and later[c + 1] == earlier[d + 1]:
            c, d = c + 1, d + 1
        found.update(zip(range(a, c + 1), range(b, d + 1), strict=True))
        edge_l, edge_e = c, d
    return sorted(found.items())


def aligned_blocks(later: list[tuple[int, int, int]], earlier: list[tuple[int, int]], least_words: int, lone_words: int = LONE_WORDS) -> list[int]:
    """Line numbers of later to delete. later: (line number, hash, words), earlier: (line number, hash), both the lines that
    the two documents share, in order. Aligned lines are one block while at most GAP lines stand between them in either document, so a
    passage with an edited line is one; a block of several lines counts from least_words words on, a line of its own, which may be a
    coincidence, from lone_words on. Alignment is repeated on what no block has, so that moved passages and repeated ones are found too."""
    gone: list[int] = []
    rest, other = list(later), list(earlier)
    while rest and other:
        match = patience([h for _, h, _ in rest], [h for _, h in other])
        if not match:  # what is left stands more than once: its first occurrences are paired
            first_l = {h: i for i, (_, h, _) in reversed(list(enumerate(rest)))}
            first_e = {h: i for i, (_, h) in reversed(list(enumerate(other)))}
            match = _longest_rise(sorted((i, first_e[h]) for h, i in first_l.items() if h in first_e))
        if not match:
            break
        run: list[tuple[int, int]] = []
        for i, j in [*match, (-1, -1)]:
            if run and (i < 0 or rest[i][0] - rest[run[-1][0]][0] > GAP + 1 or other[j][0] - other[run[-1][1]][0] > GAP + 1):
                if sum(rest[x][2] for x, _ in run) >= (least_words if len(run) > 1 else lone_words):
                    gone += [rest[x][0] for x, _ in run]
                run = []
            run.append((i, j))
        taken_l = {i for i, _ in match}
        held = Counter(h for n, (_, h, _) in enumerate(rest) if n not in taken_l)
        rest = [x for n, x in enumerate(rest) if n not in taken_l]
        # a line of the earlier document may match further occurrences in the later one
        other = [x for x in other if held[x[1]]]
    return gone


def _delete(least_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for later, lines, earlier in zip(f["later"], f["lines"], f["their"], strict=True):
                both = {r["h"] for r in lines} & {r["h"] for r in earlier}
                gone = aligned_blocks(
                    [(r["pos"], r["h"], r["words"]) for r in lines if r["h"] in both], [(r["pos"], r["h"]) for r in earlier if r["h"] in both], least_words)
                if gone:
                    out.append((later["id"], later["ref"], sorted(gone)))
            yield pd.DataFrame(out, columns=["id", "ref", "gone"])

    return run


def windows(text: str, least_words: int) -> list[tuple[int, int, int]]:
    """(hash, line number, lines) of the shortest runs of two or more neighbouring lines that reach least_words words, from every
    short line on and up to every short line. They cover every line of every longer run (lines without words only inside it),
    and a line stands in at most twice least_words of them."""
    lines = [x.strip(" ").encode() for x in text.split("\n")]
    total = [0]
    for x in lines:
        total.append(total[-1] + len(x.split(None, least_words)))
    found, start = set(), 0
    for end in range(len(lines) + 1):
        if end < len(lines) and lines[end]:
            continue
        for p in range(start, end):
            if 0 < total[p + 1] - total[p] < least_words:
                stop = bisect_left(total, total[p] + least_words, p + 1, end + 1)
                if stop <= end:
                    found.add((p, stop))
                first = bisect_right(total, total[p + 1] - least_words, start, p + 1) - 1
                if first >= start:
                    found.add((first, p + 1))
        start = end + 1
    return [(xxhash.xxh3_64_intdigest(b"\n".join(lines[a:b])) - (1 << 63), a, b - a) for a, b in sorted(found)]


def _windows(least_words: int):
    names = ["id", "ref", "h", "pos", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, ref, text in zip(*batch.columns, strict=True):
                out += [(key.as_py(), ref.as_py(), *w) for w in windows(text.as_py(), least_words)]
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), WINDOW, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), WINDOW, strict=True)], names=names)

    return run


def _with_first(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows (h, doc, pos) with first and held, of held (h, first, held): each h of held stands SALTS times, so that the rows of a line that a third
    of the corpus holds are dealt over as many tasks."""
    salted = held.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).drop("salt")


def _line(x: Column) -> Column:
    return F.trim(x)


def dedup_lines(df: DataFrame, key: str, text: str, least_words: int = 5) -> DataFrame:
    """df with the text's repeated blocks deleted, and removed_lines (how many lines were deleted, long).

    A line is what stands between line feeds, trimmed; empty lines take no part. A document comes before another by its
    key, then by its text's hash. Rare lines pair documents: of a document's lines of least_words words or more that others hold, and of its windows (the
    shortest runs of shorter neighbouring lines that reach so many), each pairs it with the first document that holds it. A rarer line of the
    passage has the same or a nearer partner, and a common one adds one pair a document, not one a pair of its holders, so pairs grow with the lines and nothing
    is capped. A pair's shared lines are aligned (patience diff, repeated on the rest for moved passages), and the aligned blocks are deleted from the later document:
    see aligned_blocks. So a short line that recurs on its own, or in another order far from its neighbours, stays. Counts are
    pre-aggregated by hash; the joins on a hash have one row a hash on one side and are salted, and a document that is the first of many gets
    a copy for every PARTNERS of them, so neither a line nor a first holder that a third of the corpus shares is one task.

    Null texts stay null and empty texts empty. Null keys come last, in their hash order. Rows of equal key and text are one
    document: all keep or lose the same lines. A document may lose all its lines: its text is then empty, and its row
    stays. Other columns are kept; a column removed_lines is replaced. An empty table stays empty.
    """
    kept = [c for c in df.columns if c != "removed_lines"]
    doc = F.struct(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), text_key(F.col(text)).alias("ref"))
    parts = F.split(F.col(text), "\n")
    lines = (
        df.where(F.col(text).isNotNull()).select(doc.alias("doc"), F.posexplode(parts).alias("pos", "line"))
        .where(_line(F.col("line")) != "")
        .select("doc", "pos", text_key(_line(F.col("line"))).alias("h"), F.regexp_count(F.col("line"), F.lit(r"\S+")).alias("words"))
    )
    held = lines.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last").select("h", "first", F.col("n").alias("held"))
    shared = materialise(_with_first(lines, held), "lines")
    # copies of a row explode alike; a document's lines count once
    item = F.struct("pos", "h", "words")
    by_doc = shared.groupBy("doc").agg(F.array_sort(F.collect_set(item)).alias("lines"))
    by_doc = materialise(by_doc, "holders")
    some = df.where(F.contains(F.col(text), F.lit("\n"))).select(doc.alias("doc"), F.col(text).alias("text"))
    runs = some.select("doc.id", "doc.ref", "text").mapInArrow(_windows(least_words), "id long, ref long, h long, pos int, n int")
    runs = materialise(runs, "windows").withColumn("doc", F.struct("id", "ref"))
    known = runs.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last").select("h", "first", F.col("n").alias("held"))
    by_window = _with_first(runs, known).where("doc > first").select(F.col("doc").alias("later"), F.col("first").alias("earlier"), "held")
    by_line = shared.where((F.col("doc") > F.col("first")) & (F.col("words") >= least_words)).select(F.col("doc").alias("later"), F.col("first").alias("earlier"), "held")
    pairs = by_line.unionByName(by_window).withColumn("copies", F.expr(f"CAST(div(held, {PARTNERS}) + 1 AS INT)"))
    pairs = materialise(pairs.groupBy("later", "earlier").agg(F.max("copies").alias("copies")), "pairs")
    copies = pairs.groupBy("earlier").agg(F.max("copies").alias("copies"))
    late = by_doc.select(F.col("doc").alias("later"), "lines")
    early = by_doc.select(F.col("doc").alias("earlier"), F.col("lines").alias("their")).join(copies, "earlier").select("earlier", "their", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
    pairs = pairs.select("later", "earlier", F.pmod(F.xxhash64("later"), F.col("copies")).cast("int").alias("part"))
    both = pairs.join(late, "later").join(early, ["earlier", "part"]).select("later", "lines", "their")
    gone = both.mapInPandas(_delete(least_words), "id long, ref long, gone array<int>")
    gone = gone.groupBy("id", "ref").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    row = F.struct(*kept)  # no name of the caller's can clash with one of ours
    out = df.select(doc.alias("doc"), row.alias("row")).select("doc.id", "doc.ref", "row").join(gone, ["id", "ref"], "left")
    rest = F.array_join(F.filter(F.split(F.col("row")[text], "\n"), lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return out.select(
        *[F.when(F.col("gone").isNull(), F.col("row")[c]).otherwise(rest).alias(c) if c == text else F.col("row")[c].alias(c) for c in kept],
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"),
    )


def op6(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs, "doc_id", "text")
    return out.select("doc_id", "text", "removed_lines")
