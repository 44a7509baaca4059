"""Hierarchical budgeting of a corpus over a tree of source levels, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise

NONE = "(none)"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _level_weight(level: str, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """Leaves (levels..., tokens) with their target tokens.

    The root's budget goes down the tree. At a node it is shared by its children's weights, each child
    capped by what its subtree holds (tokens x max_epochs); what a capped child leaves is shared again by its
    siblings' weights. A shortage therefore reaches an ancestor's other children only when all siblings are full.
    The fill level has a closed form: with the children ordered by capacity/weight, child i is full if
    capacity_i * (weights from i on) <= weight_i * (budget - capacities before i).
    """
    out = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    root = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all"))
    parents = root.select(F.least(budget.cast("long"), F.col("_all") * max_epochs).alias("_b"))
    above: list[str] = []
    for level in levels:
        path = [*above, level]
        nodes = out.groupBy(*path).agg(F.sum("cap").alias("_c")).withColumn("_w", _level_weight(level, weights.get(level, {})))
        nodes = nodes.join(parents, above) if above else nodes.crossJoin(parents)  # the root is one row
        by = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        fill = by.orderBy(F.col("_c") / F.col("_w"), level)
        before = fill.rowsBetween(Window.unboundedPreceding, -1)
        onward = by.orderBy((F.col("_c") / F.col("_w")).desc(), F.col(level).desc())
        nodes = nodes.withColumns({
            "_cb": F.coalesce(F.sum("_c").over(before), F.lit(0)),
            "_wo": F.sum("_w").over(onward.rowsBetween(Window.unboundedPreceding, 0)),
        }).withColumn("_full", F.col("_c") * F.col("_wo") <= F.col("_w") * (F.col("_b") - F.col("_cb")))
        nodes = nodes.withColumns({
            "_left": F.col("_b") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_c"))).over(by), F.lit(0)),
            "_free": F.when(~F.col("_full"), F.col("_w")).otherwise(0.0),
        })
        run = F.sum("_free").over(by.orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("_free").over(by)
        share = F.round(F.col("_left") * F.col("_run") / F.col("_total")) - F.round(
            F.col("_left") * (F.col("_run") - F.col("_free")) / F.col("_total"))
        parents = nodes.withColumns({"_run": run, "_total": F.nullif(total, F.lit(0.0))}).select(
            *path,
            F.when(F.col("_full"), F.col("_c")).otherwise(F.least(F.col("_c"), share.cast("long"))).alias("_b"),
        )
        above = path
    return out.join(parents.withColumnRenamed("_b", "target"), levels)


def mix(
    df: DataFrame, key: str, tokens: Column, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]],
    fraction: float = 0.5, max_epochs: int = 2, seed: int = 1, content: str | None = None,
) -> DataFrame:
    """The selected records: columns of df, the levels, n_tokens and copies (how often the record is taken, at least 1).

    levels: the tree from the top down, as columns; weights: by level and name, 1 where a name is missing.
    The budget is fraction of all tokens. A leaf's target of e whole epochs and a rest takes every record e times,
    and of epoch e's seeded order the longest prefix whose tokens fit the rest. The order is that of a hash of seed, epoch, key and, if
    given, the column content, which tells apart records that share a key.

    The prefix is found in three levels: token sums of a leaf's 4,096 hash ranges, then of the hashes in a range, then the rows of
    a hash. Windows run over sums alone, so a leaf of a third of the corpus is spread over 4,096 groups and a key that a third of
    the rows repeat is one row of them. Null names are the name "(none)"; null keys hash as "null"; null texts and texts without
    words have 0 tokens and are taken with the prefix they stand in; rows of equal key and content are taken alike, or not at all if
    together they do not fit; an empty table gives an empty result. Columns of df named like a level, n_tokens or copies are
    replaced; levels may have any other name.
    """
    if clash := {"n_tokens", "copies"} & set(levels):
        raise ValueError(f"levels named like results: {clash}")
    kept = [c for c in df.columns if c not in {*levels, "n_tokens", "copies"}]
    digest, epochs, rest, at, span, total, before, upto = fresh(
        [*df.columns, *levels], "digest", "epochs", "rest", "at", "span", "total", "before", "upto")
    # inside, levels have names that meet none of budgets' own
    names = fresh([*df.columns, *levels], *[f"level{i}" for i in range(len(levels))])
    weights = {n: weights.get(level, {}) for n, level in zip(names, levels, strict=True)}
    exprs = {"n_tokens": tokens.cast("long"), **{n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in zip(names, levels.values(), strict=True)}}
    same = F.md5(F.coalesce(F.col(content).cast("string"), F.lit("")).cast("binary")) if content else F.lit("")
    rows = df.withColumns({**exprs, digest: same}).select(*kept, *names, "n_tokens", digest)
    leaves = materialise(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    whole = F.coalesce(leaves.agg(F.floor(F.sum("tokens") * F.lit(float(fraction))).alias(total)).scalar(), F.lit(0))
    target = budgets(leaves, names, weights, whole, max_epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(0).cast("long")
    target = target.select(*names, full.alias(epochs), (F.col("target") - full * F.col("tokens")).alias(rest))
    target = materialise(target, "targets")
    said = F.concat_ws(":", F.lit(str(seed)), F.col(epochs).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null")), *([F.col(digest)] if content else []))
    rows = rows.join(target, names).withColumn(at, F.md5(said.cast("binary"))).withColumn(span, F.substring(at, 1, 3)).drop(digest)
    sums = materialise(rows.groupBy(*names, span, at).agg(F.sum("n_tokens").alias(total)), "sums")
    spans = sums.groupBy(*names, span).agg(F.sum(total).alias(before))
    spans = spans.withColumn(before, F.sum(before).over(Window.partitionBy(*names).orderBy(span)) - F.col(before))
    sums = sums.withColumn(upto, F.sum(total).over(Window.partitionBy(*names, span).orderBy(at))).join(spans, [*names, span])
    sums = sums.select(*names, span, at, (F.col(before) + F.col(upto)).alias(upto))
    fits = (F.col(upto) <= F.col(rest)).cast("int")
    out = rows.join(sums, [*names, span, at]).withColumn("copies", (F.col(epochs) + fits).cast("int"))
    return out.where("copies > 0").select(*kept, *[F.col(n).alias(level) for n, level in zip(names, levels, strict=True)], "n_tokens", "copies")


# the weights of the production query; a source's domain is its number modulo 4
DOMAIN = "concat('d', coalesce(cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) % 4 AS string), '?'))"
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def op7(docs: DataFrame, fraction: float = 0.6, max_epochs: int = 2) -> DataFrame:
    picked = mix(
        docs.select("doc_id", "text", "lang", "source"), "doc_id", n_words(),
        {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}, WEIGHTS, fraction, max_epochs, content="text",
    )
    return picked.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _level_sql(n: int, above: list[str], level: str) -> str:
    path = ", ".join([*above, level])
    part = f"PARTITION BY {', '.join(above)} " if above else ""
    cases = " ".join(f"WHEN {level} = '{k}' THEN {float(v)}e0" for k, v in WEIGHTS.get(level, {}).items())
    weight = f"CASE {cases} ELSE 1e0 END" if cases else "1e0"
    join = f"JOIN b{n - 1} USING ({', '.join(above)})" if above else "CROSS JOIN b0"
    return f"""
c{n} AS (SELECT {path}, c, w, b FROM (SELECT {path}, sum(tokens) * 2 AS c, {weight} AS w FROM leaf GROUP BY {path}) {join}),
f{n} AS (SELECT *, coalesce(sum(c) OVER ({part}ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
         sum(w) OVER ({part}ORDER BY c / w DESC, {level} DESC ROWS UNBOUNDED PRECEDING) AS wo FROM c{n}),
g{n} AS (SELECT *, c * wo <= w * (b - cb) AS is_full FROM f{n}),
h{n} AS (SELECT *, b - coalesce(sum(CASE WHEN is_full THEN c END) OVER ({part or ''}), 0) AS rem,
         CASE WHEN is_full THEN 0e0 ELSE w END AS free FROM g{n}),
i{n} AS (SELECT *, sum(free) OVER ({part}ORDER BY {level} ROWS UNBOUNDED PRECEDING) AS run, sum(free) OVER ({part or ''}) AS total FROM h{n}),
b{n} AS (SELECT {path}, CASE WHEN is_full THEN c ELSE least(c, CAST(round(rem * run / total) - round(rem * (run - free) / total) AS HUGEINT)) END AS b FROM i{n})"""


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, concat('d', coalesce(CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER) % 4 AS VARCHAR), '?')) AS domain,
         coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS digest
  FROM documents
), leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
b0 AS (SELECT least(CAST(floor(sum(tokens) * 0.6e0) AS HUGEINT), sum(tokens) * 2) AS b FROM leaf),
{_level_sql(1, [], "domain")},
{_level_sql(2, ["domain"], "lang")},
{_level_sql(3, ["domain", "lang"], "source")},
t AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS e, b, tokens FROM b3 JOIN leaf USING (domain, lang, source)),
r AS (
  SELECT d.*, e, b - e * tokens AS rest, md5('1:' || CAST(e AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest) AS h
  FROM d JOIN t USING (domain, lang, source)
), s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS cum FROM r)
SELECT doc_id, domain, lang, source, n_tokens, CAST(e + CASE WHEN cum <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM s WHERE e + CASE WHEN cum <= rest THEN 1 ELSE 0 END > 0
"""
