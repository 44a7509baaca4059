"""DuckDB's SQL of the hourly words: hour after hour by recursion, where the operators use windows and a fold."""

from __future__ import annotations


def hours(source: str, keys: list[str]) -> str:
    """CTEs up to `said` (keys, h, beat, longest, kind, low, high) over source (keys, day, m)."""
    k = ", ".join(keys)
    return f"""
d AS (SELECT DISTINCT {k}, day, m FROM ({source})),
g AS (SELECT *, m - lag(m) OVER w AS back, lead(m) OVER w - m AS wait, m // 60 AS h FROM d WINDOW w AS (PARTITION BY {k}, day ORDER BY m)),
days AS (SELECT {k}, day, (min(m) + 59) // 60 AS a, max(m) // 60 AS b FROM d GROUP BY {k}, day HAVING count(*) > 1),
span AS (SELECT {k}, max(a) AS a, min(b) AS b FROM days GROUP BY {k}),
each AS (
  SELECT {k}, day, h, count(*) AS n, min(wait) AS least, max(wait) AS longest, bool_and(back IS NOT NULL) AND min(back) = max(back) AS even,
    min(back) AS back, arg_max(wait, m) AS last_wait, max(m) AS last FROM g JOIN days USING ({k}, day) GROUP BY {k}, day, h
  UNION ALL
  SELECT {k}, day, unnest(range(h + 1, (m + wait) // 60)), 0, wait, wait, false, NULL, NULL, NULL FROM g
),
by_hour AS (
  SELECT {k}, h, min(n) AS fewest, max(n) AS most, min(least) AS least, max(longest) AS longest, bool_and(even) AND min(back) = max(back) AS even, min(back) AS back,
    bool_and(last_wait <= back) AS closes, bool_and(last_wait <= back OR last + back >= h * 60 + 60) AS reaches, bool_and(last_wait = back) AS exact
  FROM each JOIN span USING ({k}) WHERE h >= a AND h < b GROUP BY {k}, h
),
own AS (SELECT *, CASE WHEN least = longest AND (fewest > 1 OR longest % 60 = 0) THEN longest END AS own_beat FROM by_hour),
next AS (SELECT *, lead(own_beat) OVER (PARTITION BY {k} ORDER BY h) AS later, row_number() OVER (PARTITION BY {k} ORDER BY h) AS i FROM own),
forward AS (
  SELECT {k}, i, own_beat AS beat FROM next WHERE i = 1
  UNION ALL
  SELECT {', '.join(f'n.{x}' for x in keys)}, n.i, CASE WHEN own_beat IS NOT NULL THEN own_beat
    WHEN even AND back = beat AND (closes OR (reaches AND later IS DISTINCT FROM back)) THEN beat END
  FROM forward f JOIN next n ON n.i = f.i + 1 AND {' AND '.join(f'n.{x} = f.{x}' for x in keys)}
),
ahead AS (SELECT n.*, f.beat, row_number() OVER (PARTITION BY {', '.join(f'n.{x}' for x in keys)} ORDER BY h DESC) AS j FROM next n JOIN forward f USING ({k}, i)),
backward AS (
  SELECT {k}, j, beat FROM ahead WHERE j = 1
  UNION ALL
  SELECT {', '.join(f'n.{x}' for x in keys)}, n.j, coalesce(n.beat, CASE WHEN even AND back = b.beat AND exact THEN b.beat END)
  FROM backward b JOIN ahead n ON n.j = b.j + 1 AND {' AND '.join(f'n.{x} = b.{x}' for x in keys)}
),
hour AS (
  SELECT {k}, h, i, b.beat, coalesce(b.beat, longest) AS longest, fewest, most,
    CASE WHEN b.beat IS NOT NULL THEN 'every' WHEN most = 0 THEN 'none' WHEN fewest > 3 AND longest <= 15 THEN 'atMost' ELSE 'perHour' END AS kind
  FROM ahead JOIN backward b USING ({k}, j)
),
said AS (SELECT *, CASE WHEN kind IN ('every', 'atMost') THEN longest ELSE fewest END AS low, CASE WHEN kind IN ('every', 'atMost') THEN longest ELSE most END AS high FROM hour)"""


def words(keys: list[str], scope: list[str]) -> str:
    """CTEs from `said` up to `words` (keys, from, to, kind, low, high), groups of a scope read together."""
    k = ", ".join(keys)
    same = """((f.kind IN ('every', 'atMost') AND s.kind IN ('every', 'atMost') AND f.low = s.low) OR (f.kind = 'none' AND s.kind = 'none')
     OR (f.kind = 'perHour' AND s.kind = 'perHour' AND (f.low = 0) = (s.low = 0) AND greatest(f.high, s.high) - least(f.low, s.low) <= 1))"""
    return f"""
fold AS (
  SELECT {k}, i, h, h AS start, kind, low, high FROM said WHERE i = 1
  UNION ALL
  SELECT {', '.join(f's.{x}' for x in keys)}, s.i, s.h, CASE WHEN {same} THEN f.start ELSE s.h END,
    CASE WHEN {same} AND f.kind <> s.kind THEN 'atMost' ELSE s.kind END,
    CASE WHEN {same} THEN least(f.low, s.low) ELSE s.low END, CASE WHEN {same} THEN greatest(f.high, s.high) ELSE s.high END
  FROM fold f JOIN said s ON s.i = f.i + 1 AND {' AND '.join(f's.{x} = f.{x}' for x in keys)}
),
run AS (SELECT {k}, start, max(h) + 1 AS stop, arg_max(kind, h) AS kind, arg_max(low, h) AS low, arg_max(high, h) AS high FROM fold GROUP BY {k}, start),
counted AS (SELECT *, bool_or(kind = 'perHour' AND low = 1 AND high = 1) OVER (PARTITION BY {', '.join(scope)}) AND kind = 'every' AND low = 60 AS turns FROM run),
turned AS (SELECT {k}, start, stop, CASE WHEN turns THEN 'perHour' ELSE kind END AS kind, CASE WHEN turns THEN 1 ELSE low END AS low, CASE WHEN turns THEN 1 ELSE high END AS high FROM counted),
marked AS (SELECT *, CASE WHEN kind = 'perHour' AND lag(kind) OVER w = kind AND lag(low) OVER w = low AND lag(high) OVER w = high THEN 0 ELSE 1 END AS fresh
  FROM turned WINDOW w AS (PARTITION BY {k} ORDER BY start)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY {k} ORDER BY start ROWS UNBOUNDED PRECEDING) AS r FROM marked),
words AS (SELECT {k}, CAST(min(start) AS INT) AS "from", CAST(max(stop) AS INT) AS "to", kind, CAST(low AS INT) AS low, CAST(high AS INT) AS high FROM grouped GROUP BY {k}, r, kind, low, high)"""


def hourly(source: str, keys: list[str], scope: list[str] | None = None) -> str:
    return f"WITH RECURSIVE {hours(source, keys)},{words(keys, scope or keys)}\nSELECT * FROM words"


def stretches(source: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""WITH RECURSIVE {hours(source, keys)},
need AS (SELECT {k}, greatest(3, count(*) / 2.0e0) AS need FROM said GROUP BY {k}),
c AS (
  SELECT {k}, 'every' AS kind, beat AS n, h FROM said WHERE beat IS NOT NULL
  UNION ALL
  SELECT {', '.join(f's.{x}' for x in keys)}, 'atMost', l.longest, s.h FROM said s
  JOIN (SELECT DISTINCT {k}, longest FROM said WHERE longest <= 15) l ON s.longest <= l.longest AND {' AND '.join(f's.{x} = l.{x}' for x in keys)} WHERE s.kind <> 'perHour'
),
r AS (SELECT *, h - row_number() OVER (PARTITION BY {k}, kind, n ORDER BY h) AS r FROM c),
x AS (SELECT {k}, kind, n, min(h) AS a, max(h) + 1 AS b FROM r GROUP BY {k}, kind, n, r)
SELECT {k}, CAST(a AS INT) AS "from", CAST(b AS INT) AS "to", kind, CAST(n AS INT) AS n FROM x JOIN need USING ({k}) WHERE b - a >= need
QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY kind = 'atMost', n, a - b, a) = 1"""
