"""Search of stops, towns and lines by what is typed: token tables instead of an index in memory."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, fold, folded_words

# fixed values: umlauts as two letters, for the second spelling of a name
TWO = {"ä": "ae", "ö": "oe", "ü": "ue"}
# fixed values: abbreviations and the words they stand for
SHORT = {"hbf": "hauptbahnhof", "hauptbf": "hauptbahnhof", "bf": "bahnhof", "bhf": "bahnhof", "str": "strasse", "pl": "platz"}
BEGIN, INSIDE, SPELLING = 0, 1, 2


def tokens(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, word, n): the distinct folded words of a name, umlauts also written as two letters."""
    two = F.lower(F.col(name))
    for a, b in TWO.items():
        two = F.replace(two, F.lit(a), F.lit(b))
    words = F.array_distinct(F.concat(folded_words(F.col(name)), folded_words(two)))
    return names.select(key, F.posexplode(words).alias("n", "word"))


def letter_of(word: Column) -> Column:
    """The part of the index that words with this first letter are in: a letter or digit, or that of all others."""
    first = F.substring(word, 1, 1)
    return F.when(first.rlike("[a-z0-9]"), first).otherwise("_")


def index(words: DataFrame, key: str) -> DataFrame:
    """(key, word, letter) of tokens, to be stored by letter: every word once for each letter it holds. A word that begins with what is typed, holds it, or begins nearly so
    holds its first letter, so a search reads one part for each typed word (see search_stops)."""
    letters = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: letter_of(F.substr("word", i))))
    return words.where("word <> ''").select(key, "word", F.explode(letters).alias("letter")).repartition("letter", F.pmod(F.xxhash64("word"), F.lit(8))).sortWithinPartitions("letter", "word")


def near_beginning(word: str, typed: str, slips: int) -> bool:
    """Whether some beginning of word is typed with at most slips insertions, deletions, replacements and swaps of
    neighbouring letters. The first letters must be equal."""
    if not word or not typed or word[0] != typed[0]:
        return False
    before, row = None, list(range(len(word) + 1))
    for i, t in enumerate(typed, 1):
        last, before, row = before, row, [i]
        for j, w in enumerate(word, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (t != w))
            if last is not None and j > 1 and t == word[j - 2] and typed[i - 2] == w:
                best = min(best, last[j - 2] + 1)
            row.append(best)
    return min(row) <= slips


def slips_of(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def level_of(word: Column, typed: str) -> Column:
    """0 where the word begins with what is typed, 1 where it holds it, 2 where it begins nearly so; null for none."""
    forms = [typed, *([SHORT[typed]] if typed in SHORT else [])]
    begins, holds = F.lit(False), F.lit(False)
    for f in forms:
        begins, holds = begins | word.startswith(f), holds | word.contains(f)
    slips = slips_of(typed)
    out = F.when(begins, BEGIN).when(holds & F.lit(len(typed) > 1), INSIDE)
    if slips:

        @F.pandas_udf("boolean")
        def nearly(words: pd.Series) -> pd.Series:
            return words.map(lambda w: near_beginning(w or "", typed, slips))

        # a swap of letters is two replacements, and the beginning may be so much longer or shorter
        close = F.levenshtein(F.substring(word, 1, len(typed) + slips), F.lit(typed), 4 * slips) >= 0
        out = out.when(F.when(word.startswith(F.lit(typed[0])) & close, nearly(word)).otherwise(F.lit(False)), SPELLING)
    return out


def search_stops(words: DataFrame, names: DataFrame, key: str, typed: str, score: str, limit: int = 20, towns: DataFrame | None = None) -> DataFrame:
    """(key, level, score): names for all typed words, the best level of a name's words for each and the worst of these for the
    name; only the best level that anything reaches is kept beyond word beginnings and insides. Each typed word is one
    scan of the token table with a minimum a name, of a stored index (words with a column letter) a scan of one part; towns (key, level) may match in a name's place."""
    parts = [w for w in _fold_text(typed) if w]
    found = None
    for p in dict.fromkeys(parts):
        part = words.where(F.col("letter") == (p[0] if re.match("[a-z0-9]", p) else "_")) if "letter" in words.columns else words
        one = part.withColumn("_l", level_of(F.col("word"), p)).where("_l IS NOT NULL").groupBy(key).agg(F.min("_l").alias("_l"))
        if towns is not None:
            one = one.unionByName(towns.where(F.col("word") == p).select(key, F.lit(BEGIN).alias("_l"))).groupBy(key).agg(F.min("_l").alias("_l"))
        found = one.withColumnRenamed("_l", "level") if found is None else found.join(one, key).select(key, F.greatest("level", "_l").alias("level"))
    if found is None:
        return names.select(key, F.lit(None).cast("int").alias("level"), score).where("false")
    ranked = found.join(names.select(key, score), key)
    best = F.broadcast(ranked.agg(F.min("level").alias("_best")))  # one row
    ranked = ranked.crossJoin(best).where((F.col("level") < SPELLING) | (F.col("_best") == SPELLING)).drop("_best")
    return ranked.orderBy("level", F.desc(score), key).limit(limit)


def _fold_text(typed: str) -> list[str]:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", typed.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    return re.split(r"[\W_]+", plain)


def _begins_with(part: str):
    return lambda word: word.startswith(part)


def search_towns(towns: DataFrame, key: str, name: str, typed: str) -> DataFrame:
    """(key, exact) of towns of which words begin with all typed words; three letters at least."""
    parts = [w for w in _fold_text(typed) if w]
    if sum(map(len, parts)) < 3:
        return towns.select(key, F.lit(False).alias("exact")).where("false")
    words = folded_words(F.col(name))
    each = F.lit(True)
    for p in parts:
        each = each & F.exists(words, _begins_with(p))
    return towns.where(each).select(key, (fold(F.col(name)) == " ".join(parts)).alias("exact")).orderBy(F.desc("exact"), key)


def search_lines(lines: DataFrame, key: str, name: str, mode: str, typed: str) -> DataFrame:
    """(key, exact): 2 where the whole name is typed, 1 where its mode and name are, 0 where it begins so."""
    want = "".join(w for w in _fold_text(typed) if w)
    c, with_mode = compact(F.col(name)), F.concat(compact(F.col(mode)), compact(F.col(name)))
    exact = F.when(c == want, 2).when(with_mode == want, 1).when(c.startswith(want) | with_mode.startswith(want), 0)
    return lines.select(key, exact.alias("exact")).where("exact IS NOT NULL").orderBy(F.desc("exact"), key)
