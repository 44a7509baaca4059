"""Names, addresses and keys of a timetable as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the kinds of transport in their order, as answers name them
MODES = ["subway", "tram", "bus", "suburban", "regional", "longdistance", "ferry", "cable", "other"]
# fixed values: letters that addresses write as two or as another
LETTERS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "þ": "th"}


# fixed values: the patterns of names, addresses and keys
BROKEN = r"(\p{L})-[ ]*(?:_|\\n)[ ]*"  # a word broken at a line's end
GAP = r"_|\\[nt]"
OPERATOR_CODE = r"^(?=[A-Za-z]*\d)[A-Za-z\d]{6} +(?=\S)"
PLACE = r"@(-?\d{1,2}(?:\.\d{1,7})?),(-?\d{1,3}(?:\.\d{1,7})?)"
STOP_ADDRESS = rf"^stop/([a-z0-9-]+)(?:/([1-9]\d{{0,2}})|{PLACE})?$"
LINE_ADDRESS = rf"^line/([a-z0-9-]+)/([a-z]+)/([a-z0-9-]+)(?:{PLACE})?$"
TRIP_ADDRESS = r"^trip/([a-z0-9-]+)/([a-z]+)/([a-z0-9-]+)/(\d{4}-\d{2}-\d{2})/((?:[01]\d|2[0-3])[0-5]\d)-([a-z0-9-]+)$"
CHOICE = r"^([a-z]+)/([a-z0-9-]+)(?:~([a-z0-9-]+))?$"
SUBURBAN, LONG_DISTANCE, UNDERGROUND = r"^S\s?\d", r"^(ICE|IC|ECE|EC|RJX|RJ|NJ|EN|TGV|FLX|D)\s?\d", r"^U\s?\d+$"


def _plain() -> tuple[str, str]:
    """Lower-case letters with marks and the letters without, for Latin letters that decompose to one letter."""
    pairs = []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and c == c.lower():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, UNMARKED = _plain()
COMBINING = r"\p{M}+"


def without_marks(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, MARKED, UNMARKED), COMBINING, "")


def tidy_name(c: Column) -> Column:
    """A word broken at a line's end is one word again, with its hyphen before a capital; marks for gaps are spaces."""
    c = F.regexp_replace(c, BROKEN + r"(?=\p{Ll})", "$1")
    c = F.regexp_replace(c, BROKEN + r"(?=\S)", "$1-")
    c = F.regexp_replace(c, GAP, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slug(c: Column) -> Column:
    """A name in an address: small letters, umlauts as two letters, words joined by hyphens, "-" for none."""
    c = F.lower(c)
    for a, b in LETTERS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(F.regexp_replace(without_marks(c), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.when(c == "", F.lit("-")).otherwise(c)


def fold(c: Column) -> Column:
    """Small letters without marks, ss for the sharp s."""
    return without_marks(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def folded_words(c: Column) -> Column:
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def compact(c: Column) -> Column:
    return F.array_join(folded_words(c), "")


def town_to_show(name: Column, town: Column) -> Column:
    """The town unless a word of the name is its first word of more than three letters (its first word if there is none)."""
    words = folded_words(town)
    main = F.coalesce(F.get(F.filter(words, lambda w: F.length(w) > 3), F.lit(0)), F.get(words, F.lit(0)))
    return F.when(F.coalesce(town, F.lit("")) == "", F.lit(None).cast("string")).when(
        F.coalesce(F.array_contains(folded_words(name), main), F.lit(False)), F.lit(None).cast("string")).otherwise(town)


def operator_name(c: Column) -> Column:
    """Without a first word of six letters and digits that holds a digit."""
    return F.regexp_replace(c, OPERATOR_CODE, "")


def agency_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def kind_of(mode: Column) -> Column:
    return F.when(mode.isin(MODES), mode).otherwise(F.lit("other"))


def stop_path(name: Column, number: Column) -> Column:
    return F.concat(F.lit("stop/"), name, F.when(number > 1, F.concat(F.lit("/"), number.cast("string"))).otherwise(F.lit("")))


def stop_path_at(name: Column, lat: Column, lon: Column) -> Column:
    return F.format_string("stop/%s@%.4f,%.4f", slug(name), lat.cast("double"), lon.cast("double"))


def line_path(agency: Column, mode: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("line"), slug(agency), kind_of(mode), slug(name))


def trip_path(agency: Column, mode: Column, name: Column, day: Column, time: Column, start: Column) -> Column:
    return F.concat_ws("/", F.lit("trip"), slug(agency), kind_of(mode), slug(name), day, F.concat(time, F.lit("-"), slug(start)))


def parse_address(c: Column) -> Column:
    """The parts of a stop, line or trip address as a struct; null for any other text."""
    stop, line, trip = STOP_ADDRESS, LINE_ADDRESS, TRIP_ADDRESS

    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))

    def answer(kind: str, **given: Column) -> Column:
        none = F.lit(None).cast("string")
        texts = [given.get(k, none).alias(k) for k in ("name", "agency", "mode", "day", "time", "start")]
        number = given.get("number", none).cast("int").alias("number")
        places = [given.get(k, none).cast("double").alias(k) for k in ("lat", "lon")]
        return F.struct(F.lit(kind).alias("type"), *texts, number, *places)

    def in_range(pattern: str, i: int) -> Column:
        lat, lon = part(pattern, i).cast("double"), part(pattern, i + 1).cast("double")
        return lat.isNull() | ((F.abs(lat) <= 90) & (F.abs(lon) <= 180))

    return (
        F.when(c.rlike(stop), F.when(in_range(stop, 3), answer("stop", name=part(stop, 1), number=part(stop, 2), lat=part(stop, 3), lon=part(stop, 4))))
        .when(c.rlike(trip), F.when(part(trip, 2).isin(MODES), answer(
            "trip", agency=part(trip, 1), mode=part(trip, 2), name=part(trip, 3), day=part(trip, 4), time=part(trip, 5), start=part(trip, 6))))
        .when(c.rlike(line), F.when(part(line, 2).isin(MODES) & in_range(line, 4), answer(
            "line", agency=part(line, 1), mode=part(line, 2), name=part(line, 3), lat=part(line, 4), lon=part(line, 5))))
    )


def route_mode(kind: Column, short: Column) -> Column:
    """The kind of transport of a GTFS route type and a line's short name."""
    name = F.coalesce(short, F.lit(""))
    train = (
        F.when(name.rlike(SUBURBAN), "suburban")
        .when(name.rlike(LONG_DISTANCE), "longdistance").otherwise("regional")
    )
    return (
        F.when(kind == 0, F.when(name.rlike(UNDERGROUND), "subway").otherwise("tram"))
        .when(kind == 1, "subway")
        .when(kind.isin(3, 11) | kind.between(800, 899), "bus")
        .when(kind == 2, train)
        .when((kind == 4) | kind.between(1000, 1099) | kind.between(1200, 1299), "ferry")
        .when(kind.isin(5, 6, 7, 12, 405) | kind.between(1300, 1499), "cable").otherwise("other")
    )


def line_name(short: Column, long: Column) -> Column:
    return F.coalesce(F.nullif(short, F.lit("")), long)


def choice_key(mode: Column, line: Column, following: Column | None = None) -> Column:
    tail = F.lit("") if following is None else F.when(F.coalesce(following, F.lit("")) == "", "").otherwise(F.concat(F.lit("~"), slug(following)))
    return F.concat(mode, F.lit("/"), slug(line), tail)


def read_choice(c: Column, most: int = 64) -> Column:
    """The distinct well-formed keys of a comma-separated text, in order, at most so many."""
    keys = F.transform(F.split(F.lower(c), ","), lambda k: F.trim(k))
    good = F.filter(keys, lambda k: k.rlike(CHOICE) & F.substring_index(k, "/", 1).isin(MODES))
    return F.coalesce(F.slice(F.array_distinct(good), 1, most), F.array().cast("array<string>"))


def in_choice(keys: Column, mode: Column, line: Column, following: Column) -> Column:
    return (F.size(keys) == 0) | F.array_contains(keys, choice_key(mode, line)) | F.array_contains(keys, choice_key(mode, line, following))


def toggled(keys: Column, key: Column, every: Column) -> Column:
    """The chosen keys after a tap on key; every holds all directions of the stop."""
    line = F.substring_index(key, "~", 1)
    split = F.filter(every, lambda k: (k != key) & (F.substring_index(k, "~", 1) == line) & ~F.array_contains(keys, k))
    without = F.flatten(F.transform(keys, lambda k: F.when(k == key, F.array().cast("array<string>")).when(k == line, split).otherwise(F.array(k))))
    return F.when(F.size(keys) == 0, F.array(key)).when(
        ~F.array_contains(keys, key) & ~F.array_contains(keys, line), F.concat(keys, F.array(key))).otherwise(without)


def natural_key(c: Column) -> Column:
    """Sort key under which numbers in names compare as numbers: digits are padded to 12."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 12, "0")).otherwise(r)), "")


def version_numbers(c: Column) -> Column:
    found = F.regexp_extract(c, r"^v?(\d+\.\d+\.\d+)$", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int")))


def is_newer(candidate: Column, current: Column) -> Column:
    return F.coalesce(version_numbers(candidate) > version_numbers(current), F.lit(False))


def short_ip(c: Column) -> Column:
    """IPv4 with its last number 0, IPv6 to its first 48 bits."""
    four = F.regexp_replace(F.regexp_replace(c, r"^::ffff:", ""), r"\.\d+$", ".0")
    six = F.concat(F.array_join(F.slice(F.split(c, ":"), 1, 3), ":"), F.lit("::"))
    return F.when(c.contains("."), four).when(c.contains(":"), six).otherwise(F.lit(""))


def source_of_note(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)(?:source|quelle):\s*(.+)$", 1), F.lit(""))


def tidy_note(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
