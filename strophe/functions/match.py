"""Comparison of track metadata: durations, artist lists, names, and the score of a whole track."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions.text import equal_positions, lcs_length, let, single_spaces, to_simplified, trim

# Points of a match, and the levels of a track's score with their bounds.
POINTS = {"Perfect": 7.0, "VeryHigh": 6.0, "High": 5.0, "Medium": 4.0, "Low": 2.0, "NoMatch": 0.0}
LEVELS = [(21.0, "Perfect", 100), (19.0, "VeryHigh", 99), (17.0, "High", 95), (15.0, "PrettyHigh", 90), (11.0, "Medium", 70), (8.0, "Low", 30), (3.0, "VeryLow", 10)]
NO_MATCH = ("NoMatch", -1)
DURATION_BANDS = [(1, "Perfect"), (300, "VeryHigh"), (700, "High"), (1500, "Medium"), (3500, "Low")]
EDITIONS = ("deluxe", "explicit", "special edition", "bonus track", "feat", "with")
LCS_BANDS = [(90.0, "VeryHigh"), (80.0, "High"), (68.0, "Medium"), (55.0, "Low")]


def duration_match(a: Column, b: Column) -> Column:
    """By the difference in milliseconds; null if either is null or 0."""
    diff = F.abs(a.cast("long") - b.cast("long"))
    out = F.lit("NoMatch")
    for bound, label in reversed(DURATION_BANDS):
        out = F.when(diff < bound, label).otherwise(out)
    return F.when((a != 0) & (b != 0), out)


def artist_match(list1: Column, list2: Column) -> Column:
    """By how many of the second list stand in the first; null if either is empty or null. Not symmetric."""
    plain = [F.transform(x, lambda v: to_simplified(F.lower(v))) for x in (list1, list2)]
    return F.when((F.size(list1) > 0) & (F.size(list2) > 0), let(plain[0], lambda a: let(plain[1], lambda b: _artists(a, b))))


def _artists(a: Column, b: Column) -> Column:
    n, m = F.size(a), F.size(b)
    count = F.size(F.filter(b, lambda v: F.array_contains(a, v)))
    first, other = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    one = (n == 1) & (m > 1)
    return (
        F.when((count == n) & (n == m), "Perfect")
        .when((count + 1 >= n) & (n >= 2) | (n > 6) & (count / n > 0.8), "VeryHigh")
        .when((count == 1) & (n == 1) & (m == 2), "High")
        .when((n > 5) & (other.contains("Various") | other.contains("群星")), "VeryHigh")
        .when((n > 7) & (m > 7) & (count / n > 0.66), "High")
        .when(one & first.startswith(other), "High")
        .when(one & (F.char_length(other) > 3) & first.contains(other), "High")
        .when(one & (F.char_length(other) > 1) & first.contains(other), "Medium")
        .when((count == 1) & (n == 1) & (m >= 3), "Medium")
        .when(count >= 2, "Low")
        .otherwise("NoMatch")
    )


def fold_name(c: Column) -> Column:
    """Lower case, simplified script, trimmed."""
    return trim(to_simplified(F.lower(c)))


def normal_name(c: Column) -> Column:
    """A folded name with plain marks and single spaces."""
    for old, new in (("’", "'"), ("，", ","), ("（", " ("), ("）", " )"), ("[", "("), ("]", ")")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.replace(single_spaces(c), F.lit("acoustic version"), F.lit("acoustic"))


def _prefix(c: Column, mark: str) -> Column:
    """What stands before a mark."""
    return trim(F.substring_index(c, mark, 1))


def _either(a: Column, b: Column, rule) -> Column:
    return rule(a, b) | rule(b, a)


def _only_one(mark: str):
    return lambda x, y: x.contains(mark) & ~y.contains(mark) & (_prefix(x, mark) == y)


def _both(left: str, right: str):
    return lambda x, y: x.contains(left) & y.contains(right) & (_prefix(x, left) == _prefix(y, right))


def _any(rules: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, rules)


def name_rules(a: Column, b: Column) -> Column:
    """Match of two normal names by their marks and positions; null where only their common characters can tell."""
    closed = lambda c: F.replace(trim(F.replace(c, F.lit(" - "), F.lit(" ("))), F.lit(" "), F.lit(""))
    n, m = F.char_length(a), F.char_length(b)
    alike = let(equal_positions(a, b) / n, lambda share: (n >= 4) & (share >= 0.8) | n.between(2, 3) & (share >= 0.5))
    return (
        F.when(closed(a) == closed(b), "VeryHigh")
        .when(_any([_either(a, b, _only_one(f"({e}")) for e in EDITIONS]), "VeryHigh")
        .when(_any([_either(a, b, _both(f"({x}", f"({y}")) for x, y in (("feat", "explicit"), ("with", "explicit"), ("feat", "feat"), ("with", "with"))]), "High")
        .when(_either(a, b, _only_one("(")), "Medium")
        .when((n == m) & (n > 0) & alike, "High")
    )


def name_bands(a: Column, b: Column, lcs: Column) -> Column:
    """Match by the share of common characters."""
    share = F.when(a == b, 100.0).otherwise(lcs / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)) * 100)
    out = F.lit("NoMatch")
    for bound, label in reversed(LCS_BANDS):
        out = F.when(share > bound, label).otherwise(out)
    return out


def can_band(a: Column, b: Column) -> Column:
    """Whether the lengths alone leave a chance of the lowest band: their ratio bounds the share of common characters."""
    n, m = F.char_length(a), F.char_length(b)
    return F.least(n, m) * 100 > F.greatest(n, m) * LCS_BANDS[-1][0]


def name_match(name1: Column, name2: Column) -> Column:
    """Match of two names; null if either is null. The common subsequence is computed only where nothing else decides."""

    def normal(a: Column, b: Column) -> Column:
        lcs = F.when(can_band(a, b), lcs_length(a, b)).otherwise(0)
        return F.coalesce(name_rules(a, b), let(lcs, lambda n: name_bands(a, b, n)))

    def folded(f1: Column, f2: Column) -> Column:
        return F.when(f1 == f2, "Perfect").otherwise(let(normal_name(f1), lambda a: let(normal_name(f2), lambda b: normal(a, b))))

    found = let(fold_name(name1), lambda f1: let(fold_name(name2), lambda f2: folded(f1, f2)))
    return F.when(name1.isNotNull() & name2.isNotNull(), found)


def points(label: Column) -> Column:
    """Points of a match; 0 for none."""
    out = F.lit(0.0)
    for name, value in POINTS.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def track_score(title: Column, artist: Column, album: Column, album_artist: Column, duration: Column) -> Column:
    """Weighted points of the five matches; missing album, album artist and duration are made up for by scaling."""
    total = points(title) + points(artist) + points(album) * 0.4 + points(album_artist) * 0.2 + points(duration)
    missing = F.when(album.isNull(), 0.4).otherwise(0.0) + F.when(album_artist.isNull(), 0.2).otherwise(0.0) + F.when(duration.isNull(), 1.0).otherwise(0.0)
    return F.when(missing > 0, total * 30.0 / (30.0 - missing * 7.0)).otherwise(total)


def level(score: Column) -> Column:
    """Name of a score's level."""
    out = F.lit(NO_MATCH[0])
    for bound, name, _ in reversed(LEVELS):
        out = F.when(score > bound, name).otherwise(out)
    return out


def level_value(score: Column) -> Column:
    """Level as a number, for ordering."""
    out = F.lit(NO_MATCH[1])
    for bound, _, value in reversed(LEVELS):
        out = F.when(score > bound, value).otherwise(out)
    return out
