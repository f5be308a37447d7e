"""Search of tracks in catalogues: query texts, candidates by level, scoring and the best result.

A catalogue is a table of candidates with the query text each was found by (captured answers of a provider, or a
catalogue of one's own with a blocking key), so searching is a join on that text, not a cross join: the pairs to score
are those that share a query. Each level of refinement is such a join; the first level with answers counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import match
from strophe.functions.text import trim


def search_text(title: Column, artist: Column, album: Column) -> Column:
    """Title, artist and album; missing ones leave their spaces inside."""
    names = [F.coalesce(title, F.lit("")), F.replace(F.coalesce(artist, F.lit("")), F.lit(", "), F.lit(" ")), F.coalesce(album, F.lit(""))]
    return trim(F.replace(F.concat(names[0], F.lit(" "), names[1], F.lit(" "), names[2]), F.lit(" - "), F.lit(" ")))


def strip_feat(title: Column) -> Column:
    """A title up to (feat. and then up to - feat."""
    first = F.when(title.contains("(feat."), trim(F.substring_index(title, "(feat.", 1))).otherwise(title)
    return F.when(first.contains(" - feat."), trim(F.substring_index(first, " - feat.", 1))).otherwise(first)


def refinements(title: Column, artist: Column) -> Column:
    """Two wider queries: stripped title with the artist, and alone."""
    t = strip_feat(F.coalesce(title, F.lit("")))
    a = F.replace(F.coalesce(artist, F.lit("")), F.lit(", "), F.lit(" "))
    clean = lambda c: trim(F.replace(c, F.lit(" - "), F.lit(" ")))
    return F.array(clean(F.concat(t, F.lit(" "), a)), clean(t))


def queries_of(tracks: DataFrame) -> DataFrame:
    """(track_id, level, query): the search text and its refinements; a refinement that repeats the query before it
    ends the list. ``tracks``: track_id, title, artist, album."""
    rows = tracks.select("track_id", F.concat(F.array(search_text(F.col("title"), F.col("artist"), F.col("album"))), refinements(F.col("title"), F.col("artist"))).alias("q"))
    more = F.expr("CASE WHEN q[1] = q[0] THEN slice(q, 1, 1) WHEN q[2] = q[1] THEN slice(q, 1, 2) ELSE q END")
    return rows.select("track_id", F.posexplode(more).alias("level", "query"))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of a track (t_ columns) and a candidate (c_ columns) with their score, level and its value."""
    col = F.col
    out = pairs.withColumns(
        {
            "title_match": match.name_match(col("t_title"), col("c_title")),
            "artist_match": match.artist_match(col("t_artists"), col("c_artists")),
            "album_match": match.name_match(col("t_album"), col("c_album")),
            "album_artist_match": match.artist_match(col("t_album_artists"), col("c_album_artists")),
            "duration_match": match.duration_match(col("t_duration_ms"), col("c_duration_ms")),
        }
    )
    score = match.track_score(col("title_match"), col("artist_match"), col("album_match"), col("album_artist_match"), col("duration_match"))
    return out.withColumn("score", score).withColumns({"match": match.level(col("score")), "match_value": match.level_value(col("score"))})


_TRACK = ("title", "artists", "album", "album_artists", "duration_ms")
_POINTS = ("title_match", "artist_match", "album_match", "album_artist_match", "duration_match", "score", "match", "match_value")


def _kind(query: str, prefix: str) -> Column:
    """128 bits of a query and the values that are compared: rows that are equal in them are scored once."""
    return F.unhex(F.md5(F.to_json(F.struct(query, *[f"{prefix}_{c}" for c in _TRACK]))))


def _by_kind(tracks: DataFrame, catalogue: DataFrame, full_search: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks with the queries whose answers count (t_kind), scored pairs of kinds (t_kind, c_kind), and candidates (c_kind).

    Copies of a track or of a candidate are of one kind, so the pairs of kinds grow with what differs, not with the rows."""
    asked = queries_of(tracks).join(catalogue.select("query").distinct(), "query")
    first = F.min("level").over(Window.partitionBy("track_id"))
    asked = asked.withColumn("first", first).filter((F.col("level") == F.col("first")) | (F.lit(full_search) & (F.col("first") > 0)))
    t = asked.join(tracks.select("track_id", *[F.col(c).alias(f"t_{c}") for c in _TRACK]), "track_id").withColumn("t_kind", _kind("query", "t"))
    c = catalogue.select("query", "cand_no", "id", *[F.col(c).alias(f"c_{c}") for c in _TRACK]).withColumn("c_kind", _kind("query", "c"))
    kinds = [x.select("query", k, *[f"{k[0]}_{f}" for f in _TRACK]).dropDuplicates([k]) for x, k in ((t, "t_kind"), (c, "c_kind"))]
    return t, score_pairs(kinds[0].join(kinds[1], "query")).select("t_kind", "c_kind", *_POINTS), c.drop("query")


def _placed(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("track_id").orderBy(F.desc("match_value"), "level", "cand_no")
    return found.drop("t_kind", "c_kind").withColumn("place", F.row_number().over(order))


def search(tracks: DataFrame, catalogue: DataFrame, full_search: bool = False) -> DataFrame:
    """All results of each track, scored, with their ``place`` in it.

    ``tracks``: track_id, title, artist, album, artists, album_artists, duration_ms. ``catalogue``: query, cand_no, id,
    title, artists, album, album_artists, duration_ms. Without ``full_search`` only the first level with answers
    counts; else, if the first has none, all do. Results stand by match, then level, then the catalogue's order.
    """
    t, pairs, c = _by_kind(tracks, catalogue, full_search)
    return _placed(t.join(pairs, "t_kind").join(c, "c_kind"))


def best(tracks: DataFrame, catalogue: DataFrame, minimum: int | None = None) -> DataFrame:
    """The best result of each track that has one, of at least a level's value: each kind of track takes the first of the
    best kind's candidates."""
    t, pairs, c = _by_kind(tracks, catalogue, False)
    heads = c.groupBy("c_kind").agg(F.min_by(F.struct(*[x for x in c.columns if x != "c_kind"]), F.struct("cand_no", "id")).alias("head")).select("c_kind", "head.*")
    order = Window.partitionBy("t_kind").orderBy(F.desc("match_value"), "cand_no")
    top = pairs.join(heads, "c_kind").withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
    top = _placed(t.join(top, "t_kind")).filter("place = 1")
    return top if minimum is None else top.filter(F.col("match_value") >= minimum)
