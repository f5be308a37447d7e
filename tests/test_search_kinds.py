"""Copies of tracks and candidates are scored once, and no result of any of them is lost."""

import pytest

from strophe import catalogue
from strophe.operators import search

COPIES = 40
#: Even keys find name, brand and type, odd ones name and brand; two sizes within what durations tell apart.
ROWS = [(i, "old gizmo", "brand#1", ("economy", "promo")[i // 2 % 2], 10 + i // 4 % 2) for i in range(8 * COPIES)]


@pytest.fixture
def copies(spark, tmp_path):
    spark.createDataFrame(ROWS, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.fixture
def scored(monkeypatch):
    """How many pairs each call scores."""
    found, score_pairs = [], search.score_pairs
    monkeypatch.setattr(search, "score_pairs", lambda pairs: (found.append(pairs.count()), score_pairs(pairs))[1])
    return found


def test_best_of_copies(spark, copies, scored):
    got = {r.track_id: int(r.id) for r in catalogue.queries()["best_match"](spark, copies).collect()}
    # All candidates of the same type reach the highest level, so the first of them in the catalogue's order is the best.
    first = {kind: min(key for key, _, _, other, _ in ROWS if other == kind) for _, _, _, kind, _ in ROWS}
    assert got == {key: first[kind] for key, _, _, kind, _ in ROWS}
    # Eight kinds of track (title, type, size); at most four kinds of candidate (type, size) for each.
    assert scored and max(scored) <= 8 * 4


def test_scores_of_copies(spark, copies, scored):
    found = catalogue.queries()["track_score"](spark, copies).collect()
    want = {(a, b) for a, _, _, kind, _ in ROWS for b, _, _, other, _ in ROWS if a % 2 or kind == other}
    assert len(found) == len(want) and {(r.track_id, int(r.id)) for r in found} == want
    assert scored and max(scored) <= 8 * 4


def test_places_of_copies(spark, copies):
    tracks, candidates = catalogue._tracks(spark, copies).filter("track_id < 4"), catalogue._catalogue(spark, copies)
    found = search.search(tracks, candidates).select("track_id", "place", "match_value", "cand_no").collect()
    for key in range(4):
        mine = sorted((r.place, -r.match_value, r.cand_no) for r in found if r.track_id == key)
        assert [p for p, _, _ in mine] == [*range(1, len(mine) + 1)]
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
