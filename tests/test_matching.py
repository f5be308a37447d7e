"""Name pairs and track scores against brute force."""

import pytest

from strophe import catalogue

BANDS = ((90, "VeryHigh"), (80, "High"), (68, "Medium"), (55, "Low"))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def share(a, b):
    return 100 if a == b else lcs(a, b) * 100 / max(len(a), len(b), 1)


def name_match(a, b):
    """For names in small letters of which at most one has a bracket, that of (feat."""
    if a == b:
        return "Perfect"
    if a.replace(" ", "") == b.replace(" ", ""):
        return "VeryHigh"
    for x, y in ((a, b), (b, a)):
        if "(feat" in x and "(" not in y and x.partition("(feat")[0].strip() == y:
            return "VeryHigh"
    if len(a) == len(b):
        same = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
        if len(a) >= 4 and same >= 0.8 or 2 <= len(a) <= 3 and same >= 0.5:
            return "High"
    return next((label for bound, label in BANDS if share(a, b) > bound), "NoMatch")


NAMES = ["old gizmo", "cold gizmo", "old widget", "cold widget", "small ring", "smallring", "red bolt", "red bold", "ab", "ac", "x"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Two brands and two types of each name; sizes differ within what durations tell apart."""
    rows = [(i, name, f"brand#{i % 2}", ("economy", "economic", "promo")[i % 3], 10 + i % 5) for i, name in enumerate(NAMES * 6)]
    where = tmp_path_factory.mktemp("parts")
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{where}/part.parquet")
    return str(where), rows


def test_all_name_pairs(spark, parts):
    where, _ = parts
    got = {(r.a, r.b): r.label for r in catalogue.queries()["name_match"](spark, where).collect()}
    assert got == {(a, b): name_match(a, b) for a in NAMES for b in NAMES}
    got = {(r.a, r.b): round(r.similarity, 6) for r in catalogue.queries()["text_similarity"](spark, where).collect()}
    assert got == {(a, b): round(share(a, b), 6) for a in NAMES for b in NAMES}
    assert got["old gizmo", "cold gizmo"] == 90


POINTS = {"Perfect": 7, "VeryHigh": 6, "High": 5, "Medium": 4, "Low": 2, "NoMatch": 0}


def duration(a, b):
    bands = ((1, "Perfect"), (300, "VeryHigh"), (700, "High"), (1500, "Medium"), (3500, "Low"))
    return next((label for bound, label in bands if abs(a - b) < bound), "NoMatch")


def track_scores(rows):
    """Odd keys have (feat. x) in their titles, so they are found at level 1, by title and brand, among all types."""
    out = {}
    for key, name, brand, kind, size in rows:
        for other, name2, brand2, kind2, size2 in rows:
            if (name, brand) != (name2, brand2) or key % 2 == 0 and kind != kind2:
                continue
            title = name + (" (feat. x)" if key % 2 else "")
            marks = name_match(title, name2), "Perfect", duration(size * 100, size2 * 100)
            total = sum(POINTS[m] for m in marks) + 0.4 * POINTS[name_match(kind.lower(), kind2.lower())]
            out[key, str(other)] = (key % 2, round(total * 30 / (30 - 0.2 * 7), 6))
    return out


@pytest.mark.parametrize("where", ["fixture", "generated"])
def test_all_track_scores(spark, parts, where):
    sf_dir, rows = parts
    if where == "generated":
        sf_dir = "/root/testdata/sf0.001"
        rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").collect()]
    found = catalogue.queries()["track_score"](spark, sf_dir).collect()
    got = {(r.track_id, r.id): (r.level, round(r.score, 6)) for r in found}
    want = track_scores(rows)
    assert len(found) == len(got) and got == want
    assert len(want) > catalogue.queries()["track_score"](spark, sf_dir).count()
