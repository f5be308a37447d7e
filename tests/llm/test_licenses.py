import random
import re

import pytest

from strophe.llm import license_scan
from tests.llm.conftest import words

PUNCTUATION = ["", ",", ".", ";", " -"]


def planted():
    """Whole, cut and altered notices at all places of a window, between words that stand in no template."""
    rng, texts = random.Random(11), [None, "", " \n", "License", "the MIT License"]
    for _, _, notice in license_scan.TEMPLATES:
        plain = notice.split()
        altered = [w.upper() + rng.choice(PUNCTUATION) for w in plain]
        changed = plain.copy()
        changed[len(plain) // 2] = "other"
        for part in (plain, altered, changed, plain[1:], plain[:-1], plain[: len(plain) // 2]):
            before = words(rng, rng.randrange(150))
            texts.append(" ".join(before + part + words(rng, rng.randrange(70))))
    both = " ".join(notice for _, _, notice in license_scan.TEMPLATES)
    return list(enumerate(texts + [both, both + "\n" + both, " ".join(words(rng, 20_000, 5000)) + " " + both]))


def grams(w):
    return {tuple(w[i : i + license_scan.SHINGLE]) for i in range(len(w) - license_scan.SHINGLE + 1)}


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (text or "").lower())


def brute(docs):
    """Every window of every text against every template."""
    out = set()
    for doc_id, text in docs:
        w = tokens(text)
        for template_id, license_, notice in license_scan.TEMPLATES:
            size, ts = license_scan.class_of(len(tokens(notice))), grams(tokens(notice))
            shares = [(len(ts & grams(w[at : at + 2 * size])) / len(ts), -(at + 1)) for at in range(0, len(w), size)]
            share, at = max(shares, default=(0, 0))
            if share >= license_scan.CONTAINMENT:
                out.add((doc_id, template_id, license_, share, -at))
    return out


def test_scan_equals_brute_force(spark):
    docs = planted()
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), license_scan.templates(spark))
    rows = [tuple(r) for r in got.select("doc_id", "template_id", "license", "containment", "first_word").collect()]
    want = brute(docs)
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {t for _, t, *_ in want} == {t for t, *_ in license_scan.TEMPLATES}


def test_short_templates_are_refused(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    short = spark.createDataFrame([("a", "A", "four words are few")], "template_id string, license string, text string")
    with pytest.raises(ValueError, match="under 5 words"):
        license_scan.scan(docs, short)
