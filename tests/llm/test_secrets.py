import pytest

from strophe.llm import secrets

FOUND = [
    ("export API_KEY=9fK2xQ7LmZ4tVb8RwY3nHs6DpJ1c", "9fK2xQ7LmZ4tVb8RwY3nHs6DpJ1c", "export API_KEY="),
    ('password = "Tr0ub4dor&3x"', "Tr0ub4dor&3x", 'password = "'),
    ("secret: correcthorsebatterystaple", "correcthorsebatterystaple", "secret: "),
    ("see aGVsbG8gd29ybGQx==", "aGVsbG8gd29ybGQx==", "see "),
    ("commit 3f786850e387550fdab836ed7e6dc881de23001b merged", "3f786850e387550fdab836ed7e6dc881de23001b", "commit "),
]


def test_candidates(spark):
    docs = spark.createDataFrame([(i, line, ".env") for i, (line, *_) in enumerate(FOUND)], "doc_id long, text string, source string")
    got = {(r.doc_id, r.candidate, r.left, r.start) for r in secrets.candidates(docs).collect()}
    assert got == {(i, c, left, len(left) + 1) for i, (_, c, left) in enumerate(FOUND)}


def test_ordinary_secrets_are_scored_as_such(spark):
    lines = [line for line, *_ in FOUND[:3]] + ["password = None", "token: string"]
    docs = spark.createDataFrame([(i, line, ".env") for i, line in enumerate(lines)], "doc_id long, text string, source string")
    got = {r.doc_id: r.is_secret for r in secrets.scan(docs).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False}
