"""Planted secrets and look-alikes that were written without the rules of the training findings: precision and recall."""

import random
import string

from strophe.llm import secrets

RNG = random.Random(9)
B62 = string.ascii_letters + string.digits


def draw(chars, n):
    return "".join(RNG.choice(chars) for _ in range(n))


SECRETS = [
    lambda: f'AWS_SECRET_ACCESS_KEY={draw(B62 + "+/", 40)}',
    lambda: f"export GITHUB_TOKEN=ghp_{draw(B62, 36)}",
    lambda: f'    "api_key": "{draw(B62, 32)}",',
    lambda: f"password: '{draw(string.ascii_lowercase, 4)}{draw('!@#&', 1)}{draw(string.digits, 3)}{draw(string.ascii_uppercase, 3)}'",
    lambda: f"Authorization: Bearer {draw(B62 + '-_', 48)}",
    lambda: f'client_secret = "{draw("0123456789abcdef", 40)}"',
    lambda: f"db_password = \"{RNG.choice(['orange', 'silver', 'tiger'])}{RNG.choice(['horse', 'river', 'cloud'])}{RNG.choice(['bridge', 'garden'])}\"",
]
OTHERS = [
    lambda: f"commit {draw('0123456789abcdef', 40)} merged into main",
    lambda: f"sha256: {draw('0123456789abcdef', 64)}",
    lambda: f"order number 4{draw(string.digits, 15)} was shipped",
    lambda: f"uuid = {draw('0123456789abcdef', 8)}-{draw('0123456789abcdef', 4)}-4{draw('0123456789abcdef', 3)}-a{draw('0123456789abcdef', 3)}-{draw('0123456789abcdef', 12)}",
    lambda: f"see https://example.org/user-account-profile/{draw(string.digits, 8)}/index.html for it",
    lambda: "password = undefined",
    lambda: "token: null",
    lambda: f"the value of max_buffer_size_{draw(string.digits, 2)} is set there",
]


def test_planted_secrets_and_look_alikes(spark):
    lines, truth = [], {}
    for i in range(700):
        is_secret = i % 2 == 0
        kinds = SECRETS if is_secret else OTHERS
        lines.append((i, f"some words before it\n{kinds[(i // 2) % len(kinds)]()}\nand after", RNG.choice(["src/app.py", "conf/site.yml", "src3", ""])))
        truth[i] = is_secret
    docs = spark.createDataFrame(lines, "doc_id long, text string, source string")
    found = {r.doc_id for r in secrets.scan(docs).filter("is_secret").select("doc_id").distinct().collect()}
    hit = sum(truth[i] for i in found)
    assert hit / len(found) >= 0.9
    assert hit / sum(truth.values()) >= 0.9


def test_names_path_and_test_folders_matter(spark):
    token = "9fK2xQ7LmZ4tVb8RwY3nHs6DpJ1c"
    docs = [(1, f'api_key = "{token}"', "src/config.py"), (2, f"page {token} of the list", "src/config.py"), (3, f'api_key = "{token}"', "tests/fixtures/config.py")]
    score = {r.doc_id: r.score for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert score[1] > score[2] and score[1] > score[3]


def test_very_long_line(spark):
    text = "word " * 400_000 + 'secret = "q8W3e7R2t6Y1u5I9o4P0"' + " word" * 400_000
    rows = secrets.scan(spark.createDataFrame([(1, text, "a"), (1, text, "a")], "doc_id long, text string, source string")).collect()
    assert [(r.candidate, r.start, r.is_secret) for r in rows] == [("q8W3e7R2t6Y1u5I9o4P0", 5 * 400_000 + 11, True)] * 2
