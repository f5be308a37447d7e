"""Secret scans with a random forest against false positives.

DataFrame functions only. Candidates are runs of 16 or more token characters with a digit in them (what stands before
the = of KEY=value is no part of it), and beside the name of a credential, values of four or more characters of any
kind; which of them are secrets is left to the forest. For each one, with
its line, 40 characters on either side and the path of its document, features are built by expressions: length,
character transitions (changes of class, common letter pairs, share of distinct characters and digits), dictionary
coverage (share of characters inside common identifier words), path (test and documentation folders, a place inside a
path or address) and neighbouring words (names of credentials, assignments and quotes, placeholders, words for hashes).
A random forest trained from labelled findings (a table: candidate, left, right, path, label) scores them, on the JVM.

Without a table of labelled findings, ``labelled_findings`` makes a balanced one by rule: lines of text, of which
``candidates`` extracts the findings as it does in a scan. Training rows are bounded by
``MAX_FINDINGS``; scanning and scoring see all texts. No shuffle: a document's findings are made where its text is.

Defined results: null and empty texts have no candidates; a null path is no path; repeated rows report their own
findings; lines are counted from 0, places in a line from 1; control characters U+0001 and U+0002 count as spaces.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import table

MIN_LENGTH = 16
#: Labelled findings used for training, at most.
MAX_FINDINGS = 20_000
TREES, DEPTH, SEED = 24, 7, 11
THRESHOLD = 0.5
CONTEXT = 40


# Words of identifiers, common letter pairs, names of credentials and of what only looks like one.
DICTIONARY = (
    "account action address admin agent alpha array author basic batch block board body buffer build button cache call card channel check child class client"
    " code color column command common config content context control count create current data date default delete device document domain element email entry"
    " error event example field file filter first font format frame function gateway global group handler hash header height host icon image index input item"
    " label language level license line link list local location login main manager master message method model module name network node number object option"
    " order output package page param parent password path point port post process product project property query queue random range read record region release"
    " report request resource response result root route sample schema score screen script search second section server service session size source stage start"
    " state status step stream string style system table target task temp test text theme thread time title type update upload user value vector version view"
    " widget width window word write"
).split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
NAMES = "token|key|secret|passw(?:or)?d|passwd|pwd|auth|authorization|bearer|credentials?|access|api|private|signature"
PLACEHOLDERS = "example|dummy|sample|fake|placeholder|changeme|your|xxx+|todo|redacted|test"
#: A run of token characters, from its start or from behind a leading name and =.
_TOKEN = r"A-Za-z0-9_+/=.\-"
_KEY = r"[A-Za-z_.\-][A-Za-z0-9_.\-]{0,63}="
_RUN = rf"(?:(?<![{_TOKEN}])(?!{_KEY}[^=\s\"'])|(?<==)(?<=(?<![{_TOKEN}]){_KEY}))(?=[A-Za-z_+/=.\-]*[0-9])[{_TOKEN}]{{{MIN_LENGTH},}}"
#: A value beside the name of a credential, in quotes or not; the first look back is there for speed.
_BESIDE = rf"(?<=(?i:{NAMES})[\"'\])]{{0,2}}\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}"
_VALUE = rf"(?<=[:=>]\s{{0,3}}[\"'`])(?<=[\"'`]){_BESIDE}[\"'`])[^\s\"'`]{{4,}}(?=[\"'`])|(?<=[:=>]\s{{0,3}}){_BESIDE})(?<![^\s:=>])[A-Za-z0-9_+/.\-!@#$%^*~?&][A-Za-z0-9_+/=.\-!@#$%^*~?&]{{3,}}"
CANDIDATE = rf"(?:{_VALUE}|{_RUN})"
HASHES = "sha|sha1|sha256|md5|commit|checksum|digest|hash|integrity|uuid|guid|version|revision|rev|id|phone|card|order|etag"
_KEYWORDS = "None null true false string undefined required optional default self.value getenv input() config.get".split()
_WORDS = "correct horse battery staple purple monkey river cloud silver tiger garden winter copper falcon orange bridge".split()
TEST_PATHS = r"(?:^|[/._-])(?:tests?|specs?|fixtures?|mocks?|examples?|samples?|docs?|readme|vendor|node_modules|snapshots?|lock)(?:[/._-]|$)"

FEATURES = (
    "f_length f_changes f_pairs f_distinct f_digits f_upper f_hex f_numeric f_dictionary f_test_path f_in_path f_slashes f_named f_assigned f_quoted f_placeholder f_hash_word"
).split()


def candidates(docs: DataFrame, text: str = "text", path: str | None = "source", doc: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, start, candidate, left, right, path) for each candidate."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    lines = (
        docs.select(F.col(doc).alias("doc_id"), where.alias("path"), F.col(text).alias("t"))
        .filter(F.col("t").rlike(CANDIDATE))
        .select("doc_id", "path", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line"))
        .filter(F.col("line").rlike(CANDIDATE))
        .select("doc_id", "path", "line_no", F.translate("line", "\u0001\u0002", "  ").alias("line"))
    )
    parts = lines.withColumn("p", F.split(F.regexp_replace("line", f"({CANDIDATE})", "\u0001$1\u0002"), "\u0001", -1))
    found = F.expr(
        f"""transform(sequence(1, size(p) - 1), i -> struct(
            substring_index(p[i], '\u0002', 1) AS candidate,
            right(IF(i = 1, p[0], translate(p[i - 1], '\u0002', '')), {CONTEXT}) AS left,
            left(substring_index(p[i], '\u0002', -1), {CONTEXT}) AS right,
            aggregate(slice(p, 1, i), 1, (n, x) -> n + length(translate(x, '\u0002', ''))) AS start))"""
    )
    return parts.select("doc_id", "path", "line_no", F.explode(found).alias("x")).select("doc_id", "line_no", "x.start", "x.candidate", "x.left", "x.right", "path")


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern).cast("double")


def features(found: DataFrame) -> DataFrame:
    """Candidates with their FEATURES columns."""
    c, left, right = F.col("candidate"), F.lower("left"), F.lower("right")
    low, n = F.lower("candidate"), F.char_length("candidate").cast("double")
    changes = r"(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^0-9A-Za-z])(?=[0-9A-Za-z])"
    known = "(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    cols = {
        "f_length": n,
        "f_changes": F.regexp_count(c, F.lit(changes)) / n,
        "f_pairs": F.regexp_count(low, F.lit("(?=" + "|".join(PAIRS) + ")")) / n,
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_digits": F.regexp_count(c, F.lit("[0-9]")) / n,
        "f_upper": F.regexp_count(c, F.lit("[A-Z]")) / n,
        "f_hex": _has(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "f_numeric": _has(c, "^[0-9.+/-]+$"),
        "f_dictionary": 1 - F.char_length(F.regexp_replace(low, known, "")) / n,
        "f_test_path": _has(F.lower("path"), TEST_PATHS),
        "f_in_path": _has(left, r"(?:/|://[^\s]*|\\)$"),
        "f_slashes": F.regexp_count(c, F.lit("/")).cast("double"),
        "f_named": _has(left, rf"(?:{NAMES})[\s\"'\])]*(?:[:=]+>?|is|->)?[\s\"'(\[]*$"),
        "f_assigned": _has(left, r"[:=]>?\s*[\"'(]?$"),
        "f_quoted": (_has(left, "[\"'`]$") + _has(right, "^[\"'`]")),
        "f_placeholder": F.greatest(_has(low, f"(?:{PLACEHOLDERS})"), _has(left, rf"\b(?:{PLACEHOLDERS})\b"), _has(right, rf"\b(?:{PLACEHOLDERS})\b")),
        "f_hash_word": _has(left, rf"(?:^|[^a-z])(?:{HASHES})[\s\"'\])]*(?:[:=]+>?|is|of|-)?[\s\"'(\[]*$"),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in cols.items()})


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Findings made by rule, half of them secrets: random tokens beside the names of credentials, against hashes,
    numbers, identifiers, paths, placeholders and tokens without a telling neighbour."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[=+/]", "k")
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    size = (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(29)) + 20).cast("int")
    name = pick(["token", "api_key", "secret", "password", "auth", "access_key", "Bearer", "private_key", "TOKEN", "SECRET_KEY", "client_secret"], 2)
    sep = pick([" = \"", "=", ": ", ": \"", "=\"", " := '", " "], 3)
    code = pick(["src/app.py", "config/prod.yml", ".env", "src3", "deploy.sh", "", "web/main.js", "src0"], 4)
    kind = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(8))
    joint = pick(["_", ".", "-"], 6)
    words = F.concat(pick(DICTIONARY, 7), joint, pick(DICTIONARY, 8), joint, pick(DICTIONARY, 9), joint, F.pmod("id", F.lit(97)).cast("string"))
    digits = F.substring(F.regexp_replace(F.conv(F.substring(h, 1, 15), 16, 10), "^", "4"), 1, 16)
    prose = pick(["the and there ", "was it on ", "number ", "see ", "call ", "in ", ". "], 10)
    # Beside names: passwords of letters, marks and digits or of several words, against keywords and identifiers.
    letters = F.regexp_replace(b64, "[0-9]", "")
    password = F.when(F.pmod("id", F.lit(3)) == 0, F.concat(pick(_WORDS, 14), pick(_WORDS, 15), pick(_WORDS, 16), pick(_WORDS, 17))).otherwise(
        F.concat(F.substring(letters, 1, 3), F.substring(h, 1, 3), pick(["&", "!", "#", "_", "9", "@"], 18), F.substring(h, 5, 2), F.substring(letters, 5, 3))
    )
    plain = F.when(F.pmod("id", F.lit(3)) == 0, pick(_KEYWORDS, 19)).when(F.pmod("id", F.lit(3)) == 1, pick(DICTIONARY, 20)).otherwise(F.concat(pick(DICTIONARY, 21), pick(["_", ".", ""], 22), pick(DICTIONARY, 23)))
    near_sep = pick([" = \"", "=", ": ", ": \"", "=\""], 3)
    short = F.pmod(F.xxhash64("id", F.lit(24)), F.lit(4)) == 0
    token = F.when(F.pmod("id", F.lit(4)) < 2, F.substring(h, 1, 40)).when(F.pmod("id", F.lit(4)) == 2, F.substring(b64, 1, size)).otherwise(F.upper(F.substring(h, 1, size)))
    bad = (
        F.when(kind == 0, F.struct(F.substring(h, 1, 40).alias("candidate"), pick(["commit ", "sha1: ", "checksum = \"", "md5 ", "revision "], 11).alias("left"), code.alias("path")))
        .when(kind == 1, F.struct(digits.alias("candidate"), prose.alias("left"), code.alias("path")))
        .when(kind == 2, F.struct(words.alias("candidate"), F.concat(name, F.lit(" = ")).alias("left"), code.alias("path")))
        .when(kind == 3, F.struct(F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 13, 3), F.lit("-"), F.substring(h, 17, 12)).alias("candidate"), pick(["uuid: ", "id=", "guid ", "item "], 12).alias("left"), code.alias("path")))
        .when(kind == 4, F.struct(F.concat(words, F.lit("/"), F.substring(h, 1, 12)).alias("candidate"), F.lit("https://example.org/").alias("left"), code.alias("path")))
        .when(kind == 5, F.struct(F.concat(F.lit("your-"), words).alias("candidate"), F.concat(name, sep).alias("left"), F.lit("docs/readme.md").alias("path")))
        .when(kind == 6, F.struct(token.alias("candidate"), F.concat(name, sep).alias("left"), pick(["tests/test_auth.py", "spec/fixtures/a.json", "examples/demo.py"], 13).alias("path")))
        .otherwise(F.struct(words.alias("candidate"), prose.alias("left"), code.alias("path")))
    )
    near_name = pick(["password", "secret", "token", "api_key", "PASSWORD", "client_secret", "db_password"], 2)
    bad = F.when(short, F.struct(plain.alias("candidate"), F.concat(prose, near_name, near_sep).alias("left"), code.alias("path"))).otherwise(bad)
    good = F.struct(token.alias("candidate"), F.concat(prose, name, sep).alias("left"), code.alias("path"))
    good = F.when(short, F.struct(password.alias("candidate"), F.concat(prose, near_name, near_sep).alias("left"), code.alias("path"))).otherwise(good)
    quote = F.when(F.col("x.left").endswith('"'), '"').when(F.col("x.left").endswith("'"), "'").otherwise("")
    rows = spark.range(min(n, MAX_FINDINGS), numPartitions=1).select("id", F.when(F.pmod("id", F.lit(2)) == 0, good).otherwise(bad).alias("x"))
    line = F.concat("x.left", "x.candidate", quote, F.lit(" and then"))
    label = F.struct((F.pmod("id", F.lit(2)) == 0).cast("double").alias("label"), F.char_length("x.left").alias("at"), F.char_length("x.candidate").alias("n"))
    found = candidates(rows.select(label.alias("doc_id"), line.alias("text"), F.col("x.path").alias("source")))
    planted = (F.col("start") > F.col("doc_id.at")) & (F.col("start") <= F.col("doc_id.at") + F.col("doc_id.n"))
    return found.filter(planted).select("candidate", "left", "right", "path", "doc_id.label")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """The forest over at most MAX_FINDINGS labelled findings; in one partition, so that it is the same each time."""
    # Which of more findings are taken is fixed by their content.
    taken = findings.orderBy(F.xxhash64("candidate", "left", "right", "path"), "candidate", "left", "right", "path", "label").limit(MAX_FINDINGS)
    rows = features(taken.coalesce(1)).select(*FEATURES, "label")
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=4, featureSubsetStrategy="0.5").fit(assembled)


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", path: str | None = "source", doc: str = "doc_id") -> DataFrame:
    """All candidates with their score and ``is_secret``."""
    forest = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, text, path, doc)))
    scored = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "line_no", "start", "candidate", "left", "right", "path", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return scan(docs).select("doc_id", "line_no", "start", F.char_length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
