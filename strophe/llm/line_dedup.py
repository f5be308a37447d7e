"""Line dedup by distinct-site spread.

DataFrame functions only. Every line that has words is hashed to 128 bits; HyperLogLog sketches of the sites of a
line merge by aggregation (partially before the shuffle, so a line that holds a third of all rows travels as one
sketch per task). Lines whose estimate is clearly over ``min_sites`` are boilerplate, clearly under it they are not;
lines within ``NEAR`` of the threshold get an exact distinct count. Of a boilerplate line the first occurrence of the
corpus (lowest doc_id, then line number) stays, so no text leaves the corpus altogether; all others are removed.

A line is what stands between line feeds, compared without the white space at its ends. The spread of every line that
is not blank is counted, however short it is and whatever its script.

Defined results: a null text stays null and has no lines; an empty text has one empty line, which stays; a null site
counts as one site of its own; rows equal in doc_id, site and text are one document read several times and are cut
alike, so a first occurrence stays in each of them; rows that share a doc_id only are told apart by their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import content_key, discard, stored, table

MIN_SITES = 5
#: lgK of the sketches: relative standard error about 1.04 / sqrt(2 ** LG_K) = 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold (six standard errors) are counted exactly.
NEAR = 0.1

_EDGE = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"


def _lines(base: DataFrame) -> DataFrame:
    """Hashes of the lines that may be boilerplate, with their place."""
    line = F.regexp_replace(F.col("l"), _EDGE, "")
    return (
        base.select("rid", F.coalesce(F.col("site").cast("string"), F.lit("\u0000")).alias("site"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "l"))
        .select("rid", "site", "doc_id", "line_no", line.alias("l"))
        .filter(F.col("l") != "")
        .select("rid", "site", "doc_id", "line_no", F.xxhash64("l").alias("h1"), F.xxhash64(F.lit(7), F.col("l")).alias("h2"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites, with their first occurrence."""
    first = F.min(F.struct("doc_id", "rid", "line_no")).alias("first")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("site").alias("a"), F.max("site").alias("z"), first)
    # One site (nearly all lines) needs no estimate.
    spread = spread.filter(F.col("a") != F.col("z")).withColumn("n", F.hll_sketch_estimate("sketch"))
    low, high = min_sites * (1 - near), min_sites * (1 + near)
    spread = stored(spread.filter(F.col("n") >= int(low)).select("h1", "h2", "n", "first"), "line-spread")
    sure = spread.filter(F.col("n") > high)
    unsure = spread.filter(F.col("n") <= high)
    exact = (
        lines.join(unsure.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2")
        .agg(F.countDistinct("site").alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    found = stored(sure.select("h1", "h2", "first").unionByName(unsure.join(exact, ["h1", "h2"]).select("h1", "h2", "first")), "line-bad")
    discard(spread)
    return found


def cut(docs: DataFrame, site: str = "source", text: str = "text", doc: str = "doc_id", min_sites: int = MIN_SITES) -> DataFrame:
    """(row, clean, n_lines, n_removed): each row of ``docs`` as a struct, its text without removed lines, and counts.

    The order of what stays is kept. A document whose lines all go ends with an empty text.
    """
    key = content_key(*[F.col(f"`{c}`") for c in (doc, site, text)])
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{site}`").alias("site"), key.alias("rid"))
    # Lines are split and hashed once; what follows reads the stored hashes.
    lines = stored(_lines(base), "line-hashes")
    bad = boilerplate(lines, min_sites)
    first = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.rid") == F.col("rid")) & (F.col("first.line_no") == F.col("line_no"))
    gone = lines.join(bad.hint("merge"), ["h1", "h2"]).filter(~first).groupBy("rid").agg(F.collect_set("line_no").alias("gone"))
    gone = stored(gone, "line-gone")
    discard(lines, bad)
    # Both tables grow with the corpus: they are merged at every size, never broadcast.
    rest = F.array_join(F.expr("filter(split(text, '\\n', -1), (l, k) -> NOT array_contains(gone, k))"), "\n")
    return base.join(gone.hint("merge"), "rid", "left").select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("clean"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup(docs: DataFrame, site: str = "source", text: str = "text", doc: str = "doc_id", min_sites: int = MIN_SITES, out: str = "clean") -> DataFrame:
    """``docs`` with ``clean`` (the text without removed lines), ``n_lines`` and ``n_removed``, in place of columns of
    those names."""
    own = [c for c in docs.columns if c not in (out, "n_lines", "n_removed")]
    return cut(docs, site, text, doc, min_sites).select(*[F.col(f"row.`{c}`") for c in own], F.col("clean").alias(out), "n_lines", "n_removed")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", _sha(F.col("clean")).alias("clean_sha256"), F.char_length("clean").cast("long").alias("clean_chars"))


def _sha(c: Column) -> Column:
    return F.sha2(c, 256)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text,
         md5(concat_ws(chr(1), coalesce(CAST(doc_id AS VARCHAR), chr(2)), coalesce(source, chr(2)), coalesce(text, chr(2)))) AS key FROM documents),
l AS (
  SELECT rid, key, doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line,
         unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM d),
t AS (SELECT rid, key, doc_id, site, line_no, line, regexp_replace(line, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS k FROM l),
b AS (
  SELECT k, min(struct_pack(doc_id := doc_id, key := key, line_no := line_no)) AS first FROM t
  WHERE k <> ''
  GROUP BY k HAVING count(DISTINCT site) >= {MIN_SITES}),
x AS (
  SELECT t.rid, t.line_no, line, b.k IS NOT NULL AND NOT (b.first.doc_id = t.doc_id AND b.first.key = t.key AND b.first.line_no = t.line_no) AS gone
  FROM t LEFT JOIN b ON b.k = t.k),
c AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS clean FROM x GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(clean) AS clean_sha256, CAST(length(clean) AS BIGINT) AS clean_chars
FROM d LEFT JOIN c USING (rid)
"""
