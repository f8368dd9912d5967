"""Removal of lines that many sites share, in SQL functions only.

The site of a document is its source. Lines are compared trimmed of white space, by their 64-bit
xxHash. One aggregation merges a HyperLogLog sketch of sites and a row count per line hash; lines
whose estimate lies near the threshold get an exact distinct count, so the sketch alone decides
only where its error cannot matter. Every copy of a line on at least MIN_SITES sites goes. Rows,
columns and edge cases:

* null text stays null with 0 lines; blank lines are never candidates and stay;
* a null source is no site, but its lines are cleaned as well; null doc_ids are rows like others;
* very long texts are cleaned whole; of equal lines in a document all go or all stay;
* repeated rows each stay, cleaned alike; a document may end with empty text, but no row goes;
* an empty table gives an empty result; other columns pass through (names that begin with two
  underscores are kept for this module).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, skew_join

MIN_SITES = 5

#: Sketches have 2 ** LG_K registers: a standard error of about 1.04 / sqrt(2 ** LG_K), 4.6 %.
LG_K = 9
ERROR = 0.046

SPACE = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """A row a line with something in it: document key, site, place and hash."""
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(SPACE)).alias("line")))
    parts = F.transform(F.filter(parts, lambda x: x["line"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["line"]).alias("h")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("__text"), F.col("source").alias("site"), F.explode(parts).alias("l"))
    return rows.select("doc_id", "__text", "site", F.col("l.i").alias("__i"), F.col("l.h").alias("h"))


def shared_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """One row a line hash on at least min_sites sites: h, n (its rows)."""
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("sites"), F.count("*").alias("n"))
    low, high = min_sites * (1 - 4 * ERROR), min_sites * (1 + 4 * ERROR)
    spread = spread.where(F.col("n") >= min_sites).select("h", "n", F.hll_sketch_estimate("sites").alias("guess"))
    spread = cut(spread.where(F.col("guess") >= low))
    near = spread.where(F.col("guess") <= high).select(F.col("h").alias("near_h"))
    each = lines.where(F.col("site").isNotNull()).groupBy("h", "site").agg(F.lit(1).alias("one")).select("h")
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    exact = each.join(near, each["h"] == near["near_h"], "left_semi").groupBy("h").agg(F.count("*").alias("exact"))
    kept = spread.join(exact.withColumnRenamed("h", "exact_h"), F.col("h") == F.col("exact_h"), "left")
    return cut(kept.where(F.coalesce(F.col("exact"), F.col("guess")) >= min_sites).select("h", "n"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = True) -> DataFrame:
    """docs with shared lines cut from text, and with counts n_lines and n_removed (long) at the end.

    The counts replace columns of their names; without them all columns of docs stay. Only places of removed lines are gathered, by document; the text is dealt once, to meet them.
    """
    lines = _lines(docs)
    shared = shared_lines(lines, min_sites)
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    gone = skew_join(lines, shared, "h", "n", total, "inner")
    gone = gone.groupBy("doc_id", "__text").agg(F.sort_array(F.collect_set("__i")).alias("__gone")).withColumnsRenamed({"doc_id": "__doc", "__text": "__of"})
    rows = docs.withColumn("__text", F.xxhash64("text"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__doc"]) & (rows["__text"] == gone["__of"]), "left")
    rows = rows.withColumn("__lines", F.split("text", "\n", -1)).withColumn("__n", F.size("__gone"))
    after = lambda k: F.coalesce(F.get("__gone", k - 1) + 1, F.lit(0))
    until = lambda k: F.coalesce(F.get("__gone", k), F.size("__lines"))
    parts = F.transform(F.sequence(F.lit(0), F.col("__n")), lambda k: F.slice("__lines", after(k) + 1, until(k) - after(k)))
    rows = rows.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long")
    n_removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.col("__n")).cast("long")
    if not counts:
        return rows.select(*docs.columns)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*kept, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = f"""
WITH a AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), b AS (
  SELECT r, doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM a
), c AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM b
), d AS (
  SELECT t FROM c WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {MIN_SITES}
), e AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (t IN (SELECT t FROM d)) AS n_removed,
    string_agg(line, chr(10) ORDER BY i) FILTER (t NOT IN (SELECT t FROM d)) AS text
  FROM c GROUP BY r
)
SELECT a.doc_id, COALESCE(e.n_lines, 0) AS n_lines, COALESCE(e.n_removed, 0) AS n_removed,
  CASE WHEN a.text IS NULL THEN NULL ELSE COALESCE(e.text, '') END AS text
FROM a LEFT JOIN e USING (r)
"""
