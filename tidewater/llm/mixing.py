"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks, in SQL functions only.

Every source gets a target, whole numbers of blocks are apportioned to sources and then to the
shards of each source by highest quotients, and a seeded permutation of a shard's blocks picks
which of them are taken. A shard is a seeded share of a source's documents, laid end to end in a
seeded order and cut into blocks of equal length (to a word); a document takes the words that its
span shares with the taken blocks. Shards hold about SHARD_WORDS words whatever the source holds and
get their seats in two levels, SHARD_GROUP at a time, so no step gathers a source; only a row a source
and a row a group of shards meet in a window. Rows, columns and edge cases:

* null or wordless text has size 0 and takes 0; a source without words has target 0;
* null is a source of its own, last in order; a null doc_id is a row like others;
* rows that are equal in all that is read are interchangeable and each takes its own share;
* very long texts are taken whole or by blocks like others; an empty table gives an empty result;
  other columns are passed through, whatever their names (names that begin with two underscores are
  kept for this module).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, lookup_join

BLOCK_WORDS = 64
SHARD_WORDS = 2**17
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"

#: A prime above any shard's number of blocks: multiplying by it permutes the blocks.
PRIME = 2147483647

#: Shards whose seats are apportioned together.
SHARD_GROUP = 4096


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row a source: source, __source_size, __place (by code point, null last), __target.

    Targets share the total by weight up to max_repeat times a source's size. In the order of that
    cap per weight, capped sources come first, and the level of the rest follows from running sums:
    no rounds are needed. Only a row per source reaches the one-partition windows.
    """
    unit = math.lcm(*weights)
    at = (F.col("__place") - 1) % len(weights)
    weight = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        weight = F.when(at == k, F.lit(w)).otherwise(weight)
    rows = sizes.groupBy("source").agg(F.sum("__size").alias("__source_size"))
    rows = rows.withColumn("__place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    rows = rows.withColumn("__w", weight.cast("long")).withColumn("__cap", F.lit(max_repeat) * F.col("__source_size"))
    order = W.orderBy((F.col("__source_size") * F.expr(f"{unit} div __w")).asc(), "__place")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("__left", F.sum("__source_size").over(everything) - F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("__cap"))
    rows = rows.withColumn("__open", F.sum("__w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    rows = rows.withColumn("__full", F.col("__cap") * F.col("__open") <= F.col("__left") * F.col("__w"))
    first = F.min(F.when(~F.col("__full"), F.struct((F.col("__source_size") * F.expr(f"{unit} div __w")).alias("r"), "__place", "__left", "__open"))).over(everything)
    rows = rows.withColumn("__level", first)
    above = F.struct((F.col("__source_size") * F.expr(f"{unit} div __w")).alias("r"), F.col("__place").alias("p")) < F.struct(F.col("__level.r").alias("r"), F.col("__level.__place").alias("p"))
    capped = F.col("__level").isNull() | above
    target = F.when(capped, F.col("__cap").cast("double")).otherwise((F.col("__level.__left") * F.col("__w")).cast("double") / F.col("__level.__open"))
    return rows.select("source", "__source_size", "__place", target.alias("__target"))


def apportion(units: DataFrame, group: list[str], weight: str, seats: str, tie: str) -> DataFrame:
    """Adds __q: the Sainte-Laguë seats of each unit, the group's `seats` highest of weight / (2k + 1).

    A unit's seats lie between its shares at divisors that fit n / 2 seats fewer and more, for n
    units of the group, so only about 3n quotients of the many are listed and ranked.
    """
    whole = W.partitionBy(*group) if group else W.partitionBy()
    rows = units.withColumn("__n", F.count("*").over(whole)).withColumn("__sum", F.sum(weight).over(whole))
    share = lambda h: F.floor(F.col(weight) * h / F.col("__sum") + 0.5)
    none = F.col("__sum") <= 0
    rows = rows.withColumn("__lo", F.when(none, 0).otherwise(F.greatest(F.lit(0), share(F.col(seats) - F.col("__n") / 2) - 1)).cast("long"))
    rows = rows.withColumn("__hi", F.when(none | (F.col(weight) <= 0), 0).otherwise(share(F.col(seats) + F.col("__n") / 2) + 1).cast("long"))
    rows = rows.withColumn("__rest", F.col(seats) - F.sum("__lo").over(whole))
    steps = F.when(F.col("__hi") > F.col("__lo"), F.sequence(F.col("__lo"), F.col("__hi") - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("__k", F.explode_outer(steps))
    quotient = F.col(weight) / (2 * F.col("__k") + 1)
    rank = F.row_number().over(whole.orderBy(quotient.desc_nulls_last(), F.col(tie)))
    rows = rows.withColumn("__got", (F.col("__k").isNotNull() & (rank <= F.col("__rest"))).cast("long"))
    keys = [c for c in units.columns]
    return rows.groupBy(*keys, "__lo").agg(F.sum("__got").alias("__got")).select(*keys, (F.col("__lo") + F.col("__got")).alias("__q"))


def spread(docs: DataFrame, sizes: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs (source, __size, __key and any others) with __source_size, __target, __start, __full, __blocks, __q, __shift.

    sizes: source, __size and __key of the same rows, read twice. __start is the document's place
    in its shard of __full words in __blocks blocks, of which __q are taken.
    """
    sources = source_targets(sizes, weights, max_repeat)
    total = F.sum("__target").over(W.partitionBy())
    sources = cut(apportion(sources.withColumn("__seats", F.round(total / block_words).cast("long")), [], "__target", "__seats", "__place").withColumn("__shards", F.greatest(F.lit(1), F.ceil(F.col("__source_size") / shard_words)).cast("long")).withColumnRenamed("__q", "__seats_of"))
    known = sources.count()
    number = lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("long")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = lookup_join(rows, sources.select("source", "__source_size", "__target", "__place", "__shards", "__seats_of"), ["source"], "inner", known)
        return rows.withColumn("__shard", number(F.col("__key")) % F.col("__shards"))

    shards = dealt(sizes).groupBy("__place", "__shard", "__seats_of").agg(F.sum("__size").alias("__full"))
    # in two levels, so that no window holds all shards of a source
    shards = cut(shards.withColumn("__group", F.expr(f"__shard div {SHARD_GROUP}")))
    groups = shards.groupBy("__place", "__group", "__seats_of").agg(F.sum("__full").alias("__all"))
    groups = apportion(groups, ["__place"], "__all", "__seats_of", "__group")
    shards = shards.drop("__seats_of").join(groups.select("__place", "__group", F.col("__q").alias("__seats_of")), ["__place", "__group"])
    shards = apportion(shards, ["__place", "__group"], "__full", "__seats_of", "__shard")
    shards = shards.withColumn("__blocks", F.greatest(F.lit(1), F.round(F.col("__full") / block_words)).cast("long"))
    shards = shards.withColumn("__q", F.least("__q", max_repeat * F.col("__blocks")))
    shards = shards.withColumn("__shift", number(F.md5(F.concat_ws("|", F.lit(seed), "__place", "__shard"))) % F.col("__blocks"))
    shards = shards.select(F.col("__place").alias("__p"), F.col("__shard").alias("__s"), "__full", "__blocks", "__q", "__shift")
    rows = dealt(docs)
    along = W.partitionBy("__place", "__shard").orderBy("__key", "__size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__start", F.sum("__size").over(along) - F.col("__size"))
    rows = rows.join(shards, (rows["__place"] == shards["__p"]) & (rows["__shard"] == shards["__s"]), "inner")
    return rows.drop("__p", "__s", "__key", "__shard", "__shards", "__seats_of", "__place")


def _from(j: Column) -> Column:
    """The first word of block j of the shard."""
    return F.call_function("div", j * F.col("__full"), F.col("__blocks"))


def _blocks() -> Column:
    """The numbers of the blocks that the document's span meets; null if it has no words."""
    first = F.expr("((__start + 1) * __blocks - 1) div __full")
    last = F.expr("((__start + __size) * __blocks - 1) div __full")
    return F.when(F.col("__size") > 0, F.sequence(first, last))


def _is_extra(j: Column) -> Column:
    """Whether the shard's seeded permutation puts block j among those taken once more than the rest."""
    return (j * PRIME + F.col("__shift")) % F.col("__blocks") < F.col("__q") % F.col("__blocks")


def taken() -> Column:
    """The words that the document gives, repeats counted."""
    width = lambda j: F.least(F.col("__start") + F.col("__size"), _from(j + 1)) - F.greatest(F.col("__start"), _from(j))
    extra = F.aggregate(_blocks(), F.lit(0).cast("long"), lambda a, j: a + F.when(_is_extra(j), width(j)).otherwise(F.lit(0).cast("long")))
    return (F.col("__size") * F.expr("__q div __blocks") + F.coalesce(extra, F.lit(0))).cast("long")


def _key(seed: str) -> Column:
    """What deals rows to shards and orders them there: a digest of doc_id and text, so many rows of one doc_id spread."""
    part = lambda c: F.coalesce(c, F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(seed), part(F.col("doc_id").cast("string")), part(F.md5(F.col("text").cast("string").cast("binary")))))


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every document."""
    sizes = cut(docs.select("doc_id", "source", words_in("text").alias("__size"), _key(seed).alias("__key")))
    rows = spread(sizes, sizes, seed=seed, **options)
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken().alias("taken"), "source")


def mix_texts(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass over a document that takes any of its words.

    Its text is the taken words with the white space after them, and n_chars, where there is such a
    column, its length. All other columns stay as they are.
    """
    sized = docs.withColumn("__size", words_in("text")).withColumn("__key", _key(seed))
    rows = spread(sized, cut(sized.select("source", "__size", "__key")), seed=seed, **options)
    rows = rows.withColumn("__pieces", F.regexp_extract_all("text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)))
    rows = rows.withColumn("__pass", F.explode(F.expr("sequence(0L, __q div __blocks)")))
    begin = lambda j: F.greatest(F.col("__start"), _from(j)) - F.col("__start")
    end = lambda j: F.least(F.col("__start") + F.col("__size"), _from(j + 1)) - F.col("__start")
    some = F.array_join(F.transform(F.filter(_blocks(), _is_extra), lambda j: F.array_join(F.slice("__pieces", (begin(j) + 1).cast("int"), (end(j) - begin(j)).cast("int")), "")), "")
    rows = rows.withColumn("text", F.when(F.col("__pass") < F.expr("__q div __blocks"), F.col("text")).otherwise(some)).where((F.col("__size") > 0) & (F.col("text") != ""))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


OP3_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, md5('{SEED}|' || COALESCE(CAST(doc_id AS VARCHAR), 'null') || '|' || COALESCE(md5(text), 'null')) AS key,
    CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), a AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), b AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM a
), c AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM b
), d AS (
  SELECT *, source_size * (10 // w) AS r,
    row_number() OVER (ORDER BY source_size * (10 // w), place) AS rn,
    CAST(sum(source_size) OVER () - sum(cap) OVER (ORDER BY source_size * (10 // w), place ROWS UNBOUNDED PRECEDING) + cap AS BIGINT) AS room,
    CAST(sum(w) OVER (ORDER BY source_size * (10 // w), place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM c
), e AS (
  SELECT *, min(CASE WHEN NOT cap * open <= room * w THEN rn END) OVER () AS level_rn FROM d
), f AS (
  SELECT e.*, CASE WHEN level_rn IS NULL OR rn < level_rn THEN CAST(cap AS DOUBLE)
    ELSE CAST((SELECT room FROM d WHERE d.rn = e.level_rn) * w AS DOUBLE) / (SELECT open FROM d WHERE d.rn = e.level_rn) END AS target
  FROM e
), g AS (
  SELECT *, CAST(round(sum(target) OVER () / {BLOCK_WORDS}) AS BIGINT) AS seats, sum(target) OVER () AS total FROM f
), h AS (
  SELECT place, target / (2 * k + 1) AS quotient, seats FROM g, (SELECT unnest(range((SELECT max(seats) FROM g))) AS k) WHERE target / (2 * k + 1) > 0 AND k <= seats * target / total + 50
), i AS (
  SELECT place, count(*) AS q FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, place) AS n FROM h) WHERE n <= seats GROUP BY place
), j AS (
  SELECT g.*, COALESCE(i.q, 0) AS q, greatest(1, CAST(ceil(source_size / {SHARD_WORDS}) AS BIGINT)) AS shards FROM g LEFT JOIN i USING (place)
), k AS (
  SELECT s.*, j.source_size, j.target, j.place, j.q, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard
  FROM sizes s JOIN j ON s.source IS NOT DISTINCT FROM j.source
), l AS (
  SELECT place, shard, shard // {SHARD_GROUP} AS grp, q AS q_all, CAST(sum(size) AS BIGINT) AS whole FROM k GROUP BY place, shard, q
), l1 AS (
  SELECT place, grp, q_all, sum(whole) AS whole, sum(sum(whole)) OVER (PARTITION BY place) AS all_of FROM l GROUP BY place, grp, q_all
), l2 AS (
  SELECT place, grp, q_all, whole / (2 * n + 1) AS quotient FROM l1, LATERAL (SELECT unnest(range(CAST(q_all * whole / greatest(all_of, 1) AS BIGINT) + 50)) AS n) WHERE whole > 0
), l3 AS (
  SELECT place, grp, count(*) AS q FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, grp) AS n FROM l2) WHERE n <= q_all GROUP BY place, grp
), l4 AS (
  SELECT l.place, l.shard, l.grp, l.whole, COALESCE(l3.q, 0) AS q, sum(l.whole) OVER (PARTITION BY l.place, l.grp) AS all_of FROM l LEFT JOIN l3 USING (place, grp)
), m AS (
  SELECT place, shard, grp, q, whole / (2 * n + 1) AS quotient FROM l4, LATERAL (SELECT unnest(range(CAST(q * whole / greatest(all_of, 1) AS BIGINT) + 50)) AS n) WHERE whole > 0
), o AS (
  SELECT place, shard, count(*) AS q FROM (SELECT *, row_number() OVER (PARTITION BY place, grp ORDER BY quotient DESC, shard) AS n FROM m) WHERE n <= q GROUP BY place, shard
), p AS (
  SELECT l.place, l.shard, whole, greatest(1, CAST(round(whole / {BLOCK_WORDS}) AS BIGINT)) AS blocks, COALESCE(o.q, 0) AS q FROM l LEFT JOIN o USING (place, shard)
), r AS (
  SELECT place, shard, whole, blocks, least(q, 3 * blocks) AS q, CAST('0x' || substr(md5('{SEED}|' || place || '|' || shard), 1, 8) AS BIGINT) % blocks AS shift FROM p
), s AS (
  SELECT k.doc_id, k.source, k.size, k.source_size, k.target, whole, blocks, r.q, shift,
    CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM k JOIN r USING (place, shard)
), t AS (
  SELECT *, unnest(CASE WHEN size > 0 THEN range(((start + 1) * blocks - 1) // whole, ((start + size) * blocks - 1) // whole + 1) ELSE [NULL] END) AS j FROM s
)
SELECT doc_id, size, source_size, target, CAST(size * (q // blocks) + COALESCE(sum(CASE WHEN (j * {PRIME} + shift) % blocks < q % blocks
  THEN least(start + size, (j + 1) * whole // blocks) - greatest(start, j * whole // blocks) ELSE 0 END), 0) AS BIGINT) AS taken, source
FROM t GROUP BY doc_id, size, source_size, target, q, blocks, start, source, whole, shift
"""
