"""MinHash near-dedup with circulant signatures.

Two permutations give a whole signature: one scatters shingles over BINS places, the other, laid
out as a table and read from a place onward, shifts by one for each coordinate. So a shingle's
values for all coordinates are one run of the table, and a signature is the minimum of such runs.

Rows with equal shingle sets are one class. Bands of the signature put classes in buckets. No step
compares the members of a bucket with each other:

* every bucket names one member its centre, the one that meets most others over all its buckets,
  and each member is compared with its centres on the full sets: at most one pair an entry of a
  bucket. What a member has and its centre has not, or the reverse, is its difference; the members
  of one centre are a star;
* members of a star that are in another component than its centre choose a centre among
  themselves, and so on while that finds links;
* what may be linked still are two members of a star in different components, one of them not
  linked with the centre. Their symmetric difference follows from their differences, so for a link
  the differences must overlap by a number that only sizes decide, so they meet several times in
  the first elements of both (prefix and position bounds of set similarity joins). Members are
  joined on those elements (they are in order of how many differences of the star hold them, so few
  share the first ones); what passes the bounds is compared on full sets.

So a link is lost only if its classes meet in no bucket: at Jaccard 0.85 with probability 4e-8, at 0.8
with 2e-5. Every link is confirmed on the full sets. Edge cases:

* null, empty or wordless text: an empty set, linked with nothing, its own component;
* repeated rows with one doc_id keep a row each; a null doc_id takes part, and a component without
  any doc_id has a null component_id and keeps its rows;
* very long texts are read whole; an empty table gives an empty result; only doc_id and text are
  read, so extra columns cannot clash. Shingles count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textnum
from .common import BROADCAST_ROWS, cut, frugal, release, skew_join

BINS = 1 << 20
BANDS, ROWS = 36, 6

_TABLE: list[np.ndarray] = []


def table() -> np.ndarray:
    """The second permutation, with its beginning repeated at the end; one a worker process."""
    if not _TABLE:
        p = np.random.default_rng(7).permutation(BINS).astype(np.uint32)
        _TABLE.append(np.concatenate([p, p[: BANDS * ROWS]]))
    return _TABLE[0]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS coordinates of a non-empty set. The first permutation is a mixed hash, cut to a bin."""
    k = BANDS * ROWS
    bins = np.unique(textnum.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(44)).astype(np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(table(), k)
    best = None
    for a in range(0, len(bins), 512):
        part = rows[bins[a : a + 512]].min(axis=0)
        best = part if best is None else np.minimum(best, part)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, which holds the band's number."""
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64) + np.uint64(0x51ED270B)
        for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
            key = textnum.mix(key * np.uint64(0x2545F4914F6CDD1D) + column)
    return key


def _sketch(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            row, texts, ids, hashes = batch.columns
            for a, b, data, offsets in textnum.runs(texts):
                n, keys, bands = [], [], []
                for s in textnum.shingle_sets(data, offsets, width):
                    n.append(len(s))
                    keys.append(_key(s))
                    bands.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), row.slice(a, b - a), hashes.slice(a, b - a), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return frugal(run)


def _key(hashes: np.ndarray) -> bytes | None:
    """The class of a set: equal for equal sets."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _sets(width: int):
    """Classes and sets of texts."""
    schema = pa.schema([("cls", pa.binary()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in textnum.runs(batch.column(0)):
                sets = textnum.shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)

    return frugal(run)


#: So many links, a few MB, are joined to components by one task; more by rounds over all tasks.
FEW_LINKS = 100_000


def _forest(batches):
    """node, comp for the nodes of all links (a, b), by union of trees whose root is their least node."""
    up = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in list(up)], kind)], names=["node", "comp"])


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) of every node of links (a, b), by min-label rounds with pointer jumps.

    Each round takes the least label among a node's own and its neighbours', then that label's own
    label. Nothing is collected but a count of changes. At most FEW_LINKS links are joined by one
    task instead: a round is a dozen jobs, whose plans and figures stay in the driver's memory.
    """
    links = cut(links.select("a", "b").distinct())
    if links.count() <= FEW_LINKS:
        kind = links.schema["a"].dataType.simpleString()
        return cut(links.coalesce(1).mapInArrow(_forest, f"node {kind}, comp {kind}"))
    both = cut(links.union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("now"))
        to = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        fresh = cut(near.join(to, near["now"] == to["n2"], "left").select("node", "was", F.least("now", F.coalesce("c2", "now")).alias("comp")))
        labels = fresh.select("node", "comp")
        release(links.sparkSession)
        if not fresh.where(F.col("was") != F.col("comp")).head(1):
            return labels


#: A pivot's set is repeated for every so many of its pairs, which spreads them over tasks.
PAIRS_A_TASK = 512

#: Rounds of new centres end when less than this share of their pairs are links.
LEAST_YIELD = 0.05

#: Differences must meet in this many elements more than one, in beginnings longer by as many.
EXTRA = 1


def overlap_bounds(n: int, diff: int, centre: int, percent: int) -> tuple[int, bool, int]:
    """(weight, loose, length) of a star's member with n shingles that differs from its centre by diff of them.

    With w the weights, two members of a star are linked if and only if their differences share at
    least (w1 + w2) / (2 * (100 + percent)) elements; loose says whether the member is not linked
    with the centre. Of two members that may be linked in spite of the centre one is loose, so in any
    order that all share, the first `length` elements of both differences meet in EXTRA + 1 elements
    (or in all that are needed, if fewer).
    """
    weight, most = (100 + percent) * diff - (100 - percent) * n, (100 - percent) * centre
    if weight <= most:
        least = -(-(weight + most + 1) // (2 * (100 + percent)))
    else:
        # the other differs by as many elements at least, or it could not share enough
        other = (weight - most) / 200
        least = math.ceil((weight + 2 * percent * other - most) / (2 * (100 + percent)) - 1e-9)
    return weight, weight > most, max(0, min(diff, diff - max(1, least) + 1 + EXTRA))


def _compared(percent: int, stars: bool):
    """Compares pairs of sets; for stars of several members tells the differences as well, in the order of a hash."""

    def sets_of(column):
        values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        return (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))

    def run(batches):
        for batch in batches:
            a, b, members, score, sa, sb = batch.columns
            out = []
            for many, x, y in zip(members.to_pylist(), sets_of(sa), sets_of(sb), strict=True):
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = x[at] == y
                shared = int(both.sum())
                link = 100 * shared >= percent * (len(x) + len(y) - shared)
                if not stars or many < 2:
                    out.append((link, len(y), 0, 0, False, 0, None))
                    continue
                gone = np.delete(x, at[both])
                elements = np.sort(textnum.mix(np.concatenate([y[~both], gone])).view(np.int64))
                out.append((link, len(y), len(elements), *overlap_bounds(len(y), len(elements), len(x), percent), elements))
            kinds = [f.type for f in _COMPARED][4:]
            yield pa.RecordBatch.from_arrays([a, b, members, score, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))] if out else [pa.array([], f.type) for f in _COMPARED], schema=_COMPARED)

    return frugal(run)


_COMPARED = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("members", pa.int64()), ("score", pa.int64()), ("link", pa.bool_()), ("n", pa.int64()), ("diff", pa.int64()), ("weight", pa.int64()), ("loose", pa.bool_()), ("length", pa.int64()), ("elements", pa.list_(pa.int64()))])
_COMPARED_SQL = "a binary, b binary, members long, score long, link boolean, n long, diff long, weight long, loose boolean, length long, elements array<bigint>"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, stars: bool = False) -> DataFrame:
    """Pairs (a, b, members, score) with what _compared() finds; members is the number of pairs that a has.

    Each set of b is sent once a pair; the set of a once for PAIRS_A_TASK of its pairs.
    """
    salts = lambda m: F.ceil(m / PAIRS_A_TASK).cast("int")
    pivots = pairs.groupBy("a").agg(salts(F.max("members")).alias("salts"))
    left = sets.join(pivots, sets["cls"] == pivots["a"]).select(F.col("cls").alias("ca"), F.col("s").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("sx"))
    right = sets.select(F.col("cls").alias("cb"), F.col("s").alias("sb"))
    rows = pairs.withColumn("x", F.pmod(F.xxhash64("b"), salts(F.col("members"))).cast("int"))
    rows = rows.join(right, rows["b"] == right["cb"]).join(left, (rows["a"] == left["ca"]) & (rows["x"] == left["sx"]))
    return rows.select("a", "b", "members", "score", "sa", "sb").mapInArrow(_compared(percent, stars), _COMPARED_SQL)


def _counted(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, n, score) with members, the number of pairs of a."""
    return skew_join(pairs, pairs.groupBy("a").agg(F.count("*").alias("members")), "a", "members", pairs.count(), "inner")


def _with_component(rows: DataFrame, labels: DataFrame | None, node: str, name: str) -> DataFrame:
    """rows with the component of a class, which is the class itself where it has no link."""
    if labels is None:
        return rows.withColumn(name, F.col(node))
    known = labels.select(F.col("node").alias("__node"), F.col("comp").alias("__comp"))
    return rows.join(known, F.col(node) == F.col("__node"), "left").withColumn(name, F.coalesce("__comp", node)).drop("__node", "__comp")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _marked(docs, width, percent).drop("text_hash")


def _marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates() and a hash of each text, which tells rows with one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("row"), "text", "doc_id", F.xxhash64("text").alias("text_hash"))
    rows = cut(keyed.mapInArrow(_sketch(width), "doc_id long, row long, text_hash long, n_shingles long, cls binary, bands array<bigint>"))
    classes = cut(rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("row").alias("holder"), F.count("*").alias("members"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")))
    labels = cut(_linked(keyed, classes, width, percent).join(classes.select("cls", "least"), F.col("node") == F.col("cls")).select("cls", "least", "comp"))
    firsts = labels.groupBy("comp").agg(F.min("least").alias("first"), F.count("*").alias("parts"))
    linked = skew_join(labels.select("cls", "comp"), cut(firsts), "comp", "parts", labels.count(), "left").select(F.col("cls").alias("node"), "first")
    # a class of one row that is linked with no other has its own doc_id for a component: it needs no join
    found = classes.select("cls", "least", "members").join(cut(linked), F.col("cls") == F.col("node"), "left").where((F.col("members") > 1) | F.col("node").isNotNull())
    found = cut(found.select("cls", "members", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("first")).alias("found"), F.lit(True).alias("joined")))
    release(docs.sparkSession)
    out = skew_join(rows.select("doc_id", "text_hash", "n_shingles", "cls"), found, "cls", "members", rows.count(), "left")
    component = F.when(F.col("joined"), F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _linked(keyed: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """node, comp for every class that is linked with another."""
    entries = classes.select(F.explode("bands").alias("band"), "cls", "n")
    shared = entries.groupBy("band").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    total = classes.count() * BANDS
    buckets = skew_join(entries, cut(shared), "band", "m", total, "inner")
    buckets = cut(buckets.withColumn("score", F.sum(F.col("m") - 1).over(W.partitionBy("cls"))))  # at most BANDS rows a class
    sets = _sets_of(keyed, classes, buckets, width)
    centres = cut(buckets.groupBy("band").agg(F.max(F.struct("score", "cls", "n")).alias("c"), F.max("m").alias("bm")))
    pairs = skew_join(buckets.drop("m"), centres, "band", "bm", total, "inner").where(F.col("cls") != F.col("c.cls"))
    pairs = cut(pairs.groupBy(F.col("c.cls").alias("a"), F.col("cls").alias("b")).agg(F.max("c.n").alias("an"), F.max("n").alias("n"), F.max("score").alias("score")))
    pairs = _counted(pairs).where((F.col("members") > 1) | _sized("an", "n", percent)).drop("an", "n")
    compared = cut(_verified(pairs, sets, percent, stars=True))
    links = compared.where("link").select("a", "b")
    labels = components(links) if links.head(1) else None
    stars = compared.where("members > 1")
    links, labels = _more_centres(stars, links, labels, sets, percent)
    more = _loose_links(stars, labels, sets, percent)
    if more is not None:
        labels = components(links.union(more))
    return classes.select(F.col("cls").alias("node"), F.col("cls").alias("comp")).limit(0) if labels is None else labels


def _sized(n: str, other: str, percent: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def _sets_of(keyed: DataFrame, classes: DataFrame, buckets: DataFrame, width: int) -> DataFrame:
    """cls and s, the full sets of the classes in buckets."""
    wanted = cut(classes.join(buckets.select(F.col("cls").alias("w")).distinct(), F.col("cls") == F.col("w"), "left_semi").select("holder").distinct())
    texts = keyed.join(F.broadcast(wanted) if wanted.count() <= 5 * BROADCAST_ROWS else wanted, F.col("row") == F.col("holder"), "left_semi")
    return cut(texts.select("text").mapInArrow(_sets(width), "cls binary, s array<bigint>").dropDuplicates(["cls"]))


def _more_centres(stars: DataFrame, links: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """links and labels after members that are apart from their star's centres were compared with new ones."""
    live = stars.select(F.col("a").alias("g"), F.col("b").alias("cls"), "n", "score")
    centres = stars.select(F.col("a").alias("g"), F.col("a").alias("q"), F.col("members").alias("m")).distinct()
    while True:
        named = cut(_with_component(centres, labels, "q", "qc"))
        held = skew_join(live, named, "g", "m", live.count(), "inner").where(F.col("cls") != F.col("q"))
        live = cut(_with_component(held, labels, "cls", "comp").where(F.col("comp") != F.col("qc")).select("g", "cls", "n", "score"))
        centres = cut(live.groupBy("g").agg(F.max(F.struct("score", "cls", "n")).alias("c"), F.count("*").alias("m")).where(F.col("m") > 1))
        pairs = skew_join(live, centres, "g", "m", live.count(), "inner").where((F.col("cls") != F.col("c.cls")) & _sized("c.n", "n", percent))
        pairs = cut(pairs.groupBy(F.col("c.cls").alias("a"), F.col("cls").alias("b")).agg(F.max("score").alias("score")))
        centres = centres.select("g", F.col("c.cls").alias("q"), "m")
        tests = pairs.count()
        if not tests:
            return links, labels
        new = cut(_verified(_counted(pairs), sets, percent).where("link").select("a", "b"))
        found = new.count()
        if found:
            links = links.union(new)
            labels = components(links)
        release(stars.sparkSession)
        if found < LEAST_YIELD * tests:
            return links, labels


def _beginnings(rows: DataFrame) -> DataFrame:
    """The elements, as key, in the first `length` places of each difference, with their places; the rarest of a star come first.

    An element that members of one component have alone takes a place but meets nothing, so it is no row.
    """
    held = rows.select("g", "b", F.xxhash64("comp").alias("in"), F.explode("elements").alias("e")).select("g", "b", "in", F.xxhash64("g", "e").alias("key"))
    counts = cut(held.groupBy("key").agg(F.count("*").alias("n"), F.min("in").alias("least"), F.max("in").alias("most")).where("least <> most").select("key", "n"))
    held = held.drop("in")
    total = counts.agg(F.sum("n")).head()[0] or 0
    common = skew_join(held, counts.withColumn("often", F.col("n")), "key", "n", total, "inner")
    common = common.groupBy("g", "b").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("common")).select(F.col("g").alias("cg"), F.col("b").alias("cb"), "common")
    rows = rows.join(common, (F.col("g") == F.col("cg")) & (F.col("b") == F.col("cb"))).withColumn("alone", F.col("diff") - F.size("common"))
    first = F.slice("common.key", F.lit(1), F.greatest(F.lit(0), F.col("length") - F.col("alone")).cast("int"))
    return rows.select("g", "b", "diff", "weight", "loose", "comp", "alone", F.posexplode(first).alias("pos", "key")).withColumn("pos", F.col("alone") + F.col("pos")).drop("alone")


def _loose_links(stars: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame | None:
    """The links between members of a star that are in different components, None if there are no such members."""
    rows = cut(_with_component(stars.select(F.xxhash64("a").alias("g"), "b", "diff", "weight", "loose", "length", "elements"), labels, "b", "comp"))
    several = cut(rows.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("loose").alias("any"), F.count("*").alias("m")).where("any AND c0 <> c1").select("g", "m"))
    rows = cut(skew_join(rows, several, "g", "m", rows.count(), "inner"))
    each = cut(_beginnings(rows))
    loose = each.where("loose").select(*(F.col(c).alias(f"{c}2") for c in each.columns if c not in ("loose", "g")), F.col("g").alias("g2"))
    need = F.ceil((F.col("weight") + F.col("weight2")) / (2 * (100 + percent)) - 1e-9)
    left = F.least(F.col("diff") - F.col("pos"), F.col("diff2") - F.col("pos2"))
    met = each.join(loose, (F.col("key") == F.col("key2")) & (F.col("g") == F.col("g2")) & (F.col("comp") != F.col("comp2")) & (~F.col("loose") | (F.col("b") < F.col("b2"))) & (left + EXTRA >= need))
    met = met.groupBy("g", "b", "b2", need.alias("need")).agg(F.count("*").alias("shared")).where(F.col("shared") >= F.least(F.col("need"), F.lit(EXTRA + 1)))
    pairs = cut(met.select(F.col("b").alias("a"), F.col("b2").alias("b")).distinct().withColumn("score", F.lit(0).cast("long")))
    if not pairs.head(1):
        return None
    return cut(_verified(_counted(pairs), sets, percent).where("link").select("a", "b"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near copies: of each component the row of its smallest doc_id stays.

    Of repeated rows with that doc_id each stays; rows whose doc_id is null stay only if no row of
    their component has a doc_id.
    """
    gone = _marked(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["__doc"]) & (rows["__text"] == gone["__hash"]), "left_anti").drop("__text")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=3, percent=85)
