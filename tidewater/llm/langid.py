"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty,
which leaves most of them zero, on a bounded sample of labelled rows; a temperature fitted on rows
set aside from the sample calibrates the probabilities. Prediction reads nothing but the text, all
of it. Features are n-grams of one to three lower-cased letters, with runs of other characters as
one boundary mark, hashed to FEATURES places. Rows, columns and edge cases:

* null text or text without a letter: lang_pred "und", score 0;
* no labelled row to learn from: every row gets "und" and 0; one label: that label, score 1;
* rows with a null doc_id count as not held out; repeated rows each get their own equal result;
* the sample takes the rows with the lowest hashes, ties in hash by content, so reruns agree; of equal
  probabilities the language first by code point wins;
* very long texts are read whole; an empty table gives an empty result; identify() replaces columns
  lang_pred and score of the input, all other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .common import frugal, lookup_join

FEATURES = 1 << 15
ORDERS = 3

#: The training sample holds at most this many rows a language (chosen by a hash of doc_id and text).
SAMPLE_ROWS = 400

UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0 if it is no letter."""
    if not _LETTERS:
        table = np.zeros(1 << 16, np.uint32)
        for c in range(1 << 16):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


def features(data: np.ndarray, offsets: np.ndarray):
    """For each text (places, counts) of its hashed n-grams, both empty if it has no letter."""
    starts = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(starts)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    table = _letters()
    letters = table[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        letters[points == c] = c if chr(c).isalpha() else 0
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0
    keep |= first[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    letters = letters[keep].astype(np.uint32)
    grams, state = [], letters * np.uint32(0x9E3779B1)
    for k in range(ORDERS):
        if k:
            state = (state[:-1] ^ (state[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + letters[k:] * np.uint32(0xC2B2AE3D)
        h = (state + np.uint32(k * 0x27D4EB2F)) * np.uint32(0x165667B1)
        grams.append(((h ^ (h >> np.uint32(16))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if not letters[a:b].any():
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        count = np.bincount(np.concatenate([grams[k][a : max(a, b - k)] for k in range(ORDERS)]), minlength=FEATURES)
        places = np.flatnonzero(count)
        yield places, count[places]


def tf_idf(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length vector of log term frequency times inverse document frequency."""
    x = np.log1p(counts) * idf[places]
    return x / math.sqrt(float(x @ x))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


class Ftrl:
    """FTRL-proximal with L1 and L2 penalties for several classes."""

    def __init__(self, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(self, places) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, places: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(places)
        error = softmax(x @ w)
        error[label] -= 1
        g = np.outer(x, error)
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g


@dataclass
class Model:
    """languages in order, idf of each feature, weights (features x languages), temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, places: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not self.languages or not len(places):
            return UNKNOWN, 0.0
        p = softmax(tf_idf(places, counts, self.idf) @ self.weights[places] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _temperature(scores: list[np.ndarray], labels: list[int]) -> float:
    """The temperature in 0.05 .. 20 with the least log loss, by golden-section search on its logarithm."""
    if not scores:
        return 1.0
    s, y = np.array(scores), np.array(labels)

    def loss(t: float) -> float:
        z = s / math.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    a, b, ratio = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, seed: int = 1) -> Model:
    """Trains on (language, places, counts) rows; every fifth row of a shuffle only calibrates."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    number = {x: k for k, x in enumerate(languages)}
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = [rows[k] for k in order[::5]], [rows[k] for j, k in enumerate(order) if j % 5]
    if not used:
        held, used = [], rows
    df = np.zeros(FEATURES)
    for _, places, _ in used:
        df[places] += 1
    idf = np.log((1 + len(used)) / (1 + df)) + 1
    model = Ftrl(len(languages))
    vectors = [(p, tf_idf(p, c, idf), number[x]) for x, p, c in used]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(vectors)):
            model.learn(*vectors[k])
    weights = model.weights(slice(None))
    scores = [tf_idf(p, c, idf) @ weights[p] for _, p, c in held]
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), _temperature(scores, [number[x] for x, _, _ in held]))


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text modulo a number; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from rows of (doc_id, text, lang) with text and lang; see SAMPLE_ROWS for the sample.

    Languages are counted over all distinct rows; then a hash of doc_id and text admits about twice as
    many rows as the sample takes, repeated rows once, and the lowest hashes of those make the sample.
    Every language there is can be predicted; the driver holds a weight for each language and feature.
    """
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"), F.lit("langid"))
    labelled = labelled.withColumn("key", key)
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("d")).orderBy("lang").collect()  # a row a language
    if not counts:
        return fit([])
    spark = labelled.sparkSession
    admit = spark.createDataFrame([(r["lang"], min(1.0, (2 * sample_rows + 100) / max(1, r["d"]))) for r in counts], "lang string, share double")
    rows = lookup_join(labelled, admit, ["lang"], "inner", len(counts)).where(F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rows = rows.withColumn("order", F.pmod("key", F.lit(1 << 30))).dropDuplicates(["lang", "key"])

    def extract(batches):
        for batch in batches:
            for a, b, data, offsets in textnum.runs(batch.column(2)):
                got = list(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([p.astype(np.int32) for p, _ in got], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in got], pa.list_(pa.int32()))], names=["lang", "order", "places", "counts"])

    table = rows.select("lang", "order", "text").mapInArrow(frugal(extract), "lang string, order long, places array<int>, counts array<int>").toArrow().combine_chunks()
    by: dict[str, list] = {}
    for k, (lang, order) in enumerate(zip(table["lang"].to_pylist(), table["order"].to_pylist(), strict=True)):
        by.setdefault(lang, []).append((order, k))
    taken = [k for x in by.values() for _, k in sorted(x)[:sample_rows]]
    return fit([(table["lang"][k].as_py(), table["places"][k].values.to_numpy().astype(np.int64), table["counts"][k].values.to_numpy()) for k in taken])


def identify(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score, in columns of these names."""
    docs = docs.drop(label, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def predict(batches):
        m = shared.value
        for batch in batches:
            best = []
            for _, _, data, offsets in textnum.runs(batch.column(place)):
                best += [m.predict(p, c) for p, c in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in best], pa.string()), pa.array([s for _, s in best], pa.float64())], names=[*batch.schema.names, label, score])

    fields = docs.schema.jsonValue()
    schema = type(docs.schema).fromJson(fields).add(label, "string").add(score, "double")
    return docs.mapInArrow(frugal(predict), schema)


def reject_unknown(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) whose language is told with a score of at least `least`.

    All columns stay as they are, lang_pred and score among them.
    """
    model = train(docs.where(remainder(4) != 2))
    rows = identify(docs, model, "__lang_pred", "__score")
    return rows.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least)).select(*docs.columns)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang").where(remainder(4) != 2))
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
