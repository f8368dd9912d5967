"""Quality rules by weak supervision, in SQL functions only.

Rules vote good (1), bad (0) or abstain (null). Expectation-maximisation over the counts of vote
patterns (at most 3 ** rules rows, whatever the corpus holds) estimates the prior and, for each
rule, how often it votes bad on bad and on good documents; the posterior probability of the good
class decides. Rows, columns and edge cases:

* null or wordless text: all counts are 0, base_failed is true, rules abstain for want of words;
* repeated rows stay, each with the same verdict; an empty table gives an empty result;
* only doc_id and text are read, so extra columns cannot clash;
* 3-word windows are compared by the 64-bit xxHash of their words' hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut

SYMBOLS = "#*$%&|<>"

#: A word of ordinary prose: letters, digits, marks and inner joiners between quotes or brackets and sentence marks.
PLAIN = r"""^["'(\[\u00ab\u2018\u201c\u00bf\u00a1]*[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'\u2019.,:/@_-]*[!?;)\]"'\u00bb\u201d\u2026]*$"""


def counts(docs: DataFrame) -> DataFrame:
    """The base counts of every document, without any shuffle.

    The word array is one column, so it is split once; windows are hashed, sorted with their
    positions, and those with an equal neighbour are the repeated ones. n_repeat_words counts each
    word once that lies in some repeated window.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        "t",
        F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter("words", lambda w: w.rlike(PLAIN))).cast("long").alias("n_plain_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    steps = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    at = lambda a, i: F.get(F.col(a), i)
    rows = rows.withColumn("seen", F.sort_array(F.transform(steps, lambda i: F.struct(F.xxhash64(at("h", i), at("h", i + 1), at("h", i + 2)).alias("w"), i.alias("i"))))).drop("h")
    same = lambda x, k: F.coalesce(at("seen", k)["w"] == x["w"], F.lit(False))
    twice = F.filter("seen", lambda x, k: same(x, k - 1) | same(x, k + 1))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("seen")


@dataclass(frozen=True)
class Rule:
    """Bad beyond one bound, good within the other, abstains between and on documents without words."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    Rule("plain", "10 * n_plain_words < 7 * n_words", "20 * n_plain_words >= 19 * n_words"),
    Rule("letters", "10 * n_letter_words < 8 * n_words", "20 * n_letter_words >= 19 * n_words"),
)


def votes(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds a tinyint column v_<name> for each rule: 1 good, 0 bad, null abstains."""
    cast = lambda r: F.when(F.col("n_words") == 0, None).when(F.expr(r.bad), 0).when(F.expr(r.good), 1).cast("tinyint")
    return rows.withColumns({f"v_{r.name}": cast(r) for r in rules})


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents. bad_if_good, bad_if_bad: each rule's rate of bad votes by class."""

    prior: float
    bad_if_good: tuple[float, ...]
    bad_if_bad: tuple[float, ...]

    def log_odds(self, vote: list[int | None]) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for v, g, b in zip(vote, self.bad_if_good, self.bad_if_bad, strict=True):
            if v is not None:
                odds += math.log((1 - g) / (1 - b)) if v else math.log(g / b)
        return odds


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 100, strength: float = 4.0, n_rules: int = len(RULES)) -> LabelModel:
    """Expectation-maximisation over (votes, documents) pairs.

    It starts from rules that are right nine times in ten; pseudo-counts of that opinion, strength
    documents a class and rule, keep rates off 0 and 1. A rule never counts as worse than chance:
    its bad votes stay at least as likely on bad documents as on good ones.
    """
    n_rules = len(patterns[0][0]) if patterns else n_rules
    model = LabelModel(0.8, (0.1,) * n_rules, (0.9,) * n_rules)
    for _ in range(rounds if patterns else 0):
        good = bad = 0.0
        tally = [[0.0, 0.0, 0.0, 0.0] for _ in range(n_rules)]  # bad votes and all votes: on good, on bad
        for vote, n in patterns:
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(vote)))))
            good, bad = good + n * p, bad + n * (1 - p)
            for t, v in zip(tally, vote, strict=True):
                if v is not None:
                    t[1] += n * p
                    t[3] += n * (1 - p)
                    if v == 0:
                        t[0] += n * p
                        t[2] += n * (1 - p)
        g = [(t[0] + 0.1 * strength) / (t[1] + strength) for t in tally]
        b = [(t[2] + 0.9 * strength) / (t[3] + strength) for t in tally]
        fresh = LabelModel((good + 0.8 * strength) / (good + bad + strength), tuple(g), tuple(max(x, y) for x, y in zip(b, g, strict=True)))
        moved = max(abs(x - y) for x, y in zip((fresh.prior, *fresh.bad_if_good, *fresh.bad_if_bad), (model.prior, *model.bad_if_good, *model.bad_if_bad), strict=True))
        model = fresh
        if moved < 1e-9:
            break
    return model


def posterior(model: LabelModel, rules: tuple[Rule, ...] = RULES) -> Column:
    """The probability of the good class as an expression over the vote columns."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for r, g, b in zip(rules, model.bad_if_good, model.bad_if_bad, strict=True):
        v = F.col(f"v_{r.name}")
        odds = odds + F.when(v == 1, math.log((1 - g) / (1 - b))).when(v == 0, math.log(g / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, p_good, base_failed and kept of every document. See the module for edge cases."""
    rows = cut(votes(counts(docs), rules))
    names = [f"v_{r.name}" for r in rules]
    seen = rows.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(rules) rows
    patterns = sorted(((tuple(r[c] for c in names), r["n"]) for r in seen), key=str)
    model = fit(patterns, n_rules=len(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("p_good", posterior(model, rules)).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
