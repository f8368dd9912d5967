"""Operators on training data against brute force, with edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import ann, langid, line_dedup, lmscore, minhash, mixing, packing, quality, tokenbin, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ENGLISH = "the river ran past the old mill and over the stones to the sea where boats were waiting".split()
FRENCH = "le chat dort sur la chaise près de la fenêtre ouverte pendant que les enfants jouent".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n string, cls string"


def corpus():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        words = ENGLISH if i % 2 else FRENCH
        text = "\n".join(" ".join(rng.choice(words, 12)) + f" {i} {j}." for j in range(int(rng.integers(4, 9))))
        if i % 3 == 0:
            text += "\nAll rights reserved by everybody here."
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 7}"))
    base = " ".join(rng.choice(ENGLISH, 200)) + " end"
    rows += [(200 + k, base.replace("end", f"end{k}"), "en", "s0") for k in range(12)] + [(300 + k, base, "en", "s1") for k in range(8)]
    rows += [(400, None, None, None), (401, "", "en", ""), (402, " \t\n", None, "s1"), (403, "12 34", "fr", None), (None, "x y z", "en", "s2"), (404, "a b", "en", "s2"), (404, "a b", "en", "s2"), (405, "A B", None, "s3")]
    rows.append((406, " ".join(rng.choice(ENGLISH, 9000)), "en", "s4"))
    return [(*r, len(r[1] or ""), "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_line_dedup(docs, empty):
    sites = collections.defaultdict(set)
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            if line.strip(" \t\n\v\f\r") and r.source is not None:
                sites[line.strip(" \t\n\v\f\r")].add(r.source)
    bad = {k for k, v in sites.items() if len(v) >= 5}
    assert bad
    want = collections.Counter((r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if x.strip(" \t\n\v\f\r") not in bad)) for r in docs.collect())
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert line_dedup.dedup_lines(empty).count() == 0
    clash = docs.withColumn("n_lines", F.lit("mine"))
    assert line_dedup.dedup_lines(clash).columns == [*docs.columns, "n_lines", "n_removed"]
    kept = line_dedup.dedup_lines(clash, counts=False)
    assert kept.columns == clash.columns and {r.n_lines for r in kept.collect()} == {"mine"}


def test_language_id(docs, empty):
    model = langid.train(docs)
    out = langid.identify(docs, model).collect()
    assert len(out) == docs.count()
    for r in out:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 200:
            assert r.lang_pred == r.lang and 0 <= r.score <= 1
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"}
    kept = langid.reject_unknown(docs.withColumn("lang_pred", F.lit("mine")))
    assert kept.columns == [*docs.columns, "lang_pred"]
    rows = kept.collect()
    assert {r.doc_id for r in rows} >= set(range(120)) and {(r.score, r.lang_pred) for r in rows} == {("clash", "mine")}


def test_language_id_of_rows_it_has_not_learned_from(spark):
    rng = np.random.default_rng(12)
    tongues = {"en": ENGLISH, "fr": FRENCH, "de": "der hund schläft unter dem tisch neben dem offenen fenster während die kinder spielen".split()}
    rows = [(i, " ".join(rng.choice(tongues[lang], int(rng.integers(6, 30)))), lang) for i, lang in enumerate(rng.choice(list(tongues), 300).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where(langid.remainder(4) != 2), sample_rows=60)
    held = langid.identify(docs.where(langid.remainder(4) == 2).drop("lang"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 40 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    one = spark.createDataFrame([(1, "the same text again and again", "en")] * 500 + [(2, "le chat dort", "fr")], "doc_id long, text string, lang string")
    assert langid.train(one, sample_rows=5).languages == ["en", "fr"]


def test_langid_features_by_hand():
    data = np.frombuffer("Ab1cÉ  é".encode(), np.uint8)
    places, counts = next(langid.features(data, np.array([0, len(data)])))
    # letters ab|c|é|é with one mark for each run of others: a b _ c é _ é
    assert counts.sum() == 7 + 6 + 5


def test_temperature_improves_overconfident_scores():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    s = [np.array([8.0, 0.0]) if (t == 0) == (rng.random() < 0.8) else np.array([0.0, 8.0]) for t in y]
    assert langid._temperature(s, y.tolist()) > 3


def test_mixing(docs, empty):
    out = mixing.mix(docs, block_words=8, shard_words=256).collect()
    assert len(out) == docs.count()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total = dict.fromkeys(order, 0.0), sum(size.values())
    free, left = set(order), float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 * total and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(32, 0.05 * target[s]), (s, taken[s], target[s])
    key = lambda rs: sorted(map(repr, rs))
    assert key(out) == key(mixing.mix(docs, block_words=8, shard_words=256).collect())
    assert mixing.mix(empty).count() == 0
    clash = {"target": "t", "source_size": "s", "size": "z", "taken": "k"}
    texts = mixing.mix_texts(docs.withColumns({k: F.lit(v) for k, v in clash.items()}), block_words=8, shard_words=256)
    assert texts.columns == [*docs.columns, *clash]
    assert {tuple(r) for r in texts.select(*clash).collect()} == {tuple(clash.values())}
    real = collections.Counter()
    for r in texts.collect():
        real[r.source] += len(words(r.text))
    assert {s: n for s, n in real.items() if n} == {s: n for s, n in taken.items() if n}


def test_apportionment_takes_the_highest_quotients(spark):
    weights = [503, 302, 195, 17, 0, 90]
    for seats in (0, 1, 7, 50, 1001):
        best = sorted(((-w / (2 * k + 1), i) for i, w in enumerate(weights) for k in range(seats + 1) if w))[:seats]
        want = collections.Counter(i for _, i in best)
        df = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "i long, w long, s long")
        got = {r["i"]: r["__q"] for r in mixing.apportion(df, [], "w", "s", "i").collect()}
        assert got == {i: want[i] for i in range(len(weights))}, seats


def shingles(text, width):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    best = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            best[c] = min(best.get(c, rows[i][0]), rows[i][0])
    return [(rows[i][0], len(sets[i]), (best.get(comp[i]) if sets[i] else rows[i][0])) for i in range(len(rows))]


def test_minhash_finds_all_links(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = collections.Counter(brute_components(rows, 3, 85))
    out = minhash.near_duplicates(docs, 3, 85).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(120)) <= set(ids) and [i for i in ids if i is not None and 200 <= i < 400] == [200]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_shingles_of_a_run_of_few_words(n):
    from tidewater.llm import textnum

    text = " ".join("abcde"[:n])
    alone = textnum.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 5)
    longer = f"{text}{' '.join('fghijk')}"
    beside = textnum.shingle_sets(np.frombuffer(longer.encode(), np.uint8), np.array([0, len(text), len(longer)]), 5)
    assert len(alone) == 1 and alone[0].tolist() == beside[0].tolist() and len(alone[0]) == 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_keep_one_of_a_table_of_few_words(spark, n):
    one = spark.createDataFrame([(7, " ".join("abcde"[:n]))], "doc_id long, text string")
    assert [r.doc_id for r in minhash.keep_one(one, width=5, percent=80).collect()] == [7]


def test_minhash_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(21)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(260):
        text = list(base)
        for k in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            text[k] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(text)))
    # a second group that shares the first half, and texts that share a passage only
    other = base[:75] + [f"v{k}" for k in range(75)]
    rows += [(300 + i, " ".join(w if rng.random() > 0.01 else "y" for w in other)) for i in range(60)]
    rows += [(400 + i, " ".join(base[20:80] + [f"z{i}_{k}" for k in range(60)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert got == collections.Counter(brute_components(rows, 3, 85))


def test_overlap_bounds_lose_no_link():
    rng = np.random.default_rng(22)
    tried = 0
    for _ in range(3000):
        p = int(rng.integers(60, 95))
        centre = set(range(int(rng.integers(10, 60))))
        one = {x for x in centre if rng.random() > 0.15} | set(rng.integers(100, 130, int(rng.integers(0, 8))).tolist()) | {0}
        sets = [one, {x for x in one if rng.random() > 0.06} | set(rng.integers(90, 130, int(rng.integers(0, 3))).tolist()) | {0}]
        shared = len(sets[0] & sets[1])
        diffs = [s ^ centre for s in sets]
        bounds = [minhash.overlap_bounds(len(s), len(d), len(centre), p) for s, d in zip(sets, diffs, strict=True)]
        for s, (_, loose, _) in zip(sets, bounds, strict=True):
            assert loose != (100 * len(s & centre) >= p * len(s | centre))
        link = 100 * shared >= p * (len(sets[0]) + len(sets[1]) - shared)
        need = bounds[0][0] + bounds[1][0]
        assert link == (2 * (100 + p) * len(diffs[0] & diffs[1]) >= need)
        if link and (bounds[0][1] or bounds[1][1]):
            tried += 1
            first = [set(sorted(d)[:b[2]]) for d, b in zip(diffs, bounds, strict=True)]
            assert len(first[0] & first[1]) >= min(minhash.EXTRA + 1, math.ceil(need / (2 * (100 + p))))
    assert tried > 50


def test_signature_is_circulant():
    h = np.array([3, 99, 12345], np.uint64)
    sig, table = minhash.signature(h), minhash.table()
    bins = (minhash.textnum.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(44)).astype(int)
    assert sig.tolist() == [min(int(table[(b + k)]) for b in bins) for k in range(minhash.BANDS * minhash.ROWS)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in minhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_components_of_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    spark.sparkContext.setJobGroup("few links", "few links")
    try:
        minhash.components(links).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_few_links_equal_those_of_many(spark, monkeypatch):
    rng = np.random.default_rng(23)
    links = spark.createDataFrame([(bytes([int(a)]), bytes([int(b)])) for a, b in rng.integers(0, 250, (170, 2)) if a != b], "a binary, b binary")
    few = {r["node"]: r["comp"] for r in minhash.components(links).collect()}
    monkeypatch.setattr(minhash, "FEW_LINKS", 0)
    assert few == {r["node"]: r["comp"] for r in minhash.components(links).collect()} and 1 < len(set(few.values())) < len(few)


def test_minhash_compares_few_members_of_a_star(spark, monkeypatch):
    rng = np.random.default_rng(24)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 29):
        text = list(base)
        for k in rng.choice(np.arange(0, 150, 6), 9, replace=False):
            text[k] = f"x{i}_{k}"  # what the centre has and they have not, they share; what they add is theirs alone
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared, verified = [], minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a, **k: compared.append(pairs.count()) or verified(pairs, *a, **k))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert got == collections.Counter(brute_components(rows, 3, 85))
    assert sum(compared[2:]) < 20  # after two rounds with centres


def test_quality_counts(docs, empty):
    rows = collections.Counter()
    for r in docs.collect():
        w, t = words(r.text), r.text or ""
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often, cover, seen, dup = collections.Counter(win), set(), set(), 0
        for k, x in enumerate(win):
            if often[x] > 1:
                cover |= {k, k + 1, k + 2}
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        rows[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))] += 1
    got = collections.Counter(tuple(r) for r in quality.counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == rows
    assert quality.quality(empty).count() == 0
    for r in quality.quality(docs).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_em_recovers_rates():
    rng = np.random.default_rng(2)
    seen = collections.Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        seen[tuple(None if rng.random() < 0.2 else int(rng.random() >= (g if good else b)) for g, b in ((0.05, 0.9), (0.1, 0.8), (0.2, 0.7), (0.02, 0.6)))] += 1
    m = quality.fit(sorted(seen.items(), key=str))
    assert abs(m.prior - 0.7) < 0.03 and abs(m.bad_if_good[1] - 0.1) < 0.03 and abs(m.bad_if_bad[2] - 0.7) < 0.04


@pytest.mark.parametrize("name,drop", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_give_the_tokenizers_ids(name, drop):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    alphabet = ["a", "B", "é", " ", " ", "\n", ".", ",", "'", "s", "1", " ", "　", "日", "\t", "-", "!", "…", "\x1c", "ß", "́"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(3000)] + ["", "a  b\n\nc ", "it's  don't, x.", "<|endoftext|> x", "\n\n", "end.", "日本 語。 a"]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = []
    for a, b, ids, at in tokens.encoded(pa.array(texts), public_tokenizers.path(name), drop, None):
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(b - a)]
    assert got == want


def test_token_file_round_trip():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.zipf(1.3, 5000) % 70000, np.arange(66000)]).astype(np.uint32)
    counts = np.array([0, 4000, 1000, 66000])
    back, n, names = tokenbin.unpack(tokenbin.pack(ids, counts, [7, None, 9, -3]))
    assert (back == ids).all() and n.tolist() == counts.tolist() and names == [7, None, 9, -3]
    assert tokenbin.unpack(tokenbin.pack(ids[:0], counts[:0], []))[0].size == 0


def test_token_files_of_one_doc_id(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(3, f"text {i % 50}") for i in range(200)] + [(None, f"none {i}") for i in range(20)] + [(9, "last")]
    got = []
    for k, parts in enumerate((2, 5)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = tokenbin.read_tokens(tokenbin.write_tokens(docs, str(tmp_path / f"t{k}"), path))
        got.append(sorted((r.start, r.doc_id, list(r.ids)) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == len(rows) and got[0][0][1] is None and got[0][-1][1] == 9


def test_token_files(docs, empty, spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))  # rows of one doc_id are equal here
    got = tokenbin.read_tokens(tokenbin.write_tokens(docs, str(tmp_path / "t"), path)).orderBy("start").collect()
    start = 0
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (doc_id, start, len(ids), ids)
        start += len(ids)
    assert tokenbin.read_tokens(tokenbin.write_tokens(empty, str(tmp_path / "e"), path)).count() == 0


def test_lm_scores(docs, empty):
    train = docs.where("doc_id % 3 <> 0")
    scorer = lmscore.train(train)
    n = collections.Counter(w for r in train.collect() for w in [*words((r.text or "").translate(LOW)), None])
    total, distinct = sum(n.values()), len(n)
    assert (scorer.tokens, scorer.words) == (total, distinct) and scorer.false_positives < 0.05
    out = lmscore.score(docs.withColumn("held_out", F.lit(False)), scorer).collect()
    want = collections.Counter()
    for r in docs.collect():
        w = [*words((r.text or "").translate(LOW)), None]
        want[(r.doc_id, len(w), sum(n[x] > 0 for x in w), round(sum(math.log10((n[x] + 1) / (total + distinct + 1)) for x in w), 6))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.score <= 0 for r in out)
    assert lmscore.score(empty.withColumn("held_out", F.lit(False)), scorer).count() == 0
    assert {r.score for r in lmscore.score(docs.withColumn("held_out", F.lit(False)), lmscore.train(empty)).collect()} == {0.0}


def test_lm_filter_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "MAX_BITS", 1 << 16, raising=False)
    monkeypatch.setattr(lmscore, "SLICE_BYTES", 1 << 12, raising=False)
    rows = [(i, " ".join(f"w{i * 7 + j}" for j in range(60)) + " both ends") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    many = lmscore.train(docs)
    assert many.false_positives < 0.05
    absent = lmscore.textnum.mix(np.arange(1, 5001, dtype=np.uint64))
    assert (many.levels(absent) > 0).mean() < 0.05
    monkeypatch.setattr(lmscore, "SLICE_BYTES", 1 << 25, raising=False)
    got = [{r.doc_id: (r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lmscore.score(docs, m).collect()} for m in (many, lmscore.train(docs))]
    assert got[0] == got[1] and len(got[0]) == 1000 and {x[0] for x in got[0].values()} == {63}


def test_lm_knows_pairs_seen_once(spark):
    train = spark.createDataFrame([(0, "once upon a time")], "doc_id long, text string")
    held = spark.createDataFrame([(1, "once upon a time", True), (2, "time a upon once", True)], "doc_id long, text string, held_out boolean").select("doc_id", "held_out", "text")
    got = {r.doc_id: r.score for r in lmscore.score(held, lmscore.train(train)).collect()}
    # every pair of the first has the whole share of its word; no pair of the second was seen
    floor = 5 + (5 + 1)
    assert got[1] == pytest.approx(5 * math.log10(0.5 + 0.5 * 2 / floor)) and got[2] == pytest.approx(5 * math.log10(0.5 * 2 / floor))


def test_bloom_counts_are_quantised():
    keys = lmscore.textnum.mix(np.arange(1, 2001, dtype=np.uint64)) >> np.uint64(6)
    counts = np.repeat([1, 2, 5, 100], 500)
    entries = int(lmscore.levels_of(counts).sum())
    size = 1 << (lmscore.BITS_PER_ENTRY * entries - 1).bit_length()
    bits = lmscore.build_segment(keys, lmscore.levels_of(counts).astype(np.uint8), size)
    s = lmscore.Scorer(bits, 58, size, 1, 1, entries, [])
    got = s.levels(keys & np.uint64((1 << 58) - 1))
    exact = lmscore.levels_of(counts)
    assert (got >= exact).all() and (got == exact).mean() > 0.95
    assert ((lmscore.LEAST[exact] <= counts) & (counts <= lmscore.GREATEST[exact])).all()


def test_lm_scores_equal_a_plain_model_and_sum_to_at_most_one(spark):
    rng = np.random.default_rng(9)
    names = [f"w{k}" for k in range(25)]
    texts = [" ".join(rng.choice(names, 30, p=np.arange(1, 26) / 325)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.lit(False))
    scorer = lmscore.train(docs)
    one, two = collections.Counter(), collections.Counter()
    for t in texts:
        w = [None, *t.split(), None]
        one.update(w[1:])
        two.update(zip(w[:-1], w[1:], strict=True))
    level = lambda c: int(lmscore.levels_of(np.array([c]))[0]) if c else 0
    floor = sum(one.values()) + len(one) + 1

    def p(before, word):
        share = lmscore.LEAST[level(two[before, word])] / lmscore.GREATEST[level(one[before])]
        return 0.5 * min(1, share) + 0.5 * (lmscore.LEAST[level(one[word])] + 1) / floor

    for before in [None, *names]:
        assert sum(p(before, w) for w in [None, *names]) <= 1
    # the filter's levels are never below the true ones, and seldom above
    got = {r.doc_id: r.score for r in lmscore.score(docs.select("doc_id", "held_out", "text"), scorer).collect()}
    told, true = [], []
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        h, first = lmscore.token_hashes(data, np.array([0, len(data)]))
        pairs, before = lmscore.pair_hashes(h, first)
        w = [None, *t.split(), None]
        words_of, pairs_of, before_of = (scorer.levels(x).astype(int) for x in (h, pairs, before))
        told += [*words_of, *pairs_of]
        true += [*(level(one[x]) for x in w[1:]), *(level(two[x]) for x in zip(w[:-1], w[1:], strict=True))]
        want = sum(math.log10(0.5 * min(1, lmscore.LEAST[b] / lmscore.GREATEST[c]) + 0.5 * (lmscore.LEAST[a] + 1) / floor) for a, b, c in zip(words_of, pairs_of, before_of, strict=True))
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert (np.array(told) >= np.array(true)).all() and np.mean(np.array(told) == np.array(true)) > 0.9


def test_lm_scores_held_out_rows_above_the_base(spark):
    rng = np.random.default_rng(10)
    follow = {k: rng.choice(400, 4) for k in range(400)}
    rows = []
    for i in range(600):
        w = [int(rng.integers(400))]
        for _ in range(60):
            w.append(int(rng.choice(follow[w[-1]])))
        rows.append((i, i % 5 == 0, " ".join(f"w{k}" for k in w)))
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")
    got = lmscore.score(docs, lmscore.train(docs.where("NOT held_out"))).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > 0.7 * got["b"]  # both are negative


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[300:360] = v[5]
    rows = [(i, [float(x) for x in v[i]], "clash") for i in range(400)]
    rows += [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [float("nan")] * 16, ""), (1003, [None] + [1.0] * 15, ""), (1004, [1.0], ""), (1005, [], ""), (None, [1.0] * 16, ""), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = ann.search(df, df.where("vec_id % 20 = 0")).collect()
    x = v.astype(np.float64)
    for q in range(0, 400, 20):
        got = [r for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q]
        s = x @ x[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert len(set(best) & {r.vec_id for r in got}) >= 18
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in got)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id < 3"), df.where("vec_id < 3")).count() == 6


def test_nearest_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    v[::3] = v[0] + rng.normal(size=(1000, 32)).astype(np.float32) * np.float32(0.01)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(3000)], "vec_id long, embedding array<float>")
    out = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 100 = 0"), rerank=24, sample=300).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.vec_id)
    x = v.astype(np.float64)
    for q in range(0, 3000, 100):
        s = x @ x[q]
        assert out[q] == sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:20]


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 80
    rows = [(5, "http://a/", long), (3, "http://b/\r\nX: y", long), (9, None, long), (None, "http://n/", long), (1, "http://c/", "short"), (2, "http://d/", "short"), (4, "http://e/", None), (7, "http://f/", ""), (8, "http://g/", "z" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    got = {r.page_id: r for r in back.collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == hashlib.sha256(body).hexdigest()
        if got[i].record_type == "response":
            assert bytes(got[i].payload) == body and got[i].refers_to is None
        else:
            assert got[i].refers_to == 3 and got[i].payload is None
    assert {i for i in got if got[i].record_type == "revisit"} == {5, 9, None}
    assert back.where("record_type = 'revisit'").count() == 3 and back.where("page_id IN (1, 2)").count() == 2
    assert warc.read_warc(spark, str(tmp_path / "w"), payload=False).where("payload IS NOT NULL").count() == 0
    assert not warc.write_warc(pages.limit(0), str(tmp_path / "e")).head(1)


def test_warc_skips_payloads(tmp_path):
    import io

    body = warc.header_bytes({"record_type": "response", "record_id": "a", "date": "d", "target_uri": "u", "page_id": 1, "payload_digest": "x", "payload_bytes": 5}, 5) + b"hello\r\n\r\n"
    source = warc._Bytes(io.BytesIO(body * 2), False)
    assert warc.parse_header(source.until(b"\r\n\r\n"))["content-length"] == "5"
    assert source.take(5, False) is None and source.take(4) == b"\r\n\r\n"
    with pytest.raises(ValueError):
        warc._Bytes(io.BytesIO(body[:-8]), False).take(10**6)


def check_packing(lengths, size):
    plan = packing.Plan(collections.Counter(lengths), size)
    placed, filled = collections.Counter(), collections.defaultdict(list)
    for s, rank, count, first, each, offset in plan.runs:
        placed[s] += count
        for k in range(count):
            filled[first + k // each].append((offset + k % each * s, s))
    assert placed == collections.Counter(lengths) and len(filled) == plan.sequences
    for parts in filled.values():
        at = 0
        for offset, s in sorted(parts):
            assert offset == at
            at += s
        assert at <= size
    return plan


def test_packing_plan_places_everything_and_is_good():
    rng = np.random.default_rng(6)
    for size, low, high in ((20, 1, 21), (30, 8, 31), (50, 10, 40), (4096, 1, 4097)):
        for _ in range(30):
            lengths = rng.integers(low, min(high, size + 1), rng.integers(1, 200)).tolist()
            plan = check_packing(lengths, size)
            assert plan.sequences >= -(-sum(lengths) // size)
    assert check_packing([10] * 7 + [5] * 3, 20).sequences == 5
    assert check_packing([], 20).sequences == 0


def test_reduction_is_never_worse_than_the_optimum():
    from functools import cache

    rng = np.random.default_rng(8)

    def optimum(lengths, size):
        @cache
        def go(left, rooms):
            if not left:
                return len(rooms)
            s, rest = left[0], left[1:]
            best = go(rest, tuple(sorted((*rooms, size - s))))
            for r in set(rooms):
                if r >= s:
                    other = list(rooms)
                    other.remove(r)
                    best = min(best, go(rest, tuple(sorted((*other, r - s)))))
            return best

        return go(tuple(sorted(lengths, reverse=True)), ())

    for _ in range(60):
        lengths = rng.integers(3, 20, 8).tolist()
        plan = check_packing(lengths, 20)
        if plan.fixed == plan.sequences:
            assert plan.sequences == optimum(lengths, 20)


def test_packed_documents(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[(r.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))] += 1
    out = packing.pack_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(empty).count() == 0
