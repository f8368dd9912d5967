"""The corpus pipeline: each stage against plain Python on what its predecessor kept."""

import collections

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_ops import brute_components, corpus, words
from tokenizers import Tokenizer

from tidewater.llm import langid, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n string, cls string"
STAGE = dict(corpus_pipeline.STAGES)
CLASH = {"n_lines": "a", "target": "b", "lang_pred": "c", "pass": "d"}


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returned, by name, with the documents as they came under "documents"."""
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()}).write.parquet(str(at / "documents.parquet"))
    out = {"documents": spark.read.parquet(str(at / "documents.parquet"))}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(at)).write.parquet(str(at / name))
        docs = out[name] = spark.read.parquet(str(at / name))
    return out


def test_stages_keep_the_columns(kept):
    want = kept["documents"].columns
    for name in ("language_id", "line_dedup", "near_dedup", "mixing"):
        assert kept[name].columns == want, name
        assert {tuple(r) for r in kept[name].select(*CLASH, "score").distinct().collect()} == {(*CLASH.values(), "clash")}


def test_language_stage_drops_what_it_cannot_tell(kept):
    model = langid.train(kept["documents"].where(langid.remainder(4) != 2))
    want = collections.Counter()
    for r in kept["documents"].collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        label, score = model.predict(*next(langid.features(data, np.array([0, len(data)]))))
        if label != "und" and score >= 0.5:
            want[r.doc_id, r.text] += 1
    assert collections.Counter((r.doc_id, r.text) for r in kept["language_id"].collect()) == want
    assert {r.doc_id for r in kept["documents"].collect()} - {k for k, _ in want} >= {400, 401, 402, 403}


def test_line_stage(kept):
    sites = collections.defaultdict(set)
    rows = kept["language_id"].collect()
    for r in rows:
        for line in r.text.split("\n"):
            if line.strip(" \t\n\v\f\r") and r.source is not None:
                sites[line.strip(" \t\n\v\f\r")].add(r.source)
    bad = {k for k, v in sites.items() if len(v) >= 5}
    want = collections.Counter((r.doc_id, "\n".join(x for x in r.text.split("\n") if x.strip(" \t\n\v\f\r") not in bad)) for r in rows)
    assert bad and collections.Counter((r.doc_id, r.text) for r in kept["line_dedup"].collect()) == want


def test_near_stage_keeps_one_of_each_group(kept):
    rows = [(r.doc_id, r.text) for r in kept["line_dedup"].collect()]
    groups = brute_components(rows, 5, 80)
    want = collections.Counter(row for row, (i, _, component) in zip(rows, groups, strict=True) if i == component)
    assert collections.Counter((r.doc_id, r.text) for r in kept["near_dedup"].collect()) == want and sum(want.values()) < len(rows)


def test_mixing_stage_takes_the_words_of_the_mix(kept):
    want, most = collections.Counter(), collections.Counter()
    for r in mixing.mix(kept["near_dedup"]).collect():
        want[r.source] += r.taken
        most[r.doc_id] += 3 * r.size
    got, by = collections.Counter(), collections.Counter()
    texts = collections.defaultdict(list)
    for r in kept["near_dedup"].collect():
        texts[r.doc_id].append(words(r.text))
    for r in kept["mixing"].collect():
        w = words(r.text)
        got[r.source] += len(w)
        by[r.doc_id] += len(w)
        assert r.n_chars == len(r.text) and any(set(w) <= set(t) for t in texts[r.doc_id])
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}
    assert all(n <= most[k] for k, n in by.items())


def test_packing_stage_holds_the_tokens_of_the_mix(kept):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = collections.Counter()
    for r in kept["mixing"].collect():
        ids = t.encode(r.text, add_special_tokens=False).ids + [1]
        want.update((r.doc_id, k, tuple(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096)))
    rows = kept["packing"].collect()
    assert collections.Counter((r.doc_id, r.piece, tuple(r.ids)) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids)
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
