"""The pipeline's rows against the stages done by brute force, one document at a time."""

import os

import pytest

import corpus_pipeline
from triplicate.llm import pii, tokens, toxicity
from triplicate.llm.common import table

SF = "/root/testdata/sf0.001"


def _small(spark, folder):
    """Every odd text, copies, near copies, a shared passage and toxic documents; more columns than needed."""
    from test_texts import odd_texts

    toxic = [f"alpha beta grumbletoad gamma{i} delta{i % 7}" for i in range(40)]
    clean = [f"alpha beta epsilon gamma{i} delta{i % 7} zeta eta theta iota kappa lambda {i}" for i in range(40)]
    mails = [f"write to someone{i}@example.org or call +49 151 2345{i:04d} on day {i} of the month of may in the year of our tests" for i in range(10)]
    texts = odd_texts() + toxic + clean + mails
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    first = len(odd_texts())
    labels = [(first + i, int(i < 40)) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")


def _near(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    ids, gone = sorted(texts), set()
    label = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i for i in ids if label[i] == i}


def _cut(texts):
    words = {i: t.split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        hit = [first[tuple(w[k : k + 13])] < i for k in range(len(w) - 12)]
        out[i] = [x for j, x in enumerate(w) if not any(hit[max(0, j - 12) : j + 1])]
    return out


@pytest.mark.parametrize("made", [True, False])
def test_the_pipeline_is_its_stages_by_brute_force(spark, tmp_path, made):
    if made:
        _small(spark, str(tmp_path))
    elif not os.path.isdir(SF):
        pytest.skip("needs the tables")
    folder = str(tmp_path) if made else SF
    docs = table(spark, folder, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.train(docs, table(spark, folder, "labels"))
    alone = toxicity.Scorer(model)
    left = {i: t for i, t in texts.items() if alone.score([t])[0] < 0.5}
    assert len(left) < len(texts)
    kept = _near(left)
    assert len(kept) < len(left)
    cut = _cut({i: left[i] for i in kept})
    stages = dict(corpus_pipeline.STAGES)
    rows = docs
    for name in ("toxicity", "near_duplicates", "substrings"):
        rows = stages[name](spark, rows, folder)
    found = {r.doc_id: r for r in rows.collect()}
    assert set(found) == kept and rows.columns == docs.columns
    assert {i: (r.text or "").split() for i, r in found.items()} == cut
    encode = tokens.ByteEncoder("byte_bpe_50k.json").encode
    final = {r.doc_id: r.text or "" for r in pii.redact_pii(rows).collect()}
    size = {i: len(encode(t)) // 4 + 1 for i, t in final.items()}
    packed = corpus_pipeline.run(spark, folder).collect()
    of, bins = {}, {}
    for r in packed:
        of[r.doc_id] = of.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert of == size
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_the_stages_take_an_empty_table(spark, tmp_path):
    _small(spark, str(tmp_path))
    none = table(spark, str(tmp_path), "documents").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
