import re

import numpy as np
import pyarrow as pa
import pytest

from twigspark.llm import hashing
from twigspark.llm import quality_model as Q


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    w = {"W": r.normal(size=(6, 5)), "b": r.normal(size=5), "V": r.normal(size=(5, 3)), "U": r.normal(size=(5, 3)), "w": r.normal(size=3), "c": r.normal(size=5), "d": r.normal(size=1)}
    x, first, y, k = r.normal(size=(9, 6)), np.array([0, 2, 5, 9]), np.array([0.0, 1, 1]), np.ones(3)
    _, g = Q.gradients(w, x, first, y, k)
    for n in w:
        for i in list(np.ndindex(w[n].shape))[:4]:
            old, e = w[n][i], 1e-6
            w[n][i] = old + e
            up, _ = Q.gradients(w, x, first, y, k)
            w[n][i] = old - e
            down, _ = Q.gradients(w, x, first, y, k)
            w[n][i] = old
            assert abs((up - down) / (2 * e) - g[n][i]) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    out = got[got.held_out]
    assert len(out) > 500
    assert auc(out.quality.to_numpy(), out.score.to_numpy()) > 0.95
    assert (out.predicted == out.quality).mean() > 0.93
    assert out.predicted[out.quality == 1].mean() > 0.97


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "word " * 30_000, "é", "x" * 2_000_000]
    y = [0, 1] * 20
    model = Q.train(["good plain text here"] * 20 + ["### $$$ %%%"] * 20, np.array(sorted(y, reverse=True)))
    s = Q.scores(model, pa.array(texts))
    assert len(s) == 7 and (s >= 0).all() and (s <= 1).all() and s[0] == s[1]
    assert np.allclose(Q.scores(model, pa.array(texts[3:6])), s[3:6], atol=1e-5)
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)] + [(0, None, 0.5)], "doc_id long, text string, score double")
    assert Q.keep(df, model, 0.0).columns == df.columns and Q.keep(df, model, 0.0).count() == 8
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.report(df, none).collect()} == {0.5}
    assert Q.report(df.limit(0), none).collect() == []


def test_passages_cover_whole_texts():
    texts = pa.array(["a " * 100, "", "b " * 48, None, "c"])
    ((_, first, chunks),) = Q.passages(texts)
    assert np.diff(first).tolist() == [3, 1, 1, 1, 1]
    assert sum(int((c[5] - c[4]).sum()) for c in chunks) == 149
    x = Q.features(chunks[0])
    assert x.shape == (7, Q.BUCKETS + Q.MEASURES) and pytest.approx(x[0, Q.BUCKETS + len(Q._CLASSES)], 1e-5) == np.log1p(48)


def plain_score(model, text):
    """One text, passage by passage, as the method is stated."""
    data = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    hidden, pull = [], []
    for k in range(0, max(1, len(found)), Q.PASSAGE_WORDS):
        part = found[k : k + Q.PASSAGE_WORDS]
        a = found[k][0] if k else 0
        b = found[k + Q.PASSAGE_WORDS][0] if k + Q.PASSAGE_WORDS < len(found) else len(data)
        raw, words = data[a:b], [data[s:e] for s, e in part]
        hashes = [int(hashing.word_hashes(np.frombuffer(w, "u1"), np.array([0]), np.array([len(w)]))[0]) for w in words]
        x = np.zeros(Q.BUCKETS + Q.MEASURES)
        for h in hashes:
            x[(h >> 40) % Q.BUCKETS] += 1
        distinct = np.count_nonzero(x)
        x /= max(1e-6, np.sqrt((x * x).sum()))
        for j, chars in enumerate(Q._CLASSES):
            x[Q.BUCKETS + j] = np.sqrt(sum(c in chars for c in raw) / max(1, len(raw)))
        n = max(1, len(words))
        x[Q.BUCKETS + len(Q._CLASSES) :] = np.log1p(len(words)), sum(map(len, words)) / n, distinct / n, sum(p == q for p, q in zip(hashes, hashes[1:], strict=False)) / n, not words
        w = model.weights
        h = np.tanh((x - model.middle) / model.spread @ w["W"] + w["b"])
        hidden.append(h)
        pull.append(float(np.tanh(h @ w["V"]) / (1 + np.exp(-h @ w["U"])) @ w["w"]))
    share = np.exp(np.array(pull) - max(pull))
    share /= share.sum()
    return 1 / (1 + np.exp(-(sum(s * h for s, h in zip(share, hidden, strict=True)) @ w["c"] + w["d"][0])))


def test_scores_equal_a_plain_scorer(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(docs, labels)
    odd = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([None, "", " \n", "é " * 100, "a\nb", "#|$ " * 47 + "x  ", "w " * 48, "w " * 49])], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    got = Q.score(rows, model).collect()
    assert len(got) == docs.count() + 8
    for r in got:
        assert abs(r.score - plain_score(model, r.text)) < 1e-4
