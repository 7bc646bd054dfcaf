"""The quality classifier: gradients, whole texts, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow.dataset as ds

from pinwright.llm import attention
from pinwright.llm.attention import AttentionModel, passages, stretches
from pinwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def loss(model, x, sizes, labels):
    h, _, _, logit = model.encoded(x)
    out, at = 0.0, 0
    for n, y in zip(sizes, labels):
        weight = np.exp(logit[at:at + n] - logit[at:at + n].max())
        bag = (weight / weight.sum()) @ h[at:at + n]
        s = 1 / (1 + np.exp(-(bag @ model.weights["c"] + model.weights["d"])))
        out -= np.log(s if y else 1 - s)
        at += n
    return out / len(labels)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = AttentionModel.blank(0.7, hidden=4, gate=3)
    model.weights = {k: np.asarray(w + rng.normal(0, 0.3, np.shape(w))) for k, w in model.weights.items()}
    x, sizes, labels = rng.normal(size=(9, attention.WIDTH)), np.array([1, 5, 3]), np.array([1.0, 0.0, 1.0])
    found = model._gradient(x, sizes, labels)
    for k, w in model.weights.items():
        for at in list(np.ndindex(w.shape))[:40]:
            old, eps = w[at], 1e-5
            w[at] = old + eps
            up = loss(model, x, sizes, labels)
            w[at] = old - eps
            down = loss(model, x, sizes, labels)
            w[at] = old
            assert abs((up - down) / 2 / eps - np.asarray(found[k])[at]) < 1e-6


def test_passages():
    features, sizes = passages([b"", b"One two", b" \n ", b"w " * 130, b"a b c d a b c d"])
    assert sizes.tolist() == [1, 1, 1, 3, 1] and np.isfinite(features).all()
    shapes = features[:, 256:]
    assert shapes[1, 3] == 0.5 and (shapes[0] == 0).all()  # capitals at the begin of half the words
    assert shapes[6, 8] == 7 / 8 and shapes[1, 8] == 1  # new four-word runs; those that run out of the text are new


def test_long_texts_are_scored_whole(monkeypatch):
    model = AttentionModel.blank(0.5)
    rng = np.random.default_rng(2)
    model.weights = {k: np.asarray(w + rng.normal(0, 0.5, np.shape(w))) for k, w in model.weights.items()}
    whole = ["", "some words of a text. " * 400, "z" * 3000, "x y\n" * 900, "short"]
    monkeypatch.setattr(attention, "STRETCH", 1000)
    want = []
    for t in whole:
        made = [passages([p]) for p in stretches(t.encode())]
        assert b"".join(stretches(t.encode())) == t.encode()
        h, _, _, logit = model.encoded(model.scaled(np.concatenate([f for f, _ in made])))
        weight = np.exp(logit - logit.max())
        want.append(1 / (1 + np.exp(-((weight / weight.sum()) @ h @ model.weights["c"] + model.weights["d"]))))
    assert np.allclose(model.scores(whole), want)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op11_quality_classifier"](spark, SF).collect()}
    docs = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id"]).column(0).to_pylist()
    assert sorted(got) == sorted(docs)
    marks = {r["doc_id"]: r["quality"] for r in ds.dataset(f"{SF}/labels.parquet").to_table().to_pylist()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
               for i, r in got.items())
    for q in (0, 1):
        held = [got[i].predicted for i, m in marks.items() if m == q and got[i].held_out]
        assert len(held) >= 5 and np.mean(np.array(held) == q) >= 0.9


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", attention.F.when(attention.held_out(), 1 - labels.quality).otherwise(labels.quality))
    a, b = (attention.fit_quality(docs, x) for x in (labels, other))
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights)


def test_odd_rows(spark, docs, odd_texts):
    rows = docs([(i, t) for i, t in enumerate(odd_texts)] + [(None, "no id"), (1, "again"), (1, "again")]).withColumnRenamed("lang", "score").withColumnRenamed("source", "_text")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, None), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = attention.quality_scores(rows, attention.fit_quality(rows, labels)).collect()
    assert len(got) == len(odd_texts) + 3 and all(0 <= r.score <= 1 for r in got)
    blank = attention.fit_quality(rows, labels.limit(0))
    assert {round(r.score, 6) for r in attention.quality_scores(rows, blank).collect()} == {0.5}
    assert attention.quality_scores(rows.limit(0), blank).collect() == []
