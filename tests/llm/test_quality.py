import zlib

import numpy as np

from quarry.llm import quality
from quarry.llm.catalogue import QUERIES

SF = "/root/testdata/sf0.01"


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 4, 2)]
    y, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model = quality.train([], np.zeros(0), np.zeros(0), 0.5)
    x, starts = np.concatenate(bags), np.array([0, 1, 5])

    def loss():
        p = model.forward(x, starts)["score"]
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())

    grad = model.gradient(x, starts, y, weight)
    for name, value in model.p.items():
        flat = value.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - grad[name].reshape(-1)[i]) < 1e-6


def test_attention_sums_to_one_and_weighs_the_mean():
    rng = np.random.default_rng(2)
    model = quality.train([], np.zeros(0), np.zeros(0), 0.5)
    x = rng.normal(size=(7, quality.FEATURES))
    f = model.forward(x, np.array([0, 3]))
    assert np.allclose(np.add.reduceat(f["a"], [0, 3]), 1)
    assert np.allclose(f["z"][1], (f["a"][3:, None] * f["h"][3:]).sum(0))


def test_every_passage_counts():
    long = b"word " * 64 * 50 + b"%%% *** &&& " * 30
    assert len(quality.passages(long)) == 52 and not np.allclose(quality.passages(long)[-1], quality.passages(long)[0])


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op2_quality"](spark, SF).collect()
    assert len(rows) == 1000
    assert all(
        r.held_out == (
            zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        ) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows
    )
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.97


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels.select("doc_id", "quality"), max_bags=40)
    got = quality.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].score == by[4].score and by[3].n_passages == 1 and by[6].n_passages == -(-30_000 // 64)
    assert quality.score(no_docs, model).count() == 0
    none = quality.fit(no_docs, labels.select("doc_id", "quality").limit(0))
    assert {r.score for r in quality.score(odd_docs, none).collect()} == {0.5}
