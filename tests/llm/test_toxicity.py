import zlib

import numpy as np
import pytest

from quarry.llm import toxicity
from quarry.llm.catalogue import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def small(spark):
    import random

    rnd = random.Random(1)
    plain = ["".join(rnd.choice("aeioubdfgkl") for _ in range(9)) for i in range(400)]
    docs, labels = [], []
    for i in range(400):
        body = [rnd.choice(plain) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for w in rnd.sample(["vile", "rotten", "nasty", "hatefulness"], 2):
                body[rnd.randrange(60)] = w
        docs.append((i, " ".join(body)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_index_equals_full_comparison():
    rng = np.random.default_rng(3)
    n_terms = 60
    examples = []
    for i in range(500):
        at = rng.choice(n_terms, rng.integers(0, 6), replace=False)
        examples.append((i, int(rng.random() < 0.4), [f"t{j}" for j in at], rng.integers(1, 4, len(at)).tolist()))
    terms = [f"t{j}" for j in range(n_terms)]
    model = toxicity.build(examples, (300, 200), terms, {t: 5 + i for i, t in enumerate(terms)}, 1000)
    dense = np.zeros((len(model.ids), n_terms))
    by_id = {e[0]: e for e in examples}
    for row, i in enumerate(model.ids.tolist()):
        at, w = model.vector({model.vocabulary.place[t]: c for t, c in zip(by_id[i][2], by_id[i][3], strict=True)})
        dense[row, at] = w
    for _ in range(200):
        at = np.sort(rng.choice(n_terms, rng.integers(1, 6), replace=False))
        w = rng.random(len(at))
        w /= np.sqrt((w * w).sum())
        found, cosine = model.nearest(at, w, 10)
        full = dense[:, at] @ w
        order = np.lexsort((np.arange(len(full)), -np.round(full, 9)))[:10]
        order = order[full[order] > 0]
        assert found.tolist() == order.tolist() and np.allclose(cosine, full[order])


def test_blocks_are_skipped(small):
    docs, labels = small
    model = toxicity.fit(docs, labels)
    assert {"vile", "rotten", "nasty", "hatefulness"} <= set(model.vocabulary.place)
    assert model.score("some vile and rotten text")[0] > 0.8 > 0.2 > model.score("word and word")[0]
    assert model.score("some vile text")[1], "evidence"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op1_toxicity"](spark, SF).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(
        r.held_out == (
            zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        ) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows
    )
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.85


def test_odd_rows(spark, small, odd_docs, no_docs):
    docs, labels = small
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (99999, 1)], labels.schema)))
    got = {r.doc_id: r for r in toxicity.score(odd_docs, model).collect()}
    assert got[3].score == got[4].score == got[7].score == model.empty and got[3].neighbours == []
    assert toxicity.score(odd_docs, model).count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.fit(no_docs, labels.limit(0))
    assert toxicity.score(odd_docs, none).filter("score >= 0 and score <= 1").count() == odd_docs.count()
    assert toxicity.fit(no_docs, labels).vocabulary.place == {}


def test_known_terms_are_those_of_all():
    text = "Abcdefgh abcdefxx abcdzzzz, abc ABCDEFGH é_éééé 12abcde"
    every = toxicity.terms_of(text)
    assert every["abcd*"] == 5 and every["abcdef*3"] == 1 and "abcdz*2" not in every and every["abcdefgh"] == 2
    chosen = ["abcdefgh", "abcd*3", "abcdef*", "abcdef*2", "abcdz*2", "none", "abcdefg*"]
    assert toxicity.Vocabulary(chosen).counts(text) == {i: every[t] for i, t in enumerate(chosen) if t in every}
