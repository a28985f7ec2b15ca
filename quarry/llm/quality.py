"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded: shares of byte classes and word statistics, then a
learnt hidden layer. Gated attention, learnt from the documents' labels alone, weighs the passages; the weighted
mean of their codes is scored by a logistic unit. All weights are learnt together with Adam, in numpy.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import staged

#: Labelled documents for each label; the rest of the labels is not learnt from.
MAX_BAGS = 2500
PASSAGE = 64
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 64, 0.01, 1e-4, 7

#: Byte classes: 0 small letters, 1 capitals, 2 digits, 3 blanks, 4 lead bytes of other letters, 5 further bytes of them, 6 control, then marks.
_MARKS = (".", ",", "!?", ";:", "|", "$&", "%", "*#", "@", "'\"", "()[]{}<>", "-_/\\")
CLASSES = 7 + len(_MARKS) + 1
_CLASS = np.full(256, CLASSES - 1, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1], _CLASS[32] = 0, 1, 2, 3
_CLASS[0xC0:], _CLASS[0x80:0xC0], _CLASS[:32], _CLASS[127] = 4, 5, 6, 6
for _i, _m in enumerate(_MARKS):
    _CLASS[[ord(c) for c in _m]] = 7 + _i
FEATURES = CLASSES + 9


def passages(text: bytes) -> np.ndarray:
    """A row of features for every passage of the whole text; an empty text is one passage of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    out = np.zeros(((len(words) + PASSAGE - 1) // PASSAGE, FEATURES), np.float32)
    for k in range(len(out)):
        part = words[k * PASSAGE : (k + 1) * PASSAGE]
        n = len(part)
        joined = b" ".join(part)
        out[k, :CLASSES] = np.bincount(_CLASS[np.frombuffer(joined, np.uint8)], minlength=CLASSES) / len(joined)
        counts = Counter(part)
        out[k, CLASSES:] = (
            len(joined) / n / 10,
            len(counts) / n,
            sum(map(bytes.__eq__, part, part[1:])) / n,
            max(counts.values()) / n,
            sum(map(bytes.isupper, part)) / n,
            sum(map(bytes.isalpha, part)) / n,
            sum(map(bytes.isalnum, part)) / n,
            np.log1p(max(map(len, part))) / 5,
            np.log1p(n) / 5,
        )
    return out


@dataclass
class Model:
    """A few thousand numbers, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    prior: float
    trained: bool

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of several bags, each from starts[i] on."""
        p, count = self.p, np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
        a /= np.repeat(np.add.reduceat(a, starts), count)
        z = np.add.reduceat(a[:, None] * h, starts)
        s = z @ p["c"] + p["c0"]
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "count": count, "score": 1 / (1 + np.exp(-np.clip(s, -30, 30)))}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        f, p = self.forward(x, starts), self.p
        h, t, g, a, count = f["h"], f["t"], f["g"], f["a"], f["count"]
        ds = weight * (f["score"] - y) / weight.sum()
        dz = np.repeat(ds[:, None] * p["c"], count, axis=0)
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), count))
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        du = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {
            "W": x.T @ du,
            "b": du.sum(0),
            "V": h.T @ dt,
            "U": h.T @ dg,
            "w": (t * g).T @ de,
            "c": f["z"].T @ ds,
            "c0": ds.sum(keepdims=True),
        }


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, prior: float) -> Model:
    rng = np.random.default_rng(SEED)
    all_ = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    d = FEATURES
    p = {
        "W": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c0": np.array([np.log(prior / (1 - prior))]),
    }
    model = Model(all_.mean(0), all_.std(0) + 1e-3, p, prior, bool(len(y)) and 0 < y.sum() < len(y))
    if not model.trained:
        return model
    bags = [model.normal(b) for b in bags]
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            part = [bags[i] for i in pick]
            starts = np.cumsum([0, *map(len, part)])[:-1]
            grad = model.gradient(np.concatenate(part), starts, y[pick], weight[pick])
            step += 1
            for k, v in p.items():
                dk = grad[k] + DECAY * v
                first[k] = 0.9 * first[k] + 0.1 * dk
                second[k] = 0.999 * second[k] + 0.001 * dk * dk
                v -= RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS)) * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return model


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_bags: int = MAX_BAGS
) -> Model:
    """Learns from at most max_bags rows of labels(key, label) for each label, drawn by a hash of the key and weighed by their
    label's share. Rows with a null key or label, or without a document, teach nothing; of several labels of one key the
    largest holds. Without documents of both labels every score is the smoothed share of label 1."""
    known = staged(
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__y")),
        "labels",
    )
    counted = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    # bounded by 2 * max_bags rows
    drawn = [known.filter(F.col("__y") == v).orderBy(F.xxhash64("__key"), "__key").limit(max_bags) for v in (0, 1)]
    picked = staged(drawn[0].unionByName(drawn[1]), "drawn")

    def bags(batches):
        for batch in batches:
            found = [passages(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.astype("<f4").tobytes() for f in found], pa.binary())], ["__key", "bag"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text"))
    texts = rows.join(F.broadcast(picked.select("__key")), "__key", "left_semi")
    # rows of one key are one bag, the least
    found = texts.mapInArrow(bags, f"__key {kind}, bag binary").groupBy("__key").agg(F.min("bag").alias("bag"))
    rows = sorted(found.join(F.broadcast(picked), "__key").select("__key", "__y", "bag").collect(), key=lambda r: r[0])
    y = np.array([r[1] for r in rows], float)
    have = Counter(y.tolist())
    weight = np.array([counted[int(v)] / have[v] for v in y])
    prior = (counted.get(1, 0) + 1) / (sum(counted.values()) + 2)
    return train(
        [np.frombuffer(r[2], "<f4").reshape(-1, FEATURES) for r in rows],
        y,
        weight / weight.mean() if len(weight) else weight,
        prior,
    )


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_passages, top_passage, top_attention) for every row of docs: all passages of the whole text are scored.

    A null or empty text is one passage of zeros. Null keys and repeated rows are scored like others; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bags = [passages(t or b"") for t in part.column(1).to_pylist()]
                starts = np.cumsum([0, *map(len, bags)])[:-1]
                f = model.forward(model.normal(np.concatenate(bags)), starts)
                scores = f["score"] if model.trained else np.full(len(bags), model.prior)
                tops = [int(np.argmax(f["a"][s : s + n])) for s, n in zip(starts, f["count"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(scores, pa.float64()),
                        pa.array(f["count"], pa.int64()),
                        pa.array(tops, pa.int64()),
                        pa.array([float(f["a"][s + t]) for s, t in zip(starts, tops, strict=True)], pa.float64()),
                    ],
                    [key, "score", "n_passages", "top_passage", "top_attention"],
                )

    return docs.select(key, F.col(text).cast("binary").alias("__text")).mapInArrow(
        run, f"`{key}` {kind}, score double, n_passages bigint, top_passage bigint, top_attention double"
    )
