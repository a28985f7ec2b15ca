"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, through a block-max inverted index.

Terms are lower-case words and word beginnings of four to seven letters, the latter also as "twice or more" and "three times or more", as
one such word may stand in any text and several of them not. The vocabulary is chosen on labelled examples only: terms that are
MIN_LIFT times as frequent under one label as under the other, with a log-likelihood ratio that about one term in all passes by chance;
copies and near copies among the examples count once there. A document's vector has (1 + ln tf) * idf for each such
term, with document frequencies counted over the whole corpus, and length one.

Index: examples with vectors are ordered by their heaviest terms and cut into blocks. For each term the largest weight in every block
bounds the cosine that any example of a block can reach; blocks are scored exactly in the order of their bounds
until the bound falls below the K-th best cosine. So the neighbours are those of a full comparison.

Score: neighbours vote with weight 1 / (distance + SOFTEN), corrected for the sampling of the labels, together with a prior of
one vote; a logistic curve fitted on the examples' own leave-one-out votes makes it a probability. A document without any
term of the vocabulary gets the share of label 1 among such examples.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import pieces, staged

#: Labelled examples for each label; the rest of the labels is not learnt from.
MAX_EXAMPLES = 3000
MIN_LIFT = 3.0
NEIGHBOURS = 15
BLOCK = 64
SOFTEN = 0.05
TIE = 1e-9

#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")


#: How a beginning is marked as a term, and from how many occurrences on.
MARKS = ((1, "*"), (2, "*2"), (3, "*3"))


def terms_of(text: str) -> Counter:
    """Counts of words, and of beginnings of longer words."""
    words = Counter(_WORD.findall(text.lower()))
    begun: Counter = Counter()
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) > k:
                begun[w[:k]] += n
    for b, n in begun.items():
        for least, mark in MARKS:
            if n >= least:
                words[b + mark] = n if least == 1 else 1
    return words


class Vocabulary:
    """Chosen terms by place, and what is quickly known of words that have none."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.bases = {t.partition("*")[0] for t in terms if "*" in t}
        self.stems = {b[: BEGINNINGS[0]] for b in self.bases}

    def counts(self, text: str) -> dict[int, int]:
        """terms_of for the terms that have a place, by place."""
        out: dict[int, int] = {}
        begun: dict[str, int] = {}
        place, bases, stems = self.place, self.bases, self.stems
        for w, n in Counter(_WORD.findall(text.lower())).items():
            if w in place:
                out[place[w]] = n
            if w[: BEGINNINGS[0]] in stems:
                for k in BEGINNINGS:
                    if len(w) > k and (b := w[:k]) in bases:
                        begun[b] = begun.get(b, 0) + n
        for b, n in begun.items():
            for least, mark in MARKS:
                if n >= least and b + mark in place:
                    out[place[b + mark]] = n if least == 1 else 1
        return out


@dataclass
class Model:
    """The vocabulary, idf by place, examples' vectors by block, calibration. Bounded by MAX_EXAMPLES."""

    vocabulary: Vocabulary
    idf: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    prior: float
    empty: float
    curve: tuple[float, float] = (1.0, 0.0)
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    postings: list = field(default_factory=list)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), np.int64)
        w = (1 + np.log([counts[i] for i in at.tolist()])) * self.idf[at] if len(at) else np.zeros(0)
        length = np.sqrt((w * w).sum())
        return at, w / length if length else w

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings of each term by block, and each block's largest weight."""
        blocks = (len(vectors) + BLOCK - 1) // BLOCK
        self.block_max = np.zeros((len(self.idf), blocks), np.float32)
        rows: list[list[tuple[int, float]]] = [[] for _ in self.idf]
        for e, (at, w) in enumerate(vectors):
            for i, x in zip(at.tolist(), w.tolist(), strict=True):
                rows[i].append((e, x))
                # rounded up, so that the bound holds for exact weights
                self.block_max[i, e // BLOCK] = max(self.block_max[i, e // BLOCK], np.nextafter(np.float32(x), np.float32(2)))
        self.postings = []
        for found in rows:
            e = np.array([x[0] for x in found], np.int64)
            w = np.array([x[1] for x in found])
            self.postings.append((e, w, np.searchsorted(e, np.arange(blocks + 1) * BLOCK)))

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine, with them; ties by place. Exact. `but` is left out."""
        bound = w @ self.block_max[at]
        order = np.argsort(-bound, kind="stable")
        found = np.zeros(0, np.int64)
        cosine = np.zeros(0)
        worst = 0.0
        for b in order.tolist():
            if bound[b] <= 0 or (len(found) >= k and bound[b] < worst - TIE):
                break
            score = np.zeros(BLOCK)
            for i, x in zip(at.tolist(), w.tolist(), strict=True):
                e, y, cut = self.postings[i]
                lo, hi = cut[b], cut[b + 1]
                if lo < hi:
                    score[e[lo:hi] - b * BLOCK] += x * y[lo:hi]
            if b * BLOCK <= but < (b + 1) * BLOCK:
                score[but - b * BLOCK] = 0
            hit = np.flatnonzero(score > 0)
            found, cosine = np.concatenate([found, hit + b * BLOCK]), np.concatenate([cosine, score[hit]])
            if len(found) > k:
                best = np.lexsort((found, -np.round(cosine, 9)))[:k]
                found, cosine = found[best], cosine[best]
            if len(found) >= k:
                worst = cosine.min()
        best = np.lexsort((found, -np.round(cosine, 9)))
        return found[best], cosine[best]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        pull = self.weights[found] / (1 - np.minimum(cosine, 1) + SOFTEN)
        one = 1 / (1 + SOFTEN)
        return float((pull @ self.labels[found] + one * self.prior) / (pull.sum() + one))

    def score(self, text: str, cache: dict | None = None) -> tuple[float, list[int], list[float]]:
        """(score, neighbours' ids, cosines); cache keeps answers for equal vectors."""
        counts = self.vocabulary.counts(text)
        if not counts:
            return self.empty, [], []
        known = tuple(sorted(counts.items()))
        if cache is not None and known in cache:
            return cache[known]
        found, cosine = self.nearest(*self.vector(counts))
        a, b = self.curve
        raw = min(max(self.vote(found, cosine), 1e-6), 1 - 1e-6)
        out = float(1 / (1 + np.exp(-(a * np.log(raw / (1 - raw)) + b)))), self.ids[found].tolist(), cosine.tolist()
        if cache is not None:
            if len(cache) >= 20_000:
                cache.clear()
            cache[known] = out
        return out


def signatures(terms: list[str]) -> list[int]:
    """Two hashes that copies and most near copies share: each of the three longer words of least hash, of all terms of short texts."""
    words = [t for t in terms if len(t) >= 7 and "*" not in t]
    words = words if len(words) >= 8 else terms
    out = []
    for seed in (1, 2):
        least = sorted(
            xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words
        )[: 3 if len(words) >= 8 else None]
        out.append(xxhash.xxh64_intdigest(str(least)) >> 1)
    return out


def telling_terms(examples: DataFrame) -> list[str]:
    """Terms that tell the labels apart, the most telling first, from examples(__y, terms, signs).

    Of examples with a common signature under one label only the first counts. Counting is a grouped sum; only terms that tell the labels apart
    come to the driver, and no more than the examples have.
    """
    one = examples
    for i in (0, 1):  # a grouped minimum, not a window: a signature may be that of many examples
        first = examples.groupBy("__y", F.col("signs")[i].alias("__sign")).agg(F.min("__order").alias("__order"))
        one = one.join(first.select("__order"), "__order", "left_semi")
    own = staged(one.select("__y", F.explode("terms").alias("term"), "__order"), "example-terms")
    size = {r["__y"]: r["n"] for r in own.groupBy("__y").agg(F.countDistinct("__order").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return []
    counted = staged(own.groupBy("term").agg(F.sum(1 - F.col("__y")).alias("k0"), F.sum("__y").alias("k1")), "term-counts")
    least = 2 * float(np.log(max(counted.count(), 2)))
    n0, n1 = F.lit(float(size[0])), F.lit(float(size[1]))
    share0, share1 = (F.col("k0") + 0.5) / (n0 + 1), (F.col("k1") + 0.5) / (n1 + 1)
    p = (F.col("k0") + F.col("k1")) / (n0 + n1)

    def part(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    g = 2 * (
        part(F.col("k0"), n0 * p) + part(F.col("k1"), n1 * p) + part(n0 - F.col("k0"), n0 * (1 - p)) + part(n1 - F.col("k1"), n1 * (1 - p))
    )
    told = counted.filter(
        F.greatest(share0, share1) >= MIN_LIFT * F.least(share0, share1)
    ).withColumn("g", F.round(g, 9)).filter(F.col("g") >= least)
    return [r.term for r in told.orderBy(F.col("g").desc(), "term").collect()]


def fit_curve(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes' log odds, by Newton steps with a mild pull to (1, 0)."""
    x = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / (1 - np.clip(raw, 1e-6, 1 - 1e-6)))
    w = w / w.mean()
    beta, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - (beta - [1.0, 0.0])
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.eye(2), grad)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def build(
    examples: list[tuple[int, int, list[str], list[int]]],
    shares: tuple[int, int],
    terms: list[str],
    frequency: dict[str, int],
    n_docs: int,
) -> Model:
    """examples: (id, label, terms of the vocabulary, counts); shares: how many labels of 0 and 1 there are in all."""
    vocabulary = Vocabulary(terms)
    place = vocabulary.place
    idf = np.array([np.log((n_docs + 1) / (frequency.get(t, 0) + 1)) + 1 for t in terms])
    have = Counter(e[1] for e in examples)
    weight = {y: shares[y] / have[y] if have[y] else 0.0 for y in (0, 1)}
    total = sum(shares) or 1
    prior = (shares[1] + 1) / (total + 2)
    rows = []
    bare = [0.0, 0.0]
    for i, y, ts, ns in examples:
        counts = {place[t]: n for t, n in zip(ts, ns, strict=True) if t in place}
        if counts:
            rows.append((i, y, counts))
        else:
            bare[y] += weight[y]
    empty = (bare[1] + prior) / (sum(bare) + 1)
    model = Model(vocabulary, idf, np.zeros(0), np.zeros(0), np.zeros(0, np.int64), prior, empty)
    made = [(model.vector(c), i, y) for i, y, c in rows]
    # alike examples in one block: by their heaviest terms, then by content; keeps the blocks' bounds tight
    made.sort(
        key=lambda m: (
            [int(x) for x in m[0][0][np.argsort(-m[0][1], kind="stable")][:3]], m[0][0].tolist(), m[0][1].tolist(), m[2]
        )
    )
    model.ids = np.array([m[1] for m in made], np.int64)
    model.labels = np.array([m[2] for m in made], float)
    model.weights = np.array([weight[m[2]] for m in made])
    model.index([m[0] for m in made])
    if len(made) > 10 and 0 < model.labels.sum() < len(made):
        raw = np.array([model.vote(*model.nearest(*m[0], but=e)) for e, m in enumerate(made)])
        model.curve = fit_curve(raw, model.labels, model.weights)
    return model


def document_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(__key, terms, counts, signs)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            found = [terms_of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([list(c) for c in found], pa.list_(pa.string())),
                    pa.array([list(c.values()) for c in found], pa.list_(pa.int32())),
                    pa.array([signatures(list(c)) for c in found], pa.list_(pa.int64())),
                ],
                ["__key", "terms", "counts", "signs"],
            )

    return docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).mapInArrow(
        run, f"__key {kind}, terms array<string>, counts array<int>, signs array<bigint>"
    )


def restricted(examples: DataFrame, terms: list[str]) -> DataFrame:
    """(__key, __y, terms, counts) of examples, with the given terms only."""
    known = frozenset(terms)

    def run(batches):
        for batch in batches:
            kept = [
                [(t, n) for t, n in zip(ts, ns, strict=True) if t in known] for ts,
                ns in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([[t for t, _ in k] for k in kept], pa.list_(pa.string())),
                    pa.array([[n for _, n in k] for k in kept], pa.list_(pa.int32())),
                ],
                ["__key", "__y", "terms", "counts"],
            )

    return examples.select("__key", "__y", "terms", "counts").mapInArrow(
        run, "__key bigint, __y int, terms array<string>, counts array<int>"
    )


def document_frequencies(docs: DataFrame, text: str, terms: list[str]) -> tuple[dict[str, int], int]:
    """In how many rows of docs each of the given terms occurs, and how many rows there are. Each task adds up before the shuffle."""
    vocabulary = Vocabulary(terms)

    def run(batches):
        total, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for t in batch.column(0).to_pylist():
                for i in vocabulary.counts(t) if t else ():
                    total[i] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(len(terms)), -1)), pa.array(np.append(total, rows))], ["term", "n"]
        )

    # as many rows as there are terms in the vocabulary, whatever the data
    found = {
        r.term: r.n for r in docs.select(F.col(text).cast("string")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    }
    return {t: found.get(i, 0) for t, i in vocabulary.place.items()}, found.get(-1, 0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_examples: int = MAX_EXAMPLES,
) -> Model:
    """Learns from at most max_examples rows of labels(key, label) for each label, drawn by a hash of the key, an integer.

    Rows with a null key or label, or without a document, teach nothing; of several labels of one key the largest holds.
    Document frequencies are counted over all of docs. Without examples of both labels every score is the prior.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError("keys have to be integers, as neighbours are named by them")
    known = staged(
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).cast("long").alias("__key")).agg(
            F.max(label).cast("int").alias("__y")
        ),
        "labels",
    )
    counted = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    shares = counted.get(0, 0), counted.get(1, 0)
    # bounded by 2 * max_examples rows
    drawn = [known.filter(F.col("__y") == y).orderBy(F.xxhash64("__key"), "__key").limit(max_examples) for y in (0, 1)]
    picked = staged(drawn[0].unionByName(drawn[1]), "drawn")
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("__text"))
    found = document_terms(rows.join(F.broadcast(picked.select("__key")), "__key", "left_semi"), "__key", "__text")
    # rows of one key are one example, the first by its terms
    own = F.min(F.struct(F.xxhash64("terms", "counts").alias("hash"), "terms", "counts", "signs")).alias("own")
    examples = found.groupBy("__key").agg(own).join(F.broadcast(picked), "__key")
    examples = staged(
        examples.select("__key", "__y", "own.terms", "own.counts", "own.signs", F.xxhash64("__key").alias("__order")), "examples"
    )
    terms = telling_terms(examples)
    rows = restricted(examples, terms).collect()
    examples = [(int(r[0]), r[1], list(r[2]), list(r[3])) for r in sorted(rows, key=lambda r: r[0])]
    frequency, n_docs = document_frequencies(docs, text, terms)
    return build(examples, shares, terms, frequency, n_docs)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, neighbours, cosines) for every row of docs(key, text), with the neighbours' keys as evidence, nearest first.

    Null and empty texts, and those without a term of the vocabulary, get the share of label 1 among examples without one
    and no neighbours. Null keys and repeated rows are scored like others; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for batch in pieces(batches):
            rows = [sent.value.score(t or "", cache) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(cols[0], pa.float64()),
                    pa.array(cols[1], pa.list_(pa.int64())),
                    pa.array(cols[2], pa.list_(pa.float64())),
                ],
                [key, "score", "neighbours", "cosines"],
            )

    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(
        run, f"`{key}` {kind}, score double, neighbours array<bigint>, cosines array<double>"
    )


def rejected(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the rows that score at or above the threshold; columns stay as they are, and nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for batch in pieces(batches):
            yield batch.filter(
                pa.array([sent.value.score(t or "", cache)[0] < threshold for t in batch.column(text).to_pylist()], pa.bool_())
            )

    return docs.mapInArrow(run, docs.schema)
