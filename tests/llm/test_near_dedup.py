import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import hamming, near_dedup
from quarry.llm.catalogue import QUERIES
from quarry.llm.shared import components

SF = "/root/testdata/sf0.001"


def plain_print(text, size=3):
    """One bit at a time, on whole numbers."""
    words = [
        w for w in "".join(
            chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""
        ).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w
    ]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, radius=3):
    """prints: (key, fingerprint). The smallest key that each reaches."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(prints):
        least[root(i)] = min(k, least.get(root(i), k))
    return [least[root(i)] for i in range(len(prints))]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [(r.doc_id, plain_print(r.text)) for r in rows]
    want = {(k, f"{p:016x}", g) for (k, p), g in zip(prints, plain_groups(prints), strict=True)}
    got = QUERIES["op3_simhash_near_dedup"](spark, SF).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


@pytest.mark.parametrize("words,radius", [(1, 3), (1, 0), (1, 9), (4, 48)])
def test_gray_index_finds_every_pair_once(words, radius):
    rng = np.random.default_rng(words * 10 + radius)
    base = rng.integers(0, 2**64, (12, words), np.uint64)
    codes = base[rng.integers(0, 12, 400)]
    for _ in range(6):
        flip = rng.integers(0, 64, 400)
        codes[np.arange(400), rng.integers(0, words, 400)] ^= np.uint64(1) << flip.astype(np.uint64)
    keys = rng.integers(0, 5, 400)
    got = [
        (min(a, b), max(a, b), d) for x,
        y,
        z in hamming.GrayIndex(keys, codes).pairs(radius) for a,
        b,
        d in zip(x.tolist(), y.tolist(), z.tolist(), strict=True)
    ]
    want = {
        (i, j, d) for j in range(400) for i in range(j) if keys[i] == keys[j] and (
            d := int(np.bitwise_count(codes[i] ^ codes[j]).sum())
        ) <= radius
    }
    assert len(got) == len(set(got)) and set(got) == want


def test_gray_rank_is_the_inverse_of_the_gray_code():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (hamming.gray_rank((n ^ (n >> np.uint64(1)))[:, None])[:, 0] == n).all()


@pytest.mark.parametrize("hot", [1, 200_000])
def test_links_are_exact_with_and_without_hot_keys(spark, hot):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = [b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) for b in base for _ in range(15)]
    prints = list(dict.fromkeys(p & (2**64 - 1) for p in prints))
    nodes = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "node long, w0 long")
    found = components(near_dedup.links(near_dedup.keyed_by_blocks(nodes, 3, hot), ["w0"], 3))
    label = {r.node: r.root for r in found.collect()}
    assert [label.get(i, i) for i in range(len(prints))] == plain_groups(list(enumerate(prints)))


def test_votes_of_long_texts_equal_one_count(spark):
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, (40_000, 8), np.uint8)
    want = np.packbits(np.unpackbits(raw, axis=1).sum(0, dtype=np.int64) * 2 > len(raw)).view(">u8")
    assert (hamming.vote(raw.tobytes(), 64) == want).all()


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    out = components(edges)
    assert out.count() == 301 and out.select("root").distinct().collect()[0][0] == 0


def test_odd_rows(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs, size=3, bits=64, radius=3)
    assert got.columns == ["doc_id", "w0", "component"]
    rows = sorted((r.doc_id or 0, r.component, r.w0) for r in got.collect())
    assert [(a, b) for a, b, _ in rows] == [(0, None), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (6, 6), (7, 3), (8, 8)]
    assert [c for a, _, c in rows if a in (3, 4, 7)] == [0, 0, 0]
    assert near_dedup.near_duplicates(no_docs).count() == 0


def near_copies(seed=5, n=120):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    docs = []
    for _ in range(n):
        body = [rnd.choice(words) for _ in range(rnd.randrange(60, 500))]
        docs.append(body)
        for _ in range(rnd.randrange(3)):
            other = list(body)
            for _ in range(rnd.randrange(1, max(2, len(body) // 50))):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            docs.append(other)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def grams_of(docs):
    return [set(near_dedup.shingles_of(near_dedup.words_of(t.encode()), 5)) for _, t in docs]


def plain_copies(docs):
    """The least row number that each text reaches over pairs that share 0.8 of their shingles."""
    grams, label = grams_of(docs), list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def short_copies(start, seed=6):
    """Short texts with one word changed, in one place of which all other copies agree."""
    rnd, docs = random.Random(seed), []
    for _ in range(60):
        body = [rnd.choice("abcdefgh") * 3 + rnd.choice("klmnop") for _ in range(rnd.randrange(5, 100))]
        other = [*body[:-1], "changed"] if len(body) < 60 else [*body[:30], "changed", *body[31:]]
        docs += [(start + len(docs), " ".join(body)), (start + len(docs) + 1, " ".join(other))]
    return docs


@pytest.mark.parametrize("split", [1 << 15, 50])
def test_default_recall_by_brute_force(spark, split, monkeypatch):
    docs = near_copies()
    grams = grams_of(docs)
    alike = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for j in range(len(docs)) for i in range(j)}
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    group = {r.doc_id: r.component for r in near_dedup.near_duplicates(df).collect()}
    close = [p for p, s in alike.items() if s >= 0.8]
    assert len(close) > 50 and all(group[i] == group[j] for i, j in close)
    assert not any(group[i] == group[j] for (i, j), s in alike.items() if s < 0.3)


@pytest.mark.parametrize("hot", [2000, 3, 1])
def test_every_pair_of_a_hot_shingle_meets(spark, hot):
    rnd = random.Random(8)
    rows = [(i, *[rnd.getrandbits(63) for _ in range(4)], [77]) for i in range(12)]
    nodes = spark.createDataFrame(rows, "node long, w0 long, w1 long, w2 long, w3 long, prefix array<long>")
    met = near_dedup.keyed_by_shingles(nodes, ["w0", "w1", "w2", "w3"], hot).select("key", "node")
    both = met.join(met.withColumnRenamed("node", "other"), "key").filter("node < other").select("node", "other").distinct()
    assert both.count() == 66


@pytest.mark.parametrize("often", [8, 1])
def test_every_close_pair_meets_within_the_radius(spark, often, monkeypatch):
    monkeypatch.setattr(near_dedup, "COMMON_DOCS", often)
    monkeypatch.setattr(near_dedup, "COMMON_SHARE", 2)
    docs = near_copies(9, 30)
    docs += short_copies(len(docs))
    grams = grams_of(docs)
    close = {(i, j) for j in range(len(docs)) for i in range(j) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    words = ["w0", "w1", "w2", "w3"]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = near_dedup.fingerprints(df, bits=256)
    node = {r["__key"]: r.node for r in prints.collect()}
    code = {r["__key"]: [r[w] & (2**64 - 1) for w in words] for r in prints.collect()}
    met = near_dedup.keyed_by_shingles(prints.dropDuplicates(["node"]), words).select("key", "node")
    both = met.join(met.withColumnRenamed("node", "other"), "key").filter("node != other").select("node", "other").distinct()
    pairs = {(r.node, r.other) for r in both.collect()}
    assert len(close) > 70 and all(node[i] == node[j] or (node[i], node[j]) in pairs for i, j in close)
    assert max(sum((x ^ y).bit_count() for x, y in zip(code[i], code[j], strict=True)) for i, j in close) <= 80


def test_known_pairs_are_left_out():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**64, (8, 1), np.uint64)[rng.integers(0, 8, 300)]
    codes ^= np.uint64(1) << rng.integers(0, 64, (300, 1)).astype(np.uint64)
    label, index = rng.integers(0, 3, 300), hamming.GrayIndex(np.zeros(300, int), codes)
    every = {(min(a, b), max(a, b)) for x, y, _ in index.pairs(3) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    index.known(label)
    left = {(min(a, b), max(a, b)) for x, y, _ in index.pairs(3) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert left == {(a, b) for a, b in every if label[a] != label[b]} and len(left) < len(every)


@pytest.mark.parametrize("frequent", [256, 3, 0])
def test_shared_shingles_are_counted(frequent, monkeypatch):
    monkeypatch.setattr(near_dedup, "FREQUENT", frequent)
    rnd = random.Random(frequent)
    sets = [sorted(rnd.sample(range(60), rnd.randrange(40))) for _ in range(50)]
    counted = near_dedup.Counted(np.array(list(map(len, sets))), np.array(sum(sets, []), np.int64))
    a, b = np.array([(i, j) for i in range(50) for j in range(50)]).T
    want = np.array([len({*sets[i]} & {*sets[j]}) for i, j in zip(a, b, strict=True)])
    for more in (-1, 0, 1):
        off = a != b  # what one node has alone isn't counted
        assert (counted.reach(a, b, want + more) == (more <= 0))[off].all()


@pytest.mark.parametrize("split", [1 << 15, 300, 10])
def test_groups_are_those_of_shared_shingles(spark, split, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    rnd, docs = random.Random(4), near_copies(7, 25)
    docs += short_copies(len(docs), 3)
    for n in (30, 60, 90, 150, 300, 400) * 4:  # chains of texts that are some 0.6 to 0.95 alike
        body = [rnd.choice("abcdefgh") * 3 + str(rnd.randrange(50)) for _ in range(n)]
        for _ in range(4):
            docs.append((len(docs), " ".join(body)))
            body = list(body)
            for _ in range(rnd.randrange(1, max(2, n // 25))):
                body[rnd.randrange(n)] = f"new{rnd.random()}"
    label = plain_copies(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    group = {r.doc_id: r.component for r in near_dedup.near_duplicates(df).collect()}
    assert [group[i] for i in range(len(docs))] == label and len(set(label)) < len(docs) - 20


def test_a_family_that_is_alike_but_for_a_fifth(spark):
    """Hundreds of texts that share most shingles with all others: few of them are copies, all are compared."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(300):
        body = list(base)
        for _ in range(rnd.randrange(3)):
            body[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        docs.append((i, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    group = {r.doc_id: r.component for r in near_dedup.near_duplicates(df).collect()}
    assert [group[i] for i in range(300)] == plain_copies(docs)


def test_rows_of_one_key_are_told_apart(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one, "x"), (1, two, "y"), (1, two, "z"), (2, two + " end", "x"), (3, one + " end", "x"), (None, one, "x"), (None, one, "x")]
    names = ["__key", "k", "t", "n", "__n", "_k", "first", "node", "__same", "__text", "prefix", "W0"]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").select("*", *[F.lit(c).alias(c) for c in names])
    out = near_dedup.without_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, one), (0, one), (1, one), (1, two)]
    found = near_dedup.near_duplicates(df)
    assert sorted((r.doc_id or 0, r.component or 0) for r in found.collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    out = near_dedup.without_copies(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 6, 8]
    assert near_dedup.without_copies(no_docs).count() == 0


def test_staged_tables_can_be_cleared(spark):
    from pyspark.errors import PySparkException

    from quarry.llm.shared import clear_staged, staged

    kept = staged(spark.range(5).toDF("a"), "kept")
    path = kept.inputFiles()[0]
    assert kept.count() == 5
    clear_staged(spark)
    with pytest.raises(PySparkException):
        spark.read.parquet(path).count()
