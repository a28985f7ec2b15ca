import hashlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarry.llm import fingerprints
from quarry.llm.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plain(text):
    words = (text or "").lower().split()
    terms = Counter(f"{a} {b}" for a, b in zip(words, words[1:])) if len(words) > 1 else Counter(words)
    votes = [0.0] * 128
    for term, n in terms.items():
        h = xxhash.xxh3_128_intdigest(term.encode())
        for b in range(128):
            votes[b] += (1 + np.log(n)) * (1 if h >> (127 - b) & 1 else -1)
    return sum(1 << (127 - b) for b in range(128) if votes[b] > 1e-9)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, SF).collect()}
    assert len(got) == len(rows)
    prints = {r.doc_id: plain(r.text) for r in rows}
    for i, r in enumerate(rows):
        other = rows[(i + 1) % len(rows)]
        made = r.text[: len(r.text) - len(r.text) // 2] + other.text[: len(r.text) // 2]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(made.encode()).hexdigest())
        if i % 9 == 0:
            assert int(g.fingerprint, 16) == prints[r.doc_id] and int(g.edited_fingerprint, 16) == plain(made)
            assert g.near_edited == 1 - (plain(made) ^ prints[r.doc_id]).bit_count() / 128
        assert abs(g.near_next - (1 - (prints[other.doc_id] ^ prints[r.doc_id]).bit_count() / 128)) < 1e-12
        want = sum((prints[r.doc_id] ^ p).bit_count() <= 3 for p in prints.values()) if r.doc_id % 50 == 0 else None
        assert g.found_within_3 == want


def test_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (30, 2))
    codes = [tuple(int(x) for x in base[i % 30] ^ (1 << rng.integers(0, 62, 2) if i % 3 else 0)) for i in range(200)]
    df = spark.createDataFrame(list(dict.fromkeys(codes)), "f0 long, f1 long")
    for radius in (1, 2, 5):
        got = {tuple(r) for r in fingerprints.search(df, df, radius).collect()}
        want = {
            (*a, *b, d) for a in set(codes) for b in set(codes) if (
                d := (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count()
            ) <= radius
        }
        assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    got = fingerprints.edit_robustness(odd_docs).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 6, 7, 8]
    by = {r.doc_id: r for r in got}
    assert by[1].f0 == by[2].f0 and by[1].near_next == 1.0 and by[3].n_chars == 0 and (by[3].f0, by[3].f1) == (0, 0)
    last = by[8]
    text = "Ünïcode   \U0001f600 ｘ"
    assert last.edited_sha256 == hashlib.sha256(
        (text[: len(text) - len(text) // 2] + "no id here"[: len(text) // 2]).encode()
    ).hexdigest()
    assert fingerprints.edit_robustness(no_docs).count() == 0
    one = fingerprints.edit_robustness(odd_docs.filter("doc_id = 8")).collect()
    assert one[0].near_next == 1.0
