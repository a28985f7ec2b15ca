import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import chat, sharding
from quarry.llm.catalogue import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_query_equals_plain_reading(spark):
    convs = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: r for r in QUERIES["op7_chat_format"](spark, SF).collect()}
    assert set(got) == set(convs)
    for k, rows in convs.items():
        turns = [(r, t) for _, r, t in sorted(rows)]
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[k]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (
            len(turns), digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        )


TRICKY = [
    "<|im_end|>",
    "<\\|im_end|>",
    "</s>",
    "<\\\\/s>",
    "[INST]",
    "[\\/INST]",
    "<",
    "|",
    "<|im_turn|>",
    "\\",
    "a\n",
    "$1",
    "ß",
    "[[INST]",
    "<<|",
]


@settings(max_examples=12, deadline=None)
@given(
    st.lists(
        st.lists(
            st.tuples(
                st.sampled_from(["user", "assistant", "system", "<|im_sep|>", ""]),
                st.lists(st.sampled_from(TRICKY), max_size=6).map("".join),
            ),
            min_size=1,
            max_size=6,
        ),
        min_size=1,
        max_size=6,
    )
)
def test_any_turns_come_back(spark, convs):
    rows = [(c, i, r, t) for c, turns in enumerate(convs) for i, (r, t) in enumerate(turns)]
    out = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).select(
        "conv_id",
        "n_turns",
        "n_blocks",
        "formatted",
        chat.parsed(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("loss"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("joined"),
    ).collect()
    for r in out:
        turns = convs[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns and r.formatted == r.joined and r.n_turns == len(turns)
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert r.n_blocks == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))


def test_odd_turns(spark):
    rows = [
        (1, None, "user", "n"),
        (1, 0, None, None),
        (1, 0, "user", "x"),
        (1, 0, "user", "x"),
        (None, 1, "assistant", ""),
        (2, 5, "user", "long " * 100_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as t", "'x' as segments", "2 as formatted")
    got = {r.conv_id: r for r in chat.format_chat(df).withColumn("turns", chat.parsed(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "n"), ("", ""), ("user", "x"), ("user", "x")]
    assert [(t.role, t.text) for t in got[None].turns] == [("assistant", "")] and len(got[2].turns[0].text) == 500_000
    assert chat.format_chat(df.limit(0)).count() == 0


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(spark, n, bits):
    side = 1 << bits
    dims = [F.floor(F.col("id") / side**k) % side for k in range(n)]
    rows = spark.range(side**n).select(*[d.alias(f"d{k}") for k, d in enumerate(dims)]).withColumn(
        "h", sharding.hilbert_index([F.col(f"d{k}") for k in range(n)], bits)
    ).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**n))
    assert all(sum(abs(a[f"d{k}"] - b[f"d{k}"]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_query_deals_rows_evenly(spark):
    import zlib

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    by = {}
    for r in rows:
        raw = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        by.setdefault(r.shard, []).append((r.slot, r.curve))
    last = -1
    for s in range(24):
        assert [x for x, _ in sorted(by[s])] == list(range(len(by[s])))
        curve = [c for _, c in sorted(by[s])]
        assert curve == sorted(curve) and curve[0] >= last
        last = curve[-1]
    shards = {}
    for r in rows:
        shards.setdefault(docs[r.doc_id].text, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 23


def test_bytes_law(spark):
    df = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("size"), (F.col("id") % 7).alias("a"))
    rows = sharding.shard(df, {"a": F.col("a"), "b": F.col("size")}, 9, F.col("size"), key="id", law="bytes", bits=7).collect()
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    mean = sum(total.values()) / 9
    assert len(rows) == 3000 and all(abs(t - mean) <= 100 for t in total.values())
    for s in range(9):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_odd_rows(odd_docs, no_docs):
    dims = {"lang": sharding.quantised_name(F.col("lang"), 4), "size": sharding.quantised_log(F.length("text"), 4)}
    out = sharding.shard(odd_docs, dims, 4, F.octet_length("text"), bits=4, group=F.xxhash64("text"))
    assert Counter(r.shard for r in out.collect()).most_common()[-1][1] >= 2 and out.count() == 9
    assert sharding.shard(no_docs, dims, 4, F.octet_length("text"), bits=4).count() == 0
    few = sharding.shard(odd_docs.limit(2), dims, 4, F.lit(None).cast("long"), bits=4).collect()
    assert {r.shard for r in few} == {0, 2} and {r.size for r in few} == {0}
