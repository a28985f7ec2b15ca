"""Every query and pipeline stage over tables of odd rows, and over empty ones."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline
from quarry.llm.catalogue import QUERIES

CLASHES = [
    "__other",
    "__runs",
    "__removed",
    "__n",
    "__first",
    "__pair",
    "__item",
    "__pos",
    "__slots",
    "__y",
    "__gone",
    "__held",
    "__html",
    "__url",
    "__t",
    "__tie",
    "__part",
    "__id",
    "__at",
    "__same",
    "__text",
    "__key",
    "key",
    "w0",
    "w1",
    "component",
    "root",
    "node",
    "label",
    "runs",
    "removed",
    "score",
    "terms",
    "counts",
    "shard",
    "slot",
    "group",
    "chunks",
    "window",
    "form",
    "pos",
    "ids",
    "host",
    "token",
    "u",
    "v",
    "n",
]


def clash(df):
    return df.select("*", *[F.lit(f"{c}?").alias(c) for c in CLASHES if c not in df.columns])


def odd_tables(spark, path):
    passage = " ".join(f"word{i % 13} of{i}" for i in range(60))
    docs = [
        (1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "en", "s1", 15), (
            1, "another text under the same id", None, None, None
        ),
        (2, None, None, None, None), (3, "", "", "", 0), (4, " \t\n\n ", "en", "s1", 5), (
            None, "no id at all " + passage, "en", "s1", 4
        ), (None, None, None, None, None),
        (
            5, passage + "\nown line", "en", "s1", 3
        ), (6, "intro\n" + passage, "en", "s1", 3), (7, "x" * 200_000, "en", "s1", 3), (8, "long words " * 40_000, "de", "s2", 3),
        (
            9, "É́ \U0001f600 \x00 \x85 <|endoftext|> </s>[INST]", "xx", "s2", 3
        ), (-5, "negative id", "en", "s2", 3), (2**62, "a b c d e f g h", "en", "s2", 3),
    ]
    clash(
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    ).write.parquet(f"{path}/documents.parquet")
    labels = [
        (1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (5, 1, 0), (6, 0, 1), (99, 1, 0), (8, 1, 0), (7, 0, 0), (9, 0, 0)
    ]
    clash(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).write.parquet(f"{path}/labels.parquet")
    items = [(1, passage), (1, passage), (None, "x y z"), (2, None), (3, ""), (4, "a b c d e f g h")]
    clash(spark.createDataFrame(items, "item_id long, text string")).write.parquet(f"{path}/benchmark.parquet")
    pages = [
        (1, "http://a/x", "<article><p>t</p></article>"),
        (1, "http://a/x", "<article><p>t</p></article>"),
        (None, None, None),
        (2, "", "<"),
        (3, "not a url", "<p>" * 3000 + "deep"),
        (4, "http://a", "plain &amp; text"),
    ]
    clash(spark.createDataFrame(pages, "page_id long, url string, html string")).write.parquet(f"{path}/pages.parquet")
    turns = [
        (1, 0, "user", "q"),
        (1, 0, "user", "q"),
        (1, None, None, None),
        (None, 1, "assistant", "a"),
        (2, 1, "assistant", None),
        (2, 0, "", "x\n"),
    ]
    clash(
        spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    ).write.parquet(f"{path}/conversations.parquet")


def empty_tables(spark, path):
    for name in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    odd_tables(spark, path)
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    empty_tables(spark, path)
    return path


ROWS = {"op7_chat_format": 4, "op9_html_extract": 6}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name == "op8_packing":
        assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9, -5, 2**62}
        assert sum(r.start == 0 for r in rows) == 15
    else:
        assert len(rows) == ROWS.get(name, 15)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name == "op7_chat_format" else 0)


def test_stages_over_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, odd), name)
        if name != "packing":
            assert out.schema.names == docs.schema.names and out.count() <= docs.count(), name
            docs = out
        if name == "simhash_near_dedup":  # of the rows of key 1 one with each text; one holds item 4 of the benchmark, and key 1 then goes
            assert {r.text for r in docs.filter("doc_id = 1").collect()} == {"a b c d e f g h", "another text under the same id"}
            assert docs.filter("doc_id = 1").count() == 2
    assert {r.doc_id for r in docs.select("doc_id").collect()} >= {7, 8, -5} and docs.filter("doc_id is null").count() == 2
    assert docs.filter("doc_id = 1").count() == 0
