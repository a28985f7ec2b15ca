import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline

from quarry.llm import shared

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_clean_documents(spark, kept):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"
    ]
    assert all(d.columns == first.columns and d.schema == kept[0].schema for d in kept[:-1])
    counts = [first.count(), *[d.count() for d in kept[:-1]]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    assert kept[1].filter(F.length("text") != F.col("n_chars")).count() == 0


def test_toxic_documents_go(spark, kept):
    toxic = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1")
    assert kept[0].join(toxic, "doc_id").count() < 0.4 * toxic.count()
    clean = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0")
    assert kept[0].join(clean, "doc_id").count() >= 0.99 * clean.count()


def test_leaks_go(spark, kept):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r.text for r in kept[3].collect()]
    assert not any(i in t for t in texts for i in items) and any(i in r.text for r in kept[2].collect() for i in items)


def test_packed_ids_are_those_of_the_kept_texts(kept):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in kept[-1].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    rows = kept[3].collect()
    assert set(pieces) == {r.doc_id for r in rows}
    for r in rows[::7]:
        assert [i for _, p in sorted(pieces[r.doc_id]) for i in p] == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_hand_rows_to_python_in_small_batches(spark, name, stage):
    session = spark.newSession()
    docs = session.read.parquet(f"{SF}/documents.parquet")
    stage(session, docs.limit(20), SF)

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    texts = session.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    got = texts.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 6000 and max(r.bytes for r in got) < 1.1 * shared.BATCH_BYTES
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    shared.small_batches(session)
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
