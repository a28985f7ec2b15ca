"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each search is written to the noop sink once to warm up, then three times; its figure is the best of those three.
Corpus operators, which take longer than a warm-up does, run once.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from quarry.index.trigram import TrigramIndex, indexed_lines  # noqa: E402
from quarry.operators import match, report  # noqa: E402
from quarry.spec import SearchSpec as S  # noqa: E402

RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config(
            "spark.checkpoint.dir", f"{folder}/shared"
        ).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = TrigramIndex(spark, f"{folder}/index")

    def scan(spec: S):
        return lambda: match.matching_lines(docs, spec)

    def indexed(spec: S):
        return lambda: index.search(docs, spec, rebuild=False)

    rare, none, regex = S("licensed under"), S("zzzqzzz"), S(r"Apache License.*\d")
    work = {
        "literal_common": scan(S("the")),
        "literal_rare": scan(rare),
        "literal_none": scan(none),
        "literal_ci": scan(S("license", ignore_case=True)),
        "regex_with_literal": scan(regex),
        "regex_without_literal": scan(S(r"\d+\.\d+")),
        "regex_boundary": scan(S(r"\b\w+ing\b")),
        "alternation": scan(S("MIT|Apache|GNU")),
        "word": scan(S("the", whole_word=True)),
        "invert": scan(S("the", invert=True)),
        "count": lambda: report.counts(docs, S("the")),
        "docs_with_matches": lambda: report.docs_with_matches(docs, S(r"\d{3}-\d{4}")),
        "max_count": lambda: report.first_matches(docs, S("the", max_count=2)),
        "context": lambda: report.with_context(docs, S("@", before=1, after=2)),
        "top_documents": lambda: report.top_documents(docs, S("the"), 20),
    }
    seconds: dict[str, float] = {}

    def timed(run) -> float:
        began = time.perf_counter()
        run()
        return time.perf_counter() - began

    def measure(name: str, make) -> None:
        times = [timed(lambda: make().write.format("noop").mode("overwrite").save()) for _ in range(RUNS + 1)]
        seconds[name] = round(min(times[1:]), 4)

    for name, make in work.items():
        measure(name, make)
    seconds["index_build"] = round(min(timed(lambda: index.build(docs)) for _ in range(2)), 4)
    postings = index.postings()
    for name, spec in (("indexed_rare", rare), ("indexed_none", none), ("indexed_regex", regex)):
        measure(name, lambda spec=spec: indexed_lines(docs, postings, spec))
    measure("indexed_rare_with_staleness_check", indexed(rare))
    try:
        from quarry.llm import catalogue as llm
    except ModuleNotFoundError:
        pass
    else:
        for name, query in llm.QUERIES.items():
            seconds[name] = round(timed(lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()), 4)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name,
            }
        )
    )


if __name__ == "__main__":
    main()
