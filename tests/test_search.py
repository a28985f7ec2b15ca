import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import strings
from quarry.index.trigram import TrigramIndex, candidates, changes, indexed_lines, postings, snapshot
from quarry.operators import match, report
from quarry.operators.lines import lines, not_binary
from quarry.spec import SearchSpec as S
from quarry.streaming import watch

TEXTS = [
    "TODO first\nplain\n\ntodo second\nTODO TODO third\n",
    "no hits here\r\nat all\r",
    "",
    None,
    "\n\n",
    "FIXME or HACK\nfn main() !void { }\nöß TODO ŐÉ\n[TODO] (x) {y}\nkeep $1 \\ back",
    "a\x00binary TODO",
    "abcabcabc",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).cache()


def plain_lines(text):
    parts = (text or "").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def expected(pred):
    return sorted((d, i + 1, line) for d, t in enumerate(TEXTS) for i, line in enumerate(plain_lines(t)) if pred(line))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or ("doc_id", "line_no", "line"))).collect())


def test_lines(docs):
    assert rows(lines(docs)) == expected(lambda _: True)


@pytest.mark.parametrize(
    "spec,pred",
    [
        (S("TODO"), lambda x: "TODO" in x),
        (S("TODO", invert=True), lambda x: "TODO" not in x),
        (S("todo", ignore_case=True), lambda x: "todo" in x.lower()),
        (S("TODO|FIXME"), lambda x: "TODO" in x or "FIXME" in x),
        (S("todo|fixme", ignore_case=True), lambda x: "todo" in x.lower() or "fixme" in x.lower()),
        (S(r"fn\s+\w+\("), lambda x: re.search(r"fn\s+\w+\(", x)),
        (S(r"fn\s+\w+\(", invert=True), lambda x: not re.search(r"fn\s+\w+\(", x)),
        (S(""), lambda x: True),
        (S("", invert=True), lambda x: False),
        (S("^$"), lambda x: x == ""),
        (S("[TODO]", fixed=True), lambda x: "[TODO]" in x),
        (S("or", whole_word=True), lambda x: re.search(r"\bor\b", x)),
        (S("^.{2}$", byte_mode=True), lambda x: len(x.encode()) == 2),
        (S("ß", byte_mode=True), lambda x: "ß" in x),
        (S("[^ -~]{4}", byte_mode=True), lambda x: re.search(rb"[^ -~]{4}", x.encode())),
        (S(r"\$1 \\"), lambda x: "$1 \\" in x),
    ],
)
def test_matching_lines_counts_and_documents(docs, spec, pred):
    want = expected(pred)
    assert rows(match.matching_lines(docs, spec)) == want
    per = {}
    for d, *_ in want:
        per[d] = per.get(d, 0) + 1
    assert rows(report.counts(docs, spec), "doc_id", "n") == sorted(per.items())
    assert [r[0] for r in rows(report.docs_with_matches(docs, spec), "doc_id")] == sorted(per)
    assert [r[0] for r in rows(report.docs_without_match(docs, spec), "doc_id")] == sorted(set(range(len(TEXTS))) - set(per))
    total = report.total(docs, spec).collect()[0]
    assert (total.n, total.status) == (len(want), int(not want))
    clean = docs.filter(not_binary(F.col("text")) | F.col("text").isNull())
    assert rows(indexed_lines(clean, postings(docs), spec)) == [r for r in want if r[0] != 6]


def plain_context(spec, pred):
    out = []
    for d, t in enumerate(TEXTS):
        ls = plain_lines(t)
        hits = [i for i, x in enumerate(ls) if pred(x)][: spec.max_count]
        keep = sorted({j for i in hits for j in range(max(0, i - spec.before), min(len(ls), i + spec.after + 1))})
        group = 0
        for n, j in enumerate(keep):
            group += n > 0 and j > keep[n - 1] + 1
            out.append((d, j + 1, ls[j], j in hits, group))
    return out


@pytest.mark.parametrize(
    "spec",
    [
        S("TODO", before=1, after=1),
        S("TODO", after=2, max_count=1),
        S("TODO", invert=True, before=1),
        S("TODO", max_count=0, after=1),
        S("HACK|back", before=1),
    ],
)
def test_context(docs, spec):
    pred = {"TODO": lambda x: ("TODO" in x) != spec.invert, "HACK|back": lambda x: "HACK" in x or "back" in x}[spec.pattern]
    assert rows(report.with_context(docs, spec), "doc_id", "line_no", "line", "is_match", "group_id") == plain_context(spec, pred)


def test_caps_and_formats(docs):
    assert rows(report.first_matches(docs, S("TODO", max_count=1))) == [
        (0, 1, "TODO first"), (5, 3, "öß TODO ŐÉ"), (6, 1, "a\x00binary TODO")
    ]
    assert rows(report.counts(docs, S("TODO", max_count=1)), "doc_id", "n") == [(0, 1), (5, 1), (6, 1)]
    assert [r.n for r in report.top_documents(docs, S("TODO"), 2).collect()] == [2, 2]
    found = report.with_context(docs, S("HACK", after=1))
    assert [
        r[2] for r in rows(report.plain(found), "doc_id", "line_no", "out")
    ] == ["5:1:FIXME or HACK", "5-2-fn main() !void { }"]
    assert rows(report.plain(found, line_number=False), "out")[0][0] == "5-fn main() !void { }"
    assert rows(
        report.as_json(match.matching_lines(docs, S("HACK"))), "out"
    )[0][0] == '{"doc_id":5,"line_no":1,"line":"FIXME or HACK"}'
    shown = rows(
        report.coloured(match.matching_lines(docs, S("todo", ignore_case=True)), S("todo", ignore_case=True)),
        "doc_id",
        "line_no",
        "out",
    )
    assert shown[2][2].endswith("\x1b[1;31mTODO\x1b[0m \x1b[1;31mTODO\x1b[0m third")
    new = {r.doc_id: r.text for r in report.replaced(docs, S(r"TODO|\\"), r"<$1\>").collect()}
    assert new[0] == TEXTS[0].replace("TODO", r"<$1\>") and new[5].endswith(r"$1 <$1\> back") and new[3] is None


def test_offsets(spark):
    df = spark.createDataFrame([("aaaa",), ("xaa",), ("",), ("ab\\Eab",)], "t string")
    got = df.select(
        strings.overlapping_offsets(F.col("t"), "aa").alias("o"),
        strings.occurrences(F.col("t"), "aa").alias("n"),
        strings.first_offset(F.col("t"), "a", 1).alias("f"),
        strings.overlapping_offsets(F.col("t"), "\\E").alias("q"),
    ).collect()
    assert [(r.o, r.n, r.f, r.q) for r in got] == [([0, 1, 2], 3, 1, []), ([1], 1, 1, []), ([], 0, None, []), ([], 0, 4, [2])]


def test_needles(spark, docs):
    needles = spark.createDataFrame([("TODO f",), ("HACK",), ("main",), (None,), ("zzzz",)], "needle string")
    assert rows(match.lines_with_needles(docs, needles)) == expected(lambda x: any(n in x for n in ("TODO f", "HACK", "main")))
    short = spark.createDataFrame([("T",), ("zzzz",), ("fn m",)], "needle string")
    assert rows(match.lines_with_needles(docs, short)) == expected(lambda x: "T" in x or "fn m" in x)
    assert rows(match.lines_with_needles(docs, spark.createDataFrame([("",)], "needle string"))) == expected(lambda x: True)
    assert match.lines_with_needles(docs, needles.limit(0)).count() == 0


def test_postings(spark):
    df = spark.createDataFrame([(1, "abcabd"), (2, "ab"), (3, "é!"), (4, "a\x00bcd")], "doc_id long, text string")
    got = {(r.doc_id, r.trigram): (r.loc_mask, r.next_mask) for r in postings(df).collect()}

    def code(b):
        return b[0] | b[1] << 8 | b[2] << 16

    assert got == {
        (1, code(b"abc")): (1 << 0, 1 << ord("a") % 8), (1, code(b"bca")): (1 << 1, 1 << ord("b") % 8), (1, code(b"cab")): (1 << 2, 1 << ord("d") % 8),
        (1, code(b"abd")): (1 << 3, 255), (3, code("é!".encode())): (1, 255),
    }


@pytest.mark.parametrize("pattern", ["TODO", "fn main", r"(TODO|HACK)\b", "abcab.a", "öß", "e|TODO"])
def test_candidates_hold_all_matches(docs, pattern):
    found = candidates(postings(docs), S(pattern))
    if found is not None:
        truth = {r.doc_id for r in report.docs_with_matches(docs, S(pattern)).collect()} - {6}
        assert truth <= {r.doc_id for r in found.collect()}


def test_index_in_a_folder(spark, docs, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "index"))
    clean = docs.filter("doc_id <> 6")
    assert not index.valid()
    want = rows(match.matching_lines(clean, S("TODO")))
    assert rows(index.search(clean, S("TODO"), rebuild=False)) == want and not index.valid()
    assert rows(index.search(clean, S("TODO"))) == want and index.valid() and not index.stale(clean)
    newer = clean.filter("doc_id <> 0").withColumn(
        "text", F.when(F.col("doc_id") == 1, "now TODO").otherwise(F.col("text"))
    ).unionByName(spark.createDataFrame([(9, "new TODO")], "doc_id long, text string"))
    assert rows(changes(index.files(), snapshot(newer)), "doc_id", "change") == [(0, "removed"), (1, "changed"), (9, "added")]
    index.refresh(newer)
    assert not index.stale(newer) and rows(
        indexed_lines(newer, index.postings(), S("TODO"))
    ) == rows(match.matching_lines(newer, S("TODO")))
    made, want = index.postings().drop("shard"), postings(newer)
    assert made.exceptAll(want.select(*made.columns)).count() == 0 and made.count() == want.count()
    plan = candidates(index.postings(), S("TODO"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    spark.createDataFrame([(99,)], "version int").write.mode("overwrite").parquet(str(tmp_path / "index" / "meta"))
    assert not index.valid()


@pytest.mark.parametrize("piece", [1 << 22, 8])
def test_texts_are_folded_in_pieces(piece, monkeypatch):
    from quarry.index import trigram

    monkeypatch.setattr(trigram, "PIECE", piece)
    data = ("abcabdabc é" * 9 + "xyz").encode()
    want: dict = {}
    for i in range(len(data) - 2):
        code = data[i] | data[i + 1] << 8 | data[i + 2] << 16
        loc, nxt = want.get(code, (0, 0))
        want[code] = loc | 1 << i % 8, nxt | (1 << data[i + 3] % 8 if i + 3 < len(data) else 255)
    got = trigram.folded(data)
    assert {a: (b, c) for a, b, c in zip(*[x.tolist() for x in got], strict=True)} == want and len(got[0]) == len(want)
    assert all(len(x) == 0 for x in trigram.folded(b"ab"))


def test_refresh_appends(spark, docs, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "index"))
    clean = docs.filter("doc_id <> 6")
    index.build(clean)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "index" / "postings").rglob("*.parquet")}
    for text in ("TODO once", "then HACK", "TODO again"):
        now = clean.withColumn("text", F.when(F.col("doc_id") == 1, text).otherwise(F.col("text")))
        assert rows(index.search(now, S("TODO"))) == rows(match.matching_lines(now, S("TODO")))
        made, want = index.postings().drop("shard"), postings(now)
        assert made.exceptAll(want.select(*made.columns)).count() == 0 and made.count() == want.count()
    assert before.items() <= {f: f.stat().st_mtime_ns for f in (tmp_path / "index" / "postings").rglob("*.parquet")}.items()
    index.build(clean)
    assert index.postings().count() == postings(clean).count()


def test_stream(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    stream = watch.stream_matches(watch.watched(spark, str(tmp_path / "in"), docs.schema), S("TODO"))
    query = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("found")) == expected(lambda x: "TODO" in x)


def test_plans_push_down(spark, tmp_path):
    spark.range(100).selectExpr("id as doc_id", "concat('line ', id) as text", "'x' as other").write.parquet(str(tmp_path / "d"))
    df = match.matching_lines(spark.read.parquet(str(tmp_path / "d")), S("line 7"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,line 7)" in plan and "other" not in plan and "Exchange" not in plan
    counted = report.counts(spark.read.parquet(str(tmp_path / "d")), S("line 7"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in counted and counted.count("split(") == 1
    capped = report.first_matches(spark.read.parquet(str(tmp_path / "d")), S("line", max_count=1))
    assert "Exchange" not in capped._jdf.queryExecution().executedPlan().toString() and capped.count() == 100
    made = postings(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in made and "other" not in made


def test_staleness_by_version(spark, tmp_path):
    rows = [(1, "abc TODO", 5), (2, "def", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v long")
    index = TrigramIndex(spark, str(tmp_path / "index"), version=["v"])
    index.build(docs)
    assert not index.stale(docs) and index.stale(docs.withColumn("v", F.col("v") + 1))
    plan = index.snapshot(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.split("\n")[0]
