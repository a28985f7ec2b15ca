import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import match, report
from quarry.plans import automaton
from quarry.plans.pattern import UnsupportedPattern, compile_pattern, java, parse
from quarry.spec import SearchSpec

PATTERNS = [
    "a", "ab*", "^(a|b)*$", "(ab|a)+b", r"\bab\b", "[^ab]+c", "a{2,3}b", "(a|b|ab)*c$", "^$", "", r"\w+@\w+", "a.c", "(a*)*b", r"\W\d", "é+[à-ü]", "x?y?z?$", "(^a|b$)", r"[\D]b",
]


def python(pattern):
    """The Java pattern as one of Python: the dialects agree on what is written out."""
    return re.compile(java(parse(pattern)).replace(r"\z", r"\Z"), re.S)


@settings(max_examples=60, deadline=None)
@pytest.mark.parametrize("pattern", PATTERNS)
@given(line=st.text("abc@ 1éx_Ü\U0001f600", max_size=12))
def test_table_equals_a_backtracking_matcher(pattern, line):
    assert automaton.build(parse(pattern)).matches(line) == bool(python(pattern).search(line))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_column_equals_table(spark, pattern):
    lines = ["", "a", "ab", "abab", "abc", "aab", "c", "é", "éÜ", "x@y", " 1", "b a", "\U0001f600b", "a\U0001f600c", "_ab_", "aabb", "b1", "zzz", "Ab"]
    for spec in (SearchSpec(pattern), SearchSpec(pattern, ignore_case=True), SearchSpec(pattern, whole_word=True)):
        if spec.whole_word and not pattern:  # java.util.regex finds nothing whole between the halves of a character
            continue
        made = automaton.build(parse(pattern), spec.ignore_case, spec.whole_word)
        df = spark.createDataFrame([(x,) for x in lines], "line string").repartition(1)
        got = df.select("line", made.column(F.col("line")).alias("m"), F.col("line").rlike(compile_pattern(spec).java).alias("j")).collect()
        assert [(r.line, r.m) for r in got] == [(r.line, r.j) for r in got] == [(x, made.matches(x)) for x in [r.line for r in got]]


LONG = [
    ("^(a|b)*$", "ab" * 500_000, True),
    ("^(a|b)*$", "ab" * 500_000 + "c", False),
    ("(ing|tion|[a-z ])+$", "ing tion" * 125_000 + "!", False),
    (r"^(\w+\s?)*$", "word " * 200_000, True),
    (r"^(\w+\s?)*$", "word " * 200_000 + "!", False),
    (r"\d+\.\d+x", "1" * 1_000_000, False),
    (r"(a+)+b", "a" * 40, False),
    (r".*a.*b.*c", "ab" * 2_000, False),
]


@pytest.mark.parametrize("i", range(len(LONG)))
def test_long_lines_end_in_bounded_time(spark, i):
    pattern, line, want = LONG[i]
    docs = spark.createDataFrame([(1, line), (2, "short")], "doc_id long, text string").repartition(1)
    spec = SearchSpec(pattern)
    rows = {r.doc_id for r in match.matching_lines(docs, spec).select("doc_id").collect()}
    assert (1 in rows) == want and {r.doc_id for r in report.counts(docs, spec).collect()} == rows
    assert {r.doc_id for r in report.docs_with_matches(docs, spec).collect()} == rows


def test_which_patterns_need_an_automaton():
    limit = lambda p: compile_pattern(SearchSpec(p)).limit
    assert limit("th.re") is None and limit(r"\d{3}-\d{4}") is None and limit("(ing|tion)s?") is None
    assert limit(r"\w+@\w+\.\w+") == automaton.LONG and limit("^(ab|c)*$") == automaton.SHALLOW and limit("(a+)+$") == 0
    assert 0 < limit(".*a.*b.*c") < 100
    with pytest.raises(UnsupportedPattern):
        compile_pattern(SearchSpec("(a|b)*a(a|b){900}(c|d)"))
    assert compile_pattern(SearchSpec("a.{30}b.*c.{30}d")).limit is None


def test_replacement_refuses_what_java_could_not_end(spark):
    docs = spark.createDataFrame([(1, "ab" * 100), (2, "c" * 5000)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in report.replaced(docs, SearchSpec("(ab|b)+"), "x").collect()}
    assert out == {1: "x", 2: "c" * 5000}
    with pytest.raises(Exception, match="too long"):
        report.replaced(spark.createDataFrame([(1, "ab" * 5000)], "doc_id long, text string"), SearchSpec("(ab|b)+"), "x").collect()
