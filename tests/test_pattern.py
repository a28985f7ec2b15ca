import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.plans import trigrams as T
from quarry.plans.pattern import UnsupportedPattern, branch_literals, compile_pattern, parse, pure_literal, required_literal
from quarry.spec import SearchSpec as S


def found(pattern, text, **how):
    """The emitted expression, read by Python after the two spellings that differ from Java's."""
    java = compile_pattern(S(pattern, **how)).java
    return re.search(java.replace(r"\z", r"\Z"), text, re.ASCII) is not None


CASES = [
    ("hello", "say hello", True), ("h.llo", "hallo", True), ("h.llo", "hllo", False), ("ab*c", "ac", True), ("ab+c", "ac", False), ("ab+c", "abbc", True),
    ("cat|dog", "hotdog", True), ("[abc]x", "bx", True), ("[^abc]x", "bx", False), ("[a-f]+", "xyzf", True), (r"\d+\.\d+", "version 1.23", True), (r"\w+@\w+", "a@b", True),
    (r"\s", "a\tb", True), (r"\s", "a\x0bb", False), (r"\S\D\W", "a- ", True), ("^ab", "cab", False), ("ab$", "cab", True), ("ab$", "ab\r", False), (r"\bfoo\b", "a foo.", True),
    (r"\bfoo\b", "éfoo", True), (r"\bfoo\b", "xfoo", False), ("colou?r", "color", True), ("a{2,4}", "aaaaa", True), ("^a{2,4}$", "aaaaa", False), ("a{2}", "a", False), ("a{0}b", "b", True),
    (r"fn\s+\w+\(", "fn main(", True), (r"import\s+\{", "import {", True), ("(foo|bar)baz", "xbarbaz", True), ("(foo)*bar", "bar", True), (r"\d+$", "ab12", True), ("^a|b", "cb", True),
    ("a,b", "a,b", True), ("x]}", "x]}", True), ("*a", "*a", True), ("a{x", "a{x", True), ("a{,2}", "a{,2}", True), ("", "", True), ("[]a]", "]", True), ("[a-]", "-", True), (r"[\d\-x]", "-", True),
    (r"[^\W\d]", "1", False), (r"[^\W\d]", "é", False), (r"[^\W\d]", "q", True), (r"[\Wa]", "é", True), (r"a\.b", "axb", False), (r"\q", "q", True), ("(a(b|c)+)?d", "acbcd", True), ("a&&b", "a&&b", True), ("[a&&b]", "&", True), ("#x", "#x", True),
]


@pytest.mark.parametrize("pattern,text,want", CASES)
def test_meaning(pattern, text, want):
    assert found(pattern, text) == want


def test_java_agrees(spark):
    from quarry.operators.match import matches
    from pyspark.sql import functions as F

    row = spark.range(1)
    cols = [matches(F.lit(t), S(p)).alias(f"c{i}") for i, (p, t, _) in enumerate(CASES)]
    got = row.select(*cols).collect()[0]
    assert [(c[0], c[1], g) for c, g in zip(CASES, got, strict=True)] == [(p, t, w) for p, t, w in CASES]


@pytest.mark.parametrize(
    "pattern",
    [
        "a*?",
        "a++",
        "(?i)a",
        r"(a)\1",
        r"\Ba",
        r"\Aa",
        r"a\z",
        "[[:alpha:]]",
        r"\pL",
        "(a",
        "a)",
        "[a",
        "a{3,2}",
        "[z-a]",
        "a\\",
        "a{2000}",
    ],
)
def test_refused(pattern):
    with pytest.raises(UnsupportedPattern):
        parse(pattern)


def test_options():
    assert found("FOO", "a foo", ignore_case=True) and not found("ß", "SS", ignore_case=True) and not found("É", "é", ignore_case=True)
    assert found(r"\W", " ", ignore_case=True) and not found(r"\W", "a", ignore_case=True)
    assert found("a.c", "a.c", fixed=True) and not found("a.c", "abc", fixed=True)
    assert found("foo", "a foo b", whole_word=True) and not found("foo", "afoo", whole_word=True) and found("foo|bar", "x bar", whole_word=True)
    with pytest.raises(ValueError):
        S("a\nb")
    with pytest.raises(ValueError):
        S("a", max_count=-1)


def test_literals():
    assert pure_literal(parse("abc")) == "abc" and pure_literal(parse("a.c")) is None and pure_literal(parse(r"a\.c")) == "a.c"
    assert branch_literals(parse("TODO|FIXME|(HACK|XXX)")) == ["TODO", "FIXME", "HACK", "XXX"] and branch_literals(parse("a|b*")) is None and branch_literals(parse("a|")) is None
    assert required_literal(parse("(foo)*bar")) == "bar" and required_literal(parse(r"\d+\.\d+")) == "." and required_literal(parse("a|b")) is None
    assert required_literal(parse("(hello)+x")) == "hello" and required_literal(parse("(ab)+cde")) == "cde" and required_literal(parse("ab(c)d")) == "abcd"
    assert required_literal(parse("a{0}")) is None and required_literal(parse(r"ab\bcd")) == "ab"


def test_the_rarest_character():
    from quarry.functions.strings import rarest_index

    assert [rarest_index(w) for w in ("TODO", "zebra", "a\x00b", "ee", "")] == [2, 0, 1, 0, 0]
    assert rarest_index("fuzz") == 2 and rarest_index("a{b{") == 1
    assert required_literal(parse("ten.zoo")) == "zoo" and required_literal(parse("zoo.ten")) == "zoo"


bounded = st.lists(
    st.sampled_from([r"\b", "a", "[ab]", r"\w+", " ", "-?", r"(a|b)", r"(a| )", r"\W", "b*", "é", r"[^a]"]),
    min_size=1,
    max_size=5,
).map("".join)


@settings(max_examples=500, deadline=None)
@given(bounded, st.text("ab -é_", max_size=7))
def test_word_bounds(pattern, text):
    want = re.search(pattern.replace("[^a]", r"[^a\n]"), text, re.ASCII) is not None
    assert found(pattern, text) == want


def test_plans():
    def plan(p):
        return T.decompose(parse(p))

    assert len(plan("function").trigrams) == 6 and isinstance(plan("TODO|FIXME"), T.Or) and isinstance(plan("fn"), T.MatchAll)
    for p, selective in [
        (r"import\s+\{", True),
        ("TypeError.*found", True),
        ("error+", True),
        (r"\d+\.\d+", False),
        ("TODO|ab", False),
        ("(abc)*", False),
        ("(abc)+", True),
        ("(abc){2}", True),
    ]:
        assert T.is_selective(plan(p)) == selective
    assert len(T.trigram_list(b"hello world")) == 9 and T.trigram_list(b"ab") == [] and T.trigram_list(b"abc") == [97 | 98 << 8 | 99 << 16]
    assert T.need_masks(b"abcd") == {T.trigram_list(b"abc")[0]: 1 << 100 % 8, T.trigram_list(b"bcd")[0]: 0}


def holds(plan, grams):
    match plan:
        case T.Need(t):
            return t <= grams
        case T.And(items):
            return all(holds(i, grams) for i in items)
        case T.Or(items):
            return any(holds(i, grams) for i in items)
    return True


pieces = st.recursive(
    st.sampled_from(["abc", "b", "ca", ".", "[ab]", r"\w", "é", "abca"]),
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=3).map("".join),
        st.tuples(inner, inner).map(lambda p: f"({p[0]}|{p[1]})"),
        st.tuples(inner, st.sampled_from(["*", "+", "?", "{2}", "{0,1}"])).map(lambda p: f"({p[0]}){p[1]}"),
    ),
    max_leaves=6,
)


@settings(max_examples=400, deadline=None)
@given(pieces, st.text("abcé ", max_size=14))
def test_nothing_that_matches_is_ruled_out(pattern, text):
    c = compile_pattern(S(pattern))
    hit = re.search(c.java.replace(r"\z", r"\Z"), text) is not None
    if hit:
        data = text.encode()
        assert holds(T.decompose(c.node), set(T.trigram_list(data)))
        assert c.required is None or c.required in text
        assert c.branches is None or any(b in text for b in c.branches)
    assert hit == (re.search(pattern.replace(r"\w", "[A-Za-z0-9_]"), text) is not None)
