"""Linear forms of patterns: found in the same lines as the pattern, without an automaton's walk over the line."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry import catalogue
from quarry.operators import match
from quarry.plans import automaton
from quarry.plans.pattern import compile_pattern, parse
from quarry.spec import SearchSpec

ATOMS = st.sampled_from(["a", "b", "[ab]", "[^a]", r"\w", r"\s", ".", "c", r"\W"])


def _more(inner):
    count = st.sampled_from(["*", "+", "?", "{2}", "{1,2}", "{2,}"])
    group = st.builds(lambda p, q: f"({p}){q}", inner, count)
    return st.one_of(group, st.builds("{}{}".format, ATOMS, count), st.builds("{}{}".format, inner, inner), st.builds("({}|{})".format, inner, inner))


PATTERNS = st.builds("{}{}{}".format, st.sampled_from(["", "^", "^", r"\b"]), st.recursive(ATOMS, _more, max_leaves=5), st.sampled_from(["", "$", "$", r"\b"]))


@settings(max_examples=1500, deadline=None)
@given(pattern=PATTERNS, lines=st.lists(st.text("aab c\n", max_size=9).map(lambda x: x.replace("\n", "!")), min_size=8, max_size=8))
def test_linear_forms_find_the_same_lines(pattern, lines):
    node = parse(pattern)
    found = automaton.linear(node)
    if found is not None:
        made, form = automaton.build(node), re.compile(found.replace(r"\z", r"\Z"), re.S)
        assert [made.matches(x) for x in lines] == [bool(form.search(x)) for x in lines], (pattern, found)


def test_which_patterns_have_one():
    assert all(automaton.linear(parse(p)) is not None for p in catalogue.LONG_LINES)
    assert automaton.linear(parse("^(a|bc*d)*x?$")) == r"\A(?:a|bc*+d)*+x?+\z"
    # giving back could meet the bound; several ways of reading; many starts
    assert all(automaton.linear(parse(p)) is None for p in (r"^[a ]*\b", "^(ab|a)*c$", r"\w+@\w+x", "((a|ab){400}b)+c", "x(a*)+y", "^a*^"))


@pytest.mark.parametrize("pattern", catalogue.LONG_LINES)
def test_long_lines_are_not_walked_by_the_automaton(spark, pattern):
    spec = SearchSpec(pattern)
    lines = ["", "word, " * 100_000, "word, " * 100_000 + "!", "a" * 500_000, "ing tion" * 60_000 + "7", "a" * 500_000 + "(", "7", " a", "A 1"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(1)
    found = match.matching_lines(docs, spec)
    assert "aggregate(" not in found._jdf.queryExecution().executedPlan().toString()
    made = compile_pattern(spec).automaton
    assert {r.doc_id for r in found.collect()} == {i for i, x in enumerate(lines) if x and made.matches(x)}
