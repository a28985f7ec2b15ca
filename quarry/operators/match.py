"""Predicates of a search, as Columns, and the matching lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.strings import latin1, quoted
from quarry.operators.lines import line_array, lines
from quarry.plans.pattern import Compiled, compile_pattern
from quarry.spec import SearchSpec

#: Up to so many texts are looked for one by one, more of them by one regular expression.
FEW = 8


def any_of(text: Column, needles: list[str]) -> Column:
    """text holds one of the needles."""
    if len(needles) <= FEW:
        return reduce(or_, [text.contains(n) for n in needles], F.lit(False))
    return text.rlike("|".join(map(quoted, needles)))


def _subject(text: Column, spec: SearchSpec) -> Column:
    return latin1(text) if spec.byte_mode else text


def _bounded(subject: Column, c: Compiled) -> Column:
    """Short lines by java.util.regex, others, on which it might not end, by the pattern's automaton; all by a linear form of the pattern, if there is one."""
    if c.linear is not None:
        found = subject.rlike(c.linear)
    else:
        by_table = c.automaton.column(subject)
        found = by_table if not c.limit else F.when(F.length(subject) <= c.limit, subject.rlike(c.java)).otherwise(by_table)
    return subject.contains(c.required) & found if c.required and not c.spec.ignore_case else found


def _positive(text: Column, c: Compiled) -> Column:
    """The pattern is found; the cheapest expression that says so."""
    spec = c.spec
    subject = _subject(text, spec)
    if c.limit is not None:
        return _bounded(subject, c)
    if spec.ignore_case:  # one search by (?i), which folds ASCII only, is faster than folding the text first
        return subject.rlike(c.java)
    if c.literal is not None:
        return subject.contains(c.literal)
    if c.branches:
        return any_of(subject, c.branches)
    if c.required:
        return subject.contains(c.required) & subject.rlike(c.java)
    return subject.rlike(c.java)


def matches(line: Column, spec: SearchSpec) -> Column:
    """A line is a hit: never null, inverted if the search is."""
    found = F.coalesce(_positive(line, compile_pattern(spec)), F.lit(False))
    return ~found if spec.invert else found


def may_match(text: Column, spec: SearchSpec) -> Column | None:
    """What every document with a hit satisfies, to drop others before they are cut into lines; None if there is nothing.

    An inverted search has none: a line without the pattern may be anywhere.
    """
    c = compile_pattern(spec)
    if spec.invert or not spec.pattern:
        return None
    needles = c.branches or ([c.required] if c.required else None)
    if not needles:
        return None
    subject = _subject(text, spec)
    if spec.ignore_case:
        return subject.rlike("(?i)" + "|".join(map(quoted, needles)))
    return any_of(subject, needles)


def flagged_lines(docs: DataFrame, spec: SearchSpec, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """(key..., line_no, line, is_match) for all lines."""
    return lines(docs, key, text, spec.opens).withColumn("is_match", matches(F.col("line"), spec))


def matching_lines(docs: DataFrame, spec: SearchSpec, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """(key..., line_no, line) of the hits. One narrow stage; the document filter runs below the line generator."""
    early = may_match(F.col(text), spec)
    pruned = docs if early is None else docs.filter(early)
    return lines(pruned, key, text, spec.opens).filter(matches(F.col("line"), spec))


def has_match(text: Column, spec: SearchSpec) -> Column:
    """A document has a hit; lines are looked at in an array, without a row for each."""
    found = F.exists(line_array(text, spec.opens), lambda line: matches(line, spec))
    early = may_match(text, spec)
    return found if early is None else F.coalesce(early, F.lit(False)) & found


#: Needles of at most so many characters in all are sent to every task; those of larger tables meet the lines in a shuffle.
MAX_SENT = 4_000_000


def lines_with_needles(
    docs: DataFrame, needles: DataFrame, needle: str = "needle", key: str = "doc_id", text: str = "text", stem: int = 8
) -> DataFrame:
    """(key, line_no, line) of lines that hold any of a table of needles, of any length; null needles are ignored.

    A few needles are looked for one by one. More of them are an equi-join on their first characters, `stem` at most, fewer of shorter needles:
    lines give all their different stems of these lengths, so nothing is compared with every needle. Up to MAX_SENT the needles go to the
    lines, and only hits are shuffled; beyond, neither side has to be small. An empty needle is in every line.
    """
    wanted = needles.filter(F.col(needle).isNotNull()).select(F.col(needle).alias("__needle")).distinct()
    size = F.length("__needle")
    found = wanted.agg(
        F.count("*").alias("n"), F.sum(size).alias("chars"), F.array_sort(F.collect_set(F.least(size, F.lit(stem)))).alias("stems")
    ).first()
    each = lines(docs, key, text)
    if not found.n:
        return each.limit(0)
    if not found.stems[0]:
        return each
    if found.n <= FEW and found.chars <= MAX_SENT:
        texts = [r[0] for r in wanted.collect()]
        return lines(docs.filter(any_of(F.col(text), texts)), key, text).filter(any_of(F.col("line"), texts))
    wanted = wanted.withColumn("__stem", F.substring("__needle", 1, stem))
    if found.n + found.chars <= MAX_SENT:
        wanted = F.broadcast(wanted)
    given = [F.array_distinct(F.regexp_extract_all("line", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))) for k in found.stems]
    stems = each.withColumn("__row", F.monotonically_increasing_id()).withColumn("__stem", F.explode(F.concat(*given)))
    hits = stems.join(wanted, "__stem").filter(F.col("line").contains(F.col("__needle")))
    return hits.select("__row", key, "line_no", "line").distinct().drop("__row")
