"""Shapes of a result: counts, documents, caps, context, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lines import line_array
from quarry.operators.match import has_match, matches, matching_lines, may_match
from quarry.plans.automaton import SHALLOW, recurses
from quarry.plans.pattern import Compiled, compile_pattern
from quarry.spec import SearchSpec

ESC = "\x1b["
PATH_COLOUR, LINE_COLOUR, MATCH_COLOUR, MARK_COLOUR, RESET = f"{ESC}35m", f"{ESC}32m", f"{ESC}1;31m", f"{ESC}36m", f"{ESC}0m"


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def counts(docs: DataFrame, spec: SearchSpec, key="doc_id", text: str = "text") -> DataFrame:
    """(key..., n): matching lines of each document that has any, capped at max_count. Counted in the line array: no shuffle.

    One row of docs is one document.
    """
    early = may_match(F.col(text), spec)
    n = F.size(F.filter(line_array(F.col(text), spec.opens), lambda line: matches(line, spec))).cast("bigint")
    if spec.max_count is not None:
        n = F.least(n, F.lit(spec.max_count).cast("bigint"))
    # a filter on n would be pushed below and count twice; a generator of none or one isn't
    some = F.explode(F.filter(F.array(n), lambda x: x > 0))
    return (docs if early is None else docs.filter(early)).select(*_keys(key), some.alias("n"))


def docs_with_matches(docs: DataFrame, spec: SearchSpec, key="doc_id", text: str = "text") -> DataFrame:
    return docs.filter(has_match(F.col(text), spec)).select(*_keys(key))


def docs_without_match(docs: DataFrame, spec: SearchSpec, key="doc_id", text: str = "text") -> DataFrame:
    return docs.filter(~has_match(F.col(text), spec)).select(*_keys(key))


def total(docs: DataFrame, spec: SearchSpec, text: str = "text") -> DataFrame:
    """(n, status): matching lines in all; status is 0 if there is one, else 1."""
    out = counts(docs.select(F.lit(0).alias("__one"), text), spec, "__one", text).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return out.select("n", F.when(F.col("n") > 0, 0).otherwise(1).alias("status"))


def first_matches(docs: DataFrame, spec: SearchSpec, key="doc_id", text: str = "text") -> DataFrame:
    """matching_lines, the first max_count of each document, cut off in the line array: no shuffle."""
    if spec.max_count is None:
        return matching_lines(docs, spec, key, text)
    early = may_match(F.col(text), spec)
    numbered = F.transform(
        line_array(F.col(text), spec.opens), lambda line, i: F.struct((i + 1).cast("bigint").alias("line_no"), line.alias("line"))
    )
    hits = F.slice(F.filter(numbered, lambda x: matches(x["line"], spec)), 1, spec.max_count)
    return (docs if early is None else docs.filter(early)).select(*_keys(key), F.inline(hits))


def with_context(docs: DataFrame, spec: SearchSpec, key="doc_id", text: str = "text") -> DataFrame:
    """(key..., line_no, line, is_match, group_id): hits with the lines around them, each line once.

    group_id counts the separate stretches of a document from 0. max_count cuts hits off first, so the lines behind the last hit that counts stay.
    Hits, the cap and the context are found in the line array; only the lines that stay are shuffled, by document, to count its stretches.
    """
    keys = _keys(key)
    early = may_match(F.col(text), spec)
    numbered = F.transform(
        line_array(F.col(text), spec.opens),
        lambda line, i: F.struct((i + 1).cast("bigint").alias("line_no"), line.alias("line"), matches(line, spec).alias("is_match")),
    )
    flagged = (docs if early is None else docs.filter(early)).select(*keys, numbered.alias("__lines"))
    hits = F.transform(F.filter("__lines", lambda x: x["is_match"]), lambda x: x["line_no"])
    flagged = flagged.withColumn("__hits", hits if spec.max_count is None else F.slice(hits, 1, spec.max_count)).filter(F.size("__hits") > 0)
    spans = F.transform(
        "__hits",
        lambda h: F.sequence(F.greatest(h - spec.before, F.lit(1).cast("long")), F.least(h + spec.after, F.size("__lines").cast("long"))),
    )
    near = F.transform(F.array_distinct(F.flatten(spans)), lambda i: F.get("__lines", (i - 1).cast("int")))
    kept = flagged.withColumn("__last", F.element_at("__hits", -1)).withColumn("__near", near).select(*keys, "__last", F.inline("__near"))
    kept = kept.select(*keys, "line_no", "line", (F.col("is_match") & (F.col("line_no") <= F.col("__last"))).alias("is_match"))
    by_doc = Window.partitionBy(*keys).orderBy("line_no")
    gap = F.coalesce(F.col("line_no") - F.lag("line_no").over(by_doc) > 1, F.lit(False)).cast("int")
    return kept.withColumn("__gap", gap).withColumn(
        "group_id", F.sum("__gap").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__gap")


def top_documents(docs: DataFrame, spec: SearchSpec, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k documents with most matching lines, ties by key."""
    return counts(docs, spec, key, text).orderBy(F.col("n").desc(), F.col(key)).limit(k)


def plain(found: DataFrame, key: str = "doc_id", line_number: bool = True) -> DataFrame:
    """(key, line_no, out): path:line:text, with - for : at context lines."""
    mark = F.when(F.col("is_match"), ":").otherwise("-") if "is_match" in found.columns else F.lit(":")
    parts = [F.col(key).cast("string"), mark]
    if line_number:
        parts += [F.col("line_no").cast("string"), mark]
    return found.select(key, "line_no", F.concat(*parts, "line").alias("out"))


def as_json(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, out): one object for each line."""
    return found.select(key, "line_no", F.to_json(F.struct(key, "line_no", "line")).alias("out"))


def _replaced(line: Column, c: Compiled, java: str, by: str) -> Column:
    """Matches in the line replaced. Lines on which java.util.regex could overflow its stack are refused, if they hold a match."""
    out = F.regexp_replace(line, java, by)
    if c.limit is None or not recurses(c.node):
        return out
    told = F.raise_error(F.lit(f"a line of over {SHALLOW} characters is too long to replace this pattern in"))
    return F.when(F.length(line) <= SHALLOW, out).when(~c.automaton.column(line), line).otherwise(told.cast("string"))


def highlighted(line: Column, spec: SearchSpec) -> Column:
    """The line with every match in colour; empty matches are left alone."""
    if spec.invert or not spec.pattern:
        return line
    return _replaced(line, compile_pattern(spec), f"({compile_pattern(spec).java})", f"{MATCH_COLOUR}$1{RESET}".replace("\\", "\\\\"))


def coloured(found: DataFrame, spec: SearchSpec, key: str = "doc_id") -> DataFrame:
    """(key, line_no, out) with coloured path, number, marks and matches."""
    mark = F.lit(f"{MARK_COLOUR}:{RESET}")
    return found.select(
        key, "line_no", F.concat(
            F.lit(PATH_COLOUR),
            F.col(key).cast("string"),
            F.lit(RESET),
            mark,
            F.lit(LINE_COLOUR),
            F.col("line_no").cast("string"),
            F.lit(RESET),
            mark,
            highlighted(F.col("line"), spec),
        ).alias("out")
    )


def replaced(docs: DataFrame, spec: SearchSpec, by: str, text: str = "text") -> DataFrame:
    """docs with every match in every line replaced by a text."""
    c = compile_pattern(spec)
    safe = by.replace("\\", "\\\\").replace("$", "\\$")
    return docs.withColumn(
        text, F.array_join(F.transform(F.split(F.col(text), "\n", -1), lambda line: _replaced(line, c, c.java, safe)), "\n")
    )
