"""Column helpers: ASCII folding, byte views, paths, globs."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, everything else as it is, so lengths and offsets stay."""
    return F.translate(text, UPPER, LOWER)


def latin1(text: Column) -> Column:
    """One character for each UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def latin1_str(text: str) -> str:
    return text.encode("utf-8").decode("latin-1")


def count_char(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def first_offset(text: Column, needle: str, start: int = 0) -> Column:
    """0-based offset of the first occurrence at or after start, null if there is none."""
    at = F.locate(needle, text, start + 1) - 1
    return F.when(at >= 0, at).cast("long")


def quoted(text: str) -> str:
    """text as a Java and RE2 regular expression."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in text)


def occurrences(text: Column, needle: str) -> Column:
    """How often needle occurs, overlaps included."""
    return F.regexp_count(text, F.lit(f"(?={quoted(needle)})")).cast("long")


def overlapping_offsets(text: Column, needle: str) -> Column:
    """0-based offsets of all occurrences, overlaps included, as an array, in the text's order; meant for lines, as each offset copies those before.

    The pieces between look-ahead matches are the gaps: their running lengths are the offsets.
    """
    pieces = F.split(text, f"(?={quoted(needle)})")
    sums = F.aggregate(
        F.transform(pieces, lambda p: F.length(p).cast("long")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    # a split before the first character yields no empty piece, so the first piece may or may not start with the needle
    return F.filter(sums, lambda at: (at > 0) | text.startswith(needle))


#: Characters of English text and code from common to rare; those that are not here are rarer still. Only a prefilter's choice depends on it.
COMMON = " etaoinshrdlucmfwygpbvk" + "_.,-=()/\"0123456789:;jxqzETAOINSHRDLUCMFWYGPBVKJXQZ"


def rarity(char: str) -> int:
    """How rare a character is likely to be, from 0."""
    at = COMMON.find(char)
    return at if at >= 0 else len(COMMON)


def rarest_index(needle: str) -> int:
    """Place of the character that is likely the rarest, the first of equal ones; 0 for an empty needle."""
    return max(range(len(needle)), key=lambda i: rarity(needle[i]), default=0)


def glob_regex(glob: str) -> str:
    """* is any run, also across /, ? any one character; the whole string has to match."""
    return r"\A" + "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or quoted(c) for c in glob) + r"\z"


def glob_match(text: Column, glob: str) -> Column:
    return text.rlike(glob_regex(glob))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, empty without one; a leading dot alone starts no extension."""
    return F.regexp_extract(base_name(path), r"(?<=.)\.([^.]*)$", 1)


def directories(path: Column) -> Column:
    """Names of the directories of a relative path."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def py_extension(name: str) -> str:
    found = re.search(r"(?<=.)\.([^.]*)\Z", name)
    return found[1] if found else ""
