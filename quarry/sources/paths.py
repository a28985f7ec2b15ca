"""Which files of a tree count: hidden and well-known directories, depth, ignore rules, globs and types, for paths and for Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.strings import base_name, depth, directories, extension, glob_match, glob_regex

#: Directories that are never entered.
SKIPPED = (
    ".git",
    ".hg",
    ".svn",
    "node_modules",
    ".zig-cache",
    "zig-out",
    "target",
    "__pycache__",
    ".mypy_cache",
    ".tox",
    ".venv",
    "vendor",
    ".DS_Store",
    "build",
    "dist",
)


def skips_directory(name: str) -> bool:
    return name.startswith(".") or name in SKIPPED


def in_open_directories(path: Column) -> Column:
    """No directory of the path is hidden or well known; a hidden file may be."""
    return ~F.exists(directories(path), lambda d: d.startswith(".") | d.isin(*SKIPPED))


def within_depth(path: Column, most: int) -> Column:
    """Files of the root are at depth 0; a directory deeper than `most` isn't entered."""
    return depth(path) <= most


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file. base is the directory of that file."""

    pattern: str
    negated: bool = False
    dir_only: bool = False
    anchored: bool = False
    base: str = ""


def parse_rules(text: str, base: str = "") -> list[IgnoreRule]:
    """Rules in order; blank lines and comments are none."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line[1:] if line[:2] in ("\\#", "\\!") else line
        dir_only = line.endswith("/")
        body = line.rstrip("/") if dir_only else line
        anchored = "/" in body
        if body.strip("/"):
            out.append(IgnoreRule(body[1:] if body.startswith("/") else body, negated, dir_only, anchored, base))
    return out


def _rule_regex(pattern: str) -> str:
    """An ignore pattern: * and ? stop at /, ** doesn't."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.+")
            i += 3
        elif pattern[i] == "*":
            out.append("[^/]*")
            while pattern[i : i + 1] == "*":
                i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end + 1
        else:
            i += pattern[i] == "\\" and i + 1 < len(pattern)
            out.append(re.escape(pattern[i]))
            i += 1
    return "".join(out)


def _hits(rule: IgnoreRule, rel: str, is_dir: bool) -> bool:
    if rule.base:
        if not rel.startswith(rule.base + "/"):
            return False
        rel = rel[len(rule.base) + 1 :]
    if rule.dir_only and not is_dir:
        return False
    target = rel if rule.anchored else rel.rsplit("/", 1)[-1]
    return re.fullmatch(_rule_regex(rule.pattern), target) is not None


def is_ignored(rules: list[IgnoreRule], rel: str, is_dir: bool = False, compat: bool = False) -> bool:
    """The last rule that matches decides; what lies in an ignored directory stays ignored.

    compat: rules are plain globs against the whole path or the name, wherever they stand, and flags don't matter.
    """
    if compat:
        state = False
        for r in rules:
            regex = glob_regex(r.pattern).replace(r"\z", r"\Z")
            if re.match(regex, rel) or re.match(regex, rel.rsplit("/", 1)[-1]):
                state = not r.negated
        return state
    parts = rel.split("/")
    for i in range(1, len(parts) + 1):
        state = False
        for r in rules:
            if _hits(r, "/".join(parts[:i]), is_dir or i < len(parts)):
                state = not r.negated
        if state:
            return True
    return False


def not_ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """is_ignored(compat=True), negated, for a column of paths: the last matching rule wins."""
    state = F.lit(False)
    for r in rules:
        hit = glob_match(path, r.pattern) | glob_match(base_name(path), r.pattern)
        state = F.when(hit, F.lit(not r.negated)).otherwise(state)
    return ~state


def of_type(path: Column, ext: str) -> Column:
    return extension(path) == ext


def included(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Any include glob, if there is one, and no exclude glob matches the path or its name."""

    def any_glob(globs):
        return reduce(or_, [glob_match(path, g) | glob_match(base_name(path), g) for g in globs], F.lit(False))

    parts = ([any_glob(include)] if include else []) + ([~any_glob(exclude)] if exclude else [])
    return reduce(and_, parts, F.lit(True))
