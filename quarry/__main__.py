"""python -m quarry [options] PATTERN [PATH...]: search files with Spark. Exit status 0 with a match, 1 without, 2 on an error. Paths that
can't be read are told on stderr; the others are searched."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.index.trigram import TrigramIndex
from quarry.operators import report
from quarry.plans.pattern import UnsupportedPattern, compile_pattern
from quarry.sources import paths, tree
from quarry.spec import SearchSpec


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("pattern", nargs="?")
    p.add_argument("paths", nargs="*", default=[])
    p.add_argument("-e", dest="explicit", help="the pattern, if it starts with -")
    p.add_argument("-F", dest="fixed", action="store_true", help="the pattern is plain text")
    p.add_argument("-i", dest="ignore_case", action="store_true", help="ASCII letters match in either case")
    p.add_argument("-v", dest="invert", action="store_true", help="lines that don't match")
    p.add_argument("-w", dest="whole_word", action="store_true")
    p.add_argument("-c", dest="count", action="store_true", help="matching lines of each file")
    p.add_argument("-l", dest="files", action="store_true", help="names of files with a match")
    p.add_argument("-n", dest="number", action="store_true", default=True)
    p.add_argument("--no-line-number", dest="number", action="store_false")
    p.add_argument("-m", dest="max_count", type=int)
    p.add_argument("-A", dest="after", type=int, default=0)
    p.add_argument("-B", dest="before", type=int, default=0)
    p.add_argument("-C", dest="context", type=int, default=0)
    p.add_argument("-t", dest="type", help="only files with this extension")
    p.add_argument("-j", dest="threads", type=int, help="tasks at a time")
    p.add_argument("--max-depth", type=int)
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--json", action="store_true")
    p.add_argument("--color", choices=("always", "never", "auto"), default="auto")
    p.add_argument("--index", metavar="FOLDER", help="use the trigram index in this folder; it is built if missing or stale")
    p.add_argument("--index-build", metavar="FOLDER", help="build the index and stop")
    return p


def run(argv: list[str], spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    joined: list[str] = []
    for a in argv:  # what follows -e is the pattern, even if it looks like an option
        if joined and joined[-1] == "-e":
            joined[-1] += a
        else:
            joined.append(a)
    o = parser().parse_args(joined)
    roots = list(o.paths)
    pattern = o.pattern
    if o.explicit is not None or o.index_build:
        roots = ([o.pattern] if o.pattern else []) + roots
        pattern = o.explicit if o.explicit is not None else ""
    if pattern is None:
        print("a pattern is needed", file=sys.stderr)
        return 2
    try:
        spec = SearchSpec(
            pattern,
            o.fixed,
            o.ignore_case,
            o.invert,
            o.whole_word,
            max_count=o.max_count,
            before=max(o.before, o.context),
            after=max(o.after, o.context),
        )
        compile_pattern(spec)
    except (UnsupportedPattern, ValueError) as error:
        print(f"pattern: {error}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.master(f"local[{o.threads or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    found = tree.files(
        spark, roots or ["."], lambda root, error: print(f"quarry: {root}: {error.strerror}", file=sys.stderr), max_depth=o.max_depth, ext=o.type
    )
    docs = tree.as_documents(found).filter(paths.included(F.col("path"), o.include, o.exclude))
    if o.index_build:
        TrigramIndex(spark, o.index_build, version=["size", "mtime"]).build(docs)
        return 0
    if o.index:  # whatever the report, documents that the index rules out aren't looked at
        docs = TrigramIndex(spark, o.index, version=["size", "mtime"]).narrowed(docs, spec)
    total = 0
    if o.count or o.files:
        rows = report.counts(docs, spec, "path").orderBy("path")
        for r in rows.toLocalIterator():
            total += r.n
            if o.count:
                print(f"{r.path}:{r.n}", file=out)
            if o.files:
                print(r.path, file=out)
        return 0 if total else 1
    plain = not (spec.before or spec.after)
    lines = report.first_matches(docs, spec, "path") if plain else report.with_context(docs, spec, "path")
    lines = lines.orderBy("path", "line_no")
    if o.json:
        shown = report.as_json(lines, "path")
    elif (o.color == "always" or (o.color == "auto" and out.isatty())) and plain:
        shown = report.coloured(lines, spec, "path")
    else:
        shown = report.plain(lines, "path", o.number)
    for r in shown.orderBy("path", "line_no").toLocalIterator():
        total += 1
        print(r.out, file=out)
    return 0 if total else 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
