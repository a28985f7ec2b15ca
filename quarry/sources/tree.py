"""Files of directory trees as a DataFrame. The listing is made on the driver, bytes are read by the tasks.

Trees have to be reachable under the same path from the driver and all executors (a shared file system).
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.strings import py_extension
from quarry.operators.lines import not_binary
from quarry.sources.paths import IgnoreRule, is_ignored, parse_rules, skips_directory

FILES = "path string, rel_path string, name string, ext string, depth int, size bigint, mtime timestamp"


def list_tree(
    root: str,
    max_depth: int | None = None,
    ext: str | None = None,
    ignore_files: tuple[str, ...] = (".gitignore",),
    compat: bool = False,
) -> list[tuple]:
    """Rows of FILES, by path. A root that is a file is taken as it is, whatever the filters; links are not followed."""
    root = root.rstrip("/") or "/"
    if not os.path.isdir(root):
        return [_row(root, os.path.basename(root), 0)]
    out: list[tuple] = []
    rules: list[IgnoreRule] = []

    def enter(rel: str, depth: int) -> None:
        here = f"{root}/{rel}" if rel else root
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except PermissionError:
            return
        for name in ignore_files:
            try:
                with open(f"{here}/{name}", encoding="utf-8", errors="replace") as f:
                    rules.extend(parse_rules(f.read(), "" if compat else rel))
            except OSError:
                pass  # no such file here
        for e in entries:
            below = f"{rel}/{e.name}" if rel else e.name
            if e.is_symlink():
                continue
            if e.is_dir():
                if not skips_directory(e.name) and (max_depth is None or depth < max_depth) and not is_ignored(rules, below, True, compat):
                    enter(below, depth + 1)
            elif e.is_file() and (ext is None or py_extension(e.name) == ext) and not is_ignored(rules, below, False, compat):
                out.append(_row(f"{root}/{below}", below, depth))

    enter("", 0)
    return out


def _row(path: str, rel: str, depth: int) -> tuple:
    stat = os.stat(path)
    name = os.path.basename(path)
    return path, rel, name, py_extension(name), depth, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc)


def files(spark: SparkSession, roots: str | list[str] = ".", warn: Callable[[str, OSError], None] | None = None, **how) -> DataFrame:
    """(path, rel_path, name, ext, depth, size, mtime, content) of all files under the roots. Unreadable roots are skipped, and told to warn(root, error);
    a file that vanishes before it is read has null content."""
    rows: list[tuple] = []
    for root in [roots] if isinstance(roots, str) else roots:
        try:
            rows += list_tree(root, **how)
        except OSError as error:
            if warn:
                warn(root, error)
    listed = spark.createDataFrame(rows, FILES)
    size = sum(r[5] for r in rows)
    listed = listed.repartition(max(1, min(len(rows), size // (32 << 20) + spark.sparkContext.defaultParallelism)))

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time, so memory holds one
                part = batch.slice(i, 1)
                try:
                    with open(part.column(0)[0].as_py(), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([content], pa.binary())], [*part.schema.names, "content"]
                )

    return listed.mapInArrow(read, FILES + ", content binary")


def as_documents(found: DataFrame) -> DataFrame:
    """(doc_id, path, text, size, mtime): text files of files(); bytes that are no UTF-8 are read as U+FFFD; binary and empty files are left out."""
    docs = found.filter(F.col("content").isNotNull() & (F.col("size") > 0)).select(
        F.xxhash64("path").alias("doc_id"),
        "path",
        F.expr("make_valid_utf8(cast(content as string))").alias("text"),
        "size",
        "mtime",
    )
    return docs.filter(not_binary(F.col("text")))
