"""Removal of repeated runs of lines, by winnowing over line hashes.

A run of lines with at least `min_words` words that occurs again is kept where it comes first, in the order of
(key, line), and deleted from every later place, across documents and within one.

1. Windows: from every line the shortest stretch of lines to its right with min_words words, and to its left. A run that occurs
   twice has its windows in both places, cut alike, as a window depends on nothing outside it.
2. Winnowing: the least line hash of each window is its fingerprint. Equal windows have equal ones, so a
   repeated run is guaranteed to share some; windows whose fingerprint is nowhere else are done with.
3. Positions are joined: windows that share a fingerprint and the hash of their whole content (128 bits). The first place of each content
   stays; all others are later.
4. Matches extend both ways: as each line of a longer run starts one window and ends another, chained matches
   cover the run from end to end, whichever earlier document each part is in. Those lines go.

Nothing pairs the places of one content: a hot line or passage costs a row for each place, with
minima and counts combined before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import free, staged

MIN_WORDS = 50
RUNS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))

#: Fixed odd multipliers of the two content hashes, and their inverses modulo 2 ** 64.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(f, -1, 1 << 64) for f in _FACTORS)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows_of(text: bytes, min_words: int) -> tuple[np.ndarray, ...] | None:
    """(first line, last line, fingerprint, content hashes a and b) of every window, None if there is none.

    Windows start and end with lines that hold words: blank lines at the ends of a run don't count to it.
    """
    lines = text.split(b"\n")
    count = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    total = np.concatenate(([0], np.cumsum(count)))
    if total[-1] < min_words:
        return None
    n = len(lines)
    held = np.flatnonzero(count)
    last = np.searchsorted(total, total[held] + min_words, "left") - 1  # the line that brings the words to min_words
    right = np.stack([held, last])[:, last < n]
    first = np.searchsorted(total, total[held + 1] - min_words, "right") - 1
    left = np.stack([first, held])[:, total[held + 1] >= min_words]
    both = np.unique(np.concatenate([right, left], axis=1), axis=1)
    begin, end = both
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), "<u8").reshape(-1, 2)
    content = []
    for column, (factor, inverse) in enumerate(zip(_FACTORS, _INVERSES, strict=True)):
        powers, back = _powers(factor, n), _powers(inverse, n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digest[:, column] * powers, dtype=np.uint64)))
        content.append((sums[end + 1] - sums[begin]) * back[begin])
    bounds = np.stack([begin, end + 1], axis=1).ravel()
    least = np.minimum.reduceat(np.append(digest[:, 0], np.uint64(0xFFFFFFFFFFFFFFFF)), bounds)[::2]
    return begin, end, least, content[0], content[1]


def line_windows(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(__key, __same, begin, end, anchor, a, b); __same tells rows of one key with different texts apart."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["__key", "__same", "begin", "end", "anchor", "a", "b"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found, rows = [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    if t and (w := windows_of(t, min_words)):
                        found.append(w)
                        rows.append(np.full(len(w[0]), i))
                if found:
                    rows = pa.array(np.concatenate(rows))
                    begin, end, *hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(rows),
                            part.column(1).take(rows),
                            pa.array(begin.astype(np.int32)),
                            pa.array(end.astype(np.int32)),
                            *[pa.array(h.view(np.int64)) for h in hashes],
                        ], names
                    )

    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__same"), F.col(text).cast("binary").alias("__text"))
    return rows.mapInArrow(run, f"__key {kind}, __same bigint, begin int, end int, anchor bigint, a bigint, b bigint")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(__key, __same, runs): for each document with later repeats the lines to delete, as an array of (begin, end), both included."""
    windows = staged(line_windows(docs, key, text, min_words), "windows")
    # staged, so that both sides of the join are exchanges and a hot anchor's windows can be split
    shared = staged(windows.groupBy("anchor").count().filter("count > 1").select("anchor"), "shared-anchors")
    alike = windows.join(shared, "anchor", "left_semi")
    place = F.struct("__key", "__same", "begin", "end")
    first = alike.groupBy("a", "b").agg(F.min(place).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    # the windows themselves, not `alike`, so both sides of this join are exchanges that skewed-join handling can split
    later = windows.join(staged(first, "first-places"), ["a", "b"])
    same_doc = F.col("__first.__key").eqNullSafe(F.col("__key")) & (F.col("__first.__same") == F.col("__same"))
    # a window that overlaps its own first place, in a text that repeats itself, leaves that place whole
    begin = F.when(same_doc, F.greatest("begin", F.col("__first.end") + 1)).otherwise(F.col("begin"))
    later = later.filter(~(same_doc & (F.col("__first.begin") == F.col("begin"))))
    gone = later.select("__key", "__same", begin.alias("begin"), "end").filter("begin <= end")
    return gone.groupBy("__key", "__same").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("runs"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str = "__removed"
) -> DataFrame:
    """docs with the later repeats deleted from text, and a column `removed`: the line runs that went, merged, empty if none.

    Other columns stay as they are, whatever their names; one that is called as `removed` is refused. Lines end with \\n only and are compared byte by byte. A document that is an exact copy of
    an earlier one loses all lines that stand in runs of min_words words; a text under min_words words loses nothing.
    Null text stays null. Null keys come first in the order. Rows with equal key and text are one place: all of them
    keep what the first keeps. An empty table gives no rows.
    """
    columns = docs.columns
    if removed.lower() in {c.lower() for c in columns}:
        raise ValueError(f"there is a column {removed} already")
    own, other, hashed, held = free([*columns, removed], "key", "other", "same", "runs")
    runs = staged(repeated_runs(docs, key, text, min_words), "runs").select(
        F.col("__key").alias(own), F.col("__same").alias(other), F.col("runs").alias(held)
    )
    # always by exchange and merge: which documents lose lines grows with the corpus, so it is no side to broadcast
    joined = docs.withColumn(hashed, F.xxhash64(text)).join(
        runs.hint("merge"), F.col(key).eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(other)), "left"
    )

    def cut(batches):
        for batch in batches:
            texts, gone = [], []
            for t, r in zip(batch.column(text).to_pylist(), batch.column(held).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in r or ():
                    if spans and spans[-1][1] >= x["begin"] - 1:
                        spans[-1][1] = max(spans[-1][1], x["end"])
                    else:
                        spans.append([x["begin"], x["end"]])
                if spans:
                    lines, at, kept = t.split("\n"), 0, []
                    for a, b in spans:
                        kept += lines[at:a]
                        at = b + 1
                    t = "\n".join(kept + lines[at:])
                texts.append(t)
                gone.append([{"begin": a, "end": b} for a, b in spans])
            arrays = {c: batch.column(c) for c in columns} | {
                text: pa.array(texts, pa.string()),
                removed: pa.array(gone, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            }
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    schema = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema
        ] + [T.StructField(removed, RUNS)]
    )
    return joined.select(*columns, held).mapInArrow(cut, schema)
