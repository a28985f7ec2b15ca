"""Document fingerprints: SimHash of weighted terms, and search through permuted block tables.

Terms are pairs of neighbouring words (a single word stands alone); a term that occurs n times
weighs 1 + ln n and votes on BITS signed bits with its XXH3-128 hash. The likeness of two
fingerprints is the share of equal bits.

Search: with radius r the bits are cut into r + 1 blocks. Table i is the set of fingerprints permuted so that block i comes
first and looked up by it: two fingerprints within r bits agree on at least one block, so the tables together
find all of them.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.hamming import vote
from quarry.llm.shared import staged

BITS = 128
WORDS = ("f0", "f1")


def fingerprint(text: str) -> np.ndarray:
    """Two words, most significant first; a text without words is zero."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    terms = Counter([a + b" " + b for a, b in zip(words, words[1:])] if len(words) > 1 else words)
    weights = np.log(np.fromiter(terms.values(), float, len(terms))) + 1
    return vote(b"".join([xxhash.xxh3_128_digest(t) for t in terms]), BITS, weights)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edited(text: str, other: str) -> str:
    """text with its last half, rounded down, replaced by as much of other's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_FIELDS = "n_chars bigint, edited_sha256 string, f0 bigint, f1 bigint, e0 bigint, e1 bigint, near_edited double, near_next double"


def _compared(pairs: list[tuple]) -> list[pa.Array]:
    """pairs: (text, its fingerprint, next text, its fingerprint)."""
    made = [edited(t, o) for t, _, o, _ in pairs]
    prints = [fingerprint(x) for x in made]
    own = np.array([f for _, f, _, _ in pairs], ">u8").reshape(-1, 2).astype("<u8").view("<i8")
    new = np.array(prints, ">u8").reshape(-1, 2).astype("<u8").view("<i8")
    return [
        pa.array([len(t) for t, *_ in pairs], pa.int64()),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in made], pa.string()),
        *[pa.array(x) for x in (own[:, 0], own[:, 1], new[:, 0], new[:, 1])],
        pa.array([likeness(f, e) for (_, f, _, _), e in zip(pairs, prints, strict=True)], pa.float64()),
        pa.array([likeness(f, g) for _, f, _, g in pairs], pa.float64()),
    ]


def edit_robustness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, f0, f1, e0, e1, near_edited, near_next) for every row of docs.

    Rows are ordered by key, those of one key by a hash of the text; each is edited with the next one's beginning, the last with the first's.
    Null text: empty; null keys come first; repeated rows stay and follow one another; an only
    row is its own next; an empty table gives no rows. Other columns are ignored.

    One range exchange by key and hash moves the text once. A task knows the next row of all its rows but
    the last; it also passes on its first and last text, two rows a partition, which are then matched.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *[f.split()[0] for f in _FIELDS.split(", ")], "__part", "__edge", "__text"]

    def run(batches):
        part = TaskContext.get().partitionId()
        before = first = None
        keys_type = None
        for batch in batches:
            keys_type = batch.schema.field(0).type
            pairs, keys = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = (k, t, fingerprint(t))
                if before:
                    keys.append(before[0])
                    pairs.append((before[1], before[2], t, now[2]))
                first, before = first or now, now
            if pairs:
                n = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, keys_type),
                        *_compared(pairs),
                        pa.array([part] * n, pa.int32()),
                        pa.array([0] * n, pa.int32()),
                        pa.nulls(n, pa.string()),
                    ],
                    names,
                )
        if first:
            empty = [pa.nulls(2, x) for x in (pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first[0], before[0]], keys_type),
                    *empty,
                    pa.array([part] * 2, pa.int32()),
                    pa.array([1, 2], pa.int32()),
                    pa.array([first[1], before[1]], pa.string()),
                ],
                names,
            )

    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    # the exchange samples its keys to the driver, so a text is ordered by its hash
    ordered = rows.withColumn("__tie", F.xxhash64("__t")).repartitionByRange(key, "__tie").sortWithinPartitions(key, "__tie").drop("__tie")
    seen = staged(ordered.mapInArrow(run, f"`{key}` {kind}, {_FIELDS}, __part int, __edge int, __text string"), "edited")
    heads = seen.filter("__edge = 1").select("__part", F.col("__text").alias("__head"))
    # a number for each partition of the exchange: small whatever the data; texts meet by it
    w = Window.orderBy("__part")
    after = F.coalesce(
        F.lead("__part").over(w), F.first("__part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    order = heads.select("__part").select("__part", after.alias("__after"))
    follow = order.join(heads.select(F.col("__part").alias("__after"), F.col("__head").alias("__next")), "__after").select("__part", "__next")
    tails = seen.filter("__edge = 2").select(key, "__part", "__text").join(follow, "__part").select(key, "__text", "__next")

    def last(batches):
        for batch in batches:
            pairs = [
                (t, fingerprint(t), o, fingerprint(o)) for t,
                o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_compared(pairs)], names[:-3])

    ends = tails.mapInArrow(last, f"`{key}` {kind}, {_FIELDS}")
    return seen.filter("__edge = 0").drop("__part", "__edge", "__text").unionByName(ends)


def search(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """(q0, q1, f0, f1, distance) for all fingerprints of prints(f0, f1) within the radius of one of queries(f0, f1).

    Distinct fingerprints only: copies don't multiply. The tables are one exchange keyed by (table, block).
    """
    n = radius + 1
    if not 1 <= radius < 32:
        raise ValueError("a radius from 1 to 31")
    cuts = [BITS * i // n for i in range(n + 1)]

    def block(low: int, high: int):
        """Bits low to high, counted from the most significant, as an array of one or two longs."""
        out = []
        for w in (0, 1):
            a, b = max(low - 64 * w, 0), min(high - 64 * w, 64)
            if a < b:
                piece = F.shiftrightunsigned(WORDS[w], 64 - b)
                out.append(piece.bitwiseAND((1 << (b - a)) - 1) if b - a < 64 else piece)
        return F.xxhash64(*out)

    def tables(df):
        return df.select(*WORDS, F.posexplode(F.array(*[block(a, b) for a, b in zip(cuts, cuts[1:])])).alias("table", "block"))

    left = tables(queries.select(*WORDS).distinct()).withColumnsRenamed({"f0": "q0", "f1": "q1"})
    both = left.join(tables(prints.select(*WORDS).distinct()), ["table", "block"])
    apart = F.bit_count(F.col("q0").bitwiseXOR(F.col("f0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("f1")))
    return both.withColumn("distance", apart).filter(F.col("distance") <= radius).select("q0", "q1", *WORDS, "distance").distinct()
