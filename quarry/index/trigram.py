"""A trigram index as Parquet tables, and searches that read candidates from it.

postings(trigram, doc_id, loc_mask, next_mask, generation, shard) in a folder for each generation and each of SHARDS classes of trigrams, sorted by
trigram, so that a search opens few files and reads few of their row groups;
files(doc_id, size, fingerprint) for staleness, a folder for each generation; gone(doc_id, generation) names documents whose earlier postings don't
count any more; meta(version, generation), one row. Masks are bits of positions modulo 8 and of the following byte
modulo 8 (255 at the end of a document). A row of a corpus is a document, and keys are unique.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.strings import latin1
from quarry.operators.lines import not_binary
from quarry.operators.match import matching_lines
from quarry.plans import trigrams as T
from quarry.plans.pattern import compile_pattern
from quarry.spec import SearchSpec

VERSION = 2
SHARDS = 64


def shard_of(trigram):
    """The class of a trigram, an int or a Column; neighbouring codes spread."""
    return trigram * 40_503 % 65_537 % SHARDS


def trigram_code(chars: Column) -> Column:
    """The code of the first three characters of a byte view."""
    return F.ascii(chars) + F.ascii(F.substring(chars, 2, 1)) * 256 + F.ascii(F.substring(chars, 3, 1)) * 65536


#: Bytes of a text that are folded at once, a multiple of 8: bounds memory, not results.
PIECE = 1 << 22
#: Postings that are packed for the shuffle at once, at least: what compresses well; bounds memory, not results.
PACKED = 400_000


def _merged(code: np.ndarray, loc: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each code once, masks joined."""
    order = np.argsort(code, kind="stable")
    code, loc, nxt = code[order], loc[order], nxt[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
    if not len(first):
        return code, loc, nxt
    return code[first], np.bitwise_or.reduceat(loc, first), np.bitwise_or.reduceat(nxt, first)


def _codes(part: np.ndarray) -> np.ndarray:
    data = part.astype(np.int32)
    return data[:-2] | data[1:-1] << 8 | data[2:] << 16


def folded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams, location masks, next masks) of a text's bytes, each different trigram once."""
    whole = np.frombuffer(data, np.uint8)
    out = (np.zeros(0, np.int32),) * 3
    for at in range(0, max(0, len(whole) - 2), PIECE):
        part = whole[at : at + PIECE + 3]
        code = _codes(part)[:PIECE]
        loc = np.left_shift(np.int32(1), np.arange(len(code), dtype=np.int32) % 8)
        nxt = np.full(len(code), 255, np.int32)
        behind = part[3 : 3 + len(code)]
        nxt[: len(behind)] = np.left_shift(np.int32(1), (behind % 8).astype(np.int32))
        found = _merged(code, loc, nxt)
        out = _merged(*map(np.concatenate, zip(out, found, strict=True))) if len(out[0]) else found
    return out


def _fold(batches, names: list[str]):
    """Batches of (key, bytes) to batches of (trigram, key, loc_mask, next_mask)."""
    for batch in batches:
        held, rows, count = [], [], 0

        def out(batch=batch):
            code, loc, nxt = (np.concatenate(x) for x in zip(*held, strict=True))
            keys = batch.column(0).take(pa.array(np.repeat(rows, [len(h[0]) for h in held])))
            return pa.RecordBatch.from_arrays([pa.array(code), keys, pa.array(loc), pa.array(nxt)], names)

        for i in range(batch.num_rows):
            data = batch.column(1)[i].as_py()
            found = folded(data) if data else ((),)
            if len(found[0]):
                held.append(found)
                rows.append(i)
                count += len(found[0])
            if count > 200_000:
                yield out()
                held, rows, count = [], [], 0
        if held:
            yield out()


def _folded_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(trigram, key, loc_mask, next_mask): folded inside the task that reads the text, so that no text is shuffled."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["trigram", key, "loc_mask", "next_mask"]
    return docs.select(key, F.col(text).cast("binary").alias("__bytes")).mapInArrow(
        lambda batches: _fold(batches, names), f"trigram int, `{key}` {kind}, loc_mask int, next_mask int"
    )


def distinct_trigrams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, trigram): different byte trigrams of each document. One pass over the text, distinct within the row: no shuffle."""
    return _folded_rows(docs, key, text).select(key, "trigram")


def trigram_sums(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, total): how many byte trigrams the whole text has, repeats included, and the sum of their codes. Texts under three bytes have no row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_py() or b"", np.uint8)
                sums = [_codes(data[at : at + PIECE + 2]).sum(dtype=np.int64) for at in range(0, len(data) - 2, PIECE)]
                if sums:
                    rows.append((i, len(data) - 2, int(sum(sums))))
            if rows:
                at, n, total = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), n, total], [key, "n", "total"])

    return docs.select(key, F.col(text).cast("binary").alias("__bytes")).mapInArrow(run, f"`{key}` {kind}, n bigint, total bigint")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, key, loc_mask, next_mask), ints but for the key. Binary documents are left out. Nothing is shuffled."""
    return _folded_rows(docs.filter(not_binary(F.col(text))), key, text)


def document_frequency(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("trigram").agg(F.count("*").alias("df"))


def statistics(postings_: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(files, trigrams, postings)."""
    per = document_frequency(postings_).agg(F.count("*").alias("trigrams"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return docs.agg(F.count(F.col(key)).alias("files")).crossJoin(per)  # one row each


def snapshot(docs: DataFrame, key: str = "doc_id", text: str = "text", version: list[str] | None = None) -> DataFrame:
    """(key, size, fingerprint): what staleness compares. With version columns (size and time of a file, say) texts aren't read."""
    if version:
        return docs.select(key, F.lit(0).cast("bigint").alias("size"), F.xxhash64(*version).alias("fingerprint"))
    return docs.select(
        key,
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("size"),
        F.xxhash64(text).alias("fingerprint"),
    )


def changes(before: DataFrame, now: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, change): added, removed or changed between two snapshots."""
    old, new = (s.select(key, F.struct("size", "fingerprint").alias(name)) for s, name in ((before, "old"), (now, "new")))
    both = old.join(new, key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(key, change.alias("change"))


def plan_of(spec: SearchSpec) -> tuple[T.Plan, dict[int, int]]:
    """What candidates need, and next-byte masks if the pattern is a text. Inverted and case-blind searches rule nothing out."""
    c = compile_pattern(spec)
    if spec.invert or spec.ignore_case:
        return T.MatchAll(), {}
    masks = {}
    if c.literal:
        masks = T.need_masks(c.literal.encode("latin-1" if spec.byte_mode else "utf-8"))
    return T.decompose(c.node, spec.byte_mode), masks


def _holds(plan: T.Plan, flags: dict[int, Column]) -> Column:
    match plan:
        case T.Need(grams):
            parts = [flags[t] for t in sorted(grams)]
        case T.And(items):
            parts = [_holds(i, flags) for i in items]
        case T.Or(items):
            out = F.lit(False)
            for i in items:
                out = out | _holds(i, flags)
            return out
        case _:
            return F.lit(True)
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def candidates(postings_: DataFrame, spec: SearchSpec, key: str = "doc_id", masks: bool = True) -> DataFrame | None:
    """(key) of documents that may match, a superset of those that do; None if the pattern rules none out.

    The trigram filter is pushed to the scan; one aggregation by document with map-side combine.
    """
    plan, need = plan_of(spec)
    if not T.is_selective(plan):
        return None
    grams = sorted(T.leaves(plan))
    hits = postings_.filter(F.col("trigram").isin(grams))
    if "shard" in postings_.columns:  # prunes folders
        hits = hits.filter(F.col("shard").isin(sorted({shard_of(t) for t in grams})))
    if masks and need:
        wanted = F.lit(0)
        for t, m in need.items():
            wanted = F.when(F.col("trigram") == t, F.lit(m)).otherwise(wanted)
        hits = hits.filter(F.col("next_mask").bitwiseAND(wanted) == wanted)
    if isinstance(plan, T.Need):  # all of a set: relational division
        return hits.groupBy(key).agg(F.count("*").alias("__k")).filter(F.col("__k") == len(plan.trigrams)).select(key)
    flags = [F.max((F.col("trigram") == t).cast("int")).alias(f"__t{t}") for t in grams]
    found = hits.groupBy(key).agg(*flags)
    return found.filter(_holds(plan, {t: F.col(f"__t{t}") == 1 for t in grams})).select(key)


def indexed_lines(docs: DataFrame, postings_: DataFrame, spec: SearchSpec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of matching_lines, reading only candidates' lines."""
    found = candidates(postings_, spec, key)
    return matching_lines(docs if found is None else docs.join(found, key, "left_semi"), spec, key, text)


#: Keys of at most so many bytes, with 16 more for each, are sent to the texts; more of them meet the texts in a shuffle.
MAX_SENT = 32_000_000


def _with_keys(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """docs that have one of the keys. Counts them first, as Spark knows no size of a filtered join or group and would shuffle every text."""
    sent = keys.agg(F.coalesce(F.sum(F.octet_length(F.col(key).cast("string")) + 16), F.lit(0))).first()[0]
    return docs.join(F.broadcast(keys) if sent <= MAX_SENT else keys, key, "left_semi")


def _dealt(docs: DataFrame, key: str, text: str, salts: int) -> DataFrame:
    """(shard, salt, packed): postings() of many documents in one binary for each shard, sorted and compressed for the shuffle."""
    names = ["trigram", key, "loc_mask", "next_mask"]

    def pack(table: pa.Table) -> list[tuple[int, int, bytes]]:
        code, loc, nxt = (table.column(n).to_numpy() for n in ("trigram", "loc_mask", "next_mask"))
        shard = shard_of(code.astype(np.int64))
        order = np.lexsort((code, shard))
        whole = pa.table([code[order], table.column(key).take(pa.array(order)), loc[order].astype(np.uint8), nxt[order].astype(np.uint8)], names).combine_chunks()
        starts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
        salt, out = zlib.crc32(str(table.column(key)[0]).encode()) % salts, []
        for a, b in zip(starts, [*starts[1:], len(code)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(whole.slice(a, b - a))
            out.append((int(shard[order[a]]), salt, sink.getvalue().to_pybytes()))
        return out

    def run(batches):
        held, n = [], 0

        def out():
            shard, salt, packed = zip(*pack(pa.Table.from_batches(held)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(salt, pa.int32()), pa.array(packed, pa.binary())], ["shard", "salt", "packed"])

        for batch in _fold(batches, names):
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    whole = docs.filter(not_binary(F.col(text))).select(key, F.col(text).cast("binary").alias("__bytes"))
    return whole.mapInArrow(run, "shard int, salt int, packed binary")


def _unpacked(dealt: DataFrame, key: str, kind: str) -> DataFrame:
    """(trigram, key, loc_mask, next_mask, shard) of _dealt's binaries."""
    names = ["trigram", key, "loc_mask", "next_mask", "shard"]

    def run(batches):
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with pa.ipc.open_stream(packed.as_buffer()) as stream:
                    for part in stream:
                        loc, nxt = part.column(2).cast(pa.int32()), part.column(3).cast(pa.int32())
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), loc, nxt, pa.array(np.full(len(part), shard, np.int32))], names)

    return dealt.select("shard", "packed").mapInArrow(run, f"trigram int, `{key}` {kind}, loc_mask int, next_mask int, shard int")


class TrigramIndex:
    """The index of one corpus in a folder: build, check, refresh, search; falls back to a full scan."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", version: list[str] | None = None):
        self.spark, self.path, self.key, self.text, self.version = spark, path.rstrip("/"), key, text, version

    def snapshot(self, docs: DataFrame) -> DataFrame:
        return snapshot(docs, self.key, self.text, self.version)

    def _mark(self, generation: int) -> None:
        """The last step of a change: what was written for this generation counts from now on."""
        self.spark.createDataFrame([(VERSION, generation)], "version int, generation int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")

    def _write(self, docs: DataFrame, generation: int) -> None:
        """Deals postings by shard, a shard to several tasks if there are more tasks than shards: common trigrams don't fill one.

        Nothing is sampled, so postings are made once. The number of tasks is given, as by their packed size too many postings would be sorted in one.
        """
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, tasks // SHARDS)
        dealt = _dealt(docs, self.key, self.text, salts).repartition(tasks, "shard", "salt")
        made = _unpacked(dealt, self.key, docs.schema[self.key].dataType.simpleString())
        made.sortWithinPartitions("shard", "trigram", self.key).write.mode("overwrite").partitionBy("shard").parquet(
            f"{self.path}/postings/generation={generation}"
        )

    def _snap(self, docs: DataFrame, generation: int) -> None:
        self.snapshot(docs).write.mode("overwrite").parquet(f"{self.path}/files/generation={generation}")

    def build(self, docs: DataFrame) -> None:
        """Writes all tables; meta comes last and marks the index as whole. It goes on counting generations, so that nothing is read
        of what was there before."""
        generation = self.generation()
        generation = 0 if generation is None else generation + 1
        self._write(docs, generation)
        self._snap(docs, generation)
        # all earlier generations are gone
        self.snapshot(docs).limit(0).select(self.key, F.lit(0).alias("before")).write.mode("overwrite").parquet(f"{self.path}/gone/generation={generation}")
        self.spark.createDataFrame([(generation,)], "first int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/first")
        self._mark(generation)

    def generation(self) -> int | None:
        """The number of the last change, None if there is no whole index of this version."""
        try:
            found = self.spark.read.schema("version int, generation int").parquet(f"{self.path}/meta").collect()
        except PySparkException:  # missing or unreadable: the index isn't there
            return None
        return found[0].generation if [r.version for r in found] == [VERSION] else None

    def valid(self) -> bool:
        return self.generation() is not None

    def _paths(self, name: str) -> list[str]:
        first = self.spark.read.parquet(f"{self.path}/first").first()["first"]
        return [f"{self.path}/{name}/generation={g}" for g in range(first, self.generation() + 1)]

    def postings(self) -> DataFrame:
        """Postings that count: of all generations from the last build on, without documents that went or changed after."""
        kind = self.files().schema[self.key].dataType.simpleString()
        schema = f"trigram int, `{self.key}` {kind}, loc_mask int, next_mask int, generation int, shard int"
        paths = self._paths("postings")
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/postings").parquet(*paths)
        if len(paths) > 1:
            gone = self.spark.read.schema(f"`{self.key}` {kind}, before int").parquet(*self._paths("gone")).groupBy(F.col(self.key).alias("__gone")).agg(F.max("before").alias("__before"))
            found = found.join(gone, (F.col(self.key) == F.col("__gone")) & (F.col("generation") < F.col("__before")), "left_anti")
        return found.drop("generation")

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files/generation={self.generation()}")

    def stale(self, docs: DataFrame) -> bool:
        return not changes(self.files(), self.snapshot(docs), self.key).isEmpty()

    def narrowed(self, docs: DataFrame, spec: SearchSpec, rebuild: bool = True) -> DataFrame:
        """docs without those that the index rules out, for any report. A missing, invalid or stale index is built or brought up to date, or,
        without rebuild, not used. Inverted searches need every document."""
        if not self.valid():
            if not rebuild:
                return docs
            self.build(docs)
        elif self.stale(docs):
            if not rebuild:
                return docs
            self.refresh(docs)
        found = candidates(self.postings(), spec, self.key)
        return docs if found is None else _with_keys(docs, found, self.key)

    def search(self, docs: DataFrame, spec: SearchSpec, rebuild: bool = True) -> DataFrame:
        """Matching lines."""
        return matching_lines(self.narrowed(docs, spec, rebuild), spec, self.key, self.text)

    def refresh(self, docs: DataFrame) -> None:
        """Brings the index up to docs: a generation more, with postings of new and changed documents only; nothing that is there is read or written
        again but the snapshot."""
        generation = self.generation() + 1
        self._snap(docs, generation)  # not read before meta names it, but by what follows here, so texts are hashed once
        diff = changes(self.files(), self.spark.read.parquet(f"{self.path}/files/generation={generation}"), self.key)
        self._write(_with_keys(docs, diff.filter("change != 'removed'").select(self.key), self.key), generation)
        diff.filter("change != 'added'").select(self.key, F.lit(generation).alias("before")).write.mode("overwrite").parquet(f"{self.path}/gone/generation={generation}")
        self._mark(generation)
