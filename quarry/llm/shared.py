"""What several corpus operators need: shared storage, streaming over sorted rows, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: This process's own part of the shared folder.
_RUN = uuid.uuid4().hex


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage is cut, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/quarry/{_RUN}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def drop_staged(df: DataFrame) -> None:
    """Deletes a table that staged has returned, when nothing reads it any more."""
    _delete(df.sparkSession, df._staged)


def clear_staged(spark: SparkSession) -> None:
    """Deletes what staged has written in this process; results that are still to be read from there must be saved first."""
    _delete(spark, f"{shared_dir(spark)}/quarry/{_RUN}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names with as many underscores before them as make them differ from all that are taken, in any case of letters."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def in_key_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int, size: int = 1 << 24) -> Iterator[pa.Table]:
    """Whole runs of equal keys, some `rows` rows or `size` bytes at a time, from batches that are sorted by key."""
    held: list[pa.RecordBatch] = []
    count = held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        held_bytes += batch.nbytes
        if count < rows and held_bytes < size:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield whole.slice(0, cut)
        rest = whole.slice(cut)
        held, count, held_bytes = rest.to_batches(), rest.num_rows, rest.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def grouped(df: DataFrame, key: str, work: Callable, schema: str, rows: int = 100_000) -> DataFrame:
    """work(table) over whole keys, many small keys at once; rows are dealt and sorted by key."""

    def run(batches):
        for part in in_key_runs(batches, key, rows):
            yield from work(part)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a, b), from labels found before."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        open_ = label[a] != label[b]
        if not open_.any():
            return label
        a, b = a[open_], b[open_]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the smallest node that it reaches.

    Alternating star contraction: each round hooks every node's larger neighbours to its smallest
    neighbour, then every node's smaller ones likewise, until nothing changes. Rounds grow with the
    logarithm of the number of nodes. Each is two grouped minima with map-side combine and two
    joins that adaptive execution may split where one node has many links; its result is written
    to the shared folder. Self links and nulls don't count.
    """
    now = staged(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
        done, now = now, staged(small.filter("u != v").distinct(), "stars")
        drop_staged(done)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
    raise RuntimeError("components did not settle")


def pieces(batches, rows: int = 256):
    """The batches in slices of few rows, so that a task holds few decoded texts and results at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bytes of rows that Spark hands to Python at once where small_batches was called; Spark's own limit is 64 MB or 10,000 rows.
BATCH_BYTES = 1 << 21


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands rows to Python BATCH_BYTES at a time, unless the session has a smaller limit; a longer row is a batch of its own.

    JVM and worker hold each batch several times (as it grows, on its way and decoded). Rows and results stay the same.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
