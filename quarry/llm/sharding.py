"""Sharding along a Hilbert curve: documents that are alike in several metadata dimensions lie in the same files.

Every dimension is quantised to `bits` bits, the cell's place on the Hilbert curve is computed with
Spark expressions only (Skilling's transform, unrolled), rows are sorted by that place and the order is cut into
runs, one a shard. Minima and maxima of every dimension's cells are narrow within a run, so a reader that
filters on any of them skips most files.

Only metadata is sorted: key, dimensions, size and checksum, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import staged

LAWS = ("rows", "bytes")


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """The place on the curve of a cell with `bits` bits in each dimension; null counts as 0."""
    if not dims or bits < 1 or bits * len(dims) > 62:
        raise ValueError("the index has to fit in a long")
    n = len(dims)
    state = F.struct(*[F.coalesce(d, F.lit(0)).cast("long").alias(f"x{i}") for i, d in enumerate(dims)])

    def stepped(state: Column, step) -> Column:
        """Binds each intermediate value once, so the expression grows linearly."""
        return F.transform(F.array(state), step)[0]

    def undo(i: int, level: int):
        low = F.lit((1 << level) - 1).cast("long")

        def step(s):
            x = [s[f"x{k}"] for k in range(n)]
            is_set = F.shiftright(x[i], level).bitwiseAND(1) == 1
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            out = [F.when(is_set, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap)), *x[1:]]
            if i:
                out[i] = F.when(is_set, x[i]).otherwise(x[i].bitwiseXOR(swap))
            return F.struct(*[c.alias(f"x{k}") for k, c in enumerate(out)])

        return step

    for level in range(bits - 1, 0, -1):
        for i in range(n):
            state = stepped(state, undo(i, level))

    def gray(s):
        out = [s["x0"]]
        for k in range(1, n):
            out.append(s[f"x{k}"].bitwiseXOR(out[-1]))
        return F.struct(*[c.alias(f"x{k}") for k, c in enumerate(out)])

    state = stepped(state, gray)

    def flip(s):
        t = F.lit(0).cast("long")
        for level in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.shiftright(s[f"x{n - 1}"], level).bitwiseAND(1) * F.lit((1 << level) - 1).cast("long"))
        return F.struct(*[s[f"x{k}"].bitwiseXOR(t).alias(f"x{k}") for k in range(n)])

    state = stepped(state, flip)

    def woven(s):
        out = F.lit(0).cast("long")
        for level in range(bits):
            for k in range(n):
                out = out + F.shiftleft(F.shiftright(s[f"x{k}"], level).bitwiseAND(1), level * n + (n - 1 - k))
        return out

    return stepped(state, woven)


def quantised_log(value: Column, bits: int) -> Column:
    """With 8 bits six steps for each doubling, so sizes from a byte to terabytes fill the range evenly."""
    top = (1 << bits) - 1
    return F.least(F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) + 1) * top / 42), F.lit(top)).cast("long")


def hashed(value: Column) -> Column:
    """The first 60 bits of a text's MD5 as a long, which other engines can compute too; null stays null."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def quantised_name(value: Column, bits: int) -> Column:
    """A cell by a hash of the name: equal names, equal cells, spread evenly however names are spelt. Their order is lost, so a reader
    prunes by the cell's column, computed in the same way, not by the name's least and greatest."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(hashed(value), F.lit(1 << bits))).cast("long")


def shard(
    docs: DataFrame,
    dims: dict[str, Column],
    shards: int,
    size: Column,
    key: str = "doc_id",
    group: Column | None = None,
    bits: int = 8,
    law: str = "rows",
) -> DataFrame:
    """(key, size, shard, slot, curve and one quantised column each) for every row of docs.

    law "rows": counts at most one apart. law "bytes": a row goes to the shard that its middle byte
    falls in, so sizes differ by less than the two rows at a shard's ends. Rows of one group (equal texts, say) take the group's least
    cell and so follow one another: a cut between two shards parts at most one group. slot counts a shard's rows from 0 along the curve.

    A range exchange sorts the metadata, with group and key behind the index, so one hot cell still
    spreads over many partitions. Places within partitions come from a window over each range
    partition; partition totals, one row each, turn them into global places. Nulls in a dimension
    are cell 0, a null size counts 0; repeated rows are kept; an empty table gives no rows.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    if shards < 1:
        raise ValueError("at least one shard")
    names = [f"__d_{name}" for name in dims]
    alone = group is None
    meta = docs.select(
        F.col(key).alias("__key"),
        F.coalesce(size, F.lit(0)).cast("long").alias("__size"),
        (F.lit(None) if alone else group).cast("long").alias("__group"),
        *[c.alias(f"__d_{name}") for name, c in dims.items()],
    )
    if not alone:
        # staged, so that both sides of the join are exchanges and a hot group's rows can be split
        least = staged(
            meta.filter("__group is not null").groupBy("__group").agg(F.min(F.struct(*names)).alias("__least")), "least-cells"
        )
        meta = meta.join(least, "__group", "left").withColumns(
            {n: F.coalesce(F.col(f"__least.{n}"), F.col(n)) for n in names}
        ).drop("__least")
    meta = meta.withColumn("__curve", hilbert_index([F.col(n) for n in names], bits))
    order = ["__curve", "__group", "__key", "__size"]
    runs = meta.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids count up within a partition in the order of its rows; the partition's number is in the upper bits
    runs = staged(
        runs.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)).withColumn(
            "__at", F.col("__id").bitwiseAND((1 << 33) - 1)
        ),
        "shard-order",
    )
    totals = runs.groupBy("__part").agg(F.count("*").alias("__n"), F.sum("__size").alias("__bytes"))
    parts = totals.agg(
        F.array_sort(
            F.collect_list(F.struct("__part", "__n", "__bytes"))
        ).alias("p"), F.sum("__n").alias("__rows"), F.sum("__bytes").alias("__all_bytes")
    )
    offsets = parts.select(
        "__rows",
        "__all_bytes",
        F.explode(
            F.aggregate(
                F.coalesce("p", F.array().cast("array<struct<__part:bigint,__n:bigint,__bytes:bigint>>")),
                F.struct(
                    F.lit(0).cast("long").alias("n"),
                    F.lit(0).cast("long").alias("b"),
                    F.array().cast("array<struct<part:bigint,n0:bigint,b0:bigint>>").alias("out"),
                ),
                lambda acc, x: F.struct(
                    (acc["n"] + x["__n"]).alias("n"),
                    (acc["b"] + x["__bytes"]).alias("b"),
                    F.concat(
                        acc["out"], F.array(F.struct(x["__part"].alias("part"), acc["n"].alias("n0"), acc["b"].alias("b0")))
                    ).alias("out"),
                ),
                lambda acc: acc["out"],
            )
        ).alias("o"),
    ).select("__rows", "__all_bytes", F.col("o.part").alias("__part"), F.col("o.n0").alias("__n0"), F.col("o.b0").alias("__b0"))
    # one row for each partition of the exchange: bounded by spark.sql.shuffle.partitions, whatever the data
    placed = runs.join(F.broadcast(offsets), "__part")
    if law == "rows":
        place = F.col("__n0") + F.col("__at")
        wide = F.col("__rows").cast("decimal(20,0)")
        placed = placed.withColumn("shard", F.floor(place.cast("decimal(20,0)") * shards / wide).cast("int"))
        first = F.ceil(F.col("shard").cast("decimal(20,0)") * wide / F.lit(shards)).cast("long")
        placed = placed.withColumn("slot", place - first)
    else:
        before = F.sum("__size").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
        middle = (F.col("__b0") + F.coalesce(before, F.lit(0))).cast("decimal(38,0)") * 2 + F.col("__size")
        placed = placed.withColumn(
            "shard",
            F.least(
                F.floor(middle * shards / (F.greatest(F.col("__all_bytes"), F.lit(1)).cast("decimal(20,0)") * 2)),
                F.lit(shards - 1),
            ).cast("int"),
        )
        cut = staged(placed.groupBy("shard").agg(F.min(F.col("__n0") + F.col("__at")).alias("__first")), "shard-cuts")
        placed = placed.join(F.broadcast(cut), "shard").withColumn("slot", F.col("__n0") + F.col("__at") - F.col("__first"))
    return placed.select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("shard"), F.col("slot").cast("long").alias("slot"), F.col("__curve").alias("curve"), F.col("__group").alias("group"), *[
            F.col(f"__d_{n}").alias(n) for n in dims
        ]
    )
