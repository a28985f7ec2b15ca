"""SimHash near-duplicate groups through a Gray-order hierarchical index.

1. Fingerprint: every word shingle votes with the bits of its hash (executors, one pass over the text).
2. Equal texts become one node, so copies cost nothing further: with 64 bits texts of equal fingerprint, with more those of an equal
   set of shingles.
3. Candidates meet by a shared key. With 64 bits and radius r these are the r + 1 blocks of bits of which two near fingerprints
   share one (exact); hot blocks are split again by the same rule. Longer fingerprints, for a radius that no block
   survives, meet by shingles: in a common order of all shingles, two texts that share LIKENESS of theirs share one of their
   prefixes (exact); nodes of a hot shingle are dealt to blocks, every two of which meet.
4. Within a key the Gray-order index (hamming.GrayIndex) finds all links; a task passes on a spanning
   forest of them, at most one edge a node, not the pairs.
5. Distributed connected components join the forests.
6. With longer fingerprints these are families, not yet copies: every link needs LIKENESS of the texts' shingles. A family's sets of shingles
   meet in a task (those of a large one block by block); of all pairs that the Gray-order index finds there, the shared
   shingles are counted at once, and again only a spanning forest leaves the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.hamming import GrayIndex, distance, vote
from quarry.llm.shared import components, free, grouped, pieces, roots, staged

#: Rows of one key that a task takes before the key is split again.
HOT_ROWS = 200_000
#: Longer fingerprints: two texts are copies if they share LIKENESS of all their different shingles.
LIKENESS = 0.8
#: Shingles that COMMON_DOCS of one in COMMON_SHARE texts have come last in the order, up to MAX_COMMON of them, so that few texts meet by them. Any order gives
#: the same result.
COMMON_DOCS, COMMON_SHARE, MAX_COMMON = 8, 50, 100_000
#: Nodes of one shingle beyond which they are compared block by block.
HOT_NODES = 8_000
#: A family of n shingles is dealt to about sqrt(n / SPLIT) blocks of nodes, and to so many that none has over BLOCK shingles on average.
SPLIT, BLOCK = 1 << 15, 1 << 20
#: Shingles of more of a task's nodes than FREQUENT are counted by bits.
FREQUENT = 256


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs without ASCII white space, A to Z in lower case."""
    return text.lower().split()


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    """All runs of `size` words, repeats included; the whole sequence if it is shorter, nothing if empty."""
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [line[a:b] for a, b in zip([0, *ends], [e - 1 for e in ends[size - 1 :]], strict=False)]


def digests(shingles: list[bytes], bits: int) -> bytes:
    """bits / 8 bytes for each: XXH64 with seed 42, or for longer fingerprints XXH3-128 under several seeds."""
    if bits == 64:
        return b"".join([xxhash.xxh64_digest(s, 42) for s in shingles])
    return b"".join([xxhash.xxh3_128_digest(s, seed) for s in shingles for seed in range(42, 42 + bits // 128)])


def rows_of(digested: bytes, bits: int) -> np.ndarray:
    """Different shingles as sorted longs, from their digests."""
    return np.unique(np.frombuffer(digested, "<i8").reshape(-1, bits // 64)[:, 0])


def node_of(found: np.ndarray) -> int:
    """Names a set of shingles: a hash of all of them."""
    return int(xxhash.xxh64_intdigest(found.tobytes())) - (1 << 63)


def prefix_of(found: np.ndarray, common: np.ndarray | None = None, likeness: float = LIKENESS) -> np.ndarray:
    """The first of a text's sorted shingles, sorted `common` ones behind others: two texts that share `likeness` of all of theirs share
    one of these.

    Sets of m and n shingles have likeness * max(m, n) in common at least, so the first common shingle has no more than
    n - ceil(likeness * n) shingles of either before it.
    """
    if common is not None and len(common) and len(found):
        last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~last], found[last]])
    return found[: len(found) - math.ceil(likeness * len(found) - 1e-9) + 1]


def common_shingles(docs: DataFrame, key: str, text: str, size: int, bits: int) -> np.ndarray:
    """Shingles of many texts, judged by a part of them; only the order of shingles depends on it."""

    def run(batches):
        for batch in pieces(batches):
            found = [rows_of(digests(shingles_of(words_of(t or b""), size), bits), bits) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["s"])

    part = docs.filter(F.pmod(F.xxhash64(key), F.lit(COMMON_SHARE)) == 0).select(F.col(text).cast("binary").alias("__text"))
    count = part.mapInArrow(run, "s bigint").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_DOCS)
    return np.sort(np.array([r.s for r in count.orderBy(F.col("n").desc(), "s").limit(MAX_COMMON).collect()], np.int64))


def words_named(bits: int) -> list[str]:
    return [f"w{i}" for i in range(bits // 64)]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, bits: int = 64) -> DataFrame:
    """(__key, __same, w0, w1, ..., node) for every row: its key, a hash of its text, the fingerprint's words as longs, w0 the most
    significant, and the text's node. Over 64 bits, shingles vote once each, and (shingles, prefix) follow: the number of different
    shingles, and those of its prefix. Null text: as empty, zero, an empty set."""
    if bits not in (64, 128, 256, 512):
        raise ValueError("64, 128, 256 or 512 bits")
    words, by_sets = words_named(bits), bits > 64
    common = common_shingles(docs, key, text, size, bits) if by_sets else None
    names = ["__key", "__same", *words, "node", *(["shingles", "prefix"] if by_sets else [])]

    def run(batches):
        for batch in batches:
            codes, nodes, sizes, prefixes = [], [], [], []
            for t in batch.column(2).to_pylist():
                found = shingles_of(words_of(t or b""), size)
                digested = digests(list(dict.fromkeys(found)) if by_sets else found, bits)
                codes.append(vote(digested, bits))
                if by_sets:
                    own = rows_of(digested, bits)
                    nodes.append(node_of(own))
                    sizes.append(len(own))
                    prefixes.append(prefix_of(own, common))
            rows = np.array(codes, ">u8").reshape(len(codes), len(words)).astype("<u8").view("<i8")
            arrays = [batch.column(0), batch.column(1), *[pa.array(rows[:, i]) for i in range(len(words))]]
            if by_sets:
                arrays += [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            else:
                arrays.append(arrays[2])
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"__key {kind}, __same bigint, " + "".join(f"{w} bigint, " for w in words) + "node bigint" + (", shingles bigint, prefix array<bigint>" if by_sets else "")
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__same"), F.col(text).cast("binary").alias("__text"))
    return rows.mapInArrow(run, schema)


def block_keys(word: Column, radius: int, bits: int = 64) -> list[Column]:
    """radius + 1 keys of which two words within the radius share one: block number and block."""
    cuts = [bits * i // (radius + 1) for i in range(radius + 2)]
    return [
        F.shiftrightunsigned(word, a).bitwiseAND((1 << (b - a)) - 1) * (radius + 1) + i for i,
        (a, b) in enumerate(zip(cuts, cuts[1:]))
    ]


def keyed_by_blocks(nodes: DataFrame, radius: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """nodes(node, w0) once for each block key. A key with over hot_rows rows is dealt again by radius + 1 blocks of its
    other bits: two nodes of it differ only there, so they still share one of those.

    What is broadcast has a row for each hot block value: at most (radius + 1) * 2 ** (64 / (radius + 1)), 262,144 for
    radius 3, and no more than rows / hot_rows, whatever the data.
    """
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    if max(b - a for a, b in zip(cuts, cuts[1:])) > 20:
        hot_rows = 1 << 62  # long blocks can't be hot in numbers that could be broadcast, and needn't be
    keyed = nodes.select("*", F.posexplode(F.array(*block_keys(F.col("w0"), radius))).alias("__block", "key"))
    hot = keyed.groupBy("key").count().filter(F.col("count") > hot_rows).select("key", F.lit(True).alias("__hot"))
    keyed = keyed.join(F.broadcast(hot), "key", "left")
    # the other bits of the word, closed up
    rest = F.array(
        *[
            (
                F.shiftleft(F.shiftrightunsigned("w0", b), a) if b < 64 else F.lit(0).cast("long")
            ).bitwiseOR(F.col("w0").bitwiseAND((1 << a) - 1))
            for a, b in zip(cuts, cuts[1:])
        ]
    )[F.col("__block")]
    sub = block_keys(F.col("__rest"), radius, 64 - min(b - a for a, b in zip(cuts, cuts[1:])))
    finer = F.array(*[F.xxhash64("key", s) for s in sub])
    keyed = keyed.withColumn("__rest", rest).withColumn("keys", F.when(F.col("__hot"), finer).otherwise(F.array("key")))
    return keyed.select("node", "w0", F.explode("keys").alias("key"))


def keyed_by_shingles(nodes: DataFrame, words: list[str], hot_nodes: int | None = None) -> DataFrame:
    """nodes(node, words, prefix) once for each key by which it can meet near copies: the shingles of its prefix that another has too.

    Nodes of a shingle that has over hot_nodes (HOT_NODES) are dealt to blocks of about so many, and every two blocks meet, so that no pair is lost.
    """
    hot_nodes = hot_nodes or HOT_NODES
    each = nodes.select("node", F.explode("prefix").alias("shingle"))
    # counts are staged, so that both sides of the joins are exchanges and a hot shingle's rows can be split
    size = staged(each.groupBy("shingle").agg(F.count("*").alias("__n")).filter("__n > 1"), "shared-shingles")
    met = staged(each.join(size, "shingle"), "met")
    keyed = met.join(nodes.select("node", *words), "node")
    # blocks of a hot shingle's nodes: every two of them meet under a key of their own, each also by itself
    blocks = F.ceil(F.col("__n") / hot_nodes).cast("long")
    mine = F.pmod(F.xxhash64("node"), blocks)
    met_blocks = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: F.xxhash64("shingle", F.least(mine, b), F.greatest(mine, b)))
    keys = F.when(F.col("__n") > hot_nodes, met_blocks).otherwise(F.array("shingle"))
    return keyed.select("node", *words, F.explode(keys).alias("key"))


def links(keyed: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(u, v): for each key a spanning forest of the links within the radius among its nodes.

    Neighbours in Gray order come first; what they join isn't compared again.
    """

    def work(part: pa.Table):
        node = part.column("node").to_numpy()
        codes = np.stack([part.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
        index = GrayIndex(part.column("key").to_numpy(), codes)
        a, b = index.neighbours()
        near = distance(codes[a], codes[b]) <= radius
        label = roots(len(node), a[near], b[near])
        index.known(label)
        for a, b, _ in index.pairs(radius):
            label = roots(len(node), a, b, label)
        far = np.flatnonzero(label != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], ["u", "v"])

    return grouped(keyed, "key", work, "u bigint, v bigint")


class Counted:
    """How many shingles two of many nodes share. Shingles that one node alone has don't count, those that over FREQUENT have are
    bits of a row each, the others are looked up."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray):
        _, token, often = np.unique(values, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        frequent = np.flatnonzero(often > FREQUENT)
        place = np.full(len(often), -1)
        place[frequent] = np.arange(len(frequent))
        bit = place[token]
        self.bits = np.zeros((len(sizes), max(1, -(-len(frequent) // 64))), np.uint64)
        on = bit >= 0
        np.bitwise_or.at(self.bits, (row[on], bit[on] // 64), np.uint64(1) << (bit[on] % 64).astype(np.uint64))
        rare = (often[token] > 1) & ~on
        row, token = row[rare], token[rare]
        self.width = np.int64(len(often) + 1)
        self.token, self.known = token, row * self.width + token  # sorted: rows in order, shingles of a row too
        self.start = np.searchsorted(row, np.arange(len(sizes) + 1))
        self.rare = np.diff(self.start)

    def reach(self, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether the nodes a[i] and b[i] share at least need[i] shingles."""
        least = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64)
        few, other = np.where(self.rare[a] <= self.rare[b], a, b), np.where(self.rare[a] <= self.rare[b], b, a)
        out = least >= need
        open_ = np.flatnonzero(~out & (least + self.rare[few] >= need))
        if not len(open_):
            return out
        for part in np.array_split(open_, int(self.rare[few[open_]].sum()) // 2_000_000 + 1):
            count = self.rare[few[part]]
            ends = np.cumsum(count)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(self.start[few[part]], count)
            wanted = np.repeat(other[part], count) * self.width + self.token[at]
            hit = self.known[np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)] == wanted
            found = np.bincount(np.repeat(np.arange(len(part)), count), hit, len(part)).astype(np.int64)
            out[part] = least[part] + found >= need[part]
        return out


def confirmed(keyed: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(u, v): for each key of keyed(key, block, node, words, found) a spanning forest of its links: nodes within the radius that share LIKENESS of
    their shingles. Of a key with two blocks only those between them."""

    def work(part: pa.Table):
        part = part.combine_chunks()
        key, block, node = (part.column(c).to_numpy() for c in ("key", "block", "node"))
        codes = np.stack([part.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
        found = part.column("found").combine_chunks()
        sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
        counted = Counted(sizes, pc.list_flatten(found).to_numpy())
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        both = np.repeat(
            np.minimum.reduceat(block, starts) != np.maximum.reduceat(block, starts), np.diff(np.r_[starts, len(key)])
        )

        def linked(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
            need = np.ceil(LIKENESS / (1 + LIKENESS) * (sizes[a] + sizes[b]) - 1e-9).astype(np.int64)
            able = (label[a] != label[b]) & (np.minimum(sizes[a], sizes[b]) >= need) & (~both[a] | (block[a] != block[b]))
            a, b = a[able], b[able]
            near = counted.reach(a, b, need[able])
            return roots(len(node), a[near], b[near], label) if near.any() else label

        index = GrayIndex(key, codes)
        a, b = index.neighbours()
        near = distance(codes[a], codes[b]) <= radius
        label = linked(a[near], b[near], np.arange(len(node)))
        index.known(label)
        for a, b, _ in index.pairs(radius):
            label = linked(a, b, label)
        far = np.flatnonzero(label != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], ["u", "v"])

    return grouped(keyed, "key", work, "u bigint, v bigint")


def copies(docs: DataFrame, nodes: DataFrame, key: str, text: str, size: int, bits: int, radius: int) -> DataFrame:
    """(node, root) for every node with a link: components of the pairs that share LIKENESS."""
    words = words_named(bits)
    family = components(links(keyed_by_shingles(nodes, words), words, radius))
    members = staged(nodes.drop("prefix").join(family, "node"), "families")
    blocks = F.greatest(F.ceil(F.sqrt(F.sum("shingles") / SPLIT)), F.ceil(F.sum("shingles") / BLOCK)).cast("long")
    dealt = members.join(staged(members.groupBy("root").agg(blocks.alias("blocks")), "family-sizes"), "root")
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__same"), F.col(text).cast("binary").alias("__text"))
    # one row for each node, however often its text is repeated under its key
    texts = dealt.join(rows, (F.col("least.key") == F.col("__key")) & (F.col("least.same") == F.col("__same"))).dropDuplicates(["node"])

    def run(batches):
        for batch in pieces(batches):
            found = [rows_of(digests(shingles_of(words_of(t or b""), size), bits), bits) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "found"])

    sets = texts.select("root", "blocks", "node", *words, "__text").mapInArrow(
        run, "root bigint, blocks bigint, node bigint, " + "".join(f"{w} bigint, " for w in words) + "found array<bigint>"
    )
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # each block meets itself and every other one under a key of its own
    meets = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.xxhash64("root", F.least(mine, b), F.greatest(mine, b))
    )
    return components(confirmed(sets.select(mine.alias("block"), "node", *words, "found", F.explode(meets).alias("key")), words, radius))


def marked(docs: DataFrame, key: str, text: str, size: int, bits: int, radius: int) -> DataFrame:
    """(__key, __same, words, first) for every row of docs; first is the least (key, same) that its links reach, null for a null key."""
    prints = staged(fingerprints(docs, key, text, size, bits), "prints")
    carried = [*(words_named(bits) if bits > 64 else ()), *(["shingles", "prefix"] if bits > 64 else [])]
    least = F.min(F.struct(F.col("__key").cast("long").alias("key"), F.col("__same").alias("same"))).alias("least")
    nodes = staged(prints.filter("__key is not null").groupBy("node").agg(least, *[F.first(c).alias(c) for c in carried]), "nodes")
    if bits > 64:
        found = copies(docs, nodes, key, text, size, bits, radius)
    else:
        found = components(links(keyed_by_blocks(nodes.select("node", F.col("node").alias("w0")), radius), ["w0"], radius))
    linked = staged(nodes.select("node", "least").join(found, "node"), "linked")
    firsts = linked.groupBy("root").agg(F.min("least").alias("first"))
    named = nodes.select("node", "least").join(linked.join(firsts, "root").select("node", "first"), "node", "left")
    named = staged(named.select("node", F.coalesce("first", "least").alias("first")), "named")
    return prints.join(named, "node", "left").select(
        "__key", "__same", *words_named(bits), F.when(F.col("__key").isNotNull(), F.col("first")).alias("first")
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, bits: int = 256, radius: int = 96
) -> DataFrame:
    """(key, w0, w1, ..., component) for every row of docs; component is the smallest key that its links reach.

    With 64 bits two documents link if their fingerprints differ in at most `radius` bits; every link is found. With more, they link if they share
    LIKENESS of all their different shingles and their fingerprints are within the radius. As bits are independent, and two sets that share 0.8
    differ in each with a chance of 0.1875 at most (sets of 4 and 5 shingles; 0.1515 as sets grow), the radius of 96 of 256 loses such a link with a
    chance under 1e-12.

    key has to be an integer, and none of w0, w1, ..., component. Null and empty texts have fingerprint zero and link like any other. Rows with a null key
    get a null component and lend none. Rows of one key are told apart by their texts. Equal texts, ties and repeated rows are one node each; an
    empty table gives no rows; other columns of docs are ignored, whatever their names.
    """
    out = marked(docs, key, text, size, bits, radius)
    return out.select(F.col("__key").alias(key), *words_named(bits), F.col("first.key").alias("component"))


def without_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, bits: int = 256, radius: int = 96
) -> DataFrame:
    """docs with one row of each near-duplicate group, the one of least key and, of that key, least hash of the text; columns as they are.

    Rows with a null key stay, as no group can name them. Rows of one key with texts that are no copies of each other stay, all of them.
    """
    out = staged(marked(docs, key, text, size, bits, radius).filter("__key is not null").select("__key", "__same", "first"), "marked")
    first = (F.col("__key").cast("long") == F.col("first.key")) & (F.col("__same") == F.col("first.same"))
    k, t, n = free(docs.columns, "k", "t", "n")
    # what goes, and rows that are repeated whole in key and text, of which one stays
    told = out.withColumn(n, first).groupBy(F.col("__key").alias(k), F.col("__same").alias(t), n).agg(F.count("*").alias("__times"))
    told = staged(told.filter(f"not {n} or __times > 1").select(k, t, n), "copies")
    same = (F.col(key) == F.col(k)) & (F.xxhash64(text) == F.col(t))
    left = docs.join(told.drop(n), same, "left_anti")
    again = told.filter(n).drop(n)
    if again.isEmpty():
        return left
    return left.unionByName(docs.join(again, same).dropDuplicates([k, t]).select(*docs.columns))


def hex_of(words: list[str]) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(F.col(w)), 16, "0")) for w in words])
