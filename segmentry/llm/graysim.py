"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

A text's fingerprint has the bits that are set in over half of the XXH64 values (seed 42, unsigned) of its three-word
shingles, repeats included. Equal fingerprints are one class. The classes are sorted by the rank of their fingerprint in
the Gray code, so neighbours share long runs of bits, and cut into blocks.

A group of fingerprints has a mask of the bits that all its members agree on and their pattern. An upper node holds what
its children have in common, a child only the mask bits that its parent lacks. On the way down the differences between a
query and the patterns add up, and a group is left as a whole once they exceed ``RADIUS``.

The index has two parts. Above the blocks it is a table of nodes: pairs of nodes descend by joins on their parents, and
pairs whose common mask bits differ too often go; a fingerprint is sent to a block only if the block's pattern allows it.
A block with the fingerprints of neighbouring blocks that ask it is one group of an Arrow function, which searches the
block's tree. It returns a spanning forest of the links found, never the pairs, and groups that are one linked component
already are not compared with its members again.

Defined results: null, empty and wordless texts have fingerprint zero, which links like any other; a null ``doc_id`` gets a
fingerprint and a null component, and links nothing; rows that repeat a ``doc_id`` are one document with the links of
all of them; ties go to the smallest id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import ascii_spaced, small_side, split_words, written
from segmentry.operators.graph import connected_components

SHINGLE = 3
RADIUS = 3
# Most fingerprints of a block, and the blocks that a smaller table is cut into (of no fewer than LEAST).
BLOCK = 1 << 15
SPREAD = 64
LEAST = 256
# Children of a node inside a block, bits of a node's number above the blocks, queries at a time.
FAN = 4
GROUP_BITS = 3
CHUNK = 256
# Hash values that the fingerprint kernel takes at once.
_VALUES = 1 << 17


def shingle_values(spaced: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of all space-joined runs of ``size`` words, with repeats; a shorter text is one run, no words are none."""
    words = split_words(spaced)
    many = F.greatest(F.size(words) - (size - 1), F.lit(0))
    runs = F.transform(F.arrays_zip(*[F.slice(words, k + 1, many) for k in range(size)]), lambda z: F.xxhash64(F.concat_ws(" ", *[z[str(k)] for k in range(size)])))
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(F.xxhash64(spaced))).otherwise(F.array().cast("array<bigint>"))


def majority_bits(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive runs of ``values`` of the given sizes (some may be 0): the bits set in over half of each run."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    ends = np.cumsum(sizes[full])
    starts = ends - sizes[full]
    # Runs are taken in chunks of about _VALUES values, so that a chunk stays in the processor's cache.
    cuts = np.flatnonzero(np.diff(starts // _VALUES, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(full)]):
        part, at, half = values[starts[a]:ends[b - 1]], starts[a:b] - starts[a], sizes[full[a:b]]
        for bit in range(64):
            ones = np.add.reduceat((part >> np.uint64(bit)) & np.uint64(1), at)
            out[full[a:b]] |= (2 * ones > half).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's 64 bits as a bigint) of every row."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("values")
            sizes = np.diff(lists.offsets.to_numpy())
            bits = majority_bits(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    spaced = docs.select("doc_id", ascii_spaced(F.col(text)).alias("spaced"))
    return spaced.select("doc_id", shingle_values(F.col("spaced")).alias("values")).mapInArrow(sign, "doc_id bigint, fp bigint")


def gray_rank(fp: Column) -> Column:
    """Rank of the fingerprint in the Gray code, as a bigint that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.expr("shiftleft(1L, 63)"))


def _shared(group: DataFrame) -> DataFrame:
    """``mask`` of the bits on which all members agree, and their ``pattern`` there, from the AND and the OR of the members."""
    mask = F.bitwise_not(F.col("all_").bitwiseXOR(F.col("any_")))
    return group.withColumn("mask", mask).withColumn("pattern", F.col("all_"))


def upper_levels(blocks: DataFrame, count: int) -> list[DataFrame]:
    """Nodes ``node, parent, all_, any_, mask, pattern`` from the blocks up to one node."""
    levels = [blocks]
    while count > 1:
        below = levels[-1]
        grouped = below.groupBy(F.col("parent").alias("node")).agg(F.bit_and("all_").alias("all_"), F.bit_or("any_").alias("any_"))
        levels.append(written(_shared(grouped.withColumn("parent", F.shiftright("node", GROUP_BITS)))))
        count = -(-count // (1 << GROUP_BITS))
    return levels


def near_blocks(levels: list[DataFrame], radius: int = RADIUS) -> DataFrame:
    """Pairs ``a, b`` (a <= b) of blocks that may hold fingerprints within ``radius`` of each other."""
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        side = {s: level.select(F.col("parent").alias(s), F.col("node").alias(f"{s}_node"), F.col("mask").alias(f"{s}_mask"), F.col("pattern").alias(f"{s}_pattern")) for s in ("a", "b")}
        met = pairs.join(side["a"], "a").join(side["b"], "b").filter("a_node <= b_node")
        differing = F.bit_count(F.col("a_pattern").bitwiseXOR(F.col("b_pattern")).bitwiseAND(F.col("a_mask")).bitwiseAND(F.col("b_mask")))
        pairs = written(met.filter(differing <= radius).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return pairs


class GrayTree:
    """Groups over fingerprints in Gray order: per level the bits that a node adds to its parent's mask, and their pattern."""

    def __init__(self, values: np.ndarray):
        low, high, levels = values, values, []
        while True:
            mask = ~(low ^ high)
            levels.append((low & mask, mask))
            if len(low) == 1:
                break
            starts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
        self.patterns = [p for p, _ in levels][::-1]
        masks = [m for _, m in levels][::-1]
        self.added = [masks[0], *[m & ~np.repeat(up, FAN)[:len(m)] for up, m in zip(masks, masks[1:])]]

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level the component that all members of a node belong to, or -1."""
        low, high, out = labels, labels, []
        for _ in self.patterns:
            out.append(np.where(low == high, low, -1))
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        return out[::-1]

    def within(self, queries: np.ndarray, own: np.ndarray, uniform: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) within ``radius``, but for groups that lie in the query's own component."""
        q = np.arange(len(queries), dtype=np.int32)
        node = np.zeros(len(queries), dtype=np.int32)
        spent = np.zeros(len(queries), dtype=np.uint8)
        for level, (pattern, added) in enumerate(zip(self.patterns, self.added)):
            if level:
                q, spent = np.repeat(q, FAN), np.repeat(spent, FAN)
                node = (node[:, None] * FAN + np.arange(FAN, dtype=np.int32)).ravel()
                real = node < len(pattern)
                if not real.all():
                    q, spent, node = q[real], spent[real], node[real]
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & added[node])
            stays = (spent <= radius) & (uniform[level][node] != own[q])
            q, spent, node = q[stays], spent[stays], node[stays]
        return q, node


def _merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Components after the links ``u - v``; a label is the smallest member's number."""
    while len(u):
        a, b = labels[u], labels[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped


def linked_forest(queries: np.ndarray, members: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``queries`` and ``members``, which are in Gray order; a value may be in both."""
    tree = GrayTree(members)
    labels = np.arange(len(queries) + len(members))
    for begin in range(0, len(queries), CHUNK):
        part = np.arange(begin, min(begin + CHUNK, len(queries)))
        q, found = tree.within(queries[part], labels[part], tree.uniform(labels[len(queries):]), radius)
        _merge(labels, part[q], found + len(queries))
    values = np.concatenate([queries, members])
    ends = values[labels]
    return values[values != ends], ends[values != ends]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a_id, b_id``: links that connect the distinct fingerprints ``fp`` as all links within ``radius`` would."""
    count = classes.count()
    if count < 2:
        return classes.select(F.col("fp").alias("a_id"), F.col("fp").alias("b_id")).limit(0)
    blocks = max(-(-count // BLOCK), min(SPREAD, -(-count // LEAST)))
    ranked = classes.select("fp", gray_rank(F.col("fp")).alias("rank"))
    placed = written(ranked.repartitionByRange(blocks, "rank").select("fp", "rank", F.spark_partition_id().cast("bigint").alias("block")))
    summary = placed.groupBy(F.col("block").alias("node")).agg(F.bit_and("fp").alias("all_"), F.bit_or("fp").alias("any_"))
    lowest = written(_shared(summary.withColumn("parent", F.shiftright("node", GROUP_BITS))))
    key = F.concat_ws("-", F.col("b"), F.shiftright("a", GROUP_BITS))
    pairs = near_blocks(upper_levels(lowest, blocks), radius).withColumn("key", key)
    pairs = written(pairs.join(lowest.select(F.col("node").alias("b"), "mask", "pattern"), "b"))
    asked = written(pairs.select("key", "b").distinct())
    differing = F.bit_count(F.col("fp").bitwiseXOR(F.col("pattern")).bitwiseAND(F.col("mask")))
    queries = placed.join(small_side(pairs), (F.col("block") == F.col("a")) & (differing <= radius)).select("key", F.lit(False).alias("member"), "rank", "fp")
    members = placed.join(small_side(asked), F.col("block") == F.col("b")).select("key", F.lit(True).alias("member"), "rank", "fp")

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        values, member = group.column("fp").to_numpy().view(np.uint64), group.column("member").to_numpy(zero_copy_only=False)
        a, b = linked_forest(values[~member], values[member], radius)
        return pa.table({"a_id": a.view(np.int64), "b_id": b.view(np.int64)})

    # A number of partitions of its own: the rows are few bytes for the work that they mean, and would be put together.
    spread = queries.unionByName(members).repartition(max(1, min(-(-asked.count() // 4), 1 << 15)), "key")
    return spread.groupBy("key").applyInArrow(search, "a_id bigint, b_id bigint")


def near_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``."""
    signed = written(fingerprints(docs, text))
    known = signed.filter("doc_id is not null")
    classes = written(known.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # An id with several fingerprints ties them together.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).filter("first <> last").select("doc_id", "first")
    same = known.join(small_side(written(several)), "doc_id").filter("fp <> first").select(F.col("fp").alias("a_id"), F.col("first").alias("b_id")).distinct()
    found = written(links(classes.select("fp")).unionByName(same))
    label = connected_components(found).withColumnRenamed("row_id", "fp") if not found.isEmpty() else classes.select("fp", F.col("fp").alias("component")).limit(0)
    tied = written(classes.join(label, "fp").select("fp", "component", "least"))
    ends = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(classes.join(tied.join(ends, "component").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    out = signed.join(small_side(named), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
