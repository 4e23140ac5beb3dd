"""Merkle manifest of a dataset: content-addressed records of digest and children, descended from the root by rank.

The rows of a partition (``lang``) are leaves in the order of their ids; two consecutive nodes make one of the next
level until one node, the partition's root, is left, and the partitions' roots make the dataset's root in the same way.
``H`` is the lowercase hex SHA-256 of its inputs in a row, digests as hex text.

The manifest is stored in segments of ``LEVELS`` levels: a row holds the records ``digest -> children`` of one subtree of
at most ``2 ** LEVELS`` nodes and is addressed by the digest on top of it. Building goes up a stage of segments at a time,
each with ``2 ** LEVELS`` times fewer rows. A request for a leaf descends from the root: at each record the next binary
digit of its rank picks one child and the other one is collected. Requests that share a prefix share its descent, so
only distinct prefixes are followed above the lowest stage. The path, read backwards, is the proof of the leaf.

Ranks come from a range partitioning and the counts of its parts, so no partition is sorted in one task however large
it is. No step holds more than one segment per row.

Defined results: null fields enter the leaf as ``-``; a null ``lang`` is a partition of its own, the first one; null ids
come before others; rows that repeat an id are leaves next to each other, ordered by digest, so repeated rows have
equal leaves but proofs of their own places; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.llm.common import small_side, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 6
ROWS_PER_PART = 1 << 19
TAMPER = 7
_RECORDS = "array<struct<digest:string,children:array<string>>>"
_STEPS = "array<struct<first:boolean,digest:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(field: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = field.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    return digest(*[encoded(changed.get(c, F.col(c))) for c in fields])


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank`` (from 0, by ``order`` within ``tree``) and ``n``, the rows of the tree."""
    held = written(nodes.withColumn("__copy", F.monotonically_increasing_id()))  # the last key tells repeated rows apart
    keys = ["tree", *order, "__copy"]
    parts = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // ROWS_PER_PART))
    ranged = written(held.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy("tree", part.alias("__part")).agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__rows"))
    # One row per part and tree: the window is as small as the number of parts.
    before = F.sum("__rows").over(Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0)))
    totals = counts.groupBy("tree").agg(F.sum("__rows").alias("n"))
    offsets = written(counts.join(totals, "tree").select("tree", "__part", (F.col("__before") - F.col("__first")).alias("__shift"), "n"))
    placed = ranged.withColumn("__part", part).join(small_side(offsets), ["tree", "__part"])
    return placed.withColumn("rank", place + F.col("__shift")).drop("__copy", "__at", "__part", "__shift")


def _height(n: str) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.when(F.col(n) <= 1, F.lit(0)).otherwise(F.length(F.bin(F.col(n) - 1)))


def _segment(nodes: Column, steps: Column) -> Column:
    """``done`` (records below the top) and ``last`` (the top record alone) of a subtree over the digests ``nodes``."""
    bottom = F.transform(nodes, lambda d: F.struct(d.alias("digest"), F.array().cast("array<string>").alias("children")))
    start = F.struct(F.array().cast(_RECORDS).alias("done"), bottom.alias("last"))

    def level(acc: Column, _: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(acc["last"]), F.lit(2))
        pairs = F.transform(firsts, lambda i: F.slice(acc["last"]["digest"], i, 2))
        made = F.transform(pairs, lambda two: F.struct(F.sha2(F.array_join(two, ""), 256).alias("digest"), two.alias("children")))
        return F.struct(F.concat(acc["done"], acc["last"]).alias("done"), made.alias("last"))

    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, level)).otherwise(start)


def _stage(nodes: DataFrame) -> DataFrame:
    """Segments ``tree, block, height, steps, top, keys, children`` over nodes ``tree, rank, height, digest`` of one level."""
    block = F.shiftright("rank", LEVELS)
    grouped = nodes.groupBy("tree", block.alias("block"), "height").agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
    steps = F.least(F.col("height"), F.lit(LEVELS))
    grown = grouped.select("tree", "block", "height", steps.alias("steps"), _segment(F.col("nodes.digest"), steps).alias("s"))
    records = F.filter(F.concat("s.done", "s.last"), lambda r: F.size(r["children"]) > 0)
    rows = grown.select("tree", "block", "height", "steps", F.get("s.last", 0)["digest"].alias("top"), records.alias("records"))
    return rows.select("tree", "block", "height", "steps", "top", F.col("records.digest").alias("keys"), F.col("records.children").alias("children"))


def grow(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Roots ``tree, n, digest`` and the stages of segments over nodes ``tree, rank, n, digest``, lowest first."""
    level = nodes.select("tree", "rank", _height("n").alias("height"), "digest")
    highest = nodes.agg(F.max("n")).first()[0] or 0
    stages = []
    for _ in range(max(1, -(-(highest - 1).bit_length() // LEVELS) if highest > 1 else 1)):
        stages.append(written(_stage(level)))
        level = stages[-1].filter("height > steps").select("tree", F.col("block").alias("rank"), (F.col("height") - F.col("steps")).alias("height"), F.col("top").alias("digest"))
    roots = stages[0].filter("height = steps").select("tree", F.col("top").alias("digest"))
    for stage in stages[1:]:
        roots = roots.unionByName(stage.filter("height = steps").select("tree", F.col("top").alias("digest")))
    return written(roots), stages


def _walked(top: Column, steps: Column, rank: Column) -> Column:
    """``at`` and ``path`` of a descent of ``steps`` records from ``top`` by the binary digits of ``rank``, highest first.

    Reads the columns ``keys`` and ``children`` of the segment. A path step is the unselected child (empty where there is
    none) and whether it comes first.
    """
    def step(acc: Column, level: Column) -> Column:
        two = F.get("children", F.array_position("keys", acc["at"]).cast("int") - 1)
        second = F.call_function("getbit", rank, level) == 1
        taken, other = F.when(second, F.get(two, 1)).otherwise(F.get(two, 0)), F.when(second, F.get(two, 0)).otherwise(F.get(two, 1))
        return F.struct(taken.alias("at"), F.concat(acc["path"], F.array(F.struct(second.alias("first"), F.coalesce(other, F.lit("")).alias("digest")))).alias("path"))

    start = F.struct(top.alias("at"), F.array().cast(_STEPS).alias("path"))
    return F.when(steps > 0, F.aggregate(F.sequence(F.greatest(steps, F.lit(1)) - 1, F.lit(0)), start, step)).otherwise(start)


def _descended(frontier: DataFrame, stage: DataFrame, requests: DataFrame, carried: list[str]) -> DataFrame:
    """Each request ``tree, rank`` with the digest it reaches and its path from the root.

    ``frontier`` has ``tree, block, at, path``: where the prefixes of the requests got to. Records are looked up by digest;
    requests of one block meet them as one row.
    """
    asked = requests.groupBy("tree", F.shiftright("rank", LEVELS).alias("block")).agg(F.collect_list(F.struct("rank", *carried)).alias("asked"))
    records = stage.groupBy("top").agg(F.first(F.struct("steps", "keys", "children")).alias("s"))
    met = asked.join(frontier, ["tree", "block"]).join(records, F.col("at") == F.col("top"))
    each = met.select("tree", "top", "path", "s.steps", "s.keys", "s.children", F.explode("asked").alias("r"))
    each = each.select("tree", "path", "r.*", _walked(F.col("top"), F.col("steps"), F.col("r.rank")).alias("w"))
    return each.select("tree", "rank", *carried, F.col("w.at").alias("at"), F.concat("path", "w.path").alias("path"))


def descend(roots: DataFrame, stages: list[DataFrame], requests: DataFrame, carried: list[str]) -> DataFrame:
    """``requests`` (``tree, rank`` and ``carried`` columns) with ``at`` and ``path`` from the roots ``tree, at, path``."""
    frontier = roots.withColumn("block", F.lit(0).cast("bigint"))
    for level in range(len(stages) - 1, 0, -1):
        prefixes = requests.select("tree", F.shiftright("rank", LEVELS * level).alias("rank")).distinct()
        # Trees that end below this stage stay at their roots.
        deep = stages[level].select("tree").distinct()
        low = frontier.join(deep, "tree", "left_anti").select("tree", "block", "at", "path")
        reached = _descended(frontier, stages[level], prefixes.join(deep, "tree", "left_semi"), [])
        frontier = written(reached.select("tree", F.col("rank").alias("block"), "at", "path").unionByName(low))
    return _descended(frontier, stages[0], requests, carried)


def folded(leaf: Column, path: Column) -> Column:
    """The root recomputed from a leaf and its path, which runs from the root down."""
    return F.aggregate(F.reverse(path), leaf, lambda node, s: F.sha2(F.when(s["first"], F.concat(s["digest"], node)).otherwise(F.concat(node, s["digest"])), 256))


def manifest(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Partition roots ``tree, at, path, root`` (each with its path from the dataset's root) and stages over leaves ``tree, rank, n, leaf``."""
    subroots, stages = grow(leaves.withColumnRenamed("leaf", "digest"))
    ordered = written(_numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]))
    root, top_stages = grow(ordered.select("tree", "rank", "n", "digest"))
    start = root.select("tree", F.col("digest").alias("at"), F.array().cast(_STEPS).alias("path"))
    tops = descend(start, top_stages, ordered.select("tree", "rank", "name"), ["name"])
    one = F.broadcast(root.select("tree", F.col("digest").alias("root")))  # a single row, the dataset's root
    return written(tops.join(one, "tree").select(F.col("name").alias("tree"), "at", "path", "root")), stages


def prove(docs: DataFrame, tampered: DataFrame | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    Where 7 divides the unsigned crc32 of the id in decimals, the proof is folded from a leaf with one more ``n_chars``.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # partitions sort by bytes, null first
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_digest().alias("leaf"), F.when(hit, leaf_digest(n_chars=more)).alias("tampered"))
    leaves = written(_numbered(rows, ["doc_id", "leaf"]))
    tops, stages = manifest(leaves.select("tree", "rank", "n", "leaf"))
    found = descend(tops.select("tree", "at", "path"), stages, leaves, ["doc_id", "tampered"])
    named = found.join(small_side(tops.select("tree", F.col("at").alias("subroot"), "root")), "tree")
    siblings = F.array_join(F.transform(F.reverse("path"), lambda s: s["digest"]), "")
    full = named.select(
        "doc_id", F.col("at").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "at"), F.col("path")).alias("folded_root"))
    return full.withColumn("verified", F.col("folded_root") == F.col("root"))
