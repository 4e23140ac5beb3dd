"""Exact top-k inner products over a vector-approximation file.

Components become integers (floor of ``scale`` times the value). Each dimension is cut into ``CELLS`` cells, and the
approximation file keeps one byte a dimension. It is scanned in blocks against blocks of queries: a cell bounds a
component from both sides, so a scan of cells bounds the inner product. The k-th largest lower bound rules out all rows with a smaller
upper bound. The others' exact vectors are read in the order of their upper bounds: the first few give a k-th exact
score, and what is left is read only where its bound reaches that score.

Equal vectors are one class and stand in the file once, with their smallest k + 1 ids: no other id can be among the best.
Queries with equal vectors are answered once. Blocks are bounded, and each pair of blocks is one row of the scan. Queries go to
at most ``ROW_BLOCKS`` blocks of rows (more only where one would outgrow ``BLOCK_BYTES``), always by a shuffle: the size of
the copies is not known to the planner, which would send them through the driver.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part;
vectors of different lengths are not compared; ids that repeat count once, with their smallest vector; ties go to
the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result; extra columns are ignored.
A component beyond 2^53 in size after scaling counts as 2^53, and a score beyond the range of a long as the end of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.llm.common import written

CELLS = 128
LARGEST = 1 << 53
# Rows and queries that a task compares at once.
ROW_BLOCK = 2048
QUERY_BLOCK = 1024
# Blocks of rows that each query is sent to, and the bytes of cells in one beyond which there are more of them.
ROW_BLOCKS = 64
BLOCK_BYTES = 8 << 20
# Exact vectors that are read for a query before the rest is judged by their k-th score, as a multiple of k.
FIRST_READ = 4


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``vec_id, v``: one integer vector for each id that takes part."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("e")).filter("vec_id is not null and e is not null")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    most = F.lit(float(LARGEST))

    def whole(x: Column) -> Column:
        return F.greatest(F.least(F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), most), -most)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("bigint")

    return rows.filter(finite).groupBy("vec_id").agg(F.min(F.transform("e", whole)).alias("v"))


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """``class_id, v, ids``: distinct vectors with their k + 1 smallest ids, the first of which names the class."""
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("rank") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", 0).alias("class_id"), "v", "ids")


def _cell_bounds(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length, the smallest and largest component in each cell of each dimension."""
    cuts = [i / CELLS for i in range(1, CELLS)]
    components = classes.select(F.size("v").alias("length"), F.posexplode("v").alias("d", "x"))
    found = components.groupBy("length", "d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", cuts, 1000).alias("cuts")).collect()
    bounds = {r["length"]: (np.zeros((r["length"], CELLS)), np.zeros((r["length"], CELLS))) for r in found}
    for r in found:
        edges = np.array(r["cuts"], dtype=np.float64)
        bounds[r["length"]][0][r["d"]] = np.minimum(np.concatenate([[r["low"]], edges]), r["high"])
        bounds[r["length"]][1][r["d"]] = np.maximum(np.concatenate([edges - 1, [r["high"]]]), r["low"])
    return bounds


def _coded(classes: DataFrame, bounds: dict) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column("v").to_pylist():
                low = bounds[len(v)][0] if len(v) else np.zeros((0, CELLS))
                x = np.asarray(v, dtype=np.float64)
                cells.append(np.maximum((low[:, 1:] <= x[:, None]).sum(axis=1), 0).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("length"), pa.array(cells, pa.binary())], names=["class_id", "length", "cells"])

    return classes.select("class_id", "v", F.size("v").alias("length")).mapInArrow(code, "class_id bigint, length int, cells binary")


def _long(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _row_blocks(rows: int, width: int) -> int:
    """Blocks for rows of up to ``width`` cells and an id."""
    return max(min(-(-rows // ROW_BLOCK), ROW_BLOCKS), -(-rows * (width + 8) // BLOCK_BYTES))


def _pairs_of_blocks(rows: DataFrame, row_blocks: int, queries: DataFrame, n_queries: int) -> DataFrame:
    """Every block of rows with every block of queries of the same length, by a join on the block of rows."""
    query_blocks = -(-n_queries // QUERY_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("class_id"), F.lit(max(n, 1))).cast("int")
    left = rows.groupBy("length", block(row_blocks).alias("rb")).agg(F.collect_list(F.struct("class_id", "cells")).alias("rows"))
    right = queries.groupBy("length", block(query_blocks).alias("qb")).agg(F.collect_list(F.struct("class_id", "v", "floor")).alias("queries"))
    copies = right.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(max(row_blocks, 1) - 1))))
    return left.join(copies.hint("merge"), ["length", "rb"])


def _scan(pairs: DataFrame, bounds: dict, k: int, lower: bool) -> DataFrame:
    """Either the k largest lower bounds of each query in each block, or the rows whose upper bound reaches the query's floor."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, queries in zip(batch.column("length").to_pylist(), batch.column("rows"), batch.column("queries")):
                rows, queries = rows.values, queries.values
                ids, asked = rows.field("class_id").to_numpy(), queries.field("class_id").to_numpy()
                every = np.frombuffer(b"".join(rows.field("cells").to_pylist()), dtype=np.uint8).reshape(len(ids), length)
                q = np.array(queries.field("v").to_pylist(), dtype=np.float64).reshape(len(asked), length)
                low, high = bounds.get(length, (np.zeros((0, CELLS)),) * 2)
                d = np.arange(length)
                up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
                size = np.abs(q).sum(axis=1)[None, :]
                floor = np.array([-np.inf if f is None else f for f in queries.field("floor").to_pylist()])
                best = np.zeros((0, len(asked)))
                for start in range(0, len(ids), ROW_BLOCK):
                    cells, names = every[start : start + ROW_BLOCK], ids[start : start + ROW_BLOCK]
                    near, far = low[d, cells], high[d, cells]
                    # Sums of whole numbers are exact below 2^53; beyond, bounds make room for what rounding can take.
                    reach = np.maximum(np.abs(near), np.abs(far)).max(axis=1, initial=0)[:, None] * size
                    room = np.where(reach < 2.0**52, 0.0, reach * (length + 4) * 2.0**-50)
                    if lower:
                        best = np.concatenate([best, near @ up + far @ down - room])
                        best = best if len(best) <= k else np.partition(best, len(best) - k, axis=0)[len(best) - k:]
                    else:
                        most = far @ up + near @ down + room
                        j, i = np.nonzero((most >= floor).T)
                        yield pa.RecordBatch.from_arrays([pa.array(asked[j]), pa.array(names[i]), pa.array(_long(most[i, j]))], names=["query", "class_id", "bound"])
                if lower:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, len(best))), pa.array(_long(best.T.ravel()))], names=["query", "bound"])

    return pairs.select("length", "rows", "queries").mapInArrow(scan, "query bigint, bound bigint" if lower else "query bigint, class_id bigint, bound bigint")


def _exact(candidates: DataFrame, classes: DataFrame, wide: bool) -> DataFrame:
    """``query, class_id, score`` from the vectors themselves; ``wide`` where a score may leave the range of a long."""
    read = candidates.join(classes.select("class_id", F.col("v").alias("b")), "class_id").join(classes.select(F.col("class_id").alias("query"), F.col("v").alias("a")), "query")
    if wide:
        terms = F.zip_with("a", "b", lambda x, y: (x.cast("decimal(18,0)") * y.cast("decimal(18,0)")).cast("decimal(38,0)"))
        total = F.aggregate(terms, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
        product = F.greatest(F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")), F.lit(-(1 << 63)).cast("decimal(38,0)")).cast("bigint")
    else:
        product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return read.select("query", "class_id", product.alias("score"))


def top_inner_products(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for every id that ``is_query`` (a function of the id column) selects."""
    rows = written(integer_vectors(vectors, vec_id, embedding, scale))
    # Vectors are never broadcast: the planner knows the files only, in which they may be much smaller than in memory.
    classes = written(vector_classes(rows, k)).hint("merge")
    asking = rows.filter(is_query(F.col("vec_id")))
    member = written(asking.join(classes.select("v", "class_id"), "v").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query")))
    wanted = k + 1  # the query itself may be among the best
    bounds = _cell_bounds(classes)
    wide = any(max(abs(low.min(initial=0)), high.max(initial=0)) ** 2 * length >= 2.0**62 for length, (low, high) in bounds.items())
    coded = written(_coded(classes, bounds))
    queries = written(member.select(F.col("query").alias("class_id")).distinct().join(classes, "class_id").select("class_id", "v", F.size("v").alias("length"), F.lit(None).cast("bigint").alias("floor")))
    row_blocks, n_queries = _row_blocks(coded.count(), max(bounds, default=0)), queries.count()

    lows = written(_scan(_pairs_of_blocks(coded, row_blocks, queries, n_queries), bounds, wanted, True))
    kth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound")))
    floors = lows.withColumn("rank", kth).filter(F.col("rank") <= wanted).groupBy("query").agg(F.min("bound").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == wanted)
    floored = written(queries.drop("floor").join(floors.select(F.col("query").alias("class_id"), "floor"), "class_id", "left"))
    found = written(_scan(_pairs_of_blocks(coded, row_blocks, floored, n_queries), bounds, wanted, False))

    in_order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "class_id"))
    first = found.withColumn("rank", in_order).filter(F.col("rank") <= FIRST_READ * wanted)
    first = written(first.select("query", "class_id"))
    scored = written(_exact(first, classes, wide))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class_id"))
    certain = scored.withColumn("rank", best).filter(F.col("rank") == wanted).select("query", F.col("score").alias("reached"))
    rest = found.join(certain, "query").filter(F.col("bound") >= F.col("reached")).select("query", "class_id").join(first, ["query", "class_id"], "left_anti")
    top = scored.unionByName(_exact(rest, classes, wide)).withColumn("rank", best).filter(F.col("rank") <= wanted)

    named = top.join(classes.select("class_id", "ids"), "class_id").select("query", "score", F.explode("ids").alias("vec_id"))
    answers = member.join(written(named), "query").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
