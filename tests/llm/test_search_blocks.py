"""Blocks of the exact search: copies of queries are shuffled, and a block of several tiles gives the results of one."""

import numpy as np

from segmentry.llm import search


def test_copies_of_queries_do_not_go_through_the_driver(spark):
    rows = spark.createDataFrame([(i, 2, bytearray([i, i])) for i in range(40)], "class_id bigint, length int, cells binary")
    queries = spark.createDataFrame([(i, [i, 1], 2, None) for i in range(4)], "class_id bigint, v array<bigint>, length int, floor bigint")
    pairs = search._pairs_of_blocks(rows, 8, queries, 4)
    assert sum(len(r["rows"]) * len(r["queries"]) for r in pairs.collect()) == 160
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_query_are_bounded():
    assert [search._row_blocks(n, 64) for n in (0, 1, 2048, 2049, 615_384)] == [0, 1, 1, 2, 64]
    assert search._row_blocks(100_000_000, 64) == -(-100_000_000 * 72 // search.BLOCK_BYTES)


def test_blocks_of_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 9, (300, 6)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(search, "ROW_BLOCK", 16)
    monkeypatch.setattr(search, "ROW_BLOCKS", 3)
    got = sorted(tuple(r) for r in search.top_inner_products(df, lambda i: i % 20 == 0, k=4, scale=1).collect())
    score = (x @ x.T).astype(int)
    expected = []
    for q in range(0, 300, 20):
        best = sorted((-score[q, i], i) for i in range(300) if i != q)[:4]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(expected)
