"""The pipeline's stages on a small corpus, and the registered queries against their SQL at the smallest scale."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from segmentry.llm import queries

FOLDER = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, junk, a shared line, copies, near copies and a leaked item; returns the folder and the ids."""
    rng = random.Random(20)
    folder = str(tmp_path_factory.mktemp("corpus"))
    line, item = prose(rng, 9), prose(rng, 30)
    docs = [(i, prose(rng, rng.randint(60, 200)) + ("\n" + line if i % 3 == 0 else "")) for i in range(120)]
    docs += [(200 + i, " ".join(w + "$$$" for w in prose(rng, 80).split())) for i in range(60)]
    docs += [(300, docs[5][1]), (301, docs[5][1] + " tail"), (302, prose(rng, 40) + " " + item.upper() + ". " + prose(rng, 40)), (303, None), (304, "")]
    rows = [(i, t, "en", "a" if i % 4 else "b", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 300), 0) for i, _ in docs], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, line, dict(docs)


def test_stages_take_effect(spark, corpus):
    folder, line, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "mixing":
            assert docs.dtypes == before.dtypes
    clean = set(range(120))
    assert clean <= set(after["quality"]) and not set(range(200, 260)) & set(after["quality"])
    assert set(after["lines"]) == set(after["quality"]) and all(t is None or line not in t for t in after["lines"].values())
    gone = set(after["lines"]) - set(after["near_duplicates"])
    assert gone == {300, 301}
    assert set(after["near_duplicates"]) - set(after["decontamination"]) == {302}
    assert set(after["mixing"]) == set(after["decontamination"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(after["mixing"])


@pytest.mark.parametrize("part", ["empty", "odd"])
def test_stages_take_odd_tables(spark, corpus, part):
    folder, _, _ = corpus
    rows = [] if part == "empty" else [(None, "some words here", None, None, None), (1, None, None, None, 0), (2, "", "en", "a", 0), (3, "x y z", "en", "a", 5), (3, "x y z", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'x' as score", "1 as __key")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() <= 2 * len(rows) and set(corpus_pipeline.COLUMNS) <= set(out.columns)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    res = con.sql(entry.oracle_sql()[name])
    place = [res.columns.index(c) for c in cols]
    assert sorted(res.columns) == cols
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in place]) for r in res.fetchall())
