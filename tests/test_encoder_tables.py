"""Encoders whose dictionary stays a table, and sign flips whose bits share a hash."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from segmentry.operators import encoding as enc
from segmentry.operators import validation as val

SCHEMA = "k long, size double, kind string, tags string, `odd ``name` string"


@pytest.fixture(scope="module")
def rows(spark):
    # One tag stands in every row, a third of the rows share one kind, and every row has a tag of its own.
    table = [(i, i / 7.0, "hot" if i % 3 == 0 else f"kind{i % 50}", f"all; own{i};;all", None if i % 5 else f"o;{i}") for i in range(400)]
    table += [(400, 1.5, None, None, None), (401, -2.0, "", "  ", "")]
    return spark.createDataFrame(table, SCHEMA).repartition(5)


def dense(df):
    return {r["k"]: r["x"] for r in df.select("k", vector_to_array("features").alias("x")).collect()}


def test_table_encoder_gives_the_vectors_of_the_pipeline(spark, rows, tmp_path):
    args = (["size"], ["kind"], ["tags", "odd `name"], "standard")
    plain, words = enc.fit_encoder(rows, *args)
    joined, same = enc.fit_encoder(rows, *args, key="k", vocabulary_bytes=100)
    assert isinstance(joined, enc.TableEncoder) and not isinstance(plain, enc.TableEncoder)
    assert sorted(words.collect()) == sorted(same.collect())
    new = rows.unionByName(spark.createDataFrame([(900, 0.0, "unseen", "all;unseen", None)], SCHEMA))
    expected = dense(plain.transform(new))
    got = joined.transform(new)
    assert got.columns == [*rows.columns, "features"]
    assert dense(got) == expected and len(expected) == 403
    joined.save(str(tmp_path / "encoder"))
    assert dense(enc.TableEncoder.load(spark, str(tmp_path / "encoder")).transform(new)) == expected


def test_table_encoder_refuses_what_it_cannot_place(spark, rows):
    with pytest.raises(ValueError, match="key column"):
        enc.fit_encoder(rows, labels=["tags"], vocabulary_bytes=10)
    joined, _ = enc.fit_encoder(rows, ["size"], labels=["tags"], key="k", vocabulary_bytes=10)
    for bad in ((1, None, "", "all", None), (None, 1.0, "", "all", None)):
        with pytest.raises(Exception, match="null in k, size"):
            joined.transform(spark.createDataFrame([bad], SCHEMA)).collect()


def test_table_encoder_of_an_empty_table_and_without_numbers(spark, rows):
    joined, _ = enc.fit_encoder(rows, labels=["tags"], key="k", vocabulary_bytes=10)
    plain, _ = enc.fit_encoder(rows, labels=["tags"])
    assert dense(joined.transform(rows)) == dense(plain.transform(rows))
    assert joined.transform(rows.limit(0)).count() == 0


def test_dictionary_is_numbered_in_order_over_ranges(spark):
    table = [(i, f"w{(i * 7919) % 3000:05d}") for i in range(6000)]
    df = spark.createDataFrame(table, "k long, w string").repartition(7)
    blocks = {"second": F.array("w"), "first": F.array(F.lit("only"))}
    found = enc.counted_dictionary(df, blocks).orderBy("feature_id").collect()
    assert [r["feature_id"] for r in found] == list(range(3001))
    assert [(r["block"], r["item"]) for r in found] == [("second", f"w{i:05d}") for i in range(3000)] + [("first", "only")]
    assert {r["n"] for r in found[:3000]} == {2} and found[-1]["n"] == 6000


def test_sign_flips_equal_bits_of_the_hash(spark):
    rng = np.random.default_rng(3)
    d = np.round(rng.normal(0.05, 1, 150), 3)
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(d)] + [(1000, None), (1001, float("nan"))], "row_id long, d double")
    for repeats in (1, 128, 300):
        means = []
        for repeat in range(repeats):
            bits = [int.from_bytes(hashlib.md5(f"9:flip:{repeat // 128}:{i}".encode()).digest(), "big") >> (127 - repeat % 128) & 1 for i in range(len(d))]
            means.append(round(abs(float((d * (2 * np.array(bits) - 1)).mean())), 12))
        expected = (sum(m >= round(abs(float(d.mean())), 12) for m in means) + 1) / (repeats + 1)
        assert val.sign_flip_test(df.repartition(4), "d", "row_id", repeats, 9).first()["pvalue"] == expected
