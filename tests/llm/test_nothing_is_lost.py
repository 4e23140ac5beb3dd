"""Cases in which a shortcut would lose documents, text or links."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.llm import html, leaks, mixing, neardup, search, secret_scan
from tests_llm_rows import prose, table


def test_texts_that_share_an_id_all_stay(spark):
    rng = random.Random(5)
    one, two, near = prose(rng, 40), prose(rng, 40), prose(rng, 60).split(" ")
    rows = [(1, one, "en", "a"), (1, two, "en", "a"), (1, two, "de", "a"), (2, " ".join(near), "en", "a"), (3, " ".join([*near[:-1], "end"]), "en", "a"), (4, one, "en", "a"), (None, one, "en", "a"), (None, one, "en", "a")]
    kept = sorted(((r["doc_id"], r["text"], r["lang"]) for r in neardup.keep_one(table(spark, rows)).collect()), key=str)
    # The text of id 1 with the larger digest ranks after all ids, so that its copy under id 4 is the one to stay.
    second = max((one, two), key=lambda t: __import__("hashlib").sha256(t.encode()).digest())
    want = [(2, " ".join(near), "en"), (None, one, "en"), (None, one, "en")]
    want += [(4, one, "en"), (1, two, "de")] if second == one else [(1, one, "en"), (1, two, "de")]
    assert kept == sorted(want, key=str)


def test_every_document_is_in_a_mixture_of_large_sources(spark, monkeypatch):
    rows = [(i, "w", "en", s) for i, s in enumerate("abc" * 4)]
    rng = random.Random(6)
    for _ in range(6):
        totals = {s: rng.randrange(10**11, 10**12) for s in "abc"}
        monkeypatch.setattr(mixing, "source_totals", lambda *a, t=totals: spark.createDataFrame(list(t.items()), "source string, tokens bigint"))
        assert all(r["quota"] >= r["tokens"] for r in mixing.mixture_plan(table(spark, rows)).collect())


@pytest.mark.parametrize("inner", [
    '<section id="discussion"><p>We discuss the results of the study.</p></section>', '<div class="side-by-side"><p>Two things next to each other.</p></div>', '<p class="share-price">The price of a share rose.</p>'])
def test_parts_of_an_article_with_suspicious_names_stay(inner):
    page = f'<body><div class="side-menu"><p>Menu</p></div><article><p>First paragraph of the story here.</p>{inner}<div class="share-buttons">Share this</div><div class="ad-slot-1">Buy</div><section class="comments"><p>Nice</p></section></article></body>'
    text = html.page_text(page, [])
    assert text.split("\n") == ["First paragraph of the story here.", html.page_text(f"<article>{inner}</article>", [])] and "results" in text or "other" in text or "price" in text


def test_formulas_stay_in_their_block():
    assert html.page_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p></article>", []) == "Let x=1 hold."


def test_short_items_are_found_inside_longer_texts(spark):
    rng = random.Random(7)
    docs = table(spark, [(1, prose(rng, 30) + " Three word, item " + prose(rng, 30), "en", "a"), (2, "three word item", "en", "a"), (3, "a three word item", "en", "a"), (4, prose(rng, 50), "en", "a")])
    bench = spark.createDataFrame([(7, "three word item"), (8, prose(rng, 20))], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"], r["similarity"], r["start_word"], r["n_words"]) for r in leaks.leaked_documents(docs, bench).collect()) == [(1, 7, 1.0, 30, 3), (2, 7, 1.0, 0, 3), (3, 7, 1.0, 1, 3)]
    assert {r["doc_id"] for r in leaks.without_leaks(docs, bench).collect()} == {4}


def test_radius_holds_for_windows_cut_at_the_end():
    """Differing bits of windows that hold 80 and 85 per cent of an item's shingles, with nothing unknown: all within the radius."""
    rng = np.random.default_rng(8)
    for share in (0.80, 0.85):
        for n in (10, 20, 35, 55):
            bits = rng.integers(0, 2, (2000, n, 64)) * 2 - 1
            keep = int(np.ceil(share * n))
            apart = ((bits.sum(axis=1) >= 0) != (bits[:, :keep].sum(axis=1) >= 0)).sum(axis=1)
            assert (apart <= leaks.RADIUS).mean() >= 0.9995


def test_recall_of_leaks_near_the_threshold(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(15, 59)).split(" ")) for i in range(60)]
    docs = []
    for i, words in items:
        cut = [w for w in words[: int(np.ceil(0.86 * (len(words) - 4))) + 4]]
        docs.append((i, prose(rng, 40) + " " + " ".join(cut), "en", "a"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_documents(table(spark, docs), bench).collect()}
    assert {(i, i) for i, _ in items} <= found


def test_huge_components_take_part(spark):
    rng = np.random.default_rng(10)
    vectors = [[float(x) for x in rng.normal(0, 1, 6)] for _ in range(60)]
    vectors[3][2], vectors[10][0], vectors[11][1], vectors[12][1] = 1e7, -3e9, 1e13, 1e300
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").withColumn("query_id", F.lit("x")).withColumn("bound", F.lit(1)).withColumn("length", F.lit(2))
    top = 1 << 53
    whole = [[int(max(-top, min(top, np.floor(256 * x)))) for x in v] for v in vectors]
    want = []
    for q in range(0, 60, 10):
        scores = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i in range(60) if i != q))[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    got = sorted(tuple(r) for r in search.top_inner_products(df, lambda i: i % 10 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(want)


def test_a_doubled_ledger_gives_the_same_spans(spark, tmp_path):
    docs = table(spark, [(1, "token = abcdefghijklmnop and password: 'qrstuvwxyz123456'", "en", "a"), (2, "nothing", "en", "a")])
    path = str(tmp_path / "ledger")
    first = secret_scan.scan_secrets(docs, ledger_path=path).select("doc_id", "found").orderBy("doc_id").collect()
    spark.read.parquet(path).write.mode("append").parquet(path + "-copy")
    spark.read.parquet(path + "-copy").write.mode("append").parquet(path)
    assert secret_scan.scan_secrets(docs, ledger_path=path).select("doc_id", "found").orderBy("doc_id").collect() == first and len(first[0]["found"]) == 2
