"""Pages of great depth in linear memory, and hosts with more winning paths than travel with them."""

import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from segmentry.llm import html


@pytest.mark.parametrize("tag", ["<div>", "<section><p>", "<td>", "<div class='c'>"])
def test_containers_that_are_never_closed(tag):
    source = "<body>" + "".join(f"{tag}word{i} " for i in range(64_000))
    tracemalloc.start()
    start = time.perf_counter()
    text = html.page_text(source, [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.split("\n")[-1] == "word63999" and peak < 300 << 20 and time.perf_counter() - start < 60


def test_scores_by_distance_equal_the_sum_over_blocks():
    source = "<div>a b c<div><div>some words</div><p>other words here</p></div><section>end<article>inner text</article></section></div><div>last</div>"
    page = html.read_page(source)
    want = {}
    for b in page.blocks:
        c, steps = b.container, 1
        while c >= 0:
            want[c] = want.get(c, 0.0) + len(b.text) / steps
            c, steps = page.parents[c], steps + 1
    worth = [0.0] * len(page.paths)
    for b in page.blocks:
        worth[b.container] += len(b.text)
    got = html._distance_scores(page, html.np.array(worth))
    assert {c: round(s, 9) for c, s in enumerate(got) if s} == {c: round(s, 9) for c, s in want.items()}


def _pages():
    """Each page of host a has one of five layouts, told apart from the body down; some are short and have a long box, which loses the vote."""
    rows = []
    for i in range(90):
        layout, short = "abcde"[i % 5], i % 30 == 3 and i > 30
        story = f"<p>Story {i}.</p>" if short else f"<p>{('words of story %d ' % i) * 30}</p><p>More of {i}.</p>"
        story = f"<div class='s{layout}'>" * 7 + story + "</div>" * 7
        rows.append((i, f"http://a.example/{i}", f"<body>{story}<div class='k{layout}'><p>{'box text ' * (20 if short else 1)}</p></div></body>"))
    rows += [(200, "http://b.example/1", "<body><div class='x'><p>Only page of a host.</p></div></body>"), (201, None, None), (5, rows[5][1], rows[5][2])]
    return rows


def test_crowded_hosts_give_the_texts_of_full_lists(spark, monkeypatch):
    df = spark.createDataFrame(_pages(), "page_id bigint, url string, html string").withColumn("path", F.lit("x"))
    listed = sorted(map(tuple, html.extract(df).collect()), key=str)
    assert len(listed) == 93 and all("box" not in r[2] for r in listed) and sum("Story" in r[2] for r in listed) == 2
    monkeypatch.setattr(html, "LISTED", 3)
    assert html.host_paths(html.path_votes(df)).filter("crowded").count() == 1
    assert sorted(map(tuple, html.extract(df).collect()), key=str) == listed
