"""Merkle manifest, ranked search and SimHash groups against plain versions, and their results for odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segmentry.llm import fptree, graysim, merkle
from tests_llm_rows import DOCS, odd_rows, prose, table, with_extra


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_proofs(rows):
    def leaf(r, more=0):
        values = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def path(tree, i):
        for level in tree[:-1]:
            yield (i ^ 1) < i, level[i ^ 1] if i ^ 1 < len(level) else ""
            i //= 2

    parts = collections.defaultdict(list)
    for r in rows:
        parts[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(parts, key=lambda name: (name is not None, (name or "").encode()))
    trees = {name: levels([x[2] for x in sorted(parts[name], key=lambda x: x[:3])]) for name in names}
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (known, doc_id, own, r) in enumerate(sorted(parts[name], key=lambda x: x[:3])):
            steps = [*path(trees[name], i), *path(top, k)]
            node = leaf(r, 1) if known and r[4] is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else own
            for first, sibling in steps:
                node = digest(sibling, node) if first else digest(node, sibling)
            out.append((r[0], own, trees[name][-1][0], top[-1][0], digest(*[s for _, s in steps]), node, node == top[-1][0]))
    return sorted(out, key=str)


def proofs(df):
    return sorted((tuple(r) for r in merkle.prove(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_proofs_match_a_plain_tree(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 3), rng.choice(["en"] * 9 + ["de", None]), rng.choice(["a", "é", None]), rng.choice([None, 5, 10**12])) for i in range(700)]
    rows += [(9000 + i, "z", f"lone{i}", "a", 1) for i in range(70)]  # partitions of one leaf, more than a segment of them
    got = proofs(spark.createDataFrame(rows, DOCS).repartition(8))
    assert got == plain_proofs(rows) and {r[-1] for r in got} == {True, False}


def test_proofs_of_odd_rows(spark):
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in odd_rows(random.Random(1))]
    df = spark.createDataFrame(rows, DOCS)
    assert proofs(with_extra(df)) == plain_proofs(rows)
    assert merkle.prove(df.limit(0)).count() == 0
    (lone,) = merkle.prove(df.filter("doc_id = 8")).collect()
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def plain_ranking(rows, items, k):
    def words(text):
        folded = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    docs = [(i, collections.Counter(words(t))) for i, t in rows]
    n_docs, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    texts = collections.defaultdict(set)
    for item, text in items:
        if item is not None and text is not None:
            texts[item].add(text)
    out = []
    for item, held in texts.items():
        scores = []
        for doc_id, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(" ".join(sorted(held))) if c[t])
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "leaf", "chunk"), [(2048, 16, 1 << 13), (50, 2, 40)])
def test_ranking_matches_every_score(spark, monkeypatch, block, leaf, chunk):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("CHUNK_TERMS", chunk)):
        monkeypatch.setattr(fptree, name, value)
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(None, rows[7][1]), (2000, None), (2001, "- . !"), (5, rows[9][1]), (5, rows[9][1]), (2002, "Über ÜBER 9a\x7f9A"), (2003, prose(rng, 20_000))]
    items = [(i, prose(rng, 12) + " " + rows[i][1]) for i in range(12)] + [(50, "über 9a 9a"), (51, None), (52, "??"), (None, "ba"), (50, "ba be"), (50, "ba be")]
    docs = with_extra(spark.createDataFrame(rows, "doc_id bigint, text string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in fptree.top_documents(docs, bench).collect())
    assert got == plain_ranking(rows, items, 20) and len({g[0] for g in got}) > 10
    assert fptree.top_documents(docs.limit(0), bench).count() == 0 and fptree.top_documents(docs, bench.limit(0)).count() == 0


def test_bounds_leave_subtrees_out(monkeypatch):
    rng = np.random.default_rng(4)
    tf = rng.poisson(0.05, (2000, 60)).astype(np.int32)
    tf[:25, 40:] = 3
    tree = fptree.PrefixTree(tf, np.full(2000, 100))
    item = fptree.Item(0, np.arange(40, 60), np.full(20, 5000))
    scored = []
    whole = fptree.gain

    def spy(part, m, weights):
        scored.append(len(part))
        return whole(part, m, weights)

    monkeypatch.setattr(fptree, "gain", spy)
    scores, found = tree.search(item, np.arange(2000)[tree.order], (np.zeros(0, np.int64), np.zeros(0, np.int64)), 20)
    assert sorted(found) == list(range(20)) and sum(scored) < 1000


def plain_fingerprint(text):
    folded = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_simhash_groups(rows):
    prints, up = [plain_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [i for i, r in enumerate(rows) if r[0] is not None]
    for i in known:
        for j in known:
            if j < i and ((prints[i] ^ prints[j]).bit_count() <= 3 or rows[i][0] == rows[j][0]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in known:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], f"{p:016x}", None if r[0] is None else least[find(i)]) for i, (r, p) in enumerate(zip(rows, prints))), key=str)


@pytest.mark.parametrize(("least", "spread"), [(256, 64), (8, 40)])
def test_simhash_groups_match_all_pairs(spark, monkeypatch, least, spread):
    monkeypatch.setattr(graysim, "LEAST", least)
    monkeypatch.setattr(graysim, "SPREAD", spread)
    rng = random.Random(13)
    rows = []
    for i in range(250):
        base = prose(rng, rng.randint(1, 150)).split(" ")
        rows.append((i, " ".join(base)))
        for c in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "Other"
            rows.append((10_000 * (c + 1) + i, " ".join(copy)))
    rows += [(i, t) for i, t, _, _ in odd_rows(rng)] + [(3, "another text under an id")]
    got = sorted((tuple(r) for r in graysim.near_fingerprints(with_extra(table(spark, [(i, t, None, None) for i, t in rows]))).collect()), key=str)
    assert got == plain_simhash_groups(rows) and len({g[2] for g in got}) < len(got)
    assert graysim.near_fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_gray_tree_finds_all_links_and_emits_a_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    values = [base]
    for _ in range(6):
        copy = base.copy()
        for _ in range(rng.integers(1, 6)):
            copy ^= np.uint64(1) << rng.integers(0, 64, len(copy)).astype(np.uint64)
        values.append(copy)
    values = np.unique(np.concatenate(values))
    rank = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    values = values[np.argsort(rank)]
    a, b = graysim.linked_forest(values, values)
    place = {int(v): i for i, v in enumerate(values)}
    found, want = np.arange(len(values)), np.arange(len(values))
    graysim._merge(found, np.array([place[int(x)] for x in a]), np.array([place[int(x)] for x in b]))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    graysim._merge(want, *np.nonzero(near))
    assert (found == want).all() and len(a) <= 2 * len(values) < near.sum() * 2
