"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

A text and an item are words (lower-case runs of letters and digits) and their five-word shingles; a text of fewer
words is one shingle. A shingle of the benchmark weighs ``UNIT // (items that have it)``, at least 1, every other
shingle of a document ``UNIT``. A window is as long as an item and stands where one of their common shingles puts it,
cut at the text's ends. Its known shingles are a set, its unknown positions count each. Similarity is the weight of
the common shingles over that of the union; a window leaks the item from ``threshold`` on.

Windows without a common shingle have similarity 0 and are never formed, which is why the benchmark's shingles are
looked up first. The fingerprint of a window covers its known shingles. ``RADIUS + 1`` blocks of bits guarantee that
all pairs within the radius agree in a block: they meet in a join on (item length, block, bits), the distance is
checked there, and the exact similarity afterwards. At similarity 0.8 the expected distance is up to 10 bits of 64 (most for windows cut at a text's
end, with a deviation of 3), so a radius of 24 leaves none out in practice, and the tests hold the result against one without
fingerprints. An item of fewer than five words is one shingle of its own length; its windows are the runs of so many words with that hash, at
distance 0.

Defined results: null and empty texts and null ids leak nothing (a null ``doc_id`` is reported as null if its text
leaks); items with the same words are one, named by the smallest id; documents with the same text share a result and
repeated rows are repeated; empty tables give empty results; extra columns are ignored or
pass through, but ``without_leaks`` drops names that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import letter_words, shingle_hashes, small_side, text_key, without_reserved, written

SHINGLE = 5
THRESHOLD_PERCENT = 80
UNIT = 1000
RADIUS = 24
_EDGES = [round(64 * i / (RADIUS + 1)) for i in range(RADIUS + 2)]


def _block(bits: Column, b: int) -> Column:
    return F.shiftrightunsigned(bits, _EDGES[b]).bitwiseAND(F.lit((1 << (_EDGES[b + 1] - _EDGES[b])) - 1))


def _first_equal_block(a: Column, b: Column) -> Column:
    return F.coalesce(*[F.when(_block(a.bitwiseXOR(b), k) == 0, F.lit(k)) for k in range(RADIUS + 1)])


def simhash(known: Column) -> Column:
    """64 signs of the weighted sums of the bits of ``known`` (array of sh, weight)."""
    def sign(i: Column) -> Column:
        total = F.aggregate(known, F.lit(0).cast("bigint"), lambda acc, k: acc + F.when(F.call_function("getbit", k["sh"], i) == 1, k["weight"]).otherwise(-k["weight"]))
        return F.when(total >= 0, F.expr("1L")).otherwise(F.expr("0L"))

    signs = F.transform(F.sequence(F.lit(0), F.lit(63)), sign)
    return F.aggregate(signs, F.expr("0L"), lambda acc, s: F.shiftleft(acc, 1).bitwiseOR(s))


def _weight(known: Column) -> Column:
    return F.aggregate(known, F.expr("0L"), lambda acc, k: acc + k["weight"])


def _items(benchmark: DataFrame) -> DataFrame:
    """``words, item_id``: distinct word sequences with their smallest id."""
    words = benchmark.filter("item_id is not null").select("item_id", letter_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return words.groupBy("words").agg(F.min("item_id").alias("item_id"))


def short_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame | None:
    """``blob, item_id, similarity, start_word, n_words`` of items with fewer than five words, where there are any."""
    items = written(_items(benchmark).filter(F.size("words") < SHINGLE).select("item_id", F.size("words").alias("size"), F.xxhash64("words").alias("sh")))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    if not sizes:
        return None
    words = docs.select(text_key(F.col(text)).alias("blob"), letter_words(F.col(text)).alias("words"))

    def runs(n: int) -> Column:
        found = F.transform(shingle_hashes(F.col("words"), n), lambda sh, i: F.struct(F.lit(n).alias("size"), sh.alias("sh"), i.alias("pos")))
        return F.when(F.size("words") >= n, found).otherwise(F.array().cast("array<struct<size:int,sh:bigint,pos:int>>"))

    hits = words.select("blob", F.explode(F.concat(*[runs(n) for n in sizes])).alias("r")).select("blob", "r.*").join(small_side(items), ["size", "sh"])
    return hits.groupBy("blob", "item_id").agg(F.lit(1.0).alias("similarity"), F.min("pos").alias("start_word"), F.first("size").alias("n_words"))


def benchmark_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of five words or more (``item_id, size, known, item_weight``) and the dictionary (``sh, weight, anchors``) of a benchmark."""
    items = _items(benchmark).filter(F.size("words") >= SHINGLE)
    places = written(items.select("item_id", F.size("words").alias("size"), F.posexplode(shingle_hashes(F.col("words"), SHINGLE)).alias("o", "sh")))
    counts = places.groupBy("sh").agg(F.count_distinct("item_id").alias("df"), F.collect_set(F.struct("size", "o")).alias("anchors"))
    dictionary = written(counts.select("sh", F.greatest(F.expr(f"{UNIT} div df"), F.expr("1L")).alias("weight"), "anchors"))
    known = places.select("item_id", "size", "sh").distinct().join(dictionary.select("sh", "weight"), "sh")
    sets = known.groupBy("item_id", "size").agg(F.sort_array(F.collect_list(F.struct("sh", "weight"))).alias("known"))
    return written(sets.select("item_id", "size", "known", _weight(F.col("known")).alias("item_weight"), simhash(F.col("known")).alias("item_bits"))), dictionary


def known_places(docs: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """``blob, n_words, hits``: the places (pos, sh, weight, anchors) of benchmark shingles in each distinct text that has any."""
    words = docs.select(text_key(F.col(text)).alias("blob"), letter_words(F.col(text)).alias("words"))
    places = words.select("blob", F.size("words").alias("n_words"), F.posexplode(shingle_hashes(F.col("words"), SHINGLE)).alias("pos", "sh"))
    hits = places.join(small_side(dictionary), "sh")
    return hits.groupBy("blob", "n_words").agg(F.collect_set(F.struct("pos", "sh", "weight", "anchors")).alias("hits"))


def windows(found: DataFrame) -> DataFrame:
    """Item-sized windows with their known shingles, window weight and fingerprint.

    A window whose unknown part alone rules the threshold out is left before the fingerprint is made.
    """
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(h["anchors"], lambda a: F.struct((h["pos"] - a["o"]).alias("start"), a["size"].alias("size"))))))
    one = found.select("blob", "n_words", "hits", F.explode(starts).alias("w"))
    one = one.select("blob", "hits", F.greatest("w.start", F.lit(0)).alias("start"), F.least(F.col("w.start") + F.col("w.size"), "n_words").alias("end"), F.col("w.size").alias("size"))
    inside = F.filter("hits", lambda h: (h["pos"] >= F.col("start")) & (h["pos"] < F.greatest(F.col("end") - (SHINGLE - 1), F.col("start") + 1)))
    one = one.select("blob", "start", "end", "size", inside.alias("inside"))
    known = F.array_distinct(F.transform("inside", lambda h: F.struct(h["sh"].alias("sh"), h["weight"].alias("weight"))))
    unknown = (F.greatest(F.col("end") - F.col("start") - (SHINGLE - 1), F.lit(1)) - F.size("inside")).cast("bigint") * UNIT
    one = one.select("blob", "start", "end", "size", known.alias("known"), unknown.alias("unknown")).withColumn("known_weight", _weight(F.col("known")))
    one = one.filter(F.expr("100L") * F.col("known_weight") >= F.lit(THRESHOLD_PERCENT) * (F.col("known_weight") + F.col("unknown")))
    return one.withColumn("bits", simhash(F.col("known")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``blob, item_id, similarity, start_word, n_words``: the most similar window (the first of equals) of each leaked item in each distinct text."""
    items, dictionary = benchmark_items(benchmark)
    places = written(windows(known_places(docs, dictionary, text)))
    blocks = F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("bits"), b).alias("v")) for b in range(RADIUS + 1)])
    left = places.select("blob", "start", "end", "size", "known", (F.col("known_weight") + F.col("unknown")).alias("weight"), "bits", F.inline(blocks))
    item_blocks = F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("item_bits"), b).alias("v")) for b in range(RADIUS + 1)])
    right = items.select("item_id", "size", F.col("known").alias("item_known"), "item_weight", "item_bits", F.inline(item_blocks))
    near = left.join(right, ["size", "b", "v"]).filter((F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits"))) <= RADIUS) & (_first_equal_block(F.col("bits"), F.col("item_bits")) == F.col("b")))
    shared = _weight(F.array_intersect("known", "item_known"))
    pairs = near.select("blob", "start", "end", "item_id", shared.alias("shared"), (F.col("weight") + F.col("item_weight")).alias("both"))
    pairs = pairs.withColumn("union", F.col("both") - F.col("shared")).filter(F.expr("100L") * F.col("shared") >= F.lit(THRESHOLD_PERCENT) * F.col("union"))
    score = F.round(F.col("shared") / F.col("union"), 6)
    best = pairs.groupBy("blob", "item_id").agg(F.max(F.struct(score.alias("similarity"), (-F.col("start")).alias("back"), (F.col("end") - F.col("start")).alias("n_words"))).alias("w"))
    long = best.select("blob", "item_id", "w.similarity", (-F.col("w.back")).alias("start_word"), "w.n_words")
    short = short_leaks(docs, benchmark, text)
    return long if short is None else long.unionByName(short)


def leaked_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and leaked item: ``doc_id, item_id, similarity, start_word, n_words``."""
    leaks = written(find_leaks(docs, benchmark))
    ids = docs.select("doc_id", text_key(F.col("text")).alias("blob"))
    return ids.join(leaks, "blob").select("doc_id", "item_id", "similarity", "start_word", "n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose text leaks no item, unchanged."""
    leaky = written(find_leaks(docs, benchmark, text).select(F.col("blob").alias("__blob")).distinct())
    docs = without_reserved(docs)
    return docs.withColumn("__key", text_key(F.col(text))).join(small_side(leaky), F.col("__key") == F.col("__blob"), "left_anti").drop("__key")
