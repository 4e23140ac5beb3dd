"""Temperature mixing of sources, realised as budgeted block permutations.

A source's share of all tokens is raised to an exponent and normalised. The exponent is found by narrowing a bracket
(16 parts a round, one small grouping over the source totals) until the mixture has the wanted entropy, or until no
source is repeated more often than a limit while no document is dropped. Each source then gets ``weight * budget`` tokens:
whole passes over its documents, and a rest that is a prefix of one more pass. In each pass the documents of a source
are dealt into blocks whose order is a hash of the pass, as is the order in a block. The prefix ends at a cutoff, which
is found from block totals and the one block in which the budget ends. A document then knows from its source's row how
often it is taken: documents are never sorted, joined or moved.

Defined results: a null source is a source of its own; texts without words have no tokens, and go with the prefix by
their hash; a source without tokens is taken once; repeated rows are taken alike; one source gets weight 1; an empty
table gives an empty result; other columns pass through, but names that begin with two underscores are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.llm.common import small_side, without_reserved, written

BLOCKS = 1024
MAX_REPEATS = 2.0
SEED = 6
PARTS = 16
ROUNDS = 9


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_totals(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """``source, tokens`` of every source."""
    return docs.select(F.col(source).alias("source"), token_count(F.col(text)).alias("t")).groupBy("source").agg(F.sum("t").alias("tokens"))


def _bisect(log_shares: DataFrame, measure, target: float) -> float:
    """The exponent in [0, 1] at which ``measure(exponent)``, which falls with it, comes down to ``target``."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
        values = log_shares.agg(*[measure(a).alias(f"m{i}") for i, a in enumerate(grid)]).first()
        above = [i for i, v in enumerate(values) if v is not None and v > target]
        if len(above) == PARTS + 1 or not above:
            return high if above else low
        low, high = grid[above[-1]], grid[above[-1] + 1]
    return round((low + high) / 2, 9)


def exponent_for_entropy(log_shares: DataFrame, nats: float) -> float:
    """``log_shares`` has ``l``: the logarithm of a share relative to the largest one."""
    def entropy(a: float) -> Column:
        z = F.sum(F.exp(a * F.col("l")))
        return F.log(z) - F.sum(a * F.col("l") * F.exp(a * F.col("l"))) / z

    return _bisect(log_shares, entropy, nats)


def exponent_for_repeats(log_shares: DataFrame, repeats: float) -> float:
    """With the largest source taken once, a source of relative share s is taken s ** (exponent - 1) times."""
    return _bisect(log_shares, lambda a: F.max(F.exp((a - 1) * F.col("l"))), repeats)


def mixture_plan(docs: DataFrame, source: str = "source", text: str = "text", entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """``source, tokens, weight, quota``. Without a budget it is the least one that takes every document."""
    totals = written(source_totals(docs, source, text))
    top = totals.agg(F.max("tokens")).first()[0]
    if not top:
        return totals.select("source", "tokens", F.lit(None).cast("double").alias("weight"), F.col("tokens").alias("quota"))
    shares = totals.filter("tokens > 0").withColumn("l", F.log(F.col("tokens") / F.lit(top)))
    exponent = exponent_for_entropy(shares, entropy) if entropy is not None else exponent_for_repeats(shares, max_repeats)
    powers = shares.agg(F.sum(F.exp(exponent * F.col("l"))).alias("z"), F.max(F.col("tokens") / F.exp(exponent * F.col("l"))).alias("once")).first()
    whole = budget if budget is not None else powers["z"] * powers["once"]
    # The small addition keeps a quota that is whole in exact arithmetic from falling one short. Beyond the precision of
    # doubles it cannot, so without a budget no source gets less than all of its tokens.
    weight = F.exp(exponent * F.log(F.col("tokens") / F.lit(top))) / F.lit(powers["z"])
    planned = totals.withColumn("weight", F.when(F.col("tokens") > 0, weight))
    quota = F.floor(F.col("weight") * F.lit(float(whole)) + 1e-6)
    quota = F.greatest(quota, F.col("tokens")) if budget is None else quota
    return written(planned.withColumn("quota", F.when(F.col("tokens") > 0, quota).otherwise(F.lit(0)).cast("bigint")))


def _block_key(source: Column, block: Column, epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED), source, epoch, block)


def _dealt(docs: DataFrame, source: str, text: str, key: list[str]) -> DataFrame:
    """``docs`` with its tokens, block and order hash; ``key`` are the columns that tell documents apart."""
    order = F.xxhash64(F.lit(SEED), *[F.col(c) for c in key])
    return docs.select("*", token_count(F.col(text)).alias("__tokens"), order.alias("__order"), F.pmod(F.xxhash64(F.lit(SEED + 1), order), F.lit(BLOCKS)).alias("__block"))


def _cutoffs(dealt: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Per source: whole passes and the end of the rest, as the key of its block and the last order hash taken there."""
    epochs = plan.select(
        F.col("source").alias("s"), "tokens", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0).alias("rest"), F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(1.0).alias("passes"))
    epochs = written(epochs)
    narrow = dealt.select(F.col(source).alias("source"), "__tokens", "__order", "__block")
    blocks = narrow.groupBy("source", "__block").agg(F.sum("__tokens").alias("t")).join(small_side(epochs), F.col("source").eqNullSafe(F.col("s")))
    blocks = blocks.withColumn("key", _block_key(F.col("source"), F.col("__block"), F.col("whole")))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("key", "__block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = blocks.withColumn("upto", upto).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")))
    ends = written(ends.select(F.col("source").alias("of"), F.col("__block").alias("end_block"), F.col("key").alias("end_key"), (F.col("rest") - F.col("upto") + F.col("t")).alias("left")))
    inside = narrow.join(small_side(ends), F.col("source").eqNullSafe(F.col("of")) & (F.col("__block") == F.col("end_block")))
    inside = inside.groupBy("of", "end_key", "left", "__order").agg(F.sum("__tokens").alias("t"))
    running = F.sum("t").over(Window.partitionBy("of").orderBy("__order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", running).groupBy("of", "end_key").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("__order"))).alias("end_order"))
    return epochs.join(last, F.col("s").eqNullSafe(F.col("of")), "left").select(F.col("s").alias("__s"), F.col("whole").alias("__whole"), F.col("passes").alias("__passes"), F.col("end_key").alias("__end_key"), F.col("end_order").alias("__end_order"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: list[str] | None = None, entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """A row for each copy of each document: its columns, then the pass it belongs to, its block of the mixture and its tokens.

    The last three columns are ``__epoch, __mix_block, __tokens``. Every run of mixture blocks has the sources in about their weights.
    """
    docs = without_reserved(docs)
    plan = mixture_plan(docs, source, text, entropy, max_repeats, budget)
    dealt = _dealt(docs, source, text, key or [c for c in docs.columns if c != text])
    cut = written(_cutoffs(dealt, plan, source))
    joined = dealt.join(small_side(cut), F.col(source).eqNullSafe(F.col("__s")))
    rest_key = _block_key(F.col(source), F.col("__block"), F.col("__whole"))
    in_rest = (rest_key < F.col("__end_key")) | ((rest_key == F.col("__end_key")) & (F.col("__order") <= F.col("__end_order")))
    copies = F.col("__whole") + F.when(F.coalesce(in_rest, F.lit(False)), 1).otherwise(0)
    taken = joined.withColumn("__copies", copies).filter("__copies > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    place = F.shiftrightunsigned(_block_key(F.col(source), F.col("__block"), F.col("__epoch")).bitwiseXOR(F.expr("shiftleft(1L, 63)")), 11).cast("double") / F.lit(float(1 << 53))
    block = F.least(F.floor((F.col("__epoch") + place) / F.greatest(F.col("__passes"), F.lit(1e-9)) * BLOCKS), F.lit(BLOCKS - 1)).cast("int")
    return taken.select(*docs.columns, "__epoch", block.alias("__mix_block"), "__tokens")
