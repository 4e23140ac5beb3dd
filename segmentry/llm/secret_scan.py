"""Secret scans with an incremental ledger of scanned contents, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a table of
``(rule_version, blob, hits)``; a run scans only the contents that the ledger does not have under the rules'
version, once each, appends them, and joins the findings back to all paths that hold the content.

Defined results: a null text counts as empty and has no finding; repeated rows and paths each get their
content's findings; an empty table gives an empty result; extra columns are ignored; a null path is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.llm.common import text_key, written
from segmentry.session import stage_path


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
# kind: pattern, capture group whose length counts, least length of it. The kinds' order breaks ties.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # A run below the least length never matches, so the length can stand in the pattern.
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
RULE_VERSION = "base-1"
LEDGER_SCHEMA = "rule_version string, blob binary, hits array<struct<kind:int,i:int,reach:int,size:int,counted:int>>"


def _hits(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches as steps: each step is the gap before a match and the match.

    The anchor at the previous match's end keeps the search linear in the length of the text.
    """
    steps = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?{pattern}"), F.lit(0))
    found = F.transform(
        steps,
        lambda s, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(s).alias("reach"), F.length(F.regexp_extract(s, pattern, 0)).alias("size"),
            F.length(F.regexp_extract(s, pattern, group)).alias("counted")),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,i:int,reach:int,size:int,counted:int>>"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: dict = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of the contents in ``versions`` (``blob, text``) that ``ledger`` lacks under ``rule_version``."""
    if ledger is not None:
        versions = versions.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    # One row per content: copies meet before the shuffle, so a content held by a third of all paths is one row per task.
    contents = versions.groupBy("blob").agg(F.first("text").alias("text"))
    arrays = [_hits(F.col("text"), k, pattern, group) for k, (pattern, group, _) in enumerate(rules.values())]
    return contents.select(F.lit(rule_version).alias("rule_version"), "blob", F.concat(*arrays).alias("hits"))


def blob_spans(ledger: DataFrame, rules: dict = RULES) -> DataFrame:
    """``blob, found``: the spans (start, kind, end) of each content that has any, by start and then kind."""
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in rules.values()]), F.col("kind") + 1)
    # Runs side by side, or a run repeated after a late failure, can leave a content in the ledger more than once.
    once = ledger.filter(F.size("hits") > 0).groupBy("blob").agg(F.first("hits").alias("hits"))
    steps = once.select("blob", F.inline("hits"))
    reach = F.sum("reach").over(Window.partitionBy("blob", "kind").orderBy("i"))
    spans = steps.withColumn("end", reach).filter(F.col("counted") >= least).select("blob", F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end").alias("span"))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("found"))


def scan_secrets(paths: DataFrame, text: str = "text", ledger_path: str | None = None, rules: dict = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """All rows of ``paths`` without the text, with ``blob`` and ``found`` (spans in code points, end exclusive).

    ``ledger_path`` names the ledger's table; a later run over more versions scans only what is new to it. Without
    one the run starts a ledger of its own in the shared folder.
    """
    spark = paths.sparkSession
    own = ledger_path is None
    ledger_path = ledger_path or stage_path(spark, "ledger")
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(ledger_path)
    ledger = None if own else spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    content = F.coalesce(F.col(text), F.lit(""))
    fresh = scan_unseen(paths.select(text_key(F.col(text)).alias("blob"), content.alias("text")), ledger, rules, rule_version)
    fresh.write.mode("append").parquet(ledger_path)
    seen = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path).filter(F.col("rule_version") == rule_version)
    found = written(blob_spans(seen, rules))
    clash = [c for c in ("blob", "found") if c in paths.columns and c != text]
    held = paths.withColumn("blob", text_key(F.col(text))).drop(text, *[c for c in clash if c != "blob"])
    return held.join(found, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))


def span_text(found: Column, rules: dict = RULES) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of a scan of ``documents``."""
    scanned = scan_secrets(docs.select("doc_id", "text"))

    def count(kind: int, name: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{name}")

    counts = [count(k, name) for k, name in enumerate(RULES)]
    return scanned.select("doc_id", *counts, span_text(F.col("found")).alias("spans")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")
