"""Feature dictionaries, scaling and vector assembly."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, SQLTransformer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from segmentry.functions.text import split_labels
from segmentry.operators.order import exact_quantiles, unpivot
from segmentry.session import cut_lineage, stage_path

# A vocabulary of at most this many bytes travels with the encoder to every task; a larger one stays a table that rows are joined with.
VOCABULARY_BYTES = 32 << 20
# A word that holds more than this part of all indicators is joined by broadcast; there are fewer of them than its inverse.
HOT_PART = 1e-3


def dictionary(df: DataFrame, blocks: Mapping[str, Column]) -> DataFrame:
    """``feature_id, block, item``: sorted distinct items of array columns, numbered block by block."""
    return counted_dictionary(df, blocks).select("feature_id", "block", "item")


def counted_dictionary(df: DataFrame, blocks: Mapping[str, Column]) -> DataFrame:
    """The dictionary with ``n``, the rows that hold an item; a written table.

    Items are counted inside the tasks first. The dictionary is dealt into ranges, every range is numbered by itself
    and moved by the sizes of the ranges before it, so no task sorts or holds all of it.
    """
    arrays = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("block"), c.alias("items")) for i, (name, c) in enumerate(blocks.items())]
    rows = df.select(F.inline(F.array(*arrays))).select("place", "block", F.explode("items").alias("item"))
    counts = cut_lineage(rows.groupBy("place", "block", "item").agg(F.count(F.lit(1)).alias("n")))
    # The range of a row is written down, as a second evaluation could draw other borders.
    ranged = cut_lineage(counts.repartitionByRange("place", "item").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    # One row per range: the window orders the list of ranges.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("place", "item")) - 1
    numbered = ranged.withColumn("within", place).join(F.broadcast(starts), "part")
    return cut_lineage(numbered.select((F.col("start") + F.col("within")).cast("bigint").alias("feature_id"), "block", "item", "n"))


def _indicators(df: DataFrame, key: str, blocks: Mapping[str, Column]) -> DataFrame:
    arrays = [F.struct(F.lit(name).alias("block"), c.alias("items")) for name, c in blocks.items()]
    return df.select(key, F.inline(F.array(*arrays))).select(key, "block", F.explode("items").alias("item"))


def encode_long(df: DataFrame, key: str, blocks: Mapping[str, Column], words: DataFrame) -> DataFrame:
    """Indicator rows ``<key>, feature_id, value`` (1.0); items absent from the dictionary vanish."""
    return _indicators(df, key, blocks).join(words, ["block", "item"]).select(key, "feature_id", F.lit(1.0).alias("value"))


def _joined_ids(df: DataFrame, key: str, blocks: Mapping[str, Column], words: DataFrame) -> DataFrame:
    """``<key>, feature_id`` by a counted dictionary of any size: frequent words by broadcast, so that none of them makes one hot task."""
    total = words.agg(F.sum("n").alias("total")).first()["total"] or 0
    hot = words.filter(F.col("n") > F.lit(total * HOT_PART)).select("block", "item", F.col("feature_id").alias("__hot"))
    marked = _indicators(df, key, blocks).join(F.broadcast(hot), ["block", "item"], "left")
    known = marked.filter(F.col("__hot").isNotNull()).select(key, F.col("__hot").alias("feature_id"))
    rest = words.filter(F.col("n") <= F.lit(total * HOT_PART)).select("block", "item", "feature_id")
    return known.unionByName(marked.filter(F.col("__hot").isNull()).drop("__hot").join(rest, ["block", "item"]).select(key, "feature_id"))


def block_inventory(words: DataFrame) -> DataFrame:
    return words.groupBy("block").agg(F.count(F.lit(1)).alias("features"))


def scaler(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """``column, centre, scale`` of a standard (population sd), robust (median, IQR) or minmax scaler.

    A scale of 0 becomes 1.
    """
    long = unpivot(df, columns, cast="double")
    if kind == "robust":
        found = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"])
        q = F.col("quantiles")
        facts = found.select("column", q[1].alias("centre"), (q[2] - q[0]).alias("scale"))
    elif kind == "standard":
        facts = long.groupBy("column").agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("scale"))
    elif kind == "minmax":
        facts = long.groupBy("column").agg(F.min("value").alias("centre"), (F.max("value") - F.min("value")).alias("scale"))
    else:
        raise ValueError(f"Unknown scaler: {kind}")
    return facts.withColumn("scale", F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")))


def apply_scaler(df: DataFrame, columns: Sequence[str], facts: DataFrame) -> DataFrame:
    """Scale the columns in place; the parameters ride along as one broadcast row."""
    wide = facts.withColumn("__all", F.lit(0)).groupBy("__all").agg(
        *[F.max(F.when(F.col("column") == c, F.struct("centre", "scale"))).alias(f"__p_{c}") for c in columns])
    joined = df.withColumn("__all", F.lit(0)).join(F.broadcast(wide), "__all").drop("__all")
    scaled = {c: (F.col(c).cast("double") - F.col(f"__p_{c}.centre")) / F.col(f"__p_{c}.scale") for c in columns}
    return joined.withColumns(scaled).drop(*[f"__p_{c}" for c in columns])


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _labels_sql(column: str) -> str:
    parts = rf"transform(split(coalesce({_quoted(column)}, ''), ';'), x -> regexp_replace(x, '^\\s+|\\s+$', ''))"
    return f"array_sort(array_distinct(filter({parts}, x -> x <> '')))"


@dataclass
class TableEncoder:
    """Encoder whose dictionary is a table: rows meet their words by a join, and only the numbers' scales are a model.

    The vectors are those of the pipeline that ``fit_encoder`` gives for a small vocabulary. ``key`` must be
    unique; a null key or number is an error.
    """

    words: DataFrame
    scales: dict[str, tuple[float, float]]
    nominal: list[str]
    labels: list[str]
    key: str
    width: int
    output: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the vectors; written and read again under the vector type, so that no row passes through Python."""
        ids = _joined_ids(df, self.key, _blocks(self.nominal, self.labels), self.words)
        shift = len(self.scales)
        sets = ids.groupBy(self.key).agg(F.array_sort(F.collect_list((F.col("feature_id") + shift).cast("int"))).alias("__ids"))
        wanted = F.raise_error(F.lit(f"null in {', '.join([self.key, *self.scales])}"))
        scaled = [F.coalesce((F.col(_quoted(c)).cast("double") - centre) / scale, wanted.cast("double")) for c, (centre, scale) in self.scales.items()]
        numbers = F.array(*scaled).cast("array<double>")
        places = F.sequence(F.lit(0), F.lit(shift - 1)) if shift else F.array().cast("array<int>")
        held = F.coalesce("__ids", F.array().cast("array<int>"))
        vector = F.struct(
            F.when(F.col(_quoted(self.key)).isNull(), wanted.cast("tinyint")).otherwise(F.lit(0).cast("tinyint")).alias("type"), F.lit(self.width).alias("size"), F.concat(places, held).alias("indices"),
            F.concat(numbers, F.transform(held, lambda _: F.lit(1.0))).alias("values"))
        made = df.join(sets, self.key, "left").withColumn(self.output, vector).select(*[F.col(_quoted(c)) for c in df.columns], self.output)
        path = stage_path(df.sparkSession, "encoded")
        made.write.parquet(path)
        return df.sparkSession.read.schema(StructType([*df.schema.fields, StructField(self.output, VectorUDT())])).parquet(path)

    def save(self, path: str) -> None:
        """Dictionary and parameters as two tables."""
        facts = {k: v for k, v in vars(self).items() if k != "words"}
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        self.words.sparkSession.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").json(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TableEncoder:
        facts = json.loads(spark.read.schema("facts string").json(f"{path}/facts").first()["facts"])
        facts["scales"] = {c: tuple(p) for c, p in facts["scales"].items()}
        return cls(spark.read.parquet(f"{path}/words"), **facts)


def _blocks(nominal: Sequence[str], labels: Sequence[str]) -> dict[str, Column]:
    return {c: F.array_compact(F.array(F.col(_quoted(c)).cast("string"))) for c in nominal} | {c: split_labels(F.col(_quoted(c))) for c in labels}


def fit_encoder(
    df: DataFrame, numeric: Sequence[str] = (), nominal: Sequence[str] = (), labels: Sequence[str] = (), kind: str = "robust", output: str = "features",
    key: str | None = None, vocabulary_bytes: int = VOCABULARY_BYTES,
) -> tuple[PipelineModel | TableEncoder, DataFrame]:
    """Fitted encoder and its feature dictionary ``feature_id, block, item``.

    Up to ``vocabulary_bytes`` of words the encoder is an ordinary pipeline: scaled numbers, then one indicator per nominal category,
    then one per label. It is row-local (no shuffle at transform), ignores unknown items, and can be saved and loaded like any
    pipeline. Beyond that it is a ``TableEncoder`` with the same vectors, which joins rows by ``key``.
    """
    if any("__" in c and c.startswith("__") for c in (*numeric, *nominal, *labels)):
        raise ValueError("column names must not start with two underscores")
    facts = {r["column"]: (r["centre"], r["scale"]) for r in scaler(df, numeric, kind).collect()} if numeric else {}
    blocks = _blocks(nominal, labels)
    numbers = df.sparkSession.createDataFrame([(i, "numeric", c) for i, c in enumerate(numeric)], "feature_id bigint, block string, item string")
    words, size = None, None
    if blocks:
        words = counted_dictionary(df, blocks)
        size = words.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum(F.octet_length("item") + 64), F.lit(0)).alias("bytes")).first()
        numbers = numbers.unionByName(words.select((F.col("feature_id") + len(numeric)).alias("feature_id"), "block", "item"))
    if size and size["bytes"] > vocabulary_bytes:
        if key is None:
            raise ValueError(f"a vocabulary of {size['words']} words needs the name of the key column")
        width = len(numeric) + size["words"]
        return TableEncoder(words, {c: facts[c] for c in numeric}, list(nominal), list(labels), key, width, output), numbers
    # Literals keep the exact doubles (17 digits) inside the saved statement. Helper columns are numbered, as names may hold any character.
    scaled = [f"(CAST({_quoted(c)} AS DOUBLE) - {facts[c][0]!r}D) / {facts[c][1]!r}D AS __n_{i}" for i, c in enumerate(numeric)]
    arrays = [f"array_compact(array(CAST({_quoted(c)} AS STRING))) AS __i_{i}" for i, c in enumerate(nominal)]
    arrays += [f"{_labels_sql(c)} AS __i_{i}" for i, c in enumerate(labels, len(nominal))]
    stages = [SQLTransformer(statement="SELECT *, " + ", ".join(scaled + arrays) + " FROM __THIS__")]
    vocabulary: dict[str, list[str]] = {}
    for row in words.orderBy("feature_id").collect() if blocks else []:
        vocabulary.setdefault(row["block"], []).append(row["item"])
    filled = [(i, c) for i, c in enumerate(blocks) if c in vocabulary]
    for i, c in filled:
        stages.append(CountVectorizerModel.from_vocabulary(vocabulary[c], inputCol=f"__i_{i}", outputCol=f"__v_{i}").setBinary(True))
    order = [f"__n_{i}" for i in range(len(numeric))] + [f"__v_{i}" for i, _ in filled]
    stages.append(VectorAssembler(inputCols=order, outputCol=output))
    drop = ", ".join(order + [f"__i_{i}" for i in range(len(blocks))])
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({drop}) FROM __THIS__"))
    return PipelineModel(stages), numbers
