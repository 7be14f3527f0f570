"""What the operators of this subpackage share: the shared folder, written tables, positions and components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset a local one, if all runs in this process (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomstead-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, and lost executors don't matter.

    Results may read the table as long as the application runs, at whose end it is deleted, if `forget` hasn't before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `save` wrote and that are no longer read; frees shuffle files of finished jobs."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the context cleaner see plans that are out of use, whose shuffle files it then deletes."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def column(df: DataFrame, name: str, kind: str) -> F.Column:
    """Column `name` cast to `kind`, or nulls where df has none; names match exactly before they match loosely."""
    exact = [c for c in df.columns if c == name]
    if len(exact) > 1:
        raise ValueError(f"{name} is ambiguous")
    return df[f"`{name}`"].cast(kind) if exact else F.lit(None).cast(kind)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the columns that an operator reads, so that other columns can't clash with its own."""
    return df.select(*[column(df, n, k).alias(n) for n, k in kinds.items()])


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int = 50_000) -> DataFrame:
    """Numbers rows from 0 without gaps within each value of keys, with no task that holds a whole group.

    Equal rows are counted first, where they are, and become rows again at the end, so that no number of them meets in one task. The others fall
    into sub-groups by a hash of `order`; each is numbered alone and shifted by the sizes of those before it. The sizes (sub-groups
    x keys rows) are all that is summed in one place per key. `order` must tell unequal rows apart. df must be read from storage or be deterministic, as it is read twice.
    """
    n = df.count()
    subs = max(1, -(-n // rows))
    df = df.groupBy(*df.columns).agg(F.count("*").alias("_copies")).withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(subs)))
    sizes = df.groupBy(*keys, "_sub").agg(F.sum("_copies").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_sub").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_rank", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    placed = ranked.join(shifts, [*keys, "_sub"]).withColumn("_first", F.col("_shift") + F.col("_rank"))
    # In two steps, so that no array is longer than the root of the number of copies.
    step = F.ceil(F.sqrt(F.col("_copies").cast("double")))
    placed = placed.withColumn("_step", step).withColumn("_high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / F.col("_step")))))
    placed = placed.withColumn("_low", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_step"), F.col("_copies") - F.col("_high") * F.col("_step")) - 1)))
    return placed.withColumn(name, (F.col("_first") + F.col("_high") * F.col("_step") + F.col("_low")).cast("long")).drop("_sub", "_rank", "_shift", "_first", "_copies", "_step", "_high", "_low")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node that each node of edges (a, b: long) reaches.

    Alternating large and small stars; each round is written, so the plan stays short. Rounds grow with the
    logarithm of the longest path. No group is held in one task: minima are aggregated and joined back.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    state = None
    while True:
        digest = now.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first()
        if tuple(digest) == state:
            break
        state = tuple(digest)
        after = save(star(star(now, True), False), name)
        forget(now)
        now = after
        release(spark)
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def total(columns: Sequence[F.Column]) -> F.Column:
    return reduce(lambda a, b: a + b, columns)
