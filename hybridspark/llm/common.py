"""What several operators share: words, row keys, folders that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words: the six ASCII white space characters. Python's bytes.split() uses the same six.
SPACE = r"[\x20\x09-\x0D]+"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text; an empty array for a text without any, or null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    """As many as words() has, without keeping them."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, SPACE))
    return (parts - F.when(t.rlike(rf"\A{SPACE}"), 1).otherwise(0) - F.when(t.rlike(rf"{SPACE}\z"), 1).otherwise(0) - F.when(t == "", 1).otherwise(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"


def running(values: Column) -> Column:
    """For each value of an array the sum of those before it. Folded in blocks, as a fold copies what it has built."""
    block = 256
    zero = lambda of: F.aggregate(of, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))

    def of(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.flatten(F.zip_with(parts, zero(sums), lambda p, base: F.transform(zero(p), lambda x: x + base)))

    return F.when(F.size(values) > 0, let(blocks, of)).otherwise(F.array().cast("array<long>"))


def rank_in(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds (longs or strings) are less than value, by halving a literal array."""
    if not bounds:
        return F.lit(0)
    table = F.array(*map(F.lit, bounds))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when(F.get(table, acc + s - 1) < value, acc + s).otherwise(acc))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may leave that unset: a temporary one takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_dir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once to the shared folder and read again, so a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 0, among those that share the values of by (not null), in this order.

    Rows are dealt into ranges by by and order and written in that order, so no task sorts more than a range; a place is
    the number of a group's rows in the ranges before and that within the range. Only counts meet in a window: a row for
    each range and group in it."""
    every = [*(F.col(c) for c in by), *order]
    dealt = cut(rows.repartitionByRange(*every).sortWithinPartitions(*every).withColumn("__at", F.monotonically_increasing_id()))
    # the upper bits of such an id are the partition's number, the lower ones count its rows
    dealt = dealt.withColumn("__range", F.shiftright("__at", 33))
    sizes = dealt.groupBy("__range", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__range", *by, (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__base"))
    # without groups there is one row a range
    found = dealt.join(sizes if by else F.broadcast(sizes), ["__range", *by])
    return found.withColumn(name, F.col("__at") + F.col("__base")).drop("__at", "__range", "__base")
