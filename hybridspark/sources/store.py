"""Collections and indexes as tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from hybridspark.sources.snapshots import Points, Snapshots


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may leave that unset: a temporary one takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_dir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df, written once and read again, so that each use scans what was worked out."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer partitions than there are cores (one small file, say) is dealt out, larger ones
    stay as they are. For work on whole texts, which takes longer than to move them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a partition that rows are dealt to by key.
ROWS = 1_000_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: as many as the session has by default, and more where they would grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys to partitions of bounded size, so that sorts and groups by these keys hold as much of a small table
    as of a large one. Rows are counted, if their number isn't given."""
    return df.repartition(parts_for(df.sparkSession, df.count() if rows is None else rows), *keys)


class Collections:
    """Collections of points by name, in one folder; each changes by whole snapshots, see snapshots.py."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str = "") -> None:
        self.spark, self.folder, self.prefix = spark, folder.rstrip("/"), prefix

    def log(self, name: str) -> Snapshots:
        from hybridspark.sources.snapshots import Snapshots  # that module stores parts with this one

        return Snapshots(self.spark, f"{self.folder}/{self.prefix}{name}")

    def points(self, name: str, document: str = "document_id", key: str = "point_id") -> Points:
        from hybridspark.sources.snapshots import Points

        return Points(self.log(name), document, key)

    def ensure(self, name: str, schema: str) -> None:
        """An empty collection of this schema, if there is none; one that is there stays."""
        self.points(name).ensure(schema)

    def replace(self, name: str, rows: DataFrame) -> None:
        """rows in place of all points of their documents."""
        self.points(name).replace(rows)

    def delete(self, name: str, documents: DataFrame) -> None:
        self.points(name).delete(documents)

    def read(self, name: str) -> DataFrame:
        return self.points(name).read()
