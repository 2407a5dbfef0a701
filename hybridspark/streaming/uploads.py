"""Uploads as they land: each content under its key once, kept as objects, and handed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from hybridspark.functions.text import object_key
from hybridspark.sources.snapshots import Manifest, Snapshots
from hybridspark.sources.store import stored

_FILES = "path string, modificationTime timestamp, length long, content binary"
_OBJECTS = "key string, tender_id long, digest string, batch long, content binary"


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as they come below a folder that has one for each tender, named by its id."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(path)


class Uploads:
    """Landed objects in the manifest of log."""

    def __init__(self, log: Snapshots) -> None:
        self.log = log

    def _all(self, m: Manifest) -> DataFrame:
        paths = m.get("objects", [])
        reader = self.log.spark.read.schema(_OBJECTS)
        return reader.parquet(*paths) if paths else self.log.spark.createDataFrame([], _OBJECTS)

    def ledger(self, m: Manifest | None = None) -> DataFrame:
        """(key, digest) of each object's last content; contents are not read."""
        rows = self._all(self.log.manifest()[1] if m is None else m)
        return rows.groupBy("key").agg(F.max_by("digest", "batch").alias("digest"))

    def objects(self) -> DataFrame:
        """(key, tender_id, digest, batch, content): each object as it landed last."""
        return self._all(self.log.manifest()[1]).join(self.ledger(), ["key", "digest"], "left_semi").dropDuplicates(["key"])

    def land(self, batch: DataFrame, batch_id: int, ingest: Callable[[DataFrame], object] | None = None) -> int:
        """Takes the files of one micro-batch and hands those with a new content on, as (doc_id, path, content).

        A file whose content is what its key has already is passed over, and so is a batch that was taken before. Of two
        files with one key the one modified last counts. Files outside of a tender's folder are left out. What is handed
        on is taken again if the batch fails before its end, so ingest must replace by doc_id, as ingest_into() does."""

        def taken(m: Manifest) -> Manifest:
            if batch_id <= m.get("batch", -1):
                return m
            tender = F.regexp_extract("path", r"/(\d+)/[^/]+$", 1)
            rows = batch.where(tender != "").select(object_key(tender, F.col("path")).alias("key"), tender.cast("long").alias("tender_id"), F.sha2("content", 256).alias("digest"), "content", "modificationTime", "path")
            last = rows.groupBy("key").agg(F.max_by(F.struct("tender_id", "digest", "content"), F.struct("modificationTime", "path")).alias("r")).select("key", "r.*")
            path = self.log.new_part()
            new = last.join(self.ledger(m), ["key", "digest"], "left_anti").withColumn("batch", F.lit(batch_id).cast("long"))
            fresh = stored(new.select("key", "tender_id", "digest", "batch", "content"), path)
            if fresh.isEmpty():
                return {**m, "batch": batch_id}
            if ingest is not None:
                ingest(fresh.select(F.xxhash64("key").alias("doc_id"), F.col("key").alias("path"), "content"))
            return {**m, "batch": batch_id, "objects": [*m.get("objects", []), path]}

        return self.log.update(taken)


def start_landing(stream: DataFrame, uploads: Uploads, checkpoint: str, ingest: Callable[[DataFrame], object] | None = None) -> StreamingQuery:
    """Takes what there is, then stops; start it again for what has come since."""
    return stream.writeStream.foreachBatch(lambda df, i: uploads.land(df, i, ingest) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
