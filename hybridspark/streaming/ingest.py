"""A stream of texts or files into a table of chunks and a keyword index that grows with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from hybridspark.operators.chunking import chunk
from hybridspark.operators.segments import SegmentedIndex
from hybridspark.operators.sparse import Bm25Index
from hybridspark.sources.snapshots import Snapshots

#: Segments from which on a batch joins them into one.
MOST_SEGMENTS = 16


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).parquet(path)


def _index(spark: SparkSession, folder: str) -> SegmentedIndex:
    return SegmentedIndex(Snapshots(spark, f"{folder}/index"), "chunk_key", "doc_id")


def append_chunks(batch: DataFrame, batch_id: int, folder: str, mode: str = "fixed") -> None:
    """Chunks of one micro-batch, and a segment of the index. The batch's number is a partition and is overwritten as a
    whole, and the index takes a number once, so a batch that is run again leaves nothing twice.

    Only the batch is tokenised. A document that comes again adds chunks to the table; the index keeps its last ones."""
    chunk(batch, mode).write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch_id}")
    written = batch.sparkSession.read.parquet(f"{folder}/chunks/batch={batch_id}")
    index = _index(batch.sparkSession, folder)
    index.add(_keyed(written), batch=batch_id)
    if len(index.log.manifest()[1].get("keywords", {}).get("segments", [])) >= MOST_SEGMENTS:
        index.compact()


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def start_ingest(stream: DataFrame, folder: str, checkpoint: str, mode: str = "fixed") -> StreamingQuery:
    """Takes what there is of (doc_id, text, ...) into folder, then stops; start it again for what has come since."""
    return stream.writeStream.foreachBatch(lambda df, i: append_chunks(df, i, folder, mode)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_index(spark: SparkSession, folder: str) -> tuple[DataFrame, Bm25Index]:
    """All chunks so far, with a chunk_key, and their index: nothing is tokenised again for it."""
    return _keyed(spark.read.parquet(f"{folder}/chunks").drop("batch")), _index(spark, folder).index()
