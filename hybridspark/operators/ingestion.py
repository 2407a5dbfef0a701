"""Ingestion as a whole: files to located chunks, both indexes of a collection, and the graph of what they name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridspark.functions.text import json_span
from hybridspark.operators.dense import hashed_embedding
from hybridspark.operators.engine import index_chunks
from hybridspark.operators.graph import EXTRACTED, Graph, extracted, upsert_edges, upsert_nodes
from hybridspark.operators.sparse import Bm25Index
from hybridspark.sources.files import Parser, chunk_elements, extraction_prompts, full_text, parse
from hybridspark.sources.store import Collections, stored


@dataclass(frozen=True)
class Ingestion:
    """stats (doc_id, status, chunks, entities), the collection's points and keyword index, and the graph, null without a model."""

    stats: DataFrame
    points: DataFrame
    index: Bm25Index
    graph: Graph | None


def merged(graph: Graph | None, more: Graph) -> Graph:
    """graph with more in it: of nodes with one id those of more stay, edges are told apart by ends and type."""
    if graph is None:
        return more
    both = lambda a, b: upsert_nodes(a.withColumn("__new", F.lit(0)), b.withColumn("__new", F.lit(1)), "id", "__new").drop("__new")
    return Graph(both(graph.projects, more.projects), both(graph.members, more.members), upsert_edges(graph.edges, more.edges))


def ingest_into(collections: Collections, name: str, files: DataFrame, doc_type: str = "general", mode: str = "semantic", embed: Callable[[Column], Column] = hashed_embedding, model: Callable[[Column], Column] | None = None, graph: Graph | None = None, parsers: dict[str, Parser] | None = None, **how: object) -> Ingestion:
    """Takes files (doc_id, path, content) into a collection; a file that comes again replaces what it had.

    Files are parsed once. Chunks go to the vectors and the keywords in one change. For the kinds of documents that name
    projects and people, model answers a prompt for each document, and what it says joins graph; its answers are kept, so
    each document is asked once. A file without text is empty, has no entity and leaves what it had."""
    elements = stored(parse(files, parsers))
    chunks = stored(chunk_elements(elements, doc_type, mode, **how))
    points, index = index_chunks(collections, name, chunks, embed(F.col("text")))
    counts = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("chunks"))
    entities = files.sparkSession.createDataFrame([], "doc_id long, entities long")
    if model is not None:
        prompts = extraction_prompts(full_text(elements), doc_type)
        answers = stored(prompts.select("doc_id", model(F.col("prompt")).alias("answer")))
        said = F.from_json(json_span(F.col("answer")), EXTRACTED)
        size = lambda part: F.greatest(F.coalesce(F.size(F.col("said")[part]), F.lit(0)), F.lit(0))
        entities = answers.select("doc_id", said.alias("said")).select("doc_id", (size("projects") + size("team_members")).cast("long").alias("entities"))
        graph = merged(graph, extracted(answers))
    stats = files.select("doc_id").join(counts, "doc_id", "left").join(entities, "doc_id", "left")
    status = F.when(F.col("chunks").isNull(), "empty").otherwise("success")
    return Ingestion(stats.select("doc_id", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("entities", F.lit(0)).alias("entities")), points, index, graph)
