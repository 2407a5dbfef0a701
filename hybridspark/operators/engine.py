"""The hybrid search pipeline over a batch of queries, and the prompts built from its contexts."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridspark.functions.text import assessment, fill, requirements, rich_text
from hybridspark.operators import fusion
from hybridspark.operators.dense import dense_search, index_points
from hybridspark.operators.graph import Graph, graph_search
from hybridspark.operators.segments import SegmentedIndex
from hybridspark.operators.sparse import Bm25Index, bm25_search
from hybridspark.sources.snapshots import Manifest, Points
from hybridspark.sources.store import Collections, stored

#: Results of the dense, sparse and graph retrievers, and of the whole.
TOP = {"dense": 20, "sparse": 20, "graph": 10, "final": 5}

#: What a prompt says in each mode; the names in braces are columns of the query or its context.
TEMPLATES = {
    "general_qa": "Answer from the context alone. Say so if it does not hold the answer.\n\nContext:\n{context}\n\nQuestion:\n{query}\n",
    "proposal_section": "Write the section of a tender proposal named below, from the context alone, and meet each requirement.\n\nContext:\n{context}\n\nSection: {section_title}\nInstructions: {instructions}\nRequirements:\n{requirements}\n",
    "executive_summary": "Summarise this tender proposal for decision makers.\n\nSections:\n{sections}\n\nContext:\n{context}\n\nRequirements:\n{requirements}\n",
    "requirement_analyzer": 'List the requirements of this document as a JSON array of objects like {{"text": "", "category": "", "priority": ""}}.\n\nDocument:\n{document_text}\n',
    "compliance_checker": 'Does the section meet the requirement? Answer as a JSON object like {{"status": "", "explanation": "", "gaps": [], "suggestions": []}}.\n\nRequirement:\n{requirement}\n\nSection:\n{section_content}\n\nContext:\n{context}\n',
}
MODES = {"search": "general_qa", "qa": "general_qa", "write_section": "proposal_section", "exec_summary": "executive_summary", "analyze_reqs": "requirement_analyzer", "compliance": "compliance_checker"}


def render_prompts(queries: DataFrame, contexts: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """(query_id, template, prompt) of queries (query_id, query, mode and what their templates name) and contexts.

    An unknown mode asks a general question. Missing columns and nulls are empty; instructions and document_text fall
    back on the query."""
    rows = queries.join(contexts.select("query_id", "context"), "query_id", "left")
    col = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    given = lambda name: F.when(col(name) != "", col(name)).otherwise(F.col("query"))
    values = {
        **{n: col(n) for n in ("context", "query", "section_title", "requirements", "sections", "section_content")},
        "instructions": given("instructions"),
        "document_text": given("document_text"),
        "requirement": col("requirements"),
    }
    template = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv)), F.col("mode")), F.lit("general_qa"))
    prompt = F.lit(None).cast("string")
    for name, text in {**TEMPLATES, **(templates or {})}.items():
        prompt = F.when(F.col("template") == name, fill(text, **values)).otherwise(prompt)
    return rows.withColumn("template", template).select("query_id", "template", prompt.alias("prompt"))


@dataclass(frozen=True)
class Corpus:
    """chunks (key, text, columns of metadata), their vectors and index, and a graph; each of the last three may be absent."""

    chunks: DataFrame
    key: str = "doc_id"
    points: DataFrame | None = None
    index: Bm25Index | None = None
    graph: Graph | None = None
    metadata: tuple[str, ...] = ()


class HybridEngine:
    """Dense, sparse and graph retrieval, fused, re-ranked and put together; lazy, for a batch of queries."""

    def __init__(self, corpus: Corpus, scorer: Callable[[Column, Column], Column] = fusion.lexical_score, weights: Mapping[str, float] | None = None, k: int = fusion.K, digits: int | None = None, isolate: bool = False) -> None:
        """isolate: each retriever and the scorer run on their own, and one that fails is logged and left out."""
        self.corpus, self.scorer, self.weights, self.k, self.digits, self.isolate = corpus, scorer, dict(weights or {}), k, digits, isolate

    def _part(self, name: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        if not self.isolate:
            return make()
        try:
            return stored(make())
        except Exception as e:  # whatever a model or a broken index raises, when planned or when run
            logging.getLogger(__name__).warning("%s left out: %s", name, str(e).splitlines()[0] if str(e) else type(e).__name__)
            return None

    def _metadata(self) -> Column:
        names = self.corpus.metadata
        if not names:
            return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names))
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    def retrieve(self, queries: DataFrame, top_k: int | None = None, filters: Mapping[str, object] | None = None) -> DataFrame:
        """The ranked lists of the retrievers that the corpus has. top_k (0: not given) overrides all their limits.

        queries: query_id, query, and vector for the dense one. Filters leave the graph alone."""
        c, lists = self.corpus, []
        limit = lambda kind: top_k or TOP[kind]
        if c.points is not None:
            lists.append(self._part("dense", lambda: fusion.ranked_list(dense_search(c.points, queries.select("query_id", "vector"), limit("dense"), filters, c.key, digits=self.digits), "dense", self._metadata())))
        if c.index is not None:
            lists.append(self._part("sparse", lambda: fusion.ranked_list(bm25_search(c.index, c.chunks, queries, limit("sparse"), filters, c.key, digits=self.digits), "sparse", self._metadata())))
        if c.graph is not None:
            of = F.create_map(F.lit("source"), F.lit("knowledge_graph"), F.lit("entity_id"), F.coalesce(F.col("entity_id").cast("string"), F.lit("")))
            lists.append(self._part("graph", lambda: fusion.ranked_list(graph_search(c.graph, queries, limit("graph")), "graph", of)))
        if not lists:
            raise ValueError("the corpus has nothing to search")
        lists = [x for x in lists if x is not None]
        if not lists:
            return queries.sparkSession.createDataFrame([], "query_id long, retriever string, rank int, text string, metadata map<string,string>")
        out = lists[0]
        for x in lists[1:]:
            out = out.unionByName(x)
        return out

    def search(self, queries: DataFrame, top_k: int | None = None, filters: Mapping[str, object] | None = None, rerank: bool = True) -> DataFrame:
        """(query_id, rank, text, score, metadata, sources, ...): at most 20 results a query, whatever top_k says."""
        # a query has a bounded number of hits: dealt by query once, their texts are not moved again to be fused and ranked
        hits = self.retrieve(queries, top_k, filters).repartition("query_id")
        fused = fusion.rrf(hits, self.weights, self.k, digits=self.digits)
        if rerank:
            found = self._part("scorer", lambda: fusion.rerank(fused, queries, self.scorer, top_k or TOP["final"]))
            if found is not None:
                return found
            fused = fused.withColumn("original_score", F.col("score"))
        return fused.where(F.col("rank") <= (top_k or TOP["final"]))

    def answer(self, queries: DataFrame, model: Callable[[Column], Column], top_k: int | None = None, filters: Mapping[str, object] | None = None) -> DataFrame:
        """(query_id, template, prompt, answer): model maps prompts to answers, for instance a pandas UDF that calls one."""
        contexts = fusion.context(self.search(queries, top_k, filters))
        return render_prompts(queries, contexts).withColumn("answer", model(F.col("prompt")))


def compliance(queries: DataFrame, contexts: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """(query_id, status, explanation, gaps, suggestions) of queries with a requirement and a section: prompt, model, parsed answer."""
    asked = render_prompts(queries.withColumn("mode", F.lit("compliance")), contexts)
    return asked.withColumn("a", assessment(model(F.col("prompt")))).select("query_id", "a.*")


def requirement_rows(queries: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """(query_id, text, category, priority): the requirements that a model finds in each query's document_text."""
    none = queries.select("query_id", F.lit("").alias("context"))
    asked = render_prompts(queries.withColumn("mode", F.lit("analyze_reqs")), none)
    return asked.select("query_id", F.explode(requirements(model(F.col("prompt")))).alias("r")).select("query_id", "r.*")


def section_text(queries: DataFrame, contexts: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """(query_id, text, content): each section that a model writes, plain and as rich text."""
    asked = render_prompts(queries.withColumn("mode", F.lit("write_section")), contexts).withColumn("text", model(F.col("prompt")))
    return asked.select("query_id", "text", rich_text(F.col("text")).alias("content"))


def index_chunks(collections: Collections, name: str, chunks: DataFrame, vector: Column, document: str = "document_id", chunk_index: str = "chunk_index") -> tuple[DataFrame, Bm25Index]:
    """Stores chunks with their vectors in place of all earlier ones of their documents, and indexes their words; returns
    the collection's points and keyword index.

    Both are one change of the collection: a reader never sees the one without the other, and a failure leaves both as
    they were. Vectors are worked out once; what other documents have is neither embedded nor tokenised again."""
    log = collections.log(name)
    points, words = Points(log, document), SegmentedIndex(log, "point_id", document)
    rows = index_points(chunks, vector, document, chunk_index)

    def change(m: Manifest) -> Manifest:
        part = points.written(m, rows)
        return words.changed(points.placed(m, part), points.rows(part), dealt=True)

    log.update(change)
    return points.read(), words.index()


def remove_documents(collections: Collections, name: str, documents: DataFrame, document: str = "document_id") -> tuple[DataFrame, Bm25Index]:
    """Takes the chunks of documents (document) out of both indexes; chunks that name no document stay."""
    log = collections.log(name)
    points, words = Points(log, document), SegmentedIndex(log, "point_id", document)
    log.update(lambda m: words.changed(points.without(m, documents), None, documents) if "points" in m else m)
    return points.read(), words.index()


def echo(prompt: Column) -> Column:
    """The offline model: names the prompt by its digest."""
    return F.concat(F.lit("prompt "), F.substring(F.sha2(prompt, 256), 1, 16))


def health(corpus: Corpus) -> DataFrame:
    """One row: which components there are, and the number of chunks."""
    has = [F.lit(x is not None).alias(n) for n, x in (("dense", corpus.points), ("sparse", corpus.index), ("graph", corpus.graph))]
    return corpus.chunks.agg(F.count("*").alias("chunks")).select("chunks", *has)
