"""Documents from files: typed elements in order, their full text and their sections, and ingestion."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridspark.functions.text import basename, extension, is_blank
from hybridspark.operators.chunking import chunk
from hybridspark.operators.spans import located

#: A parser takes a file's bytes and gives (type, text, page) in order.
Parser = Callable[[bytes], list[tuple[str, str, int | None]]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SCHEMA = "doc_id long, seq int, type string, text string, page_number int, filename string"


def parse_text(data: bytes) -> list[tuple[str, str, int | None]]:
    """The whole file as one element."""
    text = data.decode("utf-8", errors="replace")
    return [("Text", text, None)] if text.strip() else []


def parse_docx(data: bytes) -> list[tuple[str, str, int | None]]:
    """A paragraph an element, blank ones dropped; heading styles give titles."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out: list[tuple[str, str, int | None]] = []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if text.strip():
            out.append(("Title" if style is not None and style.get(f"{_W}val", "").startswith("Heading") else "Text", text, None))
    return out


def parse_pdf(data: bytes) -> list[tuple[str, str, int | None]]:
    """A page an element, counted from 1, blank ones dropped but counted. Needs the optional pypdf."""
    import pypdf

    pages = (p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
    return [("Text", text, i) for i, text in enumerate(pages, 1) if text.strip()]


PARSERS: dict[str, Parser] = {".txt": parse_text, ".docx": parse_docx, ".doc": parse_docx, ".pdf": parse_pdf}


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Elements (doc_id, seq, type, text, page_number, filename) of files (doc_id, path, content), by extension.

    Files of other kinds, empty ones and those that can't be read have no elements."""
    known = {**PARSERS, **(parsers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, kind, name, content in b[["doc_id", "kind", "name", "content"]].itertuples(index=False):
                try:
                    found = known[kind](bytes(content)) if content is not None else []
                except Exception:
                    found = []
                rows += [(doc_id, i, t, text, page, name) for i, (t, text, page) in enumerate(found)]
            out = pd.DataFrame(rows, columns=["doc_id", "seq", "type", "text", "page_number", "filename"])
            out["page_number"] = out["page_number"].astype("Int32")
            yield out

    kind = extension(F.col("path"))
    rows = files.select("doc_id", kind.alias("kind"), basename(F.col("path")).alias("name"), "content").where(F.col("kind").isin(list(known)))
    return rows.mapInPandas(run, _SCHEMA)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(doc_id, path, content) of the files below a folder; ids come from the paths, so they stay the same.

    Spark skips files without a byte, so they have no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def with_sections(elements: DataFrame, key: str = "doc_id", seq: str = "seq", default: str = "Introduction") -> DataFrame:
    """elements with the title that they stand under and the number of its run; a title belongs to its own section."""
    title = F.col("type").isin("Title", "Header") & (F.coalesce("text", F.lit("")) != "")
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumns({"section": F.coalesce(F.last(F.when(title, F.col("text")), ignorenulls=True).over(w), F.lit(default)), "run": F.sum(title.cast("int")).over(w)})


def _body(seq: str, sep: str) -> Column:
    parts = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct(seq, "text"))))
    return F.array_join(F.transform(parts, lambda p: p["text"]), sep)


def full_text(elements: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(key, text): the texts of a document's elements, blank lines between them."""
    return elements.groupBy(key).agg(_body(seq, "\n\n").alias("text"))


def sections(elements: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(key, section, body): a section's texts by line. Of sections with one title the last one counts."""
    runs = with_sections(elements, key, seq).groupBy(key, "section", "run").agg(_body(seq, "\n").alias("body")).where("body <> ''")
    return runs.groupBy(key, "section").agg(F.max_by("body", "run").alias("body"))


def structured(elements: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(key, source_file, text, begins, pages, titles): a row for each document with a text in it.

    text is that of full_text(); begins says where in it each element stands, pages and titles what page and section that
    is. One window per document does both sections and places."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.coalesce("text", F.lit("")) != "", F.length("text") + 2).otherwise(0)
    rows = with_sections(elements, key, seq).withColumn("begin", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("int"))
    part = F.when(F.coalesce("text", F.lit("")) != "", F.struct(seq, "text", "begin", "page_number", "section"))
    docs = rows.groupBy(key).agg(F.max("filename").alias("source_file"), F.array_sort(F.collect_list(part)).alias("parts")).where(F.size("parts") > 0)
    of = lambda name: F.transform("parts", lambda p: p[name])
    return docs.select(key, "source_file", F.array_join(of("text"), "\n\n").alias("text"), of("begin").alias("begins"), of("page_number").alias("pages"), of("section").alias("titles"))


@dataclass(frozen=True)
class Ingested:
    elements: DataFrame
    chunks: DataFrame
    stats: DataFrame


def ingest(files: DataFrame, parsers: dict[str, Parser] | None = None, doc_type: str = "general", mode: str = "semantic", **how: object) -> Ingested:
    """Elements, chunks and, for each file, its status and number of chunks; files without elements are empty."""
    elements = parse(files, parsers)
    chunks = chunk_elements(elements, doc_type, mode, **how)
    return Ingested(elements, chunks, _stats(files, chunks))


def chunk_elements(elements: DataFrame, doc_type: str = "general", mode: str = "semantic", **how: object) -> DataFrame:
    """Chunks of the documents that elements make up, each with its file, its place in the whole text (begin, end), and
    the page and section in which it begins. Blank documents have none."""
    found = located(structured(elements), "begins", {"page_number": "pages", "section_title": "titles"}, mode=mode, **how)
    return found.select(F.col("doc_id").alias("document_id"), "chunk_index", "text", "source_file", "section_title", "page_number", F.lit(doc_type).alias("doc_type"), "begin", "end")


def ingest_text(texts: DataFrame, doc_type: str = "general", mode: str = "semantic") -> DataFrame:
    """Chunks of (doc_id, text)."""
    return chunk(texts, mode).select(F.col("doc_id").alias("document_id"), "chunk_index", "text", F.lit(doc_type).alias("doc_type"))


def _stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("chunks"))
    rows = files.select("doc_id").join(n, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.when(F.col("chunks").isNull(), "empty").otherwise("success").alias("status"))


#: Kinds of documents whose entities go into the graph.
GRAPH_KINDS = ("proposal", "reference", "cv")


def extraction_prompts(texts: DataFrame, doc_type: str, size: int = 4000) -> DataFrame:
    """(doc_id, prompt): the start of each text, for a model that names projects and people as JSON; only for GRAPH_KINDS."""
    asked = F.concat(F.lit("Name the projects and team members in this document as one JSON object.\n\n"), F.left("text", F.lit(size)))
    return texts.where(F.lit(doc_type in GRAPH_KINDS) & ~is_blank(F.col("text"))).select("doc_id", asked.alias("prompt"))


