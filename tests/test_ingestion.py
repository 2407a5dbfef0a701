import json

from pyspark.sql import functions as F

from hybridspark.operators.dense import hashed_embedding
from hybridspark.operators.engine import remove_documents
from hybridspark.operators.ingestion import ingest_into
from hybridspark.operators.sparse import bm25_search
from hybridspark.sources.files import chunk_elements
from hybridspark.sources.store import Collections, shared_folder

FILES = "doc_id long, path string, content binary"


def test_files_to_both_indexes_and_the_graph(spark):
    collections = Collections(spark, shared_folder(spark), "t_")
    asked = []

    def model(prompt):
        """Names one project and two people for each document; counts whom it was asked about."""
        asked.append(1)
        said = F.concat(F.lit('Sure: {"projects": [{"id": "p'), F.length(prompt).cast("string"), F.lit('", "name": "P", "client": "C"}], "team_members": [{"name": "Ann"}, {"name": "Bob"}]}'))
        return F.when(prompt.contains("project"), said).otherwise("nothing")

    first = spark.createDataFrame([(1, "x/a.txt", b"Our project alpha. It was large."), (2, "b.txt", b"Only beta here, a project."), (5, "e.txt", b"Filler."), (6, "f.txt", b"More filler."), (3, "c.txt", b"  "), (4, "d.bin", b"x")], FILES)
    done = ingest_into(collections, "docs", first, "cv", "fixed", model=model)
    assert sorted(map(tuple, done.stats.collect())) == [(1, "success", 1, 3), (2, "success", 1, 3), (3, "empty", 0, 0), (4, "empty", 0, 0), (5, "success", 1, 3), (6, "success", 1, 3)]
    assert sorted((r.document_id, r.source_file, r.section_title, r.begin, r.end) for r in done.points.where("document_id < 5").collect()) == [(1, "a.txt", "Introduction", 0, 32), (2, "b.txt", "Introduction", 0, 26)]
    assert done.graph.projects.count() >= 2 and {r.name for r in done.graph.members.collect()} == {"Ann", "Bob"}
    again = spark.createDataFrame([(2, "b.txt", b"Nothing but gamma.")], FILES)
    more = ingest_into(collections, "docs", again, "cv", "fixed", model=model, graph=done.graph)
    assert {r.text for r in more.points.where("document_id < 5").collect()} == {"Our project alpha. It was large.", "Nothing but gamma."}
    hits = lambda q: [r.document_id for r in bm25_search(more.index, more.points, spark.createDataFrame([(1, q)], "query_id int, query string"), key="point_id").collect()]
    assert hits("beta") == [] and hits("gamma") == [2] and hits("alpha") == [1]
    assert more.graph.projects.count() >= 2 and len(asked) == 2
    points, index = remove_documents(collections, "docs", spark.createDataFrame([(1,)], "document_id long"))
    assert sorted(r.document_id for r in points.collect()) == [2, 5, 6] and index.stats.first()["n"] == 3


def test_a_failing_embedder_leaves_both_indexes(spark):
    collections = Collections(spark, shared_folder(spark))
    files = lambda text: spark.createDataFrame([(1, "a.txt", text)], FILES)
    ingest_into(collections, "docs", files(b"Old words."), mode="fixed")

    @F.udf("array<float>")
    def broken(text):
        raise RuntimeError("no model")

    try:
        ingest_into(collections, "docs", files(b"New words."), mode="fixed", embed=broken)
        raise AssertionError("it should have failed")
    except Exception as e:
        assert "no model" in str(e)
    assert [r.text for r in collections.read("docs").collect()] == ["Old words."]
    assert ingest_into(collections, "docs", files(b""), mode="fixed", embed=hashed_embedding).points.count() == 1


def test_chunks_know_their_page_and_section(spark):
    rows = [(1, 0, "Text", "Before any title.", 1), (1, 1, "Title", "Scope", 1), (1, 2, "Text", "  One two three. Four five six!  ", 2), (1, 3, "Text", None, 2), (1, 4, "Header", "Price", 3), (1, 5, "Text", "Seven eight nine.", 3), (2, 0, "Text", "", 1)]
    elements = spark.createDataFrame([(*r, "f.pdf") for r in rows], "doc_id long, seq int, type string, text string, page_number int, filename string")
    text = "\n\n".join(r[3] for r in rows[:6] if r[3])
    places = {text.index(r[3]): (r[4], {0: "Introduction", 1: "Scope", 2: "Scope", 4: "Price", 5: "Price"}[r[1]]) for r in rows[:6] if r[3]}
    got = chunk_elements(elements, "cv", "fixed", max_size=20, overlap=0 or 1).orderBy("chunk_index").collect()
    assert len(got) > 3 and json.dumps([r.chunk_index for r in got]) == json.dumps(list(range(len(got))))
    for r in got:
        assert text[r.begin : r.end].split() == r.text.split()
        assert (r.page_number, r.section_title) == places[max(b for b in places if b <= r.begin)]
        assert (r.document_id, r.source_file, r.doc_type) == (1, "f.pdf", "cv")
