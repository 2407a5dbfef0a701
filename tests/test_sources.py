import io
import zipfile

from hybridspark.operators.sparse import bm25_search
from hybridspark.sources import files as S
from hybridspark.sources.schemas import CHUNKS, DEFAULT_SECTIONS
from hybridspark.streaming.ingest import ingested_index, read_stream, start_ingest


def docx(paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>' for style, text in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files_to_chunks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("First sentence here. Second sentence there.")
    (tmp_path / "b.DOCX").write_bytes(docx([("Heading1", "Scope"), (None, "Body one."), (None, "  "), ("Heading2", "Price"), (None, "Body two."), ("Heading1", "Scope"), (None, "Again.")]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "c.xyz").write_text("unknown kind")
    (tmp_path / "d.txt").write_text("")
    files = S.read_files(spark, str(tmp_path))
    done = S.ingest(files, mode="fixed")
    names = {r.doc_id: r.path.rsplit("/", 1)[1] for r in files.select("doc_id", "path").collect()}
    assert {names[r.doc_id]: (r.status, r.chunks) for r in done.stats.collect()} == {"a.txt": ("success", 1), "b.DOCX": ("success", 1), "bad.docx": ("empty", 0), "c.xyz": ("empty", 0)}
    elements = done.elements.where("filename = 'b.DOCX'")
    assert [(r.type, r.text) for r in elements.orderBy("seq").collect()] == [("Title", "Scope"), ("Text", "Body one."), ("Title", "Price"), ("Text", "Body two."), ("Title", "Scope"), ("Text", "Again.")]
    assert {r.section: r.body for r in S.sections(elements).collect()} == {"Scope": "Scope\nAgain.", "Price": "Price\nBody two."}
    assert S.full_text(elements).first().text == "Scope\n\nBody one.\n\nPrice\n\nBody two.\n\nScope\n\nAgain."
    assert S.extraction_prompts(S.full_text(elements), "tender").count() == 0 and S.extraction_prompts(S.full_text(elements), "cv").count() == 1
    assert spark.createDataFrame([], CHUNKS).columns[0] == "document_id" and len(DEFAULT_SECTIONS) == 8


def test_elements_before_a_title_are_an_introduction(spark):
    rows = [(1, 0, "Text", "a"), (1, 1, "Title", ""), (1, 2, "Header", "H"), (1, 3, "Text", None)]
    got = S.with_sections(spark.createDataFrame(rows, "doc_id int, seq int, type string, text string")).orderBy("seq").collect()
    assert [r.section for r in got] == ["Introduction", "Introduction", "H", "H"]


def test_stream_takes_each_row_once(spark, tmp_path):
    source, folder, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i, text in enumerate(["the needle OMEGA-X99", "straw and hay", "more straw"]):
        spark.createDataFrame([(i, text)], "doc_id long, text string").write.mode("append").parquet(source)
        start_ingest(read_stream(spark, source, "doc_id long, text string"), folder, check).awaitTermination()
    chunks, index = ingested_index(spark, folder)
    assert chunks.count() == 3
    queries = spark.createDataFrame([(1, "omega-x99")], "query_id int, query string")
    assert [r.chunk_key for r in bm25_search(index, chunks, queries, key="chunk_key").collect()] == ["0:0"]
