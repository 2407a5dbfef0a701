import os

from hybridspark.operators.ingestion import ingest_into
from hybridspark.sources.snapshots import Snapshots
from hybridspark.sources.store import Collections, shared_folder
from hybridspark.streaming.uploads import Uploads, read_uploads, start_landing


def test_a_file_is_ingested_once(spark, tmp_path):
    folder, check = tmp_path / "in", str(tmp_path / "check")
    uploads, collections, seen = Uploads(Snapshots(spark, shared_folder(spark))), Collections(spark, shared_folder(spark)), []

    def ingest(files):
        seen.append(sorted(r.path for r in files.select("path").collect()))
        ingest_into(collections, "docs", files, "tender", "fixed")

    def put(name, text):
        path = folder / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_text(text)

    def land():
        start_landing(read_uploads(spark, str(folder)), uploads, check, ingest).awaitTermination()
        return sorted(r.text for r in collections.read("docs").collect())

    put("7/a.txt", "First text.")
    put("8/a.txt", "First text.")
    put("loose.txt", "No tender.")
    assert land() == ["First text.", "First text."]
    assert seen == [["tenders/7/a.txt", "tenders/8/a.txt"]]
    put("again/7/a.txt", "First text.")  # the same content under the same key
    assert land() == ["First text.", "First text."] and len(seen) == 1
    put("more/7/a.txt", "Second text.")
    put("more/9/b.txt", "Third text.")
    assert land() == ["First text.", "Second text.", "Third text."]
    assert seen[1:] == [["tenders/7/a.txt", "tenders/9/b.txt"]]
    assert sorted((r.key, r.tender_id, bytes(r.content)) for r in uploads.objects().collect()) == [("tenders/7/a.txt", 7, b"Second text."), ("tenders/8/a.txt", 8, b"First text."), ("tenders/9/b.txt", 9, b"Third text.")]
    # a batch that is run again changes nothing
    before = uploads.log.versions()
    batch = uploads.objects().selectExpr("concat('x/', tender_id, '/new.txt') AS path", "timestamp'2024-01-01' AS modificationTime", "content")
    uploads.land(batch, 0, ingest)
    assert uploads.log.versions() == before and len(seen) == 2
