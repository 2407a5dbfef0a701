import random

import pytest

from hybridspark.operators.segments import SegmentedIndex
from hybridspark.operators.sparse import bm25_search, build_bm25
from hybridspark.sources.snapshots import Snapshots
from hybridspark.sources.store import shared_folder

KIND = "document_id long, point_id string, text string"


def prose(rng):
    return " ".join(f"w{int(rng.expovariate(0.08))}" for _ in range(rng.randrange(0, 30)))


def agree(spark, index, live):
    """Scores, weights and statistics are those of an index built of the live rows."""
    df = spark.createDataFrame([(d, k, t) for k, (d, t) in live.items()], KIND)
    fresh, now = build_bm25(df, "point_id"), index.index()
    rounded = lambda v: {r.token: (r.df, round(r.idf, 9)) for r in v.collect()}
    assert rounded(now.vocabulary) == rounded(fresh.vocabulary)
    (a,), (b,) = now.stats.collect(), fresh.stats.collect()
    assert a.n == b.n and abs(a.avgdl - b.avgdl) < 1e-9
    queries = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(4))) for i in range(6)], "query_id int, query string")
    want = bm25_search(fresh, df, queries, 10, key="point_id", digits=9).select("query_id", "rank", "point_id", "score").collect()
    got = index.search(queries, None, 10, digits=9).select("query_id", "rank", "point_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_appends_and_removals_agree_with_a_rebuild(spark):
    rng = random.Random(6)
    index = SegmentedIndex(Snapshots(spark, shared_folder(spark)), buckets=4, slots=8)
    live = {f"{d}:{i}": (d, prose(rng)) for d in range(12) for i in range(3)} | {"a": (None, "w1 w2"), "b": (None, None)}
    df = lambda rows: spark.createDataFrame([(d, k, t) for k, (d, t) in rows.items()], KIND)
    index.add(df(live))
    agree(spark, index, {k: (d, t or "") for k, (d, t) in live.items()})
    # a document comes again with other and fewer rows, another is new, and a row of no document is replaced
    more = {"3:0": (3, "w1 w1 w9 changed"), "90:0": (90, prose(rng) + " w3"), "a": (None, "w5 w5")}
    index.add(df(more))
    live = {k: v for k, v in live.items() if v[0] != 3} | more
    index.remove(spark.createDataFrame([(d,) for d in (0, 5, None, 777)], "document_id long"))
    live = {k: (d, t or "") for k, (d, t) in live.items() if d not in (0, 5)}
    agree(spark, index, live)
    assert len(index.log.manifest()[1]["keywords"]["segments"]) == 2
    index.compact()
    state = index.log.manifest()[1]["keywords"]
    assert (len(state["segments"]), state["dead"]) == (1, [])
    agree(spark, index, live)
    assert index.compact() == index.log.versions()[0]


def test_batches_are_taken_once_and_only_changed_buckets_are_read(spark, monkeypatch):
    index = SegmentedIndex(Snapshots(spark, shared_folder(spark)), buckets=32, slots=4)
    rows = spark.createDataFrame([(d, f"{d}:0", f"common word{d}") for d in range(100)], KIND)
    assert index.add(rows, batch=0) == index.add(rows, batch=0) == 1
    read = []
    docs = index._docs
    monkeypatch.setattr(index, "_docs", lambda s, g, buckets=None: (read.append((g["path"], buckets)), docs(s, g, buckets))[1])
    old = index.log.manifest()[1]["keywords"]["segments"][0]["path"]
    index.add(rows.limit(0).unionByName(spark.createDataFrame([(7, "7:0", "common other")], KIND)), batch=1)
    assert [len(b) for p, b in read if p == old] == [1]
    assert index.index().stats.first()["n"] == 100


def test_empty_indexes(spark):
    index = SegmentedIndex(Snapshots(spark, shared_folder(spark)))
    queries = spark.createDataFrame([(1, "anything")], "query_id int, query string")
    assert index.search(queries).count() == 0 and index.compact() == 0
    index.remove(spark.createDataFrame([(1,)], "document_id long"))
    index.add(spark.createDataFrame([], KIND))
    assert index.search(queries).count() == 0
    index.add(spark.createDataFrame([(1, "1:0", "anything goes"), (2, "2:0", "nothing")], KIND))
    assert index.search(queries).count() in (0, 1)
    index.remove(spark.createDataFrame([(1,), (2,)], "document_id long"))
    assert index.search(queries).count() == 0 and index.index().stats.first()["n"] == 0
    with pytest.raises(ValueError):
        index.search(queries, filters={"lang": "en"})


def test_a_words_documents_lie_in_few_rows_and_only_removed_lists_are_moved(spark, monkeypatch):
    """Removed numbers are broadcast a few at a time, or lists are moved if a bucket has many; scores are those of a rebuild."""
    from hybridspark.operators import segments

    rng = random.Random(8)
    live = {f"{d}:{i}": (d, f"common {prose(rng)}") for d in range(60) for i in range(3)}
    df = lambda rows: spark.createDataFrame([(d, k, t) for k, (d, t) in rows.items()], KIND)
    for at_once, buckets in ((7, 8), (1, 2)):
        monkeypatch.setattr(segments, "AT_ONCE", at_once)
        index = SegmentedIndex(Snapshots(spark, shared_folder(spark)), buckets=buckets, slots=4)
        # of rows with one key the greatest text stays
        index.add(df(live).unionByName(spark.createDataFrame([(0, "0:0", "a lesser text")], KIND)))
        path = index.log.manifest()[1]["keywords"]["segments"][0]["path"]
        common = spark.read.parquet(f"{path}/postings").where("token = 'common'")
        assert common.count() <= buckets and common.selectExpr("sum(size(nos))").first()[0] == 180
        index.remove(spark.createDataFrame([(d,) for d in range(1, 12)], "document_id long"))
        agree(spark, index, {k: v for k, v in live.items() if not 1 <= v[0] < 12})


def test_an_index_of_another_form_is_refused(spark):
    log = Snapshots(spark, shared_folder(spark))
    log.update(lambda m: {"keywords": {"segments": []}})
    with pytest.raises(ValueError):
        SegmentedIndex(log).index()
