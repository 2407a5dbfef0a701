"""A keyword index that grows by segments: an append or removal reads what changed, never the texts before.

A segment has forward lists (a document's tokens, by bucket of the document it belongs to) and postings (by slot of the
token), in which a row has a token's documents of some thousand, as their numbers in the segment. Removed rows are
tombstones of their segment: their numbers. Counts add up over segments less the tombstones', and are kept as
one vocabulary beside them: n, total length and the floor of the weights stand in the manifest. Scores are those of an
index built anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridspark.functions.text import tokens
from hybridspark.operators.sparse import EPSILON, Bm25Index, bm25_search
from hybridspark.sources.snapshots import Manifest, Snapshots

#: How segments are written.
FORM = 2
#: Numbers of removed documents that are broadcast at a time.
AT_ONCE = 1_000_000
_TERMS = "array<struct<token:string,tf:long>>"


def _raw(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _runs(lists: pa.Array) -> np.ndarray:
    """Where each list begins among the values of all, and where the last ends."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])


def _coded(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    found = tokens.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., dl, terms) of (.., tokens): each distinct token of a row and how often it is there."""
    for b in batches:
        lists = b.column("tokens")
        starts = _runs(lists)
        kinds, code = _coded(lists.flatten())
        row = np.repeat(np.arange(len(lists)), np.diff(starts))
        pairs, tf = np.unique(row * max(1, len(kinds)) + code, return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(lists) + 1) * max(1, len(kinds))).astype(np.int32)
        each = pa.StructArray.from_arrays([kinds.take(pa.array(pairs % max(1, len(kinds)))), pa.array(tf.astype(np.int64))], ["token", "tf"])
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("document"), b.column("bucket"), pa.array(np.diff(starts).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), each)], ["doc", "document", "bucket", "dl", "terms"])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, nos, tfs) of (no, terms), a row for each distinct token of a batch."""
    for b in batches:
        lists = b.column("terms")
        starts, flat = _runs(lists), lists.flatten()
        kinds, code = _coded(pc.struct_field(flat, "token"))
        order = np.argsort(code, kind="stable")
        ends = pa.array(np.searchsorted(code[order], np.arange(len(kinds) + 1)).astype(np.int32))
        no = np.repeat(b.column("no").to_numpy(zero_copy_only=False), np.diff(starts))[order]
        tf = pc.struct_field(flat, "tf").to_numpy(zero_copy_only=False)[order]
        yield pa.RecordBatch.from_arrays([kinds, pa.ListArray.from_arrays(ends, pa.array(no)), pa.ListArray.from_arrays(ends, pa.array(tf))], ["token", "nos", "tfs"])


class SegmentedIndex:
    """The index in the manifest of log, beside whatever else that has."""

    def __init__(self, log: Snapshots, key: str = "point_id", document: str = "document_id", buckets: int = 64, slots: int = 64, epsilon: float = EPSILON) -> None:
        self.log, self.key, self.document, self.buckets, self.slots, self.epsilon = log, key, document, buckets, slots, epsilon

    def _state(self, m: Manifest) -> Manifest:
        if (s := m.get("keywords")) and s.get("form") != FORM:
            raise ValueError("the index is of an earlier version of this library: it must be built anew")
        return s or {"form": FORM, "segments": [], "dead": [], "vocabulary": None, "n": 0, "total": 0, "floor": None, "batch": -1, "buckets": self.buckets, "slots": self.slots, "key": None, "document": None}

    def _table(self, path: str, schema: str, **parts: list[int]) -> DataFrame:
        """A part; of the named partitions only those that are asked for."""
        df = self.log.spark.read.schema(schema).parquet(path)
        for name, wanted in parts.items():
            df = df.where(F.col(name).isin(wanted))
        return df

    def _docs(self, s: Manifest, segment: Manifest, buckets: list[int] | None = None) -> DataFrame:
        kind = f"doc {s['key']}, document {s['document']}, dl long, terms {_TERMS}, no long, bucket int"
        return self._table(f"{segment['path']}/docs", kind, **({} if buckets is None else {"bucket": buckets}))

    def _postings(self, s: Manifest, segment: Manifest, slots: list[int] | None = None) -> DataFrame:
        kind = "token string, nos array<long>, tfs array<long>, slot int"
        return self._table(f"{segment['path']}/postings", kind, **({} if slots is None else {"slot": slots}))

    def _dead(self, s: Manifest, path: str) -> DataFrame | None:
        """(no) of a segment's tombstones; None without any."""
        parts = [d["path"] for d in s["dead"]]
        if not parts:
            return None
        return self.log.spark.read.schema("segment string, no long").parquet(*(f"{p}/docs" for p in parts)).where(F.col("segment") == path).select("no")

    @staticmethod
    def _without(df: DataFrame, dead: DataFrame | None) -> DataFrame:
        return df if dead is None else df.join(dead, "no", "left_anti")

    def _forward(self, s: Manifest, docs: DataFrame) -> Manifest:
        """A segment's forward lists, of docs (doc, document, dl, terms, bucket), those of a bucket together."""
        segment = {"path": self.log.new_part()}
        docs.withColumn("no", F.monotonically_increasing_id()).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{segment['path']}/docs")
        return segment

    def _written(self, s: Manifest, segment: Manifest) -> Manifest:
        """A segment with its postings, from its forward lists."""
        own = self._docs(s, segment)
        each = own.select("no", "terms").mapInArrow(_inverted, "token string, nos array<long>, tfs array<long>").withColumn("slot", F.pmod(F.xxhash64("token"), F.lit(s["slots"])).cast("int"))
        each.hint("rebalance", "slot").write.option("compression", "zstd").partitionBy("slot").parquet(f"{segment['path']}/postings")
        size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        return segment | {"n": size["n"], "total": size["total"]}

    def _bucket(self, s: Manifest, document: Column, doc: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(document.cast("string"), doc.cast("string"))), F.lit(s["buckets"])).cast("int").alias("bucket")

    def _killed(self, s: Manifest, gone: DataFrame) -> tuple[Manifest | None, DataFrame | None]:
        """Tombstones of the live rows that gone (document, doc, bucket) names, and (terms) of each. Only buckets that it
        names are read, and tokens of no other rows are moved."""
        buckets = [r[0] for r in gone.select("bucket").distinct().collect()]
        if not s["segments"] or not buckets:
            return None, None
        documents, keys = gone.select("document").where("document is not null").distinct(), gone.select("doc").where("doc is not null").distinct()
        found, lists = None, {}
        for segment in s["segments"]:
            docs = lists[segment["path"]] = self._docs(s, segment, buckets)
            live = self._without(docs.select("doc", "document", "dl", "no", "bucket"), self._dead(s, segment["path"]))
            hit = live.join(documents, "document", "left_semi").unionByName(live.where("document is null").join(keys, "doc", "left_semi"))
            hit = hit.select(F.lit(segment["path"]).alias("segment"), "no", "dl", "bucket")
            found = hit if found is None else found.unionByName(hit)
        path = self.log.new_part()
        found.write.parquet(f"{path}/docs")
        found = self.log.spark.read.schema("segment string, no long, dl long, bucket int").parquet(f"{path}/docs")
        sizes = found.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()  # as many as there are segments at most
        if not sizes:
            return None, None
        terms = None
        for r in sizes:
            for part in self._terms(lists[r["segment"]], found.where(F.col("segment") == r["segment"]), buckets, r["n"]):
                terms = part if terms is None else terms.unionByName(part)
        return {"path": path, "n": sum(r["n"] for r in sizes), "total": sum(r["total"] for r in sizes)}, terms

    @staticmethod
    def _terms(docs: DataFrame, found: DataFrame, buckets: list[int], n: int) -> list[DataFrame]:
        """(terms) of those of docs that found (no, bucket) names, n in all, as parts. Numbers are broadcast, those of so
        many buckets at a time that they stay few; if even one bucket's are many, lists are moved instead."""
        times = -(-n // AT_ONCE)
        if times > len(buckets):
            return [docs.join(found.select("no"), "no", "left_semi").select("terms")]
        some = [F.col("bucket").isin(buckets[i::times]) for i in range(times)]
        return [docs.where(b).join(F.broadcast(found.where(b).select("no")), "no", "left_semi").select("terms") for b in some]

    def _listed(self, s: Manifest, rows: DataFrame, dealt: bool) -> DataFrame:
        """(doc, document, bucket, dl, terms) of rows (doc, document, text), those of a bucket together: texts, which are
        smaller than lists of tokens, are moved there, unless they lie so (dealt)."""
        rows = rows.withColumn("bucket", self._bucket(s, F.col("document"), F.col("doc")))
        rows = rows if dealt else rows.hint("rebalance", "bucket")
        kind = f"doc {s['key']}, document {s['document']}, bucket int, dl long, terms {_TERMS}"
        return rows.select("doc", "document", "bucket", tokens(F.col("text")).alias("tokens")).mapInArrow(_counted, kind)

    def changed(self, m: Manifest, add: DataFrame | None = None, remove: DataFrame | None = None, text: str = "text", batch: int | None = None, dealt: bool = False) -> Manifest:
        """m without the documents of remove (document), with the rows of add in place of their documents' rows.

        A row of add without a document takes the place of that with its key; of rows with one key the greatest text
        stays. A batch with a number is taken once, in rising order: one that was committed before changes nothing. dealt:
        rows of a document lie together in add, and needn't be moved to their buckets."""
        s = dict(self._state(m))
        if batch is not None and batch <= s["batch"]:
            return m
        if add is not None and s["key"] is None:
            s |= {"key": add.schema[self.key].dataType.simpleString(), "document": add.schema[self.document].dataType.simpleString()}
        if s["key"] is None:
            return m
        gone, new = [], None
        if add is not None:
            rows = add.select(F.col(self.key).cast(s["key"]).alias("doc"), F.col(self.document).cast(s["document"]).alias("document"), F.coalesce(text, F.lit("")).alias("text"))
            new = self._forward(s, self._listed(s, rows, dealt))
            # rows meet by key only if a key repeats
            if not self._docs(s, new).groupBy("doc").count().where("count > 1").isEmpty():
                rows = rows.groupBy("doc").agg(F.max_by("document", "text").alias("document"), F.max("text").alias("text"))
                new = self._forward(s, self._listed(s, rows, False))
            new = self._written(s, new)
            gone.append(self._docs(s, new).select("document", F.when(F.col("document").isNull(), F.col("doc")).alias("doc"), "bucket"))
        if remove is not None:
            named = remove.select(F.col(self.document).cast(s["document"]).alias("document")).where("document is not null").distinct()
            gone.append(named.select("document", F.lit(None).cast(s["key"]).alias("doc"), self._bucket(s, F.col("document"), F.lit(None))))
        dead, terms = self._killed(s, gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])) if gone else (None, None)
        counts = self.log.spark.createDataFrame([], "token string, df long") if s["vocabulary"] is None else self._table(s["vocabulary"], "token string, df long")
        if dead is not None:
            s |= {"dead": [*s["dead"], dead], "n": s["n"] - dead["n"], "total": s["total"] - dead["total"]}
            counts = counts.unionByName(terms.select(F.explode("terms.token").alias("token"), F.lit(-1).cast("long").alias("df")))
        if new is not None and new["n"]:
            s |= {"segments": [*s["segments"], new], "n": s["n"] + new["n"], "total": s["total"] + new["total"]}
            counts = counts.unionByName(self._postings(s, new).select("token", F.size("nos").cast("long").alias("df")))
        path = f"{self.log.new_part()}/vocabulary"
        counts.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0").write.parquet(path)
        floor = self._table(path, "token string, df long").agg((F.avg(_raw(s["n"])) * self.epsilon).alias("floor")).first()["floor"]
        return {**m, "keywords": s | {"vocabulary": path, "floor": floor, "batch": s["batch"] if batch is None else batch}}

    def add(self, rows: DataFrame, text: str = "text", batch: int | None = None) -> int:
        return self.log.update(lambda m: self.changed(m, rows, None, text, batch))

    def remove(self, documents: DataFrame) -> int:
        return self.log.update(lambda m: self.changed(m, None, documents))

    def compact(self) -> int:
        """One segment of all live rows and no tombstone, from forward lists: nothing is tokenised again."""

        def one(m: Manifest) -> Manifest:
            s = dict(self._state(m))
            if len(s["segments"]) < 2 and not s["dead"]:
                return m
            live = [self._without(self._docs(s, g), self._dead(s, g["path"])) for g in s["segments"]]
            docs = live[0]
            for more in live[1:]:
                docs = docs.unionByName(more)
            docs = docs.select("doc", "document", "dl", "terms", "bucket").hint("rebalance", "bucket")
            return {**m, "keywords": s | {"segments": [self._written(s, self._forward(s, docs))], "dead": []}}

        return self.log.update(one)

    def index(self, version: int | None = None, asked: DataFrame | None = None) -> Bm25Index:
        """Postings, vocabulary and statistics of a version, for bm25_search(); asked (token): only postings of these."""
        spark, s = self.log.spark, self._state(self.log.manifest(version)[1])
        postings = spark.createDataFrame([], f"doc {s['key'] or 'string'}, token string, tf long, dl long")
        slots = None if asked is None else [r[0] for r in asked.select(F.pmod(F.xxhash64("token"), F.lit(s["slots"])).cast("int")).distinct().collect()]
        for segment in s["segments"]:
            live = self._without(self._docs(s, segment).select("no", "doc", "dl"), self._dead(s, segment["path"]))
            lists = self._postings(s, segment, slots)
            lists = lists if asked is None else lists.join(asked, "token", "left_semi")
            each = lists.select("token", F.explode(F.arrays_zip("nos", "tfs")).alias("p")).select("token", F.col("p.nos").alias("no"), F.col("p.tfs").alias("tf"))
            postings = postings.unionByName(each.join(live, "no").select("doc", "token", "tf", "dl"))
        counts = spark.createDataFrame([], "token string, df long") if s["vocabulary"] is None else self._table(s["vocabulary"], "token string, df long")
        raw = _raw(s["n"])
        vocabulary = counts.select("token", "df", F.when(raw < 0, F.lit(s["floor"])).otherwise(raw).alias("idf"))
        stats = spark.range(1).select(F.lit(s["n"]).cast("long").alias("n"), F.lit(s["total"] / s["n"] if s["n"] else None).cast("double").alias("avgdl"))
        return Bm25Index(postings, vocabulary, stats)

    def search(self, queries: DataFrame, rows: DataFrame | None = None, top_k: int = 20, filters: Mapping[str, object] | None = None, query: str = "query", digits: int | None = None) -> DataFrame:
        """bm25_search() over the newest version; postings are read for the slots of the queries' tokens only."""
        asked = queries.select(F.explode(tokens(F.col(query))).alias("token")).distinct()
        return bm25_search(self.index(asked=asked), rows, queries, top_k, filters, self.key, query, digits=digits)
