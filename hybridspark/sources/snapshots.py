"""Tables that change by whole snapshots: immutable parts in a folder, and a manifest for each version that names them.

A change writes new parts first and then one manifest, created under the next number without overwriting. Readers take
the newest manifest that is whole, so they see all of a change or nothing of it; what failed before its manifest was
written leaves parts that nobody reads. Of two writers with the same base one gets the number, the other a Conflict.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridspark.sources.store import stored

Manifest = dict


class Conflict(Exception):
    """Another writer has made the next version."""


class Snapshots:
    """The versions of one folder, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def new_part(self) -> str:
        return f"{self.folder}/parts/{uuid.uuid4().hex}"

    def has(self, path: str) -> bool:
        return self._files.exists(self._paths(path))

    def _names(self) -> list[int]:
        """The numbers of all manifests, whole or not, newest first."""
        top = self._paths(f"{self.folder}/manifests")
        if not self._files.exists(top):
            return []
        found = (s.getPath().getName() for s in self._files.listStatus(top))
        return sorted((int(n.removesuffix(".json")) for n in found if n.endswith(".json")), reverse=True)

    def _load(self, version: int) -> Manifest | None:
        """A manifest; None if it isn't whole."""
        rows = self.spark.read.text(f"{self.folder}/manifests/{version:010d}.json", wholetext=True).collect()
        body, _, digest = (rows[0]["value"] if rows else "").rpartition("\n")
        return json.loads(body) if digest == hashlib.sha256(body.encode()).hexdigest() else None

    def versions(self) -> list[int]:
        """Whole versions, newest first."""
        return [v for v in self._names() if self._load(v) is not None]

    def manifest(self, version: int | None = None) -> tuple[int, Manifest]:
        """The newest version's number and manifest, or a given one's; 0 and an empty one before the first."""
        for v in self._names():
            if version in (None, v) and (found := self._load(v)) is not None:
                return v, found
        if version is not None:
            raise ValueError(f"there is no version {version}")
        return 0, {}

    def update(self, change: Callable[[Manifest], Manifest]) -> int:
        """Makes the next version of what change gives for the newest one; none if that is the same. Its number."""
        base, now = self.manifest()
        new = change(now)
        if new == now:
            return base
        names = self._names()
        if names and self.manifest()[0] != base:
            raise Conflict(f"version {base} is not the newest any more")
        number = max([base, *names]) + 1
        body = json.dumps(new, sort_keys=True)
        try:
            out = self._files.create(self._paths(f"{self.folder}/manifests/{number:010d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {number} is being written") from e
        out.write(bytearray(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode()))
        out.close()
        return number

    def vacuum(self, keep: int = 2) -> int:
        """Deletes older manifests than the newest keep, and parts that no kept one names; how many parts. Not while others read or write."""
        versions = self.versions()
        named = "\n".join(json.dumps(self._load(v)) for v in versions[:keep])
        for v in versions[keep:]:
            self._files.delete(self._paths(f"{self.folder}/manifests/{v:010d}.json"), False)
        top, gone = self._paths(f"{self.folder}/parts"), 0
        for s in self._files.listStatus(top) if self._files.exists(top) else []:
            if s.getPath().getName() not in named:
                gone += self._files.delete(s.getPath(), True)
        return gone


#: Parts that a bucket's rows may lie in, and parts that may say what is gone; one more, and the buckets are written anew.
MOST_PARTS = 16


def _kind(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


class Points:
    """Stored points in buckets of documents. A change writes its own rows, and of earlier ones in their buckets the
    numbers of those that are gone: what stays is neither moved nor written again. Buckets that a change does not name are shared.

    document names what a point belongs to, key the point. A null document is none: such points are told apart by key."""

    def __init__(self, log: Snapshots, document: str = "document_id", key: str = "point_id", buckets: int = 64, most: int = MOST_PARTS) -> None:
        self.log, self.document, self.key, self.buckets, self.most = log, document, key, buckets, most

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(self.document).cast("string"), F.col(self.key).cast("string"))), F.lit(n)).cast("int").alias("__bucket")

    def _live(self, m: Manifest, part: str, buckets: list[str]) -> DataFrame:
        """The rows of a part in these buckets that are not gone, with __no, their number in it, and __bucket."""
        rows = self.rows({"path": part, "schema": m["parts"][part]}).where(F.col("__bucket").isin([int(b) for b in buckets]))
        gone = [f"{g['path']}/gone" for g in m["gone"] if part in g["of"]]
        if not gone:
            return rows
        return rows.join(self.log.spark.read.schema("__part string, __no long").parquet(*gone).where(F.col("__part") == part).select("__no"), "__no", "left_anti")

    def _parts(self, m: Manifest, buckets: list[str] | None = None) -> dict[str, list[str]]:
        """The buckets of each part that has some of these."""
        if "parts" not in m:
            raise ValueError("the collection is empty or of an earlier version of this library")
        found: dict[str, list[str]] = {}
        for b, parts in m["points"].items():
            for p in parts if buckets is None or b in buckets else []:
                found.setdefault(p, []).append(b)
        return found

    def _read(self, m: Manifest, buckets: list[str] | None = None) -> DataFrame:
        out = self.log.spark.createDataFrame([], m["schema"])
        for part, own in self._parts(m, buckets).items():
            out = out.unionByName(self._live(m, part, own).drop("__no", "__bucket"), allowMissingColumns=True)
        return out

    def ensured(self, m: Manifest, schema: str) -> Manifest:
        if "points" in m:
            return m
        return {**m, "schema": schema, "buckets": self.buckets, "points": {}, "parts": {}, "gone": []}

    def ensure(self, schema: str) -> int:
        """An empty collection of this schema, if there is none; one that is there stays."""
        return self.log.update(lambda m: self.ensured(m, schema))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.log.manifest(version)[1])

    def _write(self, m: Manifest, rows: DataFrame) -> Manifest:
        part = {"path": self.log.new_part(), "schema": _kind(rows)}
        # dealt by bucket; a bucket that is too large for a task is split
        dealt = rows.withColumn("__bucket", self._bucket(m.get("buckets", self.buckets))).hint("rebalance", "__bucket")
        dealt.withColumn("__no", F.monotonically_increasing_id()).write.option("compression", "zstd").partitionBy("__bucket").parquet(f"{part['path']}/rows")
        return part

    def written(self, m: Manifest, rows: DataFrame) -> Manifest:
        """A part of rows that no version names yet. Of rows with one key the one with the greatest text, or else any, stays.

        rows are worked out once, as vectors may come from a model. They meet by key only if a key repeats; to see that, keys alone are moved."""
        part = self._write(m, rows)
        stored = self.rows(part).drop("__no", "__bucket")
        if stored.groupBy(self.key).count().where("count > 1").isEmpty():
            return part
        order = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in rows.columns else F.lit(0)
        one = stored.groupBy(F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in stored.columns)), order).alias("r")).select("r.*")
        return self._write(m, one)

    def rows(self, part: Manifest) -> DataFrame:
        """All rows of a part, those of a bucket together, with __no and __bucket."""
        return self.log.spark.read.schema(f"{part['schema']}, __no long, __bucket int").parquet(f"{part['path']}/rows")

    def _changed(self, m: Manifest, gone: DataFrame, new: Manifest | None) -> Manifest:
        """gone: (document, key, __bucket) of what goes: a document's points, or without one the point of that key. new: a part of what comes."""
        touched = [str(r[0]) for r in gone.select("__bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return m
        path = new["path"] if new else self.log.new_part()
        schema = m["schema"] if new is None else _kind(self.log.spark.createDataFrame([], m["schema"]).unionByName(self.log.spark.createDataFrame([], new["schema"]), allowMissingColumns=True))
        old, left, dead = None, set(), set()
        for part, own in self._parts(m, touched).items():
            rows = self._live(m, part, own).select(F.lit(part).alias("__part"), self.document, self.key, "__no", "__bucket")
            old = rows if old is None else old.unionByName(rows)
        if old is not None:
            named = lambda c, flag: gone.select(c).where(F.col(c).isNotNull()).distinct().withColumn(flag, F.lit(True))
            marked = old.join(named(self.document, "__by_document"), self.document, "left").join(named(self.key, "__by_key"), self.key, "left")
            marked = stored(marked.select("__part", "__no", "__bucket", F.coalesce("__by_document", "__by_key", F.lit(False)).alias("__gone")))
            for r in marked.groupBy("__part", "__bucket").agg(F.max("__gone").alias("some"), F.min("__gone").alias("all")).collect():
                left |= set() if r["all"] else {(r["__part"], str(r["__bucket"]))}
                dead |= {r["__part"]} if r["some"] else set()
            if dead:
                marked.where("__gone").select("__part", "__no").write.parquet(f"{path}/gone")
        points = {b: [p for p in parts if b not in touched or (p, b) in left] + ([path] if new and b in touched else []) for b, parts in (dict.fromkeys(touched, []) | m["points"]).items()}
        points = {b: parts for b, parts in points.items() if parts}
        held = {p for parts in points.values() for p in parts}
        parts = {p: k for p, k in (m["parts"] | ({path: new["schema"]} if new else {})).items() if p in held}
        notes = [g for g in [*m["gone"], *([{"path": path, "of": sorted(dead)}] if dead else [])] if held & {*g["of"]}]
        return self._few({**m, "schema": schema, "points": points, "parts": parts, "gone": notes})

    def _few(self, m: Manifest) -> Manifest:
        """With buckets of too many parts as one part."""
        noted = {p for g in m["gone"] for p in g["of"]} if len(m["gone"]) > self.most else set()
        crowded = [b for b, parts in m["points"].items() if len(parts) > self.most or noted & {*parts}]
        if not crowded:
            return m
        new = self._write(m, self._read(m, crowded))
        points = m["points"] | {b: [new["path"]] for b in crowded}
        held = {p for parts in points.values() for p in parts}
        return {**m, "points": points, "parts": {p: k for p, k in (m["parts"] | {new["path"]: new["schema"]}).items() if p in held}, "gone": [g for g in m["gone"] if held & {*g["of"]}]}

    def placed(self, m: Manifest, part: Manifest) -> Manifest:
        """With the rows of a part in place of all points of their documents."""
        m = self.ensured(m, part["schema"])
        return self._changed(m, self.rows(part).select(self.document, self.key, "__bucket"), part)

    def replaced(self, m: Manifest, rows: DataFrame) -> Manifest:
        """With rows in place of all points of their documents. Of rows with one key the one with the greatest text, or else any, stays."""
        return self.placed(m, self.written(m, rows))

    def replace(self, rows: DataFrame) -> int:
        """Stores rows in place of all points of their documents; the new version's number."""
        return self.log.update(lambda m: self.replaced(m, rows))

    def without(self, m: Manifest, documents: DataFrame) -> Manifest:
        kind = next((f.dataType.simpleString() for f in self._read(m).schema if f.name == self.key), "string")
        gone = documents.select(self.document).where(F.col(self.document).isNotNull()).distinct().withColumn(self.key, F.lit(None).cast(kind))
        return self._changed(m, gone.withColumn("__bucket", self._bucket(m["buckets"])), None)

    def delete(self, documents: DataFrame) -> int:
        """Without the points of these documents; points that name none stay."""
        return self.log.update(lambda m: self.without(m, documents) if "points" in m else m)
