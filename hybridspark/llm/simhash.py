"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits each variant within half the radius; two fingerprints within the radius share a
variant. A variant's bucket holds at most as many distinct fingerprints as its ball has members, so buckets are
bounded whatever the data: copies and hot texts collapse to one fingerprint before the shuffle. Within a bucket all
members are linked to its smallest one, which keeps every connection with a number of rows linear in the bucket.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let, read
from .minhash import likeness
from .shingles import distinct, prints

#: A-Z to a-z, all other bytes as they are.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at a time, which bounds memory for very long texts.
_BLOCK = 65536
#: Fingerprints whose balls a task makes, and rows of balls that a task takes.
_FPS, _ROWS = 16384, 1 << 19
#: Keys that are broadcast to choose rows; the rows of more are shuffled.
_SENT = 1_000_000


def simhash(text: str | None, k: int = 3) -> int:
    """The 64-bit fingerprint of a text's k-word shingles, as a signed integer; 0 for a text without words.

    A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); repeats count."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    last = min(k, len(w)) - 1
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[starts[i] : ends[i + last] - 1], 42) for i in range(at, min(n, at + _BLOCK))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3, text: str = "text") -> DataFrame:
    """docs with a column fingerprint (long) in place of the text. Null and empty texts get 0."""
    keep = [c for c in docs.columns if c not in (text, "fingerprint")]
    udf = F.pandas_udf(lambda s: pd.Series([simhash(t, k) for t in s], dtype="int64"), "long")
    return docs.select(*(F.col(f"`{c}`") for c in keep), udf(F.col(text)).alias("fingerprint"))


def ball(fp: Column, radius: int, width: int = 64) -> Column:
    """All values of width bits within radius bits of fp, fp included."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.expr(f"array({','.join(f'{m}L' if m != -(1 << 63) else '(-9223372036854775807L - 1L)' for m in signed)})"), lambda m: fp.bitwiseXOR(m))


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) with a < b: links between distinct fingerprints that connect all that differ in radius bits or fewer.

    prints: column fingerprint, in any number of copies. The radius must be even and 4 at most: a ball of half the
    radius is emitted for each distinct fingerprint (65 rows for radius 2)."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    fps = cut(prints.select("fingerprint").distinct())
    n = fps.count()
    # as many tasks as their balls need: the fingerprints alone look small
    fps = fps.repartition(max(1, n // _FPS), "fingerprint")
    spread = fps.select("fingerprint", F.explode(ball(F.col("fingerprint"), radius // 2)).alias("variant"))
    # each bucket holds as many members as a ball at most, and a task so many rows
    dealt = spread.repartition(max(1, -(-n * _size(radius // 2) // _ROWS)), "variant")
    return dealt.mapInArrow(lambda batches: _stars(batches, radius), "a long, b long").distinct()


def _size(radius: int, width: int = 64) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def _stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of a task's rows (fingerprint, variant): each bucket's least fingerprint with those within the radius."""
    table = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    fps, variants = (np.concatenate([np.zeros(0, dtype=np.int64), *(t[i] for t in table)]) for i in range(2))
    order = np.lexsort((fps, variants))
    fps, variants = fps[order], variants[order]
    first = np.ones(len(fps), dtype=bool)
    first[1:] = variants[1:] != variants[:-1]
    least = fps[np.maximum.accumulate(np.where(first, np.arange(len(fps)), 0))]
    linked = (least < fps) & (np.bitwise_count((least ^ fps).view(np.uint64)) <= radius)
    yield pa.RecordBatch.from_arrays([pa.array(least[linked]), pa.array(fps[linked])], names=["a", "b"])


#: A key is made of so many groups of four bins of a MinHash sketch; keys of a text.
GROUPS, KEYS = 3, 48
#: Heads that a bucket draws, the most central first, before what is left is compared whole.
DRAWS = 1
#: Members of a bucket that meet all others in the first round after that; twice as many in each further one, up to MOST.
HEADS, MOST = 32, 1000
#: Pairs of one text that a task compares.
_SHARE = 512
#: How far below the limit the likeness of two sketches may be, over four standard errors, before shingles are compared.
_SLACK = 0.12


def bands(bins: Column) -> Column:
    """The keys of a MinHash sketch: KEYS draws, fixed once for all, of GROUPS groups of four bins.

    A group agrees with a chance of (J + (1 - J) / 16) ** 4 at a similarity J, whatever the size of the corpus: pairs at
    0.8 have a key in common in 0.94 of all cases, at 0.85 in over 0.99, at 0.5 in 0.03; unlike ones with a chance of
    48 / 2 ** 48."""
    rng = random.Random(5)
    drawn = [rng.sample(range(64), GROUPS) for _ in range(KEYS)]
    groups = let(bins, lambda s: F.array(*(F.shiftrightunsigned(F.get(s, F.lit(i // 4)), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)) for i in range(64))))
    return let(groups, lambda g: F.array(*(F.xxhash64(F.lit(j), *(F.get(g, F.lit(i)) for i in d)) for j, d in enumerate(drawn))))


def shared(rows: DataFrame) -> DataFrame:
    """The distinct rows (key, id) whose key has several ids; of keys with the very same ids, which copies share, one stays.

    Sets of ids are told apart by their count, ends and two hashes of 64 bits. All of it are partial aggregates: neither
    single keys nor a hot one are gathered."""
    hashes = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    sets = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n"), *hashes).where("a < z")
    return only(rows, sets.groupBy("a", "z", "n", "x1", "x2").agg(F.min("key").alias("key")).select("key"), "key")


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among these, which are distinct: up to a million are broadcast, so that only what stays is shuffled."""
    keys = cut(keys.select(key))
    return rows.join(F.broadcast(keys) if keys.count() <= _SENT else keys, key, "left_semi")


def decide(members: DataFrame, likely: Callable[[Column, Column], Column], alike: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root), as components(), of all pairs within a bucket of members (key, id, s and, where known, degree, keys) that pass.

    A pair passes if likely(s, s) holds of it, which the join of a bucket's members tests, and if alike, which takes
    pairs (a, b), returns it. First each bucket draws the member of the highest degree, the number of buckets that it
    is in, at random among equals: edited copies leave most buckets of their original, so that it is in more of them
    than they are. It meets the others, which brings nearly all that are connected together with one pair a member.
    Then, as long as a bucket holds several components, members outside its largest one meet all members of other
    components, a bounded number at a time, and are done. Where keys, all buckets of a member, are known, a pair that
    has several in common meets in the least of them alone. So each pair of a bucket either was tried or lies within
    one component, whatever the degrees. A bucket is never gathered: its members stay rows, and what is picked from it
    is cut before the shuffle."""
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    roots: DataFrame | None = None
    degree = F.col("degree") if "degree" in members.columns else F.lit(0).alias("degree")
    of = ["id", "s", *(c for c in ("keys",) if c in members.columns)]
    left, heads, nth = members.select("key", *of, degree), HEADS, 0
    while True:
        if roots is not None:
            placed = left.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
            parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
            open_ = parts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", "top")
            left = cut(placed.join(open_, "key"))
            if left.isEmpty():
                return roots
        once = F.lit(True)
        if nth < DRAWS:
            some = left.groupBy("key").agg(F.max(F.struct("degree", F.xxhash64("key", "id", F.lit(nth)), "id", "s")).alias("h")).select("key", F.col("h.id").alias("head"), F.col("h.s").alias("hs"))
            some = some.withColumn("own", F.lit(None).cast("long")) if roots is None else some.join(roots.withColumnRenamed("node", "head"), "head", "left").select("key", "head", "hs", F.coalesce("root", "head").alias("own"))
        else:
            order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), "root", "id"))
            some = left.where("root <> top").select("key", *(F.col(c).alias(f"h_{c}") for c in of), F.col("root").alias("own"), order.alias("nth")).where(F.col("nth") <= heads).drop("nth")
            some = some.withColumnsRenamed({"h_id": "head", "h_s": "hs"})
            once = F.array_min(F.array_intersect("h_keys", "keys")) == F.col("m.key") if "keys" in of else once
            heads = min(MOST, 2 * heads)
        some, nth = cut(some), nth + 1
        apart = F.col("head") != F.col("id") if roots is None else F.col("own") != F.col("root")
        pairs = some.alias("h").join(left.alias("m"), (F.col("h.key") == F.col("m.key")) & apart & likely(F.col("hs"), F.col("s")) & once).select(*pair("head", "id")).distinct()
        passed = cut(alike(pairs))
        if roots is None:
            roots = cut(components(passed))
        elif not passed.isEmpty():
            # each node that has a root stands for its component by one edge
            roots = cut(components(passed.unionByName(roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))))
        left = left.join(some.select("key", F.col("head").alias("id")), ["key", "id"], "left_anti").select("key", *of, "degree")


def _shares(pairs: DataFrame, by: str) -> DataFrame:
    """(by, parts): over how many tasks the pairs of the text in column by are dealt."""
    return pairs.groupBy(by).agg(F.ceil(F.count("*") / _SHARE).cast("int").alias("parts"))


def _values(shares: DataFrame, by: str, values: DataFrame, name: str) -> DataFrame:
    """(by, part_by, name): the value (id, s) of each text in shares, once for each task that takes some of its pairs."""
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{by}")
    return values.withColumnRenamed("id", by).join(shares, by).select(by, F.col("s").alias(name), part)


def bring(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b), which must be cut, with the values (id, s) of both texts as x and y.

    Shares are counted and dealt while pairs are narrow, so that each value is joined to them once."""
    shares = {by: _shares(pairs, by) for by in ("a", "b")}
    for by, share in shares.items():
        pairs = pairs.join(share, by).withColumn(f"part_{by}", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int")).drop("parts")
    for (by, share), name in zip(shares.items(), "xy", strict=True):
        pairs = pairs.join(_values(share, by, values, name), [by, f"part_{by}"])
    return pairs.select("a", "b", "x", "y")


def near_texts(docs: DataFrame, k: int = 5, similar: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(md5, first, root): each distinct text of docs, the first row that has it and its group of near copies.

    first is a struct (last, key, md5) that orders by key, nulls last. Texts are near copies if they share that much of
    their distinct k-word shingles, without regard to case; groups are what such links connect. Null counts as empty,
    and texts without words are alike. Texts are named by 64 bits of their MD5.

    Candidates are the texts of one component of SimHash fingerprints (balls of radius 2) and those that share a key
    of MinHash bins: at a similarity of 0.8 fingerprints of 64 bits differ in ten bits, which no ball reaches. Each pair of
    candidates is verified by its shingles or lies within one group already."""
    md5 = F.md5(F.coalesce(text, F.lit(""))).alias("md5")
    number = F.conv(F.substring("md5", 1, 16), 16, -10).cast("long").alias("id")
    rank = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), "md5")
    rows = docs.select(key, md5, prints(F.col(text), k).alias("p"))
    texts = rows.groupBy("md5").agg(F.min(rank).alias("first"), F.first("p").alias("p"))
    texts = cut(texts.select(number, "md5", "first", "p.fingerprint", "p.sketch", "p.few"))
    groups = components(links(texts)).select(F.col("node").alias("fingerprint"), F.col("root").alias("group"))
    balls = texts.select("id", "fingerprint").join(groups, "fingerprint", "left").select(F.coalesce("group", "fingerprint").alias("key"), "id")
    banded = texts.select(F.explode(F.when(F.col("few").isNull(), bands(F.col("sketch"))).otherwise(F.array("few"))).alias("key"), "id")
    met = cut(shared(banded.unionByName(balls)))
    degrees = met.groupBy("id").agg(F.count("*").alias("degree"), F.collect_list("key").alias("keys")).join(texts.select("id", F.col("sketch").alias("s")), "id")
    members = cut(met.join(degrees, "id"))
    wanted = only(docs.select(md5, F.col(text).alias("text")).select(number, "text"), met.select("id").distinct(), "id")
    shingles = cut(wanted.dropDuplicates(["id"]).select("id", distinct(F.col("text"), k).alias("s")))

    def alike(pairs: DataFrame) -> DataFrame:
        both = bring(cut(pairs), shingles)
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common >= similar * (F.size("x") + F.size("y") - common)).select("a", "b")

    roots = decide(members, lambda x, y: likeness(x, y) >= similar - _SLACK, alike)
    return texts.select("id", "md5", "first").join(roots.withColumnRenamed("node", "id"), "id", "left").select("md5", "first", F.coalesce("root", "id").alias("root"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): each node of edges (a, b) with the smallest node that it is connected to.

    Alternates large-star and small-star steps; each is a shuffle on nodes. Stars of hot nodes are reduced to minima
    by partial aggregation, and the state of each round is written to the shared folder."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the text, with fingerprint (long) and component_id: the smallest key that can be reached.

    One row comes back for each row of docs, repeated rows and rows with a null key included; a null key counts only
    where its component has no other. Columns named like the new ones are replaced; others come through."""
    docs = docs.drop("fingerprint", "component_id")
    f = cut(fingerprints(docs, k, text))
    least = f.groupBy("fingerprint").agg(F.min(key).alias("first_key"))
    roots = components(links(f, radius))
    named = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    first = named.groupBy("root").agg(F.min("first_key").alias("component_id"))
    named = cut(named.join(first, "root").select("fingerprint", "component_id"))
    return f.join(named, "fingerprint")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")
