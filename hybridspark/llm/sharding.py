"""Sharding by minimax contiguous partition.

Groups of equal texts are atoms, in the order of their texts' hashes. The smallest feasible shard capacity is searched
on a bounded summary of the running sums of group sizes: cells of equal width, each with its least and greatest sum.
A greedy check over the summary brackets the capacity; only cells that a cut may fall into are then split further, and
the search repeated, until capacity and cuts are exact. A cut is a hash, so rows find their shard without a join.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, rank_in, read

#: Cells of the first summary, and parts that a cell is split into.
CELLS, SPLIT = 1 << 15, 32
#: Cells that a round of splitting may bring to the driver.
BUDGET = 1 << 18


def ends(groups: DataFrame, digits: int = 3) -> DataFrame:
    """(hash, end) of groups (hash, size): end is the sum of sizes up to and with this hash, in hash order.

    Two steps: sums over leading digits of the hashes (16 ** digits rows), then within them."""
    head = F.left("hash", F.lit(digits)).alias("head")
    tops = groups.groupBy(head).agg(F.sum("size").alias("size"))
    tops = tops.select("head", F.coalesce(F.sum("size").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.sum("size").over(Window.partitionBy("head").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0))
    return groups.select("hash", "size", head).select("head", "hash", within.alias("end")).join(tops, "head").select("hash", (F.col("base") + F.col("end")).alias("end"))


class Summary:
    """What is known of the running sums: disjoint cells (least, greatest) in order."""

    def __init__(self, cells: list[tuple[int, int]]) -> None:
        self.cells = sorted(cells)
        self.low = [a for a, _ in self.cells]

    def reach(self, x: int, surely: bool) -> int:
        """The greatest sum up to x: a lower bound, or an upper one."""
        i = bisect_right(self.low, x) - 1
        if i < 0:
            return 0
        a, b = self.cells[i]
        return b if b <= x else a if surely else x

    def path(self, capacity: int, shards: int, surely: bool) -> list[int]:
        """Where the shards end if each is filled as far as it goes."""
        at, out = 0, []
        for _ in range(shards):
            out.append(at := self.reach(at + capacity, surely))
        return out

    def capacity(self, shards: int, total: int, surely: bool) -> int:
        """The smallest one with which the last shard ends at total, by binary search."""
        low, high = -(-total // shards), total
        while low < high:
            mid = (low + high) // 2
            if self.path(mid, shards, surely)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low

    def open(self, shards: int, low: int, high: int) -> list[tuple[int, int]]:
        """Cells of more than one sum that a cut may fall into with a capacity from low to high."""
        near, far = [0, *self.path(low, shards, True)], [0, *self.path(high, shards, False)]
        found = set()
        for a, b in zip(near[:-1], far[:-1], strict=True):
            i = max(0, bisect_right(self.low, a + low) - 1)
            while i < len(self.cells) and self.cells[i][0] <= b + high:
                if self.cells[i][0] < self.cells[i][1] and self.cells[i][1] > a + low:
                    found.add(i)
                i += 1
        return [self.cells[i] for i in sorted(found)]

    def even(self, shards: int, total: int, capacity: int) -> list[int]:
        """Ends of shards that keep to the capacity, near to even shares of what is left; only at sums that are known."""
        known = sorted({x for c in self.cells for x in c})
        least = [total]
        for _ in range(shards - 1):
            least.append(known[bisect_left(known, least[-1] - capacity)])
        least.reverse()
        at, out = 0, []
        for k in range(shards - 1):
            most = bisect_right(known, at + capacity) - 1
            want = at + (total - at) // (shards - k)
            i = bisect_left(known, want)
            i = i - 1 if i and (i == len(known) or known[i] - want > want - known[i - 1]) else i
            first = bisect_left(known, least[k])
            at = max(at, known[min(max(i, first), most)]) if most >= 0 else at
            out.append(at)
        return [*out, total]


def cells(sums: DataFrame, width: int, within: tuple[int, list[int]] | None = None) -> list[tuple[int, int]]:
    """The cells of that width, all or those inside some wider cells: their width and numbers."""
    if within is not None:
        wide, numbers = within
        some = sums.sparkSession.createDataFrame([(x,) for x in numbers], "cell long")  # BUDGET at most
        sums = sums.withColumn("cell", F.expr(f"end div {wide}L")).join(F.broadcast(some), "cell", "left_semi")
    found = sums.groupBy(F.expr(f"end div {width}L")).agg(F.min("end").alias("a"), F.max("end").alias("b"))
    return [(r["a"], r["b"]) for r in found.select("a", "b").collect()]


def minimax_cuts(sums: DataFrame, shards: int, budget: int = BUDGET) -> tuple[int, list[int]]:
    """The smallest capacity, and where the shards end (as sums); sums: column end.

    Where a cut may fall is uncertain by as many cells as there are shards before it, so up to about half the square of
    shards cells have to be split. Where that would bring more than budget cells to the driver (with the default from
    some 700 shards on), splitting ends and the capacity is above the smallest one by less than a cell's width, which
    is the total over a quarter of budget at most. Widths are powers of two, so that narrow cells lie within wide ones."""
    total = sums.agg(F.max("end")).first()[0] or 0
    if not total:
        return 0, [0] * shards
    width = 1 << max(0, (total // CELLS).bit_length() - 1)
    known = Summary(cells(sums, width))
    while True:
        low, high = known.capacity(shards, total, False), known.capacity(shards, total, True)
        unclear = known.open(shards, low, high)
        split = min(SPLIT, width, 1 << max(0, (budget // max(1, len(unclear))).bit_length() - 1))
        if not unclear or split < 2:
            return high, known.even(shards, total, high)
        inside = {c[0] // width for c in unclear}
        kept = [c for c in known.cells if c[0] // width not in inside]
        known = Summary(kept + cells(sums, width // split, (width, sorted(inside))))
        width //= split


def size_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 16


def shard(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the text, with size, text_crc32, shard (from 0) and slot (gapless from 0 within a shard).

    Equal texts stay together, null and empty ones too; within that, the largest shard is as small as any contiguous
    partition allows. A group above the even share makes a shard larger than others. With fewer groups than shards,
    some shards are empty. The columns size, text_crc32, shard and slot are replaced. Slots follow no order but are the same in each run; rows alike in key and text may swap."""
    new = ("size", "text_crc32", "shard", "slot")
    others = [c for c in docs.columns if c not in (text, *new)]
    t = F.coalesce(F.col(text), F.lit(""))
    # written once: all that follows needs no texts
    rows = cut(docs.select(*(F.col(f"`{c}`") for c in others), size_of(F.col(text)).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(t).alias("__hash")))
    groups = rows.select(F.col("__hash").alias("hash"), "size").groupBy("hash").agg(F.sum("size").alias("size"))
    sums = cut(ends(groups))
    _, stops = minimax_cuts(sums, shards)
    some = docs.sparkSession.createDataFrame([(s,) for s in sorted(set(stops))], "end long")
    where = {r["end"]: r["hash"] for r in sums.join(F.broadcast(some), "end").collect()}  # one row a shard
    rows = rows.withColumn("shard", rank_in(F.col("__hash"), sorted(where.get(s, "") for s in stops[:-1])))

    counts = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    most = max(256, min(sum(counts.values()) // 2048, 2_000_000))
    parts = F.array(*(F.lit(-(-counts.get(k, 1) // most)) for k in range(shards)))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(F.col(key), F.col("__hash")), F.element_at(parts, F.col("shard") + 1)).cast("int"))
    before = rows.groupBy("shard", "__part").agg(F.count("*").alias("n"))
    before = before.select("shard", "__part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("shard", "__part").orderBy(F.col(key).asc_nulls_first(), "__hash")))
    return rows.join(before, ["shard", "__part"]).select(*(F.col(f"`{c}`") for c in others), "size", "text_crc32", "shard", (F.col("__base") + F.col("__nth") - 1).cast("long").alias("slot"))


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
