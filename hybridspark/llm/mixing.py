"""Mixing sources to target weights by systematic sampling.

Every document has a number of expected copies. Within a source their prefix sums, shifted by one random offset, cross
whole numbers; a document is emitted once for each it crosses. Expected copies are the target over the source's size at
first. The largest documents come first, one size after the other, and after each size the rate becomes what is left of
the target over what is left of the source, so that the smallest ones make up for the rounding of the large ones. All
other documents share the rate that is left and follow one another by falling size, roughly. Prefix sums take two
steps: bounded cells of a source, then rows within a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words, cut, let, read

#: Copies of a document at most, and with that a target over its source's size.
MOST = 3
#: Documents of a source, the largest ones, whose copies are settled one size after the other.
LARGE = 2048


def fraction(*parts: Column) -> Column:
    """A number from 0 to below 1 that hangs on nothing but parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, extra: tuple[str, ...] = ()) -> DataFrame:
    """(source, source_size, target, *extra) of totals (source, source_size, *extra): one row a source.

    Sources by code point, null last, have the weights in turn and share the sum of all sizes. A target stops at most
    times its source's size; the excess goes to the others by weight. With the sources in the order in which they
    reach that bound, the level that the rest attain follows from two running sums."""
    w = F.array(*map(F.lit, weights))
    ranked = totals.withColumn("weight", F.element_at(w, (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    cap = F.col("source_size") * most
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the level of this source and those after it, if those before stop at their bound
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = ranked.withColumn("level", left / weight).withColumn("free", F.col("level") * F.col("weight") <= cap)
    level = F.min(F.when(F.col("free"), F.struct((F.col("source_size") * most / F.col("weight")).alias("bound"), F.col("level").alias("level")))).over(Window.partitionBy())["level"]
    target = F.least(F.coalesce(level * F.col("weight"), cap.cast("double")), cap.cast("double"))
    return leveled.select("source", "source_size", target.alias("target"), *extra)


def quotas(classes: Column, offset: Column, target: Column, size: Column, most: int = MOST) -> Column:
    """How many copies each class of equal documents gets, largest first, and what is left over for the other documents.

    classes: array of (size, n) by falling size. A class expects its share of what is left of the target: its copies are
    the whole numbers that its expected copies cross from the offset on. Where the documents after it could then not
    make up the rest (by up to most copies of each, or by none), the nearest number that they can make up is taken, or
    else the one that leaves the least over. The result has the classes with their copies, and the target and size left."""
    start = F.struct(target.cast("double").alias("left"), size.cast("double").alias("size"))

    def copies(now: Column, c: Column) -> Column:
        s, n = c["size"].cast("double"), c["n"].cast("double")
        rest = (now["size"] - s * n) * most
        want = F.floor(offset + n * now["left"] / now["size"])
        low, high = F.ceil((now["left"] - rest) / s), F.floor(now["left"] / s)
        near = F.when(now["left"] - high * s - rest <= low * s - now["left"], high).otherwise(low)
        got = F.when(low <= high, F.greatest(low, F.least(want, high))).otherwise(near)
        return F.when(s == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(got, F.lit(most) * c["n"]))).cast("long")

    def step(acc: Column, c: Column) -> Column:
        def after(k: Column) -> Column:
            size_left = acc["now"]["size"] - c["size"] * c["n"]
            left = F.greatest(F.lit(0.0), F.least(acc["now"]["left"] - k * c["size"], size_left * most))
            done = F.concat(acc["done"], F.array(F.struct(c["size"].alias("size"), c["n"].alias("n"), k.alias("copies"))))
            return F.struct(F.struct(left.alias("left"), size_left.alias("size")).alias("now"), done.alias("done"))

        return let(copies(acc["now"], c), after)

    none = F.array().cast("array<struct<size:bigint,n:bigint,copies:bigint>>")
    return F.aggregate(classes, F.struct(start.alias("now"), none.alias("done")), step)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 17, large: int = LARGE) -> DataFrame:
    """docs without the text, with size, source_size, target, copies (long: how often the mix has the row) and tie (the text's MD5).

    The words taken of a source of up to large documents miss the target by half of its smallest document's size, if
    the documents allow that at all; with more documents by about the size of the first one after the large ones, less
    than a thousandth of the source. Null and empty texts have size 0; a source without any words has target 0 and no
    copies. Rows without a source make up one of their own. Repeated rows and equal keys are told apart by their texts,
    else they are alike and it does not matter which of them is taken. Columns named like the new ones are replaced."""
    new = ("size", "source_size", "target", "copies", "tie")
    others = [c for c in docs.columns if c not in (text, key, source, *new)]
    # written once: all that follows needs no texts
    rows = cut(docs.select(*(F.col(f"`{c}`") for c in others), F.col(key), F.col(source).alias("__source"), count_words(F.col(text)).alias("__size"), F.md5(F.coalesce(text, F.lit(""))).alias("__tie")))
    rows = rows.withColumn("__bin", F.expr("-(length(bin(__size)) * 8 + shiftright(__size * 8, length(bin(__size)) - 1) - 8) - 1").cast("long"))
    bins = cut(rows.groupBy(F.col("__source").alias("source"), F.col("__bin").alias("bin")).agg(F.count("*").alias("n"), F.sum("__size").alias("size")))
    totals = bins.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"))
    offset = fraction(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))
    goals = cut(targets(totals, extra=("n",)).withColumn("offset", offset))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))

    # the largest documents of each source: whole bins, so many documents at most
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("top", upto <= large)
    placed = rows.alias("r").join(bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), "top").alias("t"), F.col("r.__source").eqNullSafe(F.col("t.s")) & (F.col("r.__bin") == F.col("t.b"))).select("r.*", "top")
    classes = placed.where("top").groupBy(F.col("__source").alias("source"), F.col("__size").alias("size")).agg(F.count("*").alias("n"))
    classes = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("classes"))
    folded = goals.alias("g").join(classes.alias("c"), same("g", "c"), "left").select("g.*", F.coalesce("c.classes", F.array().cast("array<struct<size:bigint,n:bigint>>")).alias("classes"))
    folded = cut(folded.withColumn("q", quotas(F.col("classes"), F.col("offset"), F.col("target"), F.col("source_size"))).drop("classes"))

    # documents in order: cells of equal size among the large ones; else of about one size, dealt so that none is large
    most = max(256, min((totals.agg(F.sum("n")).first()[0] or 0) // 2048, 2_000_000))
    placed = placed.alias("r").join(goals.select("source", "n").alias("g"), F.col("r.__source").eqNullSafe(F.col("g.source"))).select("r.*", F.col("g.n").alias("__n"))
    salt = F.floor(fraction(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("__tie")) * F.ceil(F.col("__n") / most)).cast("long")
    placed = placed.withColumn("__cell", F.when(F.col("top"), F.col("__size")).otherwise(F.col("__bin"))).withColumn("__salt", F.when(F.col("top"), F.lit(0)).otherwise(salt)).drop("__n", "__bin")
    cells = placed.where("not top").groupBy(F.col("__source").alias("source"), F.col("__cell").alias("cell"), F.col("__salt").alias("salt")).agg(F.count("*").alias("n"))
    ends = cells.groupBy("source", "cell").agg(F.sum("n").alias("n"))
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("source", "cell", earlier(["source"], "cell").alias("base"))
    cells = cells.withColumn("before", earlier(["source", "cell"], "salt"))
    cells = cells.alias("c").join(ends.alias("e"), same("c", "e") & (F.col("c.cell") == F.col("e.cell"))).select("c.source", "c.cell", "c.salt", (F.col("before") + F.col("base")).alias("before"))
    # of each cell the documents before it and the expected copies of one document, as a quotient
    rates = cells.alias("c").join(folded.alias("f"), same("c", "f")).select("c.*", F.col("q.now.left").alias("up"), F.col("q.now.size").alias("down"))
    tops = folded.select("source", F.explode("q.done").alias("d")).select("source", F.col("d.size").alias("cell"), F.lit(0).cast("long").alias("salt"), F.lit(0).cast("long").alias("before"), F.col("d.copies").cast("double").alias("up"), F.col("d.n").cast("double").alias("down"))
    rates = rates.unionByName(tops).alias("c").join(goals.alias("g"), same("c", "g")).select("c.*", "g.source_size", "g.target", "g.offset")
    nth = F.row_number().over(Window.partitionBy("__source", "__cell", "__salt").orderBy("__size", F.col(key).asc_nulls_last(), "__tie"))
    out = placed.withColumn("__nth", nth).alias("r").join(rates.alias("k"), F.col("r.__source").eqNullSafe(F.col("k.source")) & (F.col("r.__cell") == F.col("k.cell")) & (F.col("r.__salt") == F.col("k.salt")))
    at = lambda i: F.floor(F.col("k.offset") + i * F.col("k.up") / F.col("k.down"))
    last = F.col("k.before") + F.col("r.__nth")
    copies = F.when(F.col("k.down") > 0, at(last) - at(last - 1)).otherwise(0)
    return out.select(*(F.col(f"r.`{c}`") for c in (*others, key)), F.col("r.__source").alias(source), F.col("r.__size").alias("size"), "k.source_size", "k.target", copies.cast("long").alias("copies"), F.col("r.__tie").alias("tie"))


def op5_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS tie FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM r GROUP BY 1),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM tot),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, (3 * source_size)::DOUBLE / weight) AS level FROM o WHERE level * weight <= 3 * source_size),
t AS (SELECT source, source_size, n, least(coalesce(l.level * weight, 3 * source_size), 3 * source_size)::DOUBLE AS target,
  ('0x' || substr(md5('17|' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM o LEFT JOIN l ON TRUE),
m AS (SELECT greatest(256, least(count(*) // 2048, 2000000)) AS most FROM r),
b AS (SELECT *, length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)) - 8 AS bin FROM r),
g AS (SELECT b.*, count(*) OVER (PARTITION BY source ORDER BY bin DESC) <= 2048 AS top FROM b),
c AS (SELECT source, size, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS k FROM g WHERE top GROUP BY 1, 2),
f AS (SELECT source, 0::BIGINT AS k, NULL::BIGINT AS size, 0::BIGINT AS n, 0::BIGINT AS copies, target AS w, source_size::DOUBLE AS s, off FROM t
UNION ALL SELECT source, k, size, n, copies, greatest(0, least(w - copies * size, (s - size * n) * 3))::DOUBLE, s - size * n, off FROM
 (SELECT source, k, size, n, w, s, off, CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(3 * n, CASE WHEN low <= high THEN greatest(low, least(floor(off + n * w / s), high))
   WHEN w - high * size - (s - size * n) * 3 <= low * size - w THEN high ELSE low END)) END::BIGINT AS copies FROM
  (SELECT c.source, c.k, c.size, c.n, f.w, f.s, f.off, ceil((f.w - (f.s - c.size * c.n) * 3) / c.size) AS low, floor(f.w / c.size) AS high FROM f JOIN c ON c.source IS NOT DISTINCT FROM f.source AND c.k = f.k + 1))),
e AS (SELECT source, arg_min(w, s) AS w, min(s) AS s FROM (SELECT source, w, s, k, max(k) OVER (PARTITION BY source) AS z FROM f) WHERE k = z GROUP BY 1),
p AS (SELECT g.*, t.source_size, t.target, t.off, row_number() OVER (PARTITION BY g.source, top, CASE WHEN top THEN size END ORDER BY
  CASE WHEN top THEN 0 ELSE -bin END, CASE WHEN top THEN 0 ELSE floor(('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || tie), 1, 8))::BIGINT / 4294967296.0::DOUBLE * ceil(n / most::DOUBLE)) END,
  size, doc_id NULLS LAST, tie) AS nth FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source, m),
u AS (SELECT p.*, CASE WHEN top THEN f.copies::DOUBLE ELSE e.w END AS up, CASE WHEN top THEN f.n::DOUBLE ELSE e.s END AS down
  FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source LEFT JOIN f ON p.source IS NOT DISTINCT FROM f.source AND p.size = f.size AND f.k > 0)
SELECT doc_id, size, source_size, target, CASE WHEN down > 0 THEN floor(off + nth * up / down) - floor(off + (nth - 1) * up / down) ELSE 0 END::BIGINT * size AS taken FROM u
"""
