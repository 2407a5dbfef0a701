"""Document fingerprints by one-permutation MinHash.

Each shingle is hashed once. The leading bits of a hash name its bin, of which the least hash is kept. An empty bin
takes the value of the first full one in a random order of bins of its own (optimal densification), the same order for
all documents. Of each bin's value only the low-order bits are stored; the share of bins that agree is corrected for
values that agree by chance. All of it is one expression over the text, evaluated where the text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, read, words

#: Bins (a power of two), low-order bits kept of each, words of a shingle.
BINS, BITS, K = 256, 4, 5
#: Bins that an empty one tries at random before it compares all full ones.
_TRIES = 12
_LONGS = BINS * BITS // 64
#: Rows of the bucket in which documents find the next one, about.
_BUCKETS = 2048


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({','.join(f'{v}L' for v in values)})")


def _bin(h: Column) -> Column:
    """The bin of a hash of 62 bits."""
    return F.shiftrightunsigned(h, 62 - BINS.bit_length() + 1)


def _mix(x: int) -> int:
    """A 64-bit finaliser, for the tables of random bins."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def shingle_hashes(text: Column, k: int = K) -> Column:
    """A hash of 62 bits, its lowest bit 0, for each run of k words; the whole of a shorter text is one shingle."""

    def of(w: Column) -> Column:
        runs = F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.transform(runs, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, F.lit(k))), 2).bitwiseAND(F.lit(~1))))

    return let(words(text), of)


def sketch(text: Column, k: int = K) -> Column:
    """The fingerprint of a text as 16 longs of 16 bins each; null and empty texts have one of zeros."""
    width = 62 - BINS.bit_length() + 1
    # one value a bin that no hash exceeds and none equals: it stays where a bin is empty
    ends = _longs([(b + 1 << width) - 1 for b in range(BINS)])
    tries = [_longs([_mix(b * 1000003 + t) % BINS + 1 for b in range(BINS)]) for t in range(_TRIES)]

    def least(sorted_: Column) -> Column:
        return F.filter(sorted_, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(sorted_, i - 1))))

    def dense(v: Column) -> Column:
        full = lambda h: h.bitwiseAND(F.lit(1)) == 0

        def value(h: Column, b: Column) -> Column:
            tried = [let(F.get(v, F.get(t, b).cast("int") - 1), lambda x: F.when(full(x), x)) for t in tries]
            rest = F.array_min(F.transform(F.filter(v, full), lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("order"), x.alias("value"))))["value"]
            return F.when(full(h), h).otherwise(F.coalesce(*tried, rest))

        return F.transform(v, value)

    def packed(v: Column) -> Column:
        per = 64 // BITS
        low = F.transform(v, lambda h: F.shiftright(h, 1).bitwiseAND(F.lit((1 << BITS) - 1)))
        return let(low, lambda d: F.transform(F.sequence(F.lit(0), F.lit(_LONGS - 1)), lambda j: F.aggregate(F.slice(d, j * per + 1, F.lit(per)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x))))

    def of(hashes: Column) -> Column:
        none = _longs([0] * _LONGS)
        return F.when(F.size(hashes) == 0, none).otherwise(let(let(let(F.sort_array(F.concat(hashes, ends)), least), dense), packed))

    return let(shingle_hashes(text, k), of)


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two sketches, from 0 to 1."""
    ones = F.expr("1229782938247303441L")  # the lowest bit of each group of four
    # lanes in a fold: written one after the other they make a method that is too large for the JVM to compile
    unlike = lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(ones))
    equal = F.lit(BINS) - F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda acc, x: acc + unlike(x))
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (equal.cast("double") / BINS - chance) / (1 - chance))


def as_string(s: Column) -> Column:
    """A sketch in hexadecimal digits, one a bin."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(rows: DataFrame, key: str, bring: dict[str, Column]) -> DataFrame:
    """rows with columns of the row that follows by ascending key; the first follows the last.

    bring: name to expression over the following row. Keys are cut into ranges of about equal counts; the first key
    of a range also stands, marked, at the end of the range before, so that each range finds all it needs in itself.
    Equal keys follow one another by all other columns' hashes. A row with a null key has no place and gets nulls."""
    n, low = rows.agg(F.count(key), F.min(key)).first()
    ranges = max(1, min(32768, n // max(1, min(n // _BUCKETS, 200_000), 64))) if n else 1
    cuts = rows.agg(F.percentile_approx(key, [i / ranges for i in range(ranges)], 100_000)).first()[0] or []
    starts = sorted({*cuts, *([low] if n else [])})
    table = _longs([int(s) for s in starts]) if starts else F.array().cast("array<long>")
    # the last start that isn't above the key, by halving
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(max(1, len(starts).bit_length())))))
    at = F.aggregate(steps, F.lit(0), lambda acc, s: F.when(F.get(table, acc + s - 1) <= F.col(key), acc + s).otherwise(acc))
    rows = rows.withColumn("__range", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(1024)).cast("int") - 2048).otherwise(at))
    home = F.struct(F.col("__range").alias("range"), F.lit(0).alias("guest"))
    before = F.struct(F.when(F.col("__range") == 1, len(starts)).otherwise(F.col("__range") - 1).alias("range"), F.lit(1).alias("guest"))
    first = (F.col("__range") > 0) & (F.get(table, F.col("__range") - 1) == F.col(key))
    placed = rows.select("*", F.explode(F.when(first, F.array(home, before)).otherwise(F.array(home))).alias("__place")).drop("__range")
    placed = placed.select(*rows.columns[:-1], F.col("__place.range").alias("__range"), F.col("__place.guest").alias("__guest"))
    w = Window.partitionBy("__range").orderBy("__guest", key, F.xxhash64(*[c for c in rows.columns[:-1] if c != key]))
    # one window: every further one would shuffle the texts again
    placed = placed.withColumn("__next", F.lead(F.struct(*(v.alias(n) for n, v in bring.items()))).over(w)).where("__guest = 0")
    following = [F.when(F.col(key).isNotNull(), F.col("__next")[n]).alias(n) for n in bring]
    return placed.select(*rows.columns[:-1], *following)


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("sketch", sketch(F.col("text")))
    docs = with_next(docs, "doc_id", {"next_text": F.col("text"), "next_sketch": F.col("sketch")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.coalesce(F.left("next_text", half), F.lit("")))
    docs = docs.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited")).withColumn("edited_sketch", sketch(F.col("edited")))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        F.coalesce(likeness(F.col("sketch"), F.col("next_sketch")), F.lit(0.0)).alias("near_next"),
    )
