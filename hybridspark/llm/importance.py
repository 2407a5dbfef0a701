"""Importance resampling towards a target distribution over hashed n-grams, by external sort-count.

Each block of documents becomes one row: ids, and a packed stream of uint16 buckets with each document's offset in it.
The streams are written once. To count, a task sorts each stream and run-length encodes it, so that only (bucket, n)
rows, no more than there are buckets, leave it. Later the same streams gather the buckets' gains, and np.add.reduceat
at the offsets sums them for each document. A score adds Gumbel noise that hangs on the id alone, so the highest scores
are a draw without replacement; they are ranked within ranges, never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, read

#: Buckets of features; a stream holds them in 16 bits.
BUCKETS = 10000
MOST_BUCKETS = 1 << 16
#: A row of streams is closed at this many features, and texts are split into words by pieces of this many bytes.
BLOCK = PIECE = 1 << 20
#: Words that a document must have to be drawn, percent of those documents that are, and what the noise is drawn with.
LEAST_WORDS, SHARE, SEED = 20, 10, 2024
#: A-Z in lower case; the ASCII characters that are neither letters nor digits part words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def features(text: bytes, n: int = 1, buckets: int = BUCKETS) -> tuple[int, list[np.ndarray]]:
    """How many words a text has, and the buckets of all its runs of 1 to n words, order of no account.

    Words are made by pieces of the text, so a very long one costs little more than itself."""
    data, at, n_words, out, before = text.translate(_FOLD), 0, 0, [], []
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        at, n_words = end, n_words + len(words)
        runs = list(words)
        for k in range(2, n + 1):
            # the last words of the piece before begin runs that end here
            line = before[len(before) - (k - 1) :] + words if len(before) >= k - 1 else before + words
            runs += [b" ".join(line[i : i + k]) for i in range(len(line) - k + 1)]
        before = (before + words)[-(n - 1) :] if n > 1 else []
        out.append((np.fromiter(map(crc32, runs), np.uint32, len(runs)) % buckets).astype("<u2"))
    return n_words, out


def streams(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Blocks (ids, n_words, ends, stream) of docs: the documents of a block, where each one's buckets end in the stream.

    Nulls and texts without words have no buckets; every row of docs is in one block, repeated rows too. Columns besides
    key and text are not read."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: pa.Array, words: list[int], ends: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
            one = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, pa.array(words, pa.int64()), pa.array(ends, pa.int64()))]
            stream = np.concatenate(parts) if parts else np.empty(0, "<u2")
            return pa.RecordBatch.from_arrays([*one, pa.array([stream.tobytes()], pa.binary())], names=["ids", "n_words", "ends", "stream"])

        for batch in batches:
            keys, begin, words, ends, parts, size = batch.column(0), 0, [], [], [], 0
            for i, t in enumerate(batch.column(1)):
                own, found = features((t.as_py() or "").encode(), n, buckets)
                size += sum(map(len, found))
                words.append(own)
                ends.append(size)
                parts += found
                if size >= BLOCK:
                    yield block(keys.slice(begin, i + 1 - begin), words, ends, parts)
                    begin, words, ends, parts, size = i + 1, [], [], [], 0
            if words:
                yield block(keys.slice(begin), words, ends, parts)

    return cut(docs.select(F.col(key), F.col(text)).mapInArrow(run, f"ids array<{kind}>, n_words array<long>, ends array<long>, stream binary"))


def encoded(sorted_values: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal values and how long they are; with n, how much their n come to."""
    if not len(sorted_values):
        return sorted_values, np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return sorted_values[first], np.diff(np.r_[first, len(sorted_values)]) if n is None else np.add.reduceat(n, first)


def counts(blocks: DataFrame) -> DataFrame:
    """(bucket, n) over all streams: sorted and run-length encoded one by one, their runs merged within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, n = np.empty(0, "<u2"), np.empty(0, np.int64)
        for batch in batches:
            for s in batch.column(0):
                found, more = encoded(np.sort(np.frombuffer(s.as_buffer(), "<u2")))
                both, m = np.concatenate([values, found]), np.concatenate([n, more])
                order = np.argsort(both, kind="stable")
                values, n = encoded(both[order], m[order])
        yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32), pa.int32()), pa.array(n, pa.int64())], names=["bucket", "n"])

    return blocks.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), for counts (bucket, n) of both sides.

    The driver sees a number for each bucket, 65,536 at most."""

    def table(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in df.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = table(raw), table(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight) of each document in blocks: the sum of its features' gains, 0 without any."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for ids, words, ends, stream in zip(*batch.columns, strict=True):
                end = ends.values.to_numpy()
                size = np.diff(end, prepend=0)
                some, sums = size > 0, np.zeros(len(size), np.int64)
                if some.any():
                    # an empty segment would take the value at its offset, so only others are asked for
                    sums[some] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), "<u2")], (end - size)[some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(size), pa.array(sums)], names=["key", "n_words", "n_features", "weight"])

    return blocks.select("ids", "n_words", "ends", "stream").mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of sha256('seed:key'); a null key is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of docs; rank is null where it isn't drawn.

    Of the documents with least_words words or more share percent (rounded down) are drawn, highest scores first, ties to
    the smaller key, null keys last. Null and empty texts have no features and weigh 0. Repeated rows are documents of
    their own with one score; with clashing columns only key and text are read. Empty docs give no row; an empty target
    weighs by rarity alone."""
    # the target is keyed by a constant, as only its counts matter
    aim = streams(target.select(F.lit(0).alias("__key"), F.col(target_text).alias("__text")), "__key", "__text", n, buckets)
    blocks = streams(docs, key, text, n, buckets)
    found = weights(blocks, gains(counts(blocks), counts(aim), buckets))
    scored = cut(found.withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * share // 100
    placed = numbered(scored.where(able), [], [F.desc("score"), F.asc_nulls_last("key"), F.asc("n_features"), F.asc("weight")])
    ranked = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: CRC32 of a text, for SQL without such a function; crc_of is the column of the polynomial's table.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_of)"


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH {CRC_TABLE},
f AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
buckets AS (SELECT word, {crc_sql('word')} % {BUCKETS} AS bucket FROM (SELECT word FROM f UNION SELECT word FROM b), crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN buckets USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN buckets USING (word) GROUP BY 1),
sums AS (SELECT (SELECT count(*) FROM f) AS ss, (SELECT count(*) FROM b) AS tt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS}) / ((s + 1)::DOUBLE * (tt + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY 1),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * {SHARE} // 100 AS drawn FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
