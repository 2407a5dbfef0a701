"""Byte-level BPE: overlapping chunk encoding, and decoding.

Texts above chunk characters are cut into overlapping chunks that are pre-tokenised in parallel. Pre-tokenising looks
only forward, so once two neighbours share a boundary inside their overlap they agree from there on; each chunk then
encodes what lies between its two such boundaries. A text in which some pair of neighbours shares none (one pre-token
longer than the overlap) is put together again and encoded in one piece, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 1 << 16, 2048
#: A boundary this far from the cut end of a chunk does not depend on what follows it: the pattern looks at most two characters ahead.
_MARGIN = 8
#: Half the distinct pre-tokens that a worker remembers, and tokens that it holds before it hands over a batch.
_CACHE, _FLUSH = 60_000, 1_000_000


#: Letters and numbers that Unicode gained after version 16, to which the rank files' usual library keeps.
#: The regex module is newer; these characters count as neither here.
_NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: What the pattern's classes mean: Unicode's white space, without the four separators that Python adds, and version 16's letters and numbers. Frequent ranges first.
_CLASSES = {
    r"\p{L}": rf"[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f[\p{{L}}--[{_NEWER}]]]",
    r"\p{N}": rf"[0-9[\p{{N}}--[{_NEWER}]]]",
    r"\s": r"\p{White_Space}",
    r"\S": r"\P{White_Space}",
}


def _ascii(pattern: str) -> str:
    """The same pattern for texts of ASCII characters alone, which the standard library matches faster."""
    out, inside = "", False
    for part in re.split(r"(\\p\{[LN]\}|(?<!\\)[\[\]])", pattern):
        inside = part == "[" or inside and part != "]"
        span = {r"\p{L}": "a-zA-Z", r"\p{N}": "0-9"}.get(part)
        out += part if span is None else span if inside else f"[{span}]"
    return out


class Bpe:
    """Ranks of byte strings; encodes one pre-token by always merging the leftmost pair of lowest rank."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        self.ascii = re.compile(_ascii(pattern), re.ASCII).findall
        for name, meaning in _CLASSES.items():
            pattern = pattern.replace(name, meaning)
        self.any = regex.compile(f"(?V1){pattern}").findall
        # tuples take less memory than lists; a worker lives on after its task
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.any(text)

    def pre_token(self, piece: str) -> list[int]:
        b = piece.encode()
        if (i := self.ranks.get(b)) is not None:
            return [i]
        return self._merge_few(b) if len(b) <= 48 else self._merge_many(b)

    def _merge_few(self, b: bytes) -> list[int]:
        rank, none = self.ranks.get, 1 << 60
        parts = [b[i : i + 1] for i in range(len(b))]
        pairs = [rank(b[i : i + 2], none) for i in range(len(b) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge_many(self, b: bytes) -> list[int]:
        """The same by a heap, for pieces where looking at every pair each time would take too long."""
        ends, size = [*range(1, len(b) + 1)], len(b)
        before = [*range(-1, size - 1)]
        rank = lambda i, j: self.ranks.get(b[i:j])
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := rank(i, i + 2)) is not None]
        heapq.heapify(heap)
        gone = bytearray(size)
        while heap:
            _, i, end = heapq.heappop(heap)
            if gone[i] or ends[i] == size or ends[i] >= end or ends[ends[i]] != end:
                continue  # one of the two parts has been merged meanwhile
            gone[ends[i]] = 1
            ends[i] = end
            if end < size:
                before[end] = i
                if (r := rank(i, ends[end])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := rank(p, end)) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < size:
            out.append(self.ranks[b[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                got = self.before.get(piece) or tuple(self.pre_token(piece))
                if len(piece) <= 64:
                    if len(known) >= _CACHE:  # what has been used since the last time stays for one more round
                        self.before, self.known = known, {}
                        known = self.known
                    known[piece] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(ranks_path: str, pattern: str) -> Bpe:
    return Bpe(ranks_path, pattern)


def _with_column(batch: pa.RecordBatch, drop: tuple[str, ...], name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in drop]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), values], names=[*(n for n, _ in kept), name])


def _encode_rows(df: DataFrame, ranks_path: str, pattern: str, done: bool = False) -> DataFrame:
    """Column ids in place of text (null: empty); with done, rows that have ids already keep them."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("text", "ids"))

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            texts = batch.column("text")
            given = batch.column("ids") if done else None
            flat, ends, at = array("i"), [0], 0
            for i, t in enumerate(texts):
                flat.extend(given[i].values.to_numpy().tolist() if done and given[i].is_valid else bpe.encode(t.as_py() or ""))
                ends.append(len(flat))
                if len(flat) >= _FLUSH or i == len(texts) - 1:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))
                    yield _with_column(batch.slice(at, i + 1 - at), ("text", "ids"), "ids", ids)
                    flat, ends, at = array("i"), [0], i + 1

    return df.mapInArrow(run, f"{fields}{', ' * bool(fields)}ids array<int>")


def _boundaries(df: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Columns head and tail: boundaries in the first and in the last overlap of a chunk, counted from the text's start."""

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            heads, tails = [], []
            for text, no, last in zip(*(batch.column(c).to_pylist() for c in ("piece", "no", "last")), strict=True):
                start, at, head, tail = no * chunk, 0, [], []
                for p in bpe.split(text):
                    at += len(p)
                    if at < overlap:
                        head.append(start + at)
                    elif at > chunk and (last or at <= len(text) - _MARGIN):
                        tail.append(start + at)
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int64())) for x in (heads, tails))], names=[*batch.schema.names, "head", "tail"])

    return df.mapInArrow(run, "sha string, no int, last boolean, piece string, head array<long>, tail array<long>")


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with the tokens of each whole text as ids (array<int>) in place of the text.

    A null text has no tokens, like an empty one. Equal long texts are encoded once. All other columns come through,
    but for one called ids, which is replaced."""
    if not 2 * _MARGIN < overlap < chunk:
        raise ValueError("overlap must lie between 16 and chunk")
    docs = docs.drop("ids").withColumnRenamed(text, "text")
    size = F.length(F.coalesce("text", F.lit("")))
    short = _encode_rows(docs.where(size <= chunk + overlap), ranks_path, pattern)

    long = docs.where(size > chunk + overlap).withColumn("__sha", F.sha2("text", 256))
    pieces = long.select(F.col("__sha").alias("sha"), "text", F.ceil((size - overlap) / chunk).cast("int").alias("n"))
    pieces = pieces.select("sha", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("no"))
    pieces = pieces.select("sha", "no", (F.col("no") == F.col("n") - 1).alias("last"), F.substring("text", F.col("no") * chunk + 1, F.lit(chunk + overlap)).alias("piece")).dropDuplicates(["sha", "no"])
    w = Window.partitionBy("sha")
    pieces = _boundaries(pieces, ranks_path, pattern, chunk, overlap)
    pieces = pieces.withColumn("stop", F.array_min(F.array_intersect("tail", F.lead("head").over(w.orderBy("no"))))).drop("head", "tail")
    pieces = pieces.withColumn("start", F.lag("stop").over(w.orderBy("no"))).withColumn("whole", F.min(F.col("last") | F.col("stop").isNotNull()).over(w))
    first = F.when(F.col("no") == 0, 0).otherwise(F.col("start") - F.col("no") * chunk)
    own = F.when(F.col("last"), F.length("piece")).otherwise(F.col("stop") - F.col("no") * chunk) - first
    # the part to encode now; or the text as it is, without the overlap
    part = F.when(F.col("whole"), F.substring("piece", (first + 1).cast("int"), own.cast("int"))).otherwise("")
    rest = F.when(~F.col("whole"), F.when(F.col("last"), F.col("piece")).otherwise(F.left("piece", F.lit(chunk))))
    parts = _encode_rows(pieces.select("sha", "no", part.alias("text"), rest.alias("rest")), ranks_path, pattern)
    joined = parts.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("no", "ids", "rest"))).alias("parts"))
    split = F.exists("parts", lambda p: p["rest"].isNotNull())
    joined = joined.select(F.col("sha").alias("__sha"), F.when(split, F.array_join("parts.rest", "")).alias("text"), F.when(~split, F.flatten("parts.ids")).alias("ids"))
    joined = _encode_rows(joined, ranks_path, pattern, done=True)
    return short.unionByName(long.drop("text").join(joined, "__sha").select(short.columns))


def decode(tokens: DataFrame, ranks_path: str, pattern: str = "", into: str = "decoded") -> DataFrame:
    """tokens with the bytes that ids stand for (binary; null for null ids), in the order of ids."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != into)

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            ids = batch.column("ids")
            yield _with_column(batch, (into,), into, pa.array([bpe.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in ids], pa.binary()))

    return tokens.mapInArrow(run, f"{fields}, `{into}` binary")


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    ranks = public.path("byte_bpe_multi_50k.tiktoken")
    tokens = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public.PATTERN)
    hashed = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return decode(hashed, ranks, public.PATTERN).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
