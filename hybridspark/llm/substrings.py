"""Substring deduplication by suffix automata of reference shards.

The corpus is its own reference. To shard it without comparing every document with every shard, each window of
consecutive words is assigned an anchor: the eight-word run of least hash inside it (the leftmost on a tie). Equal
windows have equal anchors. Windows that follow one another with the same anchor make up a piece, so each occurrence
of a window lies in exactly one piece. Pieces whose anchor occurs once are done with; equal pieces decide one another;
only where an anchor has different pieces are their words fetched and dealt to shards by anchor. A shard's task builds
a suffix automaton of its distinct pieces, with how often each substring occurs, and streams the pieces through it:
a window is repeated if the state of its words has been reached twice or more.

An anchor with more than HOT different pieces is counted window by window instead, with partial aggregates, as its
shard would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

#: Words of a window, and of an anchor.
WINDOW, GRAM = 35, 8
#: Different pieces of an anchor that a shard takes.
HOT = 4000
#: Anchors that may have a larger share of the repeated pieces than one over this.
_HOT_ANCHORS = 1000
#: Bytes of text that are looked at together, and windows.
_BLOCK = 1 << 19
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
#: Lower bits of a gram's hash that give way to its place.
_PLACE = np.uint64((1 << 20) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B2
    return x ^ (x >> np.uint64(32))


_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * _B1))


def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_B1), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, x)])) for x in (_B1, inverse))


_kept = lru_cache(maxsize=4)(_made)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n, at least, of a base modulo 2^64, and of its inverse."""
    return _kept(1 << max(10, n.bit_length())) if n <= 2 * _BLOCK else _made(n)


def _runs(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of values from first to before end: the difference of two prefix sums of value times power,
    over the power at its start."""
    power, back = _powers(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return _mixed((sums[end] - sums[first]) * back[first])


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts, bytes one after the other, and how many words begin before each of starts."""
    space = _SPACES[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = starts[starts < len(data)]
    before[inner] = True
    after[inner[inner > 0] - 1] = True
    after[-1:] = True
    begins, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    out = np.empty(len(begins), dtype=np.uint64)
    cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, len(data), _BLOCK)), len(begins)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        at = begins[i]
        out[i:j] = _runs(_BYTES[data[at : ends[j - 1]]], begins[i:j] - at, ends[i:j] - at)
    return out, np.searchsorted(begins, starts)


def pieces_of(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its anchor, a signature of its words and of its anchor's place, its text, its first window there
    and its windows. h: hashes of words; those of text i are from bounds[i] to before bounds[i + 1]."""
    n = len(h)
    end = np.repeat(bounds[1:], np.diff(bounds))[: max(0, n - window + 1)]
    start = np.flatnonzero(np.arange(len(end)) + window <= end)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    h = _mixed(h)
    grams = _runs(h, np.arange(n - gram + 1), np.arange(gram, n + 1))
    span = window - gram + 1
    at = np.empty(len(end), dtype=np.int64)
    for i in range(0, len(end), _BLOCK):
        # the least by the upper bits of the hash, then by place: both depend on a window's words alone
        low = grams[i : i + _BLOCK + span - 1] & ~_PLACE | np.arange(min(_BLOCK + span - 1, len(grams) - i), dtype=np.uint64)
        m, k = len(low) - span + 1, 1
        while 2 * k <= span:
            low, k = np.minimum(low[:-k], low[k:]), 2 * k
        at[i : i + m] = (np.minimum(low[:m], low[span - k : span - k + m]) & _PLACE).astype(np.int64) + i
    at = at[start]
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first, at, count = start[edge], at[edge], np.diff(np.append(edge, len(start)))
    sig = _mixed(_runs(h, first, first + count + window - 1) * _B2 + (count * 64 + at - first).astype(np.uint64))
    text = np.searchsorted(bounds, first, side="right") - 1
    return grams[at].view(np.int64), sig.view(np.int64), text, first - bounds[text], count


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, sig, t1, t2, n, place) of texts (t1, t2, n, text); place: 64 times the first window plus the windows, less 1."""

    def run(batches):
        for batch in batches:
            column = batch.column("text").cast(pa.large_string())
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
            # whole texts, up to a block of bytes and the text that exceeds it
            groups = np.unique(np.append(np.searchsorted(offsets, np.arange(offsets[0], offsets[-1], _BLOCK)), len(column)))
            for i, j in zip(groups[:-1], groups[1:], strict=True):
                words, bounds = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                anchor, sig, text, first, count = pieces_of(words, bounds, window)
                own = (batch.column(c).to_numpy()[i + text] for c in ("t1", "t2", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, sig, *own, first * 64 + count - 1)], names=["anchor", "sig", "t1", "t2", "n", "place"])

    return texts.select("t1", "t2", "n", "text").mapInArrow(run, "anchor long, sig long, t1 long, t2 long, n long, place long")


class Automaton:
    """A suffix automaton of sequences of words; each state knows how often its substrings occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.seen = [-1], [0], [0]

    def add(self, words: list, times: int) -> None:
        """A further sequence, to be counted so many times."""
        nxt, link, size, seen = self.next, self.link, self.size, self.seen
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                last = q
            elif q is not None:
                last = self._split(last, w, q)
            else:
                new = len(nxt)
                nxt.append({})
                link.append(0)
                size.append(size[last] + 1)
                seen.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
                last = new
            seen[last] += times

    def _split(self, p: int, w: object, q: int) -> int:
        """A state of its own for the substrings of q up to one word longer than p's."""
        nxt, link, size = self.next, self.link, self.size
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        self.seen.append(0)
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def close(self) -> None:
        """Hands every state's occurrences on to the states of its suffixes."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.seen[self.link[s]] += self.seen[s]

    def repeated(self, words: list, window: int) -> list[int]:
        """The windows of an added sequence that occur twice or more, by the matching statistics of its positions."""
        s, out = 0, []
        for i, w in enumerate(words):
            s = self.next[s][w]
            while self.size[self.link[s]] >= window:
                s = self.link[s]
            if i >= window - 1 and self.seen[s] >= 2:
                out.append(i - window + 1)
        return out


def _spans(starts: list[int]) -> list[dict]:
    """Runs of consecutive numbers, as first and last."""
    out: list[dict] = []
    for i in starts:
        if out and out[-1]["b"] == i - 1:
            out[-1]["b"] = i
        else:
            out.append({"a": i, "b": i})
    return out


def _shard(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton, ids = Automaton(), {}
        rows = [[ids.setdefault(w, len(ids)) for w in words.split(b" ")] for words in pdf["words"]]
        for words, n in zip(rows, pdf["n"], strict=True):
            automaton.add(words, int(n))
        automaton.close()
        found = [_spans(automaton.repeated(words, window)) if n < 2 else None for words, n in zip(rows, pdf["n"], strict=True)]
        return pd.DataFrame({"anchor": pdf["anchor"], "sig": pdf["sig"], "spans": found})

    return run


_SPANS = "array<struct<a:int,b:int>>"


def _words(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, sig, n, words) of wanted (anchor, sig, n, t1, t2, place)."""
    lists = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "sig", "n", "place")).alias("pieces"))

    def run(batches):
        for batch in batches:
            rows = []
            for text, pieces in zip(batch.column("text"), batch.column("pieces"), strict=True):
                words = text.as_py().encode().split()
                for p in pieces.as_py():
                    first, more = divmod(p["place"], 64)
                    rows.append((p["anchor"], p["sig"], p["n"], b" ".join(words[first : first + more + window])))
            for i in range(0, len(rows), 50_000):
                a, s, n, w = zip(*rows[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(w, pa.binary())], names=["anchor", "sig", "n", "words"])

    return texts.join(lists, ["t1", "t2"]).select("t1", "t2", "n", "text", "pieces").mapInArrow(run, "anchor long, sig long, n long, words binary")


def _windows(words: DataFrame, window: int) -> DataFrame:
    """(anchor, sig, spans) of pieces whose anchor is hot: each window is a row and equal ones are counted."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, sig, n, joined in zip(*(batch.column(c).to_pylist() for c in ("anchor", "sig", "n", "words")), strict=True):
                w = joined.split(b" ")
                rows += [(anchor, sig, n, i, xxhash.xxh3_128_digest(b" ".join(w[i : i + window]))) for i in range(len(w) - window + 1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "sig", "n", "i", "hash"])

    rows = words.select("anchor", "sig", "n", "words").mapInArrow(run, "anchor long, sig long, n long, i int, hash binary")
    often = rows.groupBy("hash").agg(F.sum("n").alias("times")).where("times > 1").select("hash")
    return rows.where("n < 2").join(often, "hash").groupBy("anchor", "sig").agg(F.collect_list(F.struct(F.col("i").alias("a"), F.col("i").alias("b"))).alias("spans"))


def repeats(docs: DataFrame, text: str, texts: DataFrame, shards: int, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(t1, t2, spans): for each text that has any, spans of windows (first, last) whose words also start elsewhere.

    Pieces are cut where documents are read and written once; texts (t1, t2, n, text) are those to fetch words from."""
    pieces = cut(_pieces(docs.select(*_halves(text), F.lit(1).cast("long").alias("n"), F.coalesce(text, F.lit("")).alias("text")), window))
    known = cut(pieces.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1"))
    # anchors with over a thousandth of all pieces, a thousand at most, are broadcast, so that no task gets one whole
    many = (known.agg(F.sum("times")).first()[0] or 0) // _HOT_ANCHORS
    busy = F.broadcast(known.where(F.col("times") > many).select("anchor"))
    rest = pieces.join(busy, "anchor", "left_anti").join(known.where(F.col("times") <= many).select("anchor"), "anchor", "left_semi")
    some = pieces.join(busy, "anchor", "left_semi").unionByName(rest)
    some = cut(some.groupBy("anchor", "sig", "t1", "t2", "place").agg(F.sum("n").alias("n")))
    # the first text of each distinct piece stands for it
    kinds = some.groupBy("anchor", "sig").agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2", "place")).alias("at"))
    each = cut(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    mixed = kinds.join(each, "anchor").select("anchor", "sig", "n", "at.t1", "at.t2", "at.place", "kinds")
    cold = _words(texts, mixed.where(F.col("kinds") <= hot), window).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    cold = cold.groupBy("shard").applyInPandas(_shard(window), f"anchor long, sig long, spans {_SPANS}").where("spans is not null and size(spans) > 0")
    warm = _windows(_words(texts, mixed.where(F.col("kinds") > hot), window), window)
    whole = kinds.where("n > 1").select("anchor", "sig", F.lit(None).cast(_SPANS).alias("spans"))
    verdicts = cold.unionByName(warm).unionByName(whole)
    found = some.join(verdicts, ["anchor", "sig"])
    first, last = F.shiftright("place", 6).cast("int"), F.col("place").bitwiseAND(F.lit(63)).cast("int")
    spans = F.when(F.col("spans").isNull(), F.array(F.struct(first.alias("a"), (first + last).alias("b")))).otherwise(F.transform("spans", lambda s: F.struct((s["a"] + first).alias("a"), (s["b"] + first).alias("b"))))
    return found.select("t1", "t2", spans.alias("spans")).groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept(docs: DataFrame, text: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(t1, t2, n_words, n_removed, kept): each distinct text of docs without the words that repeated windows cover.

    t1 and t2 are the halves of the text's MD5. A null text counts as empty. Copies of a text repeat one another."""
    texts = _texts(docs, text)
    shards = max(64, docs.count() // 200)
    found = repeats(docs, text, texts, shards, window, hot)

    def run(batches):
        for batch in batches:
            n_words, n_removed, left = [], [], []
            for t, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = t.as_py().encode().split()
                n_words.append(len(words))
                if spans.is_valid:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in spans.as_py():
                        edges[s["a"]] += 1
                        edges[s["b"] + window] -= 1
                    covered = np.cumsum(edges[:-1]) > 0
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                n_removed.append(n_words[-1] - len(words))
                left.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())], names=["t1", "t2", "n_words", "n_removed", "kept"])

    return texts.join(found, ["t1", "t2"], "left").select("t1", "t2", "n", "text", "spans").mapInArrow(run, "t1 long, t2 long, n_words long, n_removed long, kept string")


def _halves(text: str) -> list:
    """Two longs that name a text."""
    t = F.md5(F.coalesce(F.col(text), F.lit("")))
    half = lambda i: F.conv(F.substring(t, i, 16), 16, -10).cast("long")
    return [half(1).alias("t1"), half(17).alias("t2")]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(t1, t2, n, text): each distinct text once, with how many rows have it."""
    return docs.select(*_halves(text), F.coalesce(text, F.lit("")).alias("text")).groupBy("t1", "t2").agg(F.count("*").alias("n"), F.first("text").alias("text"))


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and, in place of the text, what is left of it (words joined by one space)."""
    left = kept(docs, text, window).withColumnsRenamed({"kept": "__kept", "t1": "__t1", "t2": "__t2"})
    rows = docs.drop("n_words", "n_removed").select("*", *(h.alias(n) for h, n in zip(_halves(text), ("__t1", "__t2"), strict=True))).drop(text)
    return rows.join(left, ["__t1", "__t2"]).drop("__t1", "__t2").withColumnRenamed("__kept", text)


def op4_suffix_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    left = kept(docs).select("t1", "t2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *_halves("text")).join(left, ["t1", "t2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT doc_id, list(i ORDER BY i) AS st FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1 GROUP BY doc_id),
cov AS (SELECT doc_id, list_distinct(flatten(list_transform(st, lambda s: range(s, s + 35)))) AS ps FROM rep),
gone AS (SELECT doc_id, unnest(ps) AS p FROM cov),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
left_ AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (doc_id)
"""
