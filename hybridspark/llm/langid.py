"""Language identification by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

import sys
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

#: n-grams of a profile.
TOP = 400
#: The answer for texts without letters.
UNKNOWN = "und"
#: n-grams that a task holds before it counts them.
_HELD = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def grams(text: str | None) -> np.ndarray:
    """The n-grams of a text, each as often as it occurs: runs of one to three characters of a word, which is a run of
    letters in lower case with a blank at either end; the blank alone is none. An n-gram is a number that sorts as its
    characters do: 21 bits each for its code points plus 1, where a blank has code point 0."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    inside = _letters()[c]
    if not inside.any():
        return np.zeros(0, dtype=np.int64)
    c = np.concatenate([[0], np.where(inside, c, 0), [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])] + 1
    one = c[c > 1] << 42
    two = (c[:-1] << 42) + (c[1:] << 21)
    three = (c[:-2] << 42) + (c[1:-1] << 21) + c[2:]
    return np.concatenate([one, two, three[c[1:-1] > 1]])


def ranking(text: str | None, top: int) -> np.ndarray:
    """The most frequent n-grams of a text; ties by code point."""
    found, n = np.unique(grams(text), return_counts=True)
    return found[np.lexsort((found, -n))[:top]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """For each language its most frequent n-grams over all rows of docs that have a language.

    Each task counts its own rows; only (language, n-gram, count) is shuffled, and top rows a language reach the driver."""

    def count(batches):
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            sizes: Counter = Counter()
            totals: dict[str, Counter] = {}

            def add(label: str) -> None:
                found, n = np.unique(np.concatenate(held.pop(label)), return_counts=True)
                totals.setdefault(label, Counter()).update(dict(zip(found.tolist(), n.tolist(), strict=True)))
                sizes[label] = 0

            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(label, []).append(grams(t))
                sizes[label] += len(held[label][-1])
                if sizes[label] >= _HELD:
                    add(label)
            for label in list(held):
                add(label)
            rows = [(label, g, n) for label, c in totals.items() for g, n in c.items()]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "gram", "n"])

    found = docs.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(count, "lang string, gram long, n long")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for r in found.orderBy("lang", "rank").select("lang", "gram").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Judge:
    """Compares a text with each profile."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP) -> None:
        self.top, self.langs = top, sorted(profiles)
        self.codes = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
        # of each n-gram its rank in each language's profile; -1 where it isn't in it
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language of the least out-of-place distance (ties: the first by name), and 1 less the share of the greatest possible distance."""
        mine = ranking(text, self.top)
        if not len(mine) or not len(self.codes):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == mine, self.ranks[:, at], -1)
        apart = np.where(ranks < 0, self.top, abs(ranks - np.arange(len(mine)))).sum(axis=1)
        k = int(np.argmin(apart))
        return self.langs[k], 1 - float(apart[k]) / (self.top * len(mine))


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", top: int = TOP) -> DataFrame:
    """docs with lang_pred and score (0 to 1); both are replaced if docs has them.

    Null texts, and texts without letters, get 'und' and 0."""
    docs = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text)

    def run(batches):
        judge = Judge(profiles, top)
        for batch in batches:
            got = [judge.judge(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; rows without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op9_rank_order_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), profiles).drop("text")
