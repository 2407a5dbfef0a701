import random
import re

import pytest
from pyspark.sql import functions as F

from hybridspark.functions.numbers import last_at_most, running_sums
from hybridspark.operators import chunking as C
from hybridspark.operators import spans as S


def prose(rng, n):
    """Sentences of all lengths, with all kinds of white space between and within them."""
    word = lambda: "".join(rng.choice("abcé漢😀.") for _ in range(rng.randrange(1, 12)))
    gap = lambda: rng.choice([" ", "  ", "\n\n", "\t", " ", "  "])
    return gap() + "".join(word() + (rng.choice(".!?") if rng.random() < 0.2 else "") + gap() for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return [None, "", " \n ", "One.", "no end " * 400, "A. B! C? ", *(prose(rng, rng.randrange(1, 120)) for _ in range(60)), prose(rng, 4000)]


def test_chunks_are_those_of_chunk_and_lie_where_they_say(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    for how in ({"mode": "fixed", "max_size": 90, "overlap": 2}, {"mode": "fixed"}, {"max_size": 60, "min_size": 30}, {"max_size": 40, "min_size": 200, "threshold": 0.9}):
        want = {}
        for r in C.chunk(df, **how).orderBy("doc_id", "chunk_index").collect():
            want.setdefault(r.doc_id, []).append(r.text)
        got = {r.doc_id: r["__spans"] for r in S.chunk_spans(df, **how).collect()}
        assert {k: [s.text for s in v] for k, v in got.items()} == want
        for k, spans in got.items():
            for s in spans:
                own = texts[k][s.begin : s.end]
                assert own == own.strip() and re.split(r"\s+", own) == re.split(r"\s+", s.text)
            if how.get("mode") != "fixed":
                assert all(a.end <= b.begin for a, b in zip(spans, spans[1:]))


def test_vectors_give_the_same_chunks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    embed = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("double"))
    same = lambda c: F.array(F.length(c).cast("double"), F.lit(3.0))
    want = sorted((r.doc_id, r.chunk_index, r.text) for r in C.chunk(df, embed=same, threshold=0.98, max_size=80).collect())
    got = S.chunk_spans(df, embed=same, threshold=0.98, max_size=80).select("doc_id", F.posexplode("__spans").alias("i", "s")).collect()
    assert sorted((r.doc_id, r.i, r.s.text) for r in got) == want and callable(embed)


def test_what_stands_at_a_chunk_agrees_with_a_loop(spark):
    rng = random.Random(2)
    rows, want = [], []
    for i in range(40):
        parts = [(prose(rng, rng.randrange(1, 40)), p, f"s{rng.randrange(3)}") for p in range(rng.randrange(1, 9))]
        begins, text = [], ""
        for p, _, _ in parts:
            text += "\n\n" if text else ""
            begins.append(len(text))
            text += p
        rows.append((i, text, begins, [p for _, p, _ in parts], [s for _, _, s in parts], "kept"))
        want.append((begins, parts))
    df = spark.createDataFrame(rows, "doc_id int, text string, begins array<int>, pages array<int>, names array<string>, chunk_index string")
    got = S.located(df, "begins", {"page": "pages", "section": "names"}, mode="fixed", max_size=70).collect()
    assert len(got) > 100 and set(got[0].asDict()) == {"doc_id", "chunk_index", "text", "begin", "end", "page", "section"}
    for r in got:
        begins, parts = want[r.doc_id]
        at = max(k for k, b in enumerate(begins) if b <= r.begin)
        assert (r.page, r.section) == parts[at][1:]


def test_sums_and_places(spark):
    values = [[], [3], list(range(300)), [2] * 128, [1] * 129]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>").select("v", running_sums(F.col("v")).alias("s"))
    assert all(r.s == [sum(r.v[:i]) for i in range(len(r.v))] for r in df.collect())
    rows = [([], 1), ([5], 4), ([5], 5), ([1, 1, 4, 9], 1), ([1, 1, 4, 9], 8), ([1, 1, 4, 9], 99)]
    df = spark.createDataFrame(rows, "v array<int>, x int").select(last_at_most(F.col("v"), F.col("x")).alias("at"))
    assert [r.at for r in df.collect()] == [-1, -1, 0, 1, 2, 3]
