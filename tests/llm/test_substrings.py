import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridspark.llm import substrings as M

from .conftest import agrees_with_sql, prose


def brute(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def corpus():
    rng = random.Random(8)
    shared = [prose(rng, n) for n in (34, 35, 36, 60, 200)]
    texts = [None, "", "a b", " ".join(["again"] * 100), prose(rng, 36) + " x\x1fy"]
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 60)) for _ in range(3)]
        texts.append(f"{parts[0]} {rng.choice(shared)}\n{parts[1]}\t{rng.choice(shared)} {parts[2]}")
    edited = texts[10].split()
    edited[len(edited) // 2] = "edited"
    twice = prose(rng, 50)
    return [*texts, texts[7], texts[7], " ".join(edited), f"{twice} between {twice}", "Common line of ten words that comes up very often. " * 9]


@pytest.mark.parametrize("hot", [M.HOT, 1])
def test_agrees_with_brute_force(spark, hot):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    left = M.kept(df, hot=hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.select("doc_id", *M._halves("text")).join(left, ["t1", "t2"]).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_hot_anchors_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "_HOT_ANCHORS", 20)
    texts = [*corpus(), *(f"{i} " + "one very common passage of many words that stands in every text and has no end " * 4 + f"{i}" for i in range(80))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.select("doc_id", *M._halves("text")).join(M.kept(df), ["t1", "t2"]).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_automaton_counts_occurrences():
    rng = random.Random(2)
    rows = [[rng.randrange(3) for _ in range(rng.randrange(4, 40))] for _ in range(12)]
    a = M.Automaton()
    for r in rows:
        a.add(r, 1)
    a.close()
    seen = Counter(tuple(r[i : i + 4]) for r in rows for i in range(len(r) - 3))
    for r in rows:
        assert a.repeated(r, 4) == [i for i in range(len(r) - 3) if seen[tuple(r[i : i + 4])] > 1]


def test_edges(docs, rows, none):
    got = M.remove_repeats(docs)
    assert got.count() == len(rows) and got.columns.count("n_words") == 1
    assert M.remove_repeats(none).count() == 0
    assert got.where("t1 <> 'x' or size <> 'x'").count() == 0
    want = Counter((a, b, hashlib.sha256(c.encode()).hexdigest()) for a, b, c in brute([t for _, t, *_ in rows]))
    assert Counter((r.n_words, r.n_removed, r.h) for r in got.select("n_words", "n_removed", F.sha2("text", 256).alias("h")).collect()) == want


def test_words_and_pieces(monkeypatch):
    """Words of texts laid end to end are those of each text; equal windows have equal anchors and lie in one piece."""
    rng = random.Random(1)
    pad = lambda: " \t" * rng.randrange(2)
    texts = ["", " ", "a", *(pad() + " ".join(rng.choice("ab") * rng.randrange(1, 4) for _ in range(rng.randrange(90))) + pad() for _ in range(60)), "", "x y é"]
    texts = [t.encode() for t in texts]
    data, starts = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    for block in (M._BLOCK, 7):
        monkeypatch.setattr(M, "_BLOCK", block)
        h, bounds = M.word_hashes(data, starts)
        words = [w for t in texts for w in t.split()]
        assert list(np.diff(bounds)) == [len(t.split()) for t in texts]
        assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
        covered, anchors, sigs = [], {}, {}
        for anchor, sig, text, first, n in zip(*(x.tolist() for x in M.pieces_of(h, bounds, 12, 4)), strict=True):
            w = texts[text].split()
            assert sigs.setdefault(sig, w[first : first + n + 11]) == w[first : first + n + 11]
            for i in range(first, first + n):
                covered.append((text, i))
                assert anchors.setdefault(tuple(w[i : i + 12]), anchor) == anchor
        assert covered == [(t, i) for t, x in enumerate(texts) for i in range(len(x.split()) - 11)]


def test_agrees_with_sql(spark):
    agrees_with_sql(spark, M.op4_suffix_automaton_dedup, M.OP4_SQL)
