import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from hybridspark.llm import langid as M

SOUNDS = {"aa": "the and ing tion er of".split(), "bb": "der und sch ein ich über".split(), "cc": "que los ción ado mente ñ".split()}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang), lang) for i in range(150) for lang in [rng.choice(sorted(SOUNDS))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    flags = {r.doc_id: r.h for r in df.select("doc_id", M.held_out(F.col("doc_id")).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    got = M.predict(df, M.learn(df.where(~M.held_out(F.col("doc_id"))))).where(M.held_out(F.col("doc_id"))).collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def code(gram):
    return sum(((0 if x == " " else ord(x)) + 1) << 21 * (2 - i) for i, x in enumerate(gram))


def counted(texts):
    count = Counter()
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        count.update(code(g) for w in words for k in (1, 2, 3) for i in range(len(w) + 3 - k) if (g := f" {w} "[i : i + k]) != " ")
    return count


def best(count, top):
    return sorted(sorted(count), key=count.__getitem__, reverse=True)[:top]


def test_profiles_count_every_row(spark, monkeypatch):
    monkeypatch.setattr(M, "_HELD", 500)
    rng = random.Random(6)
    rows = [(text(rng, "aa", 30), "aa") for _ in range(50)] + [(None, "aa"), ("", "aa"), ("the", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert M.learn(df, top=50) == {"aa": best(counted(t for t, lang in rows if lang), 50)}


def test_rankings_agree_with_counting(rows):
    for t in [t for _, t, *_ in rows if t and len(t) < 3000] + ["a", "x² ½ y_z 3d é'É ǅ ŉ", "１２ ٣", "a b  c"]:
        assert M.ranking(t, 40).tolist() == best(counted([t]), 40)


def test_edges(docs, none, rows):
    profiles = M.learn(docs)
    got = M.predict(docs, profiles)
    assert got.columns.count("score") == 1
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert und == {0, 1, 2, 3, None} and got.count() == len(rows)
    assert M.predict(none, profiles).count() == 0
    assert M.learn(none) == {}
    assert {r.lang_pred for r in M.predict(docs, {}).collect()} == {"und"}


def test_judge_agrees_with_counting():
    rng = random.Random(11)
    top = 60
    profiles = {lang: best(counted([text(rng, lang, 40)]), top) for lang in SOUNDS} | {"short": best(counted(["ab"]), top)}
    judge = M.Judge(profiles, top)
    for t in [text(rng, lang, rng.randrange(1, 40)) for lang in sorted(SOUNDS) * 10] + ["a", "zzz qqq", "the и и"]:
        mine = best(counted([t]), top)
        apart = {lang: sum(abs(p.index(g) - i) if g in p else top for i, g in enumerate(mine)) for lang, p in profiles.items()}
        least = min(sorted(apart), key=apart.__getitem__)
        lang, score = judge.judge(t)
        assert lang == least and abs(score - (1 - apart[least] / (top * len(mine)))) < 1e-12
    assert judge.judge("123 !") == judge.judge(None) == M.Judge({}).judge("abc") == (M.UNKNOWN, 0.0)
