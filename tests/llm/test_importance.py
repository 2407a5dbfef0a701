import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hybridspark.llm import importance as M

from .conftest import CLASHES, agrees_with_sql, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n=1, buckets=M.BUCKETS):
    words = WORD.findall((text or "").translate(FOLD))
    runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain(rows, target, n=1, buckets=M.BUCKETS, least=M.LEAST_WORDS, share=M.SHARE):
    """(id, n_features, weight, score, rank) of rows (id, text), by the contract."""
    found = [(i, *grams(t, n, buckets)) for i, t in rows]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for x in target for b in grams(x, n, buckets)[1])
    size, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in s}
    out = []
    for i, words, f in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = len(able) * share // 100
    ranks = {id(r): k + 1 for k, r in enumerate(able[:drawn])}
    return sorted(([*r[:4], ranks.get(id(r))] for r in out), key=str)


def listed(df):
    return sorted(([r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")] for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "buckets"), [(1, 10000), (3, 97), (2, 65536)])
def test_agrees_with_a_plain_version(spark, docs, rows, n, buckets):
    target = [prose(random.Random(3), 300), None, "", "ünï CÖDÉ One."]
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    got = M.resample(docs.withColumn("rank", F.lit("x")), aim, n=n, buckets=buckets, least_words=5, share=30)
    want = plain([(r[0], r[1]) for r in rows], target, n, buckets, 5, 30)
    assert listed(got) == want
    assert set(got.columns) == {"doc_id", "n_features", "weight", "score", "rank"} and sum(r[4] is not None for r in want) > 5
    assert "n" in CLASHES


def test_pieces_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    text = " ".join("é" * rng.randrange(1, 9) + f"-A{rng.randrange(99)}" for _ in range(500))
    whole = grams(text, 3)
    for piece in (1, 7, 64, 5000):
        monkeypatch.setattr(M, "PIECE", piece)
        words, parts = M.features(text.encode(), 3)
        assert (words, Counter(int(b) for p in parts for b in p)) == (whole[0], Counter(whole[1]))


def test_sort_count(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(i))) for i in range(40)], "doc_id long, text string").repartition(5)
    want = Counter(b for r in df.collect() for b in grams(r.text)[1])
    assert {r.bucket: r.n for r in M.counts(M.streams(df)).collect()} == dict(want)
    assert M.encoded(M.np.array([], "<u2"))[1].tolist() == []


def test_empty_tables_and_bounds(spark, none):
    aim = spark.createDataFrame([("some words",)], "text string")
    assert M.resample(none, aim).count() == 0
    rows = [(i, prose(random.Random(i), 30)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(M.resample(df, aim.limit(0))) == plain(rows, [])
    with pytest.raises(ValueError):
        M.streams(df, buckets=70000)


def test_query_agrees_with_sql(spark):
    agrees_with_sql(spark, M.op11_importance_resampling, M.OP11_SQL)
