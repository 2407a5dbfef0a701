import hashlib
import random

from pyspark.sql import functions as F

from hybridspark.llm import minhash as M

from .conftest import prose


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        a = prose(rng, rng.choice([12, 80, 600])).split()
        b = list(a)
        for _ in range(rng.randrange(0, max(1, len(a) // 8))):
            b[rng.randrange(len(b))] = "x"
        rows.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = df.select("i", M.likeness(M.sketch(F.col("a")), M.sketch(F.col("b"))).alias("s")).collect()
    wrong = [r.s - len(shingles(rows[r.i][1]) & shingles(rows[r.i][2])) / len(shingles(rows[r.i][1]) | shingles(rows[r.i][2])) for r in got]
    assert abs(sum(wrong) / len(wrong)) < 0.03 and sorted(map(abs, wrong))[48] < 0.12


def test_equal_texts_and_unlike_ones(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(prose(rng, 300), prose(rng, 300))], "a string, b string")
    s = lambda c: M.sketch(F.col(c))
    r = df.select(M.likeness(s("a"), s("a")).alias("same"), M.likeness(s("a"), s("b")).alias("other"), M.likeness(M.sketch(F.lit(None).cast("string")), M.sketch(F.lit(""))).alias("none")).first()
    assert r.same == 1.0 and r.other < 0.1 and r.none == 1.0


def test_next_row_by_key(spark):
    keys = random.Random(2).sample(range(-(10**12), 10**12), 3000)
    df = spark.createDataFrame([(k, f"t{k}") for k in keys] + [(None, "lost"), (None, "lost")], "k long, t string").repartition(5)
    got = {r.k: r.n for r in M.with_next(df, "k", {"n": F.col("t")}).collect() if r.k is not None}
    order = sorted(keys)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert [r.n for r in M.with_next(df, "k", {"n": F.col("t")}).where("k is null").collect()] == [None, None]
    assert M.with_next(df.limit(0), "k", {"n": F.col("t")}).count() == 0


def test_query_over_a_table(spark, rows, tmp_path):
    rows = [r for r in rows if r[0] is not None and r[0] != 7]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in M.op1_minhash_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = a[1] or "", b[1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (got[a[0]].n_chars, got[a[0]].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(got[a[0]].fingerprint) == 256 and 0 <= got[a[0]].near_edited <= 1
    assert got[5].fingerprint == got[6].fingerprint


def plain_likeness(a, b):
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


def test_query_with_null_and_repeated_ids(spark, rows, tmp_path):
    """Every row comes back once; rows without an id have no next one; equal ids follow one another in some order."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op1_minhash_fingerprints(spark, str(tmp_path)).collect()
    prints = spark.createDataFrame([(r[1],) for r in rows], "t string").distinct().select("t", M.as_string(M.sketch(F.col("t"))).alias("f")).collect()
    prints = {r.t or "": r.f for r in prints}
    edits = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    want = lambda i, t, n: (i, len(t), prints[t], edits(t, n or ""), 0.0 if n is None else round(plain_likeness(prints[t], prints[n]), 9))
    have = sorted((r.doc_id, r.n_chars, r.fingerprint, r.edited_sha256, round(r.near_next, 9)) for r in got if r.doc_id is not None)
    known = sorted(((r[0], r[1] or "") for r in rows if r[0] is not None), key=lambda r: r[0])
    at = [i for i, r in enumerate(known) if r[0] == 7]
    assert len(at) == 2
    orders = [known, [*known[: at[0]], known[at[1]], known[at[0]], *known[at[1] + 1 :]]]
    assert have in [sorted(want(a[0], a[1], b[1]) for a, b in zip(o, o[1:] + o[:1], strict=True)) for o in orders]
    lost = sorted((r.doc_id, r.n_chars, r.fingerprint, r.edited_sha256, r.near_next) for r in got if r.doc_id is None)
    assert lost == sorted(want(None, r[1] or "", None) for r in rows if r[0] is None)
    assert all(abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9 for r in got)
