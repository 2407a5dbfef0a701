import random
from collections import Counter

import corpus_pipeline as P
from hybridspark.llm import simhash
from hybridspark.llm.common import cut

from .conftest import SCHEMA


def test_stages_on_awkward_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, ""))
        ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name == "language":
            assert not {0, 1, 2, 3} & set(ids) and ids[7] == 2 and ids[None] == 1
        if name == "near_duplicates":
            assert set(ids.values()) == {1} and 5 in ids and not {6, 7} & set(ids) and {100 + i for i in range(40)} <= set(ids)
        if name != "tokens":
            assert docs.columns == columns
    assert docs.where("not round_trip").count() == 0 and max(ids.values()) <= 3


def test_secrets_are_replaced(spark):
    hexa = "0123456789abcdef" * 2
    rows = [(1, f"key {hexa} end", "en", "s1", 10), (2, "plain", "en", "s1", 5), (3, None, None, None, None), (4, f'token = "{hexa}00" é', "en", "s2", 1)]
    rows += [(10 + i, f"shown {'ab12' * 8}", "en", f"s{i}", 38) for i in range(5)]
    got = {r.doc_id: (r.text, r.n_chars) for r in P.secret_scan(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got[1] == ("key [SECRET] end", 16) and got[2] == ("plain", 5) and got[3] == (None, None)
    assert got[4] == ('[SECRET]" é', 11) and got[10] == (f"shown {'ab12' * 8}", 38)


def test_near_copies_go_and_others_stay(spark, rows):
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA)
    kept = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    assert 5 in kept and not {6, 7} & kept and {4, 9, 10, 11} <= kept


def test_near_copies_go_in_a_family_with_a_shared_passage(spark):
    # the passage alone decides every fingerprint, so all texts share theirs; the tails decide the similarity
    rng = random.Random(9)
    rows = []
    for i in range(40):
        tail = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        for j, words in enumerate((tail, [*tail[:-1], "changed"])):
            text = "alpha beta gamma delta epsilon " * 60 + " ".join(words)
            rows.append((i + 100 * j, text, "en", "s1", len(text)))
    assert len({simhash.simhash(r[1], P.SHINGLE) for r in rows}) == 1
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))


def test_empty_tables(spark, none):
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_last_stages_on_rows_as_they_are(spark, rows):
    """Nulls, blanks and repeated rows that earlier stages would have taken away."""
    short = [r for r in rows if len(r[1] or "") < 3000]
    assert Counter(r[0] for r in short)[7] == 2
    docs = spark.createDataFrame(short, SCHEMA).repartition(2)
    plain = lambda rs: Counter(tuple(r) for r in rs)
    assert plain(P.secret_scan(spark, docs, "").collect()) == plain(short)
    mixed = plain(P.source_mix(spark, docs, "").select("doc_id", "text", "source").collect())
    given = plain((r[0], r[1], r[3]) for r in short)
    assert mixed and all(n <= 3 * given[r] for r, n in mixed.items()) and {r[2] for r in mixed} == {r[2] for r in given if r[1] and r[1].strip()}
    coded = P.tokens(spark, docs, "").collect()
    assert Counter(r.doc_id for r in coded) == Counter(r[0] for r in short) and all(r.round_trip and len(r.ids) == r.n_tokens for r in coded)
    assert all((r.n_tokens == 0) == (not texts[r.doc_id]) for texts in [{r[0]: r[1] for r in short}] for r in coded if r.doc_id is not None)
