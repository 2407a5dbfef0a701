import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own; inputs may have them too.
CLASHES = ("size", "slot", "shard", "fingerprint", "component_id", "ids", "score", "lang_pred", "spans", "copies", "n", "key", "hash", "tie", "n_words", "target", "base", "nth", "t1", "sha", "no", "root", "part")


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and blank texts, a very long one, copies, repeated rows and near copies."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \t\n ", "!!! 123", "One.", base, base, " ".join(near), base.upper(), prose(rng, 40000), "ünï cödé 漢字 😀 " * 30, "same words " * 60]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    out += [(100 + i, prose(rng, rng.randrange(1, 90)), "en", f"s{i % 4}", 0) for i in range(40)]
    out += [(7, " ".join(near), "de", "s2", len(" ".join(near))), (None, "w5 w17 w120 w33 without an id", None, None, None), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def agrees_with_sql(spark, query, sql, sf="/root/testdata/sf0.001"):
    """A registered query gives the rows of its SQL over the smallest tables."""
    import glob
    import os

    import duckdb

    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = query(spark, sf)
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda r: str([float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r])
    assert sorted(plain(tuple(r)) for r in df.select(*names).collect()) == sorted(map(plain, found.fetchall()))
