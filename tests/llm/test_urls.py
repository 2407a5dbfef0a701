import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridspark.llm import urls as M

from .conftest import agrees_with_sql

RULES = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.com", "", "block"), ("example.com", "/x", "allow"), ("example.com", "/x", "block")]
URLS = [None, "", "no scheme/at/all", "http://", "http:///path", "HTTP://A.EXAMPLE.org/es/1", "ftp://xexample.org/es/1", "https://example.org/en/12?x=1#f", "https://org", "https://org/", "http://www.com/de/5/", "http://com/fr/", "http://a.example.com", "http://b.a.example.com/fr/q", "http://example.com/x/y", "x://y.example.net/p?b=2&a=1", "x://y.example.net/p/?utm_q=1&a=1&b=2#z", "https://u:p@Y.example.net:443/p?a=1&b=2", "http://é.example.net/ä?ö", "http://h.net/a://b", "http://h.net?q=/no/path", "http://h.net#f/p", "http://h.net/" + "long/" * 5000, "http://y.example.net./p?a=1&b=2"]


def parts(url):
    rest = url.partition("://")[2] if url else ""
    found = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest)
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1])
    return lower, found[2], found[3] or ""


def canonical(url):
    host, path, query = parts(url)
    name = re.sub(r"\.?(:(80|443)?)?$", "", host.rpartition("@")[2])
    kept = sorted(p for p in query.split("&") if p and not p.startswith("utm_"))
    return (name + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")) if name else None


def plain(url, listed):
    host, path, _ = parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    rule = max(fits, default=None)
    hit = canonical(url) in listed and canonical(url) is not None
    return host, path, rule and rule[3], rule[4] if rule else "block" if hit else "allow", canonical(url), hit


@pytest.mark.parametrize("most_blocks", [1, 1 << 20])
def test_agrees_with_a_plain_version(spark, most_blocks):
    """With a filter of one block nearly every URL passes it; the exact join then decides."""
    rng = random.Random(4)
    urls = URLS + [f"http://h{rng.randrange(50)}.net/p{rng.randrange(40)}{rng.choice(['', '/', '?b=1&a=2', '#x'])}" for _ in range(400)] + ["http://hot.net/same"] * 300
    rows = [(i if i % 7 else None, u) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "listed", "maybe", "canonical", "block", "key")}).repartition(5)
    bad = [u for i, u in enumerate(urls) if i % 3 == 0] + [None, "nothing"]
    listed = spark.createDataFrame([(u, "x") for u in bad], "url string, canonical string")
    got = sorted(map(str, (tuple(r) for r in M.judge(pages, listed, RULES, most_blocks=most_blocks).collect())))
    known = {canonical(u) for u in bad} - {None}
    assert got == sorted(str((i, *plain(u, known))) for i, u in rows)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    urls = spark.range(20000).select("id", F.concat(F.lit("h.net/"), F.col("id").cast("string")).alias("url"))
    bloom = M.blocked_bloom(urls.where("id < 5000").select("url"))
    assert bloom.shape == (256, M.WORDS) and bloom.dtype == np.uint64
    got = M.may_be_listed(urls.select(F.col("url").alias("canonical"), F.col("id")), bloom).groupBy(F.col("id") < 5000).agg(F.count_if("maybe").alias("n")).collect()
    n = {r[0]: r.n for r in got}
    assert n[True] == 5000 and n[False] < 75


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://h.net/a"), (2, None)], "page_id long, url string")
    assert M.judge(none, some).count() == 0
    assert {(r.page_id, r.verdict, r.listed) for r in M.judge(some, none).collect()} == {(1, "allow", False), (2, "allow", False)}
    with pytest.raises(ValueError):
        M.judge(some, none, [(f"h{i}", "/", "allow") for i in range(M.MOST_RULES + 1)])


def test_query_agrees_with_sql(spark):
    agrees_with_sql(spark, M.op12_blocked_bloom_url_filter, M.OP12_SQL)
