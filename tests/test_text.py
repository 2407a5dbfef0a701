import json
import re

import pytest
from pyspark.sql import functions as F

from hybridspark.functions import numbers as N
from hybridspark.functions import text as X

TEXTS = ["état caffè ISO-9001 foo- of the with AI", "", "...", None, "It's a  test.\nNext one!  And? yes", "a b. c", "x" * 250]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("c")).first().c


def plain_tokens(text):
    found = re.findall(r"\b[a-z0-9][\w-]*\b", text.lower())
    return [t for t in found if t not in X.STOP_WORDS or len(t) <= 2]


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_and_sentences(spark, text):
    got = one(spark, text, X.tokens(F.col("t")))
    assert got == (None if text is None else plain_tokens(text))
    if text is not None:
        want = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]
        assert one(spark, text, X.sentences(F.col("t"))) == want


def test_short_stop_words_stay():
    assert plain_tokens("of the it is state-of-the-art") == ["of", "it", "is", "state-of-the-art"]
    assert len(X.STOP_WORDS) == len(set(X.STOP_WORDS))


def test_cuts(spark):
    assert one(spark, "x" * 201, X.snippet(F.col("t"))) == "x" * 200 + "..." and one(spark, "x" * 200, X.snippet(F.col("t"))) == "x" * 200
    assert one(spark, "\t AB" + "c" * 300, X.identity_key(F.col("t"))) == ("ab" + "c" * 300)[:200]
    assert one(spark, " a, ,b ,", X.tags(F.col("t"))) == ["a", "b"]
    assert one(spark, "/x/y.PDF", X.extension(F.col("t"))) == ".pdf" and one(spark, "/x/y", X.extension(F.col("t"))) == ""
    assert one(spark, "in_progress_now", X.first_underscore(F.col("t"))) == "in progress_now"
    assert one(spark, "Sparse+graph", X.source_badges(F.col("t"))) == ["sparse", "graph"] and one(spark, None, X.source_badges(F.col("t"))) == ["dense"]


def test_templates(spark):
    assert one(spark, "b", X.fill("a {t} {{x}} {t}", t=F.col("t"))) == "a b {x} b"
    with pytest.raises(KeyError):
        X.fill("{missing}")


@pytest.mark.parametrize(
    ("answer", "status", "gaps"),
    [('{"status": "met", "gaps": ["a"]}', "met", ["a"]), ("not json", "unknown", []), ("", "unknown", []), ('{"status": ', "unknown", []), ("[1, 2]", None, None), ('{"x": 1}', None, None)],
)
def test_assessments(spark, answer, status, gaps):
    got = one(spark, answer, X.assessment(F.col("t")))
    assert ((got.status, got.gaps) if got else (None, None)) == (status, gaps)
    if status == "unknown":
        assert got.explanation == answer


def test_requirements(spark):
    got = one(spark, "prose", X.requirements(F.col("t")))
    assert [tuple(r) for r in got] == [("prose", "general", "medium")]
    got = one(spark, '[{"text": "a", "category": "c", "priority": "high"}]', X.requirements(F.col("t")))
    assert [tuple(r) for r in got] == [("a", "c", "high")]


def test_embedded_json(spark):
    assert one(spark, 'so {"a": {"b": 1}} there', X.json_span(F.col("t"))) == '{"a": {"b": 1}}'
    assert one(spark, "none", X.json_span(F.col("t"))) is None


def test_rich_text(spark):
    tree = one(spark, "one\n\n \n\ntwo\nlines", X.rich_text(F.col("t")))
    assert [n["content"][0]["text"] for n in json.loads(tree)["content"]] == ["one", "two\nlines"]
    assert one(spark, tree, X.plain_text(F.col("t"))) == "one\n\ntwo\nlines"
    assert one(spark, '{"text": "bare"}', X.plain_text(F.col("t"))) == "bare"


def test_numbers(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], 1, 0)], "a array<double>, z array<double>, n int, d int").select(
        N.cosine(F.col("a"), F.col("a")).alias("same"),
        N.cosine(F.col("a"), F.col("z")).alias("zero"),
        N.normalized(F.col("a")).alias("unit"),
        N.percent(F.col("n"), F.lit(8)).alias("p"),
        N.percent(F.col("n"), F.col("d")).alias("none"),
        N.or_default(F.col("d"), 7).alias("default"),
        N.cpu_percent(F.lit(5), F.lit(1), F.lit(9), F.lit(9), F.lit(2)).alias("cpu"),
        N.band(F.lit(0.8)).alias("band"),
    ).first()
    assert (row.same, row.zero, row.unit, row.p, row.none, row.default, row.cpu, row.band) == (1.0, 0.0, [0.6, 0.8], 13, 0, 7, 0.0, "medium")


def test_deadlines(spark):
    hours = {"none": None, "-1h": -1, "-25h": -25, "+1h": 1, "7d": 168, "14d": 336, "15d": 360}
    df = spark.createDataFrame(list(hours.items()), "name string, h int").withColumn("due", F.expr("timestamp'2024-01-10 00:00:00' + make_interval(0, 0, 0, 0, h)"))
    flags = N.deadline_flags(F.col("due"), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    got = {r.name: (r.urgent, r.past, r.pending) for r in df.select("name", *(c.alias(n) for n, c in flags.items())).collect()}
    no = (False, False, False)
    assert got == {"none": no, "-1h": no, "-25h": (False, True, False), "+1h": (True, False, True), "7d": (True, False, True), "14d": (False, False, True), "15d": no}
