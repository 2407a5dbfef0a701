"""The corpus pipeline: language ID, near-duplicates, secrets, source mix, tokens.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the one before it kept; run() writes each
result to the shared folder and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridspark.llm import bpe, langid, mixing, secrets, simhash
from hybridspark.llm.common import cut, read

#: Texts that are less like every known language than this are rejected, as are those without letters.
MIN_LIKENESS = 0.2
#: Words of a shingle, and the similarity from which on one of two documents goes.
SHINGLE, SIMILAR = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that resemble no language. Profiles are learned from the rows that name one.

    Null and empty texts are rejected, and so is everything if no row names a language."""
    judged = langid.predict(docs, langid.learn(docs))
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LIKENESS)).select(docs.columns)


def _same(a: str, b: str, *names: str) -> Column:
    return reduce(Column.__and__, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, null last, and once if repeated.

    Texts that SimHash or its bands bring together are linked if they share 0.8 of their five-word shingles, without
    regard to case, so that clean documents are left alone. Null, empty and blank texts are copies of one another."""
    place = F.md5(F.concat_ws("|", F.md5(F.coalesce("text", F.lit(""))), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))).alias("__place")
    stay = simhash.near_texts(docs, SHINGLE, SIMILAR).groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.md5(F.concat_ws("|", "first.md5", F.coalesce(F.col("first.key").cast("string"), F.lit("none")))).alias("__place"))
    return docs.select("*", place).join(stay, "__place").dropDuplicates(["__place"]).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With [SECRET] in place of each span that looks live; widely copied examples stay. n_chars follows the new text.

    Every row stays: null and empty texts have no spans and come through as they are, with their n_chars; repeated rows
    are all rewritten; a null doc_id is matched like any other; null sources are one owner. An empty table stays empty."""
    spans = secrets.scan(docs).where(F.exists("spans", lambda s: s["live"])).dropDuplicates(["key", "sha"])
    spans = spans.select(F.col("key").alias("doc_id"), "sha", F.filter("spans", lambda s: s["live"]).alias("spans"))
    found = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("d").join(spans.alias("s"), _same("d", "s", "doc_id", "sha"), "left").select("d.*", "s.spans")
    nothing = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["text"], gap, F.when(s["start"] < acc["at"], "").otherwise("[SECRET]")).alias("text"))

    cleaned = F.aggregate("spans", nothing, step, lambda acc: F.concat(acc["text"], F.substring("text", acc["at"] + 1, F.length("text"))))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cleaned)
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: some not at all, some up to three times.

    A null source is a source of its own. Null, empty and blank texts have no words, so no copy of them moves a source
    towards its target. Rows alike in doc_id, source and text are counted one by one and come out as often as all of them
    together are taken. An empty table stays empty."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source")).where("copies > 0")
    taken = mixed.groupBy("doc_id", "source", "tie").agg(F.sum("copies").cast("int").alias("copies"))
    # repeated rows once, as mix() has counted each of them
    rows = docs.withColumn("tie", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "source", "tie"])
    out = rows.alias("d").join(taken.alias("t"), _same("d", "t", "doc_id", "source", "tie"))
    return out.select(*(f"d.{c}" for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("t.copies")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding the ids gives the text again.

    A row for each row of docs, repeated ones included. Null counts as empty: no ids, and the round trip holds. An empty
    table stays empty."""
    import public_tokenizers as public

    ranks = public.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text"), ranks, public.PATTERN)
    # written between the two, else each task would keep two Python workers with the ranks
    back = bpe.decode(cut(encoded), ranks, public.PATTERN)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mix", source_mix), ("tokens", tokens)]

#: SQL can express neither the fingerprints nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
