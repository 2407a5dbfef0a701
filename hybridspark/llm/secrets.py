"""Secret scans with corpus-wide ownership frequency.

Candidates are found by regular expressions. Their hashes are counted by distinct repositories and owners over the
whole corpus: a value that many owners share, or that many repositories of few owners hold, is a copied example; one
that few own looks live. The counts go through partial aggregates, so a value in a third of all rows costs no more than
any other. The patterns run once over each text; only spans and hashes are written and shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, read, running

#: kind, pattern, group of the value, least length of the value; listed in order of precedence at one start. Shorter
#: runs of access and hex can't match in part, so their length stands in the pattern.
BASE = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further candidates: long runs with a digit, a capital and a small letter. They count if few own them.
OPAQUE = ("opaque", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
_ORDER = [k for k, *_ in BASE] + [OPAQUE[0]]
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Owners that a value may have before it counts as a widely copied example.
MAX_OWNERS = 2
#: Repositories that a value may be in, over all its owners, before it counts as copied: within one large owner too.
MAX_REPOSITORIES = 50


def find(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, value); code points, end exclusive.

    What lies between the matches comes from split(), so that running sums of lengths give the places."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    matches = F.arrays_zip(gaps.alias("gap"), F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.length(m)).alias("size"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    matches = F.filter(matches, lambda m: m["size"].isNotNull())

    def spans(found: Column) -> Column:
        before = running(F.transform(found, lambda m: m["gap"] + m["size"]))

        def span(m: Column, at: Column) -> Column:
            begin = (at + m["gap"]).cast("int")
            return F.struct(begin.alias("start"), F.lit(_ORDER.index(kind)).alias("kind"), (begin + m["size"]).alias("end"), m["value"].alias("value"))

        return F.filter(F.zip_with(found, before, span), lambda s: F.length(s["value"]) >= least)

    return F.when(text.rlike(pattern), let(matches, spans)).otherwise(F.array().cast(_SPAN))


def candidates(text: Column) -> Column:
    """All spans of the base kinds, and opaque runs that touch none of them, by start."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*(find(text, *b) for b in BASE))
    opaque = F.filter(find(text, *OPAQUE), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))

    def both(pair):
        return F.array_sort(F.concat(pair["base"], F.filter(pair["opaque"], lambda o: ~F.exists(pair["base"], lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))))

    return F.element_at(F.transform(F.array(F.struct(base.alias("base"), opaque.alias("opaque"))), both), 1)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, _ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repositories, n_owners) of found (value, owner, repository); nulls are one owner, one repository."""
    seen = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    seen = seen.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return seen.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """For each row of docs its key, sha (of its text) and spans (start, kind, end, value hash, n_owners,
    n_repositories, live), by start and kind.

    Base spans are always there, whoever owns them; opaque ones only where they look live: max_owners own the value at
    most, in max_repositories at most. A null or empty text has no spans. Repeated rows come back as often as they are in docs."""
    hashed = F.transform(candidates(F.col(text)), lambda s: s.withField("value", F.sha2(s["value"], 256)))
    # written once, as each use would run the patterns over all texts again
    rows = cut(docs.select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha"), hashed.alias("c")))
    some = rows.where(F.size("c") > 0)
    loose = some.select("key", "sha", "owner", "repository", F.explode("c").alias("s"))
    counts = ownership(loose.select(F.col("s.value").alias("value"), "owner", "repository"))
    judged = loose.select("key", "sha", "s", F.col("s.value").alias("value")).join(counts, "value")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    judged = judged.where((F.col("s.kind") < len(BASE)) | live)
    span = F.struct("s.start", "s.kind", "s.end", "value", "n_owners", "n_repositories", live.alias("live"))
    spans = judged.groupBy("key", "sha").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    a, b = some.select("key", "sha").alias("a"), spans.alias("b")
    some = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.sha") == F.col("b.sha")), "left").select("a.key", "a.sha", "b.spans")
    none = rows.where(F.size("c") == 0).select("key", "sha", F.lit(None).alias("spans"))
    kind = spans.schema["spans"].dataType
    return some.unionByName(none.withColumn("spans", F.col("spans").cast(kind))).withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def n(field: str, value: object) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    counts = [n("kind", i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    return found.select(F.col("key").alias("doc_id"), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), n("live", True).alias("n_live"))
