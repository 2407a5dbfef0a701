"""Chunks with their places: where in the whole text each chunk begins and ends, and what stood there.

Sentences and words keep their offsets, chunks are runs of them, so a place survives stripping, merging and splitting.
All of it stays inside a document's row. Chunks have the same texts as those of chunking.chunk().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridspark.functions.numbers import last_at_most, running_sums
from hybridspark.functions.text import SENTENCE_END, WHITE, is_blank, once, strip
from hybridspark.operators import chunking as C

_RUNS = "array<struct<a:int,b:int>>"


def pieces(text: Column, separator: str) -> Column:
    """(text, begin, end) of each part between separators, white space at both ends of the whole left out."""
    pattern = rf"(?U){separator}"

    def placed(t: Column) -> Column:
        # what a lambda names is worked out again for each element, so arrays and lengths are bound before
        parts = F.split(t["body"], pattern)
        gaps = F.transform(F.regexp_extract_all(t["body"], F.lit(pattern), F.lit(0)), lambda g: F.length(g))
        steps = F.zip_with(F.transform(parts, lambda p: F.length(p)), gaps, lambda n, gap: n + F.coalesce(gap, F.lit(0)))
        begun = F.zip_with(parts, running_sums(steps), lambda p, at: F.struct(p.alias("text"), (t["lead"] + at).cast("int").alias("begin"), (t["lead"] + at + F.length(p)).cast("int").alias("end")))
        return F.filter(begun, lambda s: s["text"] != "")

    lead = F.length(text) - F.length(F.regexp_replace(text, rf"(?U)^{WHITE}+", ""))
    return once(F.struct(strip(text).alias("body"), lead.alias("lead")), placed)


def sentence_spans(text: Column) -> Column:
    return pieces(text, SENTENCE_END)


def word_spans(text: Column) -> Column:
    return pieces(text, rf"{WHITE}+")


def _run(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def fixed_runs(sizes: Column, max_size: int = C.MAX_SIZE, overlap: int = C.OVERLAP) -> Column:
    """Runs [a, b) of sentences of these sizes, as fixed_chunks() gathers them."""
    state = lambda done, a, i, size: F.struct(done.alias("done"), a.cast("int").alias("a"), i.cast("int").alias("i"), size.cast("int").alias("size"))
    start = state(F.array().cast(_RUNS), F.lit(0), F.lit(0), F.lit(0))

    def step(sizes: Column, acc: Column, n: Column) -> Column:
        full = (acc["size"] + n > max_size) & (acc["i"] > acc["a"])
        a = acc["a"] if overlap == 0 else F.greatest(acc["a"], acc["i"] - overlap)
        tail = F.aggregate(F.slice(sizes, a + 1, acc["i"] - a), F.lit(0), lambda s, x: s + x)
        closed = state(F.concat(acc["done"], F.array(_run(acc["a"], acc["i"]))), a, acc["i"] + 1, tail + n)
        return F.when(full, closed).otherwise(state(acc["done"], acc["a"], acc["i"] + 1, acc["size"] + n))

    last = lambda acc: F.when(acc["i"] > acc["a"], F.concat(acc["done"], F.array(_run(acc["a"], acc["i"])))).otherwise(acc["done"])
    return once(sizes, lambda sizes: F.aggregate(sizes, start, lambda acc, n: step(sizes, acc, n), last))


def semantic_runs(sizes: Column, cuts: Column, min_size: int = C.MIN_SIZE, max_size: int = C.MAX_SIZE) -> Column:
    """Runs [a, b) of sentences between cuts; small ones join the run before as in semantic_chunks()."""
    n = F.size(sizes)

    def built(sums: Column) -> Column:
        # sums[b] - sums[a] are the letters of a run, and a space stands between its sentences
        length = lambda r: F.get(sums, r["b"]) - F.get(sums, r["a"]) + r["b"] - r["a"] - 1
        segments = F.zip_with(F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(n)), _run)

        def step(acc: Column, s: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            joins = (length(s) < min_size) & (F.size(acc) > 0) & (length(last) + 1 + length(s) <= max_size)
            return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(_run(last["a"], s["b"])))).otherwise(F.concat(acc, F.array(s)))

        head = F.aggregate(F.slice(segments, F.lit(1), F.size(segments) - 1), F.array().cast(_RUNS), step)
        return F.concat(head, F.slice(segments, F.size(segments), F.lit(1)))

    return once(running_sums(F.concat(sizes, F.array(F.lit(0)))), built)


def _gathered(parts: Column, run: Column) -> Column:
    """A run of (text, begin, end) as one."""
    own = F.slice(parts, run["a"] + 1, run["b"] - run["a"])
    return F.struct(F.array_join(F.transform(own, lambda p: p["text"]), " ").alias("text"), F.get(parts, run["a"])["begin"].alias("begin"), F.get(parts, run["b"] - 1)["end"].alias("end"))


def oversize_runs(sizes: Column, max_size: int = C.MAX_SIZE) -> Column:
    """Runs [a, b) of words that split_oversize() makes."""
    state = lambda done, a, i, size: F.struct(done.alias("done"), a.cast("int").alias("a"), i.cast("int").alias("i"), size.cast("int").alias("size"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["size"] + n + 1 > max_size) & (acc["i"] > acc["a"])
        closed = state(F.concat(acc["done"], F.array(_run(acc["a"], acc["i"]))), acc["i"], acc["i"] + 1, n + 1)
        return F.when(full, closed).otherwise(state(acc["done"], acc["a"], acc["i"] + 1, acc["size"] + n + 1))

    done = F.aggregate(sizes, state(F.array().cast(_RUNS), F.lit(0), F.lit(0), F.lit(0)), step)
    return once(done, lambda acc: F.when(acc["i"] > acc["a"], F.concat(acc["done"], F.array(_run(acc["a"], acc["i"])))).otherwise(acc["done"]))


def _sizes(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.length(p["text"]))


def _split(whole: Column, c: Column, max_size: int) -> Column:
    """A chunk as it is, or as runs of its words if it is too long; words are looked up in the whole text."""

    def runs(words: Column) -> Column:
        moved = lambda r: _gathered(words, r).withField("begin", F.get(words, r["a"])["begin"] + c["begin"]).withField("end", F.get(words, r["b"] - 1)["end"] + c["begin"])
        return F.transform(oversize_runs(_sizes(words), max_size), moved)

    return F.when(F.length(c["text"]) > max_size, once(word_spans(F.substring(whole, c["begin"] + 1, c["end"] - c["begin"])), runs)).otherwise(F.array(c))


def chunk_spans(docs: DataFrame, mode: str = "semantic", text: str = "text", min_size: int = C.MIN_SIZE, max_size: int = C.MAX_SIZE, threshold: float = C.THRESHOLD, overlap: int = C.OVERLAP, similar: Callable[[Column, Column], Column] = C.term_cosine, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with __spans, an array of chunks (text, begin, end): the chunks of chunk(), and their places in the text.

    Places are code points, end exclusive; a chunk's words are those of text[begin:end]. Blank and null texts have none.
    With an overlap chunks share sentences, and so places."""
    if mode not in ("semantic", "fixed"):
        raise ValueError("mode must be semantic or fixed")
    whole = F.col(text)
    if mode == "semantic" and embed is not None:
        # the sentences of both are the same, in the same order
        rows = C.vector_boundaries(docs, embed, text, threshold).drop("__parts")
    else:
        rows = docs.where(~is_blank(whole))
    rows = rows.withColumn("__sentences", sentence_spans(whole))
    parts = F.col("__sentences")
    if mode == "fixed":
        spans = F.transform(fixed_runs(_sizes(parts), max_size, overlap), lambda r: _gathered(parts, r))
    else:
        if embed is None:
            rows = rows.withColumn("__cuts", once(F.transform(parts, lambda p: p["text"]), lambda texts: C.boundaries(texts, similar, threshold)))
        runs = F.transform(semantic_runs(_sizes(parts), F.col("__cuts"), min_size, max_size), lambda r: _gathered(parts, r))
        spans = F.flatten(F.transform(runs, lambda c: _split(whole, c, max_size)))
    rows = rows.withColumn("__spans", F.when(F.size(parts) <= 1, parts).otherwise(spans))
    return rows.drop("__sentences", "__cuts")


def located(docs: DataFrame, begins: str, carried: dict[str, str], **how: object) -> DataFrame:
    """One row a chunk: chunk_index, text, begin, end, and of what stands at its begin the columns of carried.

    docs: text, an ascending array of where its parts begin, and for each name in carried an array with a value a part.
    Further columns are kept. The part is found by halving, so a long text costs its chunks times a logarithm."""
    rows = chunk_spans(docs, **how)

    def one(s: Column) -> Column:
        of = lambda at: F.struct(*(F.get(F.col(c), at).alias(name) for name, c in carried.items()))
        return F.struct(s["text"].alias("text"), s["begin"].alias("begin"), s["end"].alias("end"), once(last_at_most(F.col(begins), s["begin"]), of).alias("at"))

    text = str(how.get("text", "text"))
    kept = [c for c in docs.columns if c not in (text, begins, *carried.values(), "chunk_index", "begin", "end", *carried)]
    found = rows.select(*kept, F.posexplode(F.transform("__spans", one)).alias("chunk_index", "__chunk"))
    return found.select(*kept, "chunk_index", F.col("__chunk.text").alias(text), "__chunk.begin", "__chunk.end", *(F.col(f"__chunk.at.{name}").alias(name) for name in carried))
