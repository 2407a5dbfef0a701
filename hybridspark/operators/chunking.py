"""Splitting texts into chunks: by topic, by size, and of oversize chunks by words.

The folds run inside one row with higher-order functions, so chunking neither shuffles nor leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridspark.functions.numbers import cosine
from hybridspark.functions.text import is_blank, once, sentences, split_words, tokens
from hybridspark.operators.dense import Vectors
from hybridspark.sources.store import spread

MIN_SIZE, MAX_SIZE, THRESHOLD, OVERLAP = 200, 1500, 0.5, 1
_STRINGS = "array<string>"


def _joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def _none() -> Column:
    return F.array().cast(_STRINGS)


def term_cosine(a: Column, b: Column) -> Column:
    """Likeness of two sentences by their token counts: the default in place of an embedding model."""
    x, y = tokens(a), tokens(b)
    both = F.array_union(x, y)
    count = lambda words: F.transform(both, lambda w: F.size(F.filter(words, lambda v: v == w)))
    return cosine(count(x), count(y))


def _terms(text: Column) -> Column:
    """A sentence's distinct tokens with their counts, in order, from where the runs of the sorted tokens begin."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        size = lambda f, k: (F.coalesce(F.get(f, k + 1), F.size(s)) - F.get(f, k)).cast("double")
        counted = once(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("t"), size(f, k).alias("n"))))
        return F.when(F.size(s) > 0, counted).otherwise(F.array().cast("array<struct<t:string,n:double>>"))

    return once(F.sort_array(tokens(text)), runs)


def _terms_cosine(a: Column, b: Column) -> Column:
    """term_cosine() of two sentences by their terms: equal tokens stand side by side once both lists are sorted as one."""
    size = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, t: s + t["n"] * t["n"]))

    def shared(both: Column) -> Column:
        start = F.struct(F.lit("").alias("t"), F.lit(0.0).alias("n"), F.lit(0.0).alias("dot"))
        step = lambda s, x: F.struct(x["t"].alias("t"), x["n"].alias("n"), F.when(x["t"] == s["t"], s["dot"] + s["n"] * x["n"]).otherwise(s["dot"]).alias("dot"))
        return F.aggregate(both, start, step, lambda s: s["dot"])

    long = size(a) * size(b)
    return F.when(long > 0, shared(F.sort_array(F.concat(a, b))) / long).otherwise(0.0)


def boundaries(parts: Column, similar: Callable[[Column, Column], Column] = term_cosine, threshold: float = THRESHOLD) -> Column:
    """Where a sentence is less like the one before than threshold; positions count from 0.

    For term_cosine each sentence is cut into tokens and counted once, in time that grows with its length (but for sorting)."""

    def cuts(xs: Column, alike: Callable[[Column, Column], Column]) -> Column:
        places = F.when(F.size(xs) > 1, F.sequence(F.lit(1), F.size(xs) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: alike(F.get(xs, i - 1), F.get(xs, i)) < threshold)

    if similar is term_cosine:
        return once(F.transform(parts, _terms), lambda xs: cuts(xs, _terms_cosine))
    return cuts(parts, similar)


def split_oversize(text: Column, max_size: int = MAX_SIZE) -> Column:
    """Runs of words whose lengths and spaces stay within max_size; a longer word stands alone.

    The fold keeps where runs begin and the size of the last one, not the words themselves."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("size"))

    def step(acc: Column, size: Column) -> Column:
        begins = (acc["i"] == 0) | (acc["size"] + size + 1 > max_size)
        return F.struct(F.when(begins, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"), (acc["i"] + 1).alias("i"), (F.when(begins, 0).otherwise(acc["size"]) + size + 1).alias("size"))

    def runs(words: Column) -> Column:
        starts = F.aggregate(F.transform(words, lambda w: F.length(w)), start, step, lambda acc: acc["starts"])
        return once(starts, lambda s: F.transform(s, lambda a, i: _joined(F.slice(words, a + 1, F.coalesce(F.get(s, i + 1), F.size(words)) - a))))

    return once(split_words(text), runs)


def fixed_chunks(parts: Column, max_size: int = MAX_SIZE, overlap: int = OVERLAP) -> Column:
    """Sentences gathered up to max_size characters, spaces not counted; each chunk begins with the last overlap sentences of the one before, all of them if overlap is 0."""
    start = F.struct(_none().alias("done"), _none().alias("now"), F.lit(0).alias("size"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["size"] + F.length(s) > max_size) & (F.size(acc["now"]) > 0)
        tail = acc["now"] if overlap == 0 else F.slice(acc["now"], F.greatest(F.size(acc["now"]) - overlap + 1, F.lit(1)), F.lit(overlap))
        kept = F.struct(F.concat(acc["done"], F.array(_joined(acc["now"]))).alias("done"), F.concat(tail, F.array(s)).alias("now"), (total(tail) + F.length(s)).alias("size"))
        more = F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(s)).alias("now"), (acc["size"] + F.length(s)).alias("size"))
        return F.when(full, kept).otherwise(more)

    return F.aggregate(parts, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(_joined(acc["now"])))).otherwise(acc["done"]))


def semantic_chunks(parts: Column, cuts: Column, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE) -> Column:
    """Segments between cuts. A small segment joins the chunk before it unless that would exceed max_size; the last
    segment never does. Chunks that are too long are split by words at the end."""
    starts = F.concat(F.array(F.lit(0)), cuts)
    ends = F.concat(cuts, F.array(F.size(parts)))
    segments = F.zip_with(starts, ends, lambda a, b: _joined(F.slice(parts, a + 1, b - a)))
    head = F.slice(segments, F.lit(1), F.size(segments) - 1)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.length(s) < min_size) & (F.size(acc) > 0) & (F.length(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))) + 1 + F.length(s) <= max_size)
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s)))

    built = F.concat(F.aggregate(head, _none(), step), F.slice(segments, F.size(segments), F.lit(1)))
    return F.flatten(F.transform(built, lambda c: F.when(F.length(c) > max_size, split_oversize(c, max_size)).otherwise(F.array(c))))


def _cuts(threshold: float):
    """A column function over sentences in their order: where a document's vectors are unlike, at its last sentence; else null.

    It keeps the vector before from batch to batch, so it must see all rows, and no filter may be moved before it."""

    @F.arrow_udf("array<int>")
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        before, open_cuts = None, np.empty(0, np.int32)
        for at, last, vectors in batches:
            if not len(at):
                yield pa.array([], pa.list_(pa.int32()))
                continue
            own = vectors.slice(0, 1) if before is None else before
            v = Vectors(both := pa.concat_arrays([own, vectors]), int(pc.mode(pc.fill_null(pc.list_value_length(both), 0))[0].as_py()["mode"] or 1))
            sound = v.sound[:-1] & v.sound[1:]
            with np.errstate(all="ignore"):
                score = np.einsum("ij,ij->i", v.rows[:-1], v.rows[1:]) / (v.sizes[:-1] * v.sizes[1:])
            # near the threshold, and for vectors of other kinds, as the column functions have it
            for i in np.flatnonzero(~sound | (np.abs(score - threshold) < 1e-6)):
                (exact,), (unlike,) = v.against(i, v, np.array([i + 1]))
                score[i] = np.nan if unlike else exact
            places, ends = at.to_numpy(), np.flatnonzero(last.to_numpy(zero_copy_only=False))
            apart = (places > 0) & ~pc.is_null(both).to_numpy(zero_copy_only=False)[:-1] & (score < threshold)
            where = np.flatnonzero(apart)
            found = np.concatenate([open_cuts, places[where].astype(np.int32)])
            upto = len(open_cuts) + np.searchsorted(where, ends, side="right")
            done = int(upto[-1]) if len(ends) else 0
            values = np.zeros(len(at) + 1, dtype=np.int32)
            values[ends + 1] = np.diff(np.concatenate([[0], upto]))
            mask = np.ones(len(at), dtype=bool)
            mask[ends] = False
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(values), pa.int32()), pa.array(found[:done], pa.int32()), mask=pa.array(mask))
            before, open_cuts = vectors.slice(len(vectors) - 1), found[done:]

    return cuts.asNondeterministic()


def vector_boundaries(docs: DataFrame, embed: Callable[[Column], Column], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with __parts (sentences) and __cuts, where a sentence's vector is less like the one before than threshold.

    embed maps sentences to vectors and may be a pandas UDF of a model: sentences are rows here, each is embedded once and
    compared with the one before it, which is the row before. A document's sentences stay together and in order, so nothing
    is shuffled or written; its last sentence carries its columns. docs may have any columns."""
    rows = spread(docs.where(~is_blank(F.col(text)))).withColumn("__parts", sentences(F.col(text)))
    whole = F.struct(*(F.col(f"`{c}`") for c in [*docs.columns, "__parts"]))
    last = F.size("__parts") - 1
    # made before the rows are, so that a text isn't copied into each of its sentences' rows; outer, lest Spark cuts texts again to test for empty lists
    each = F.transform("__parts", lambda s, i: F.struct(i.alias("__at"), s.alias("__sentence"), (i == last).alias("__last"), F.when(i == last, whole).alias("__doc")))
    each = rows.select(F.inline_outer(each)).select("__at", "__last", "__doc", embed(F.col("__sentence")).alias("__vector"))
    return each.select("__doc", _cuts(threshold)("__at", "__last", "__vector").alias("__cuts")).where("__cuts is not null").select("__doc.*", "__cuts")


def chunk(docs: DataFrame, mode: str = "semantic", text: str = "text", min_size: int = MIN_SIZE, max_size: int = MAX_SIZE, threshold: float = THRESHOLD, overlap: int = OVERLAP, similar: Callable[[Column, Column], Column] = term_cosine, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with one row a chunk: chunk_index from 0, and the chunk in place of the text.

    Semantic chunks end where two sentences are unlike: by similar, a function of built-in functions alone, or by the
    cosine of the vectors that embed gives, which may be a pandas UDF.

    A blank text has no chunk. A text of one sentence is one chunk, however long."""
    if mode not in ("semantic", "fixed"):
        raise ValueError("mode must be semantic or fixed")
    if mode == "semantic" and embed is not None:
        rows = vector_boundaries(docs, embed, text, threshold)
    else:
        rows = docs.where(~is_blank(F.col(text))).withColumn("__parts", sentences(F.col(text)))
    if mode == "semantic":
        if embed is None:
            rows = rows.withColumn("__cuts", boundaries(F.col("__parts"), similar, threshold))
        many = semantic_chunks(F.col("__parts"), F.col("__cuts"), min_size, max_size)
    else:
        many = fixed_chunks(F.col("__parts"), max_size, overlap)
    chunks = F.when(F.size("__parts") <= 1, F.col("__parts")).otherwise(many)
    kept = [c for c in docs.columns if c not in (text, "chunk_index")]
    return rows.select(*kept, F.posexplode(chunks).alias("chunk_index", text))
