"""Text and JSON column functions of the retrieval pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stop words. Only those of three letters or more are ever removed.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the to was were will with this but they "
    "have had what when where who which their there been would could should can do does did not no if so than then "
    "these those our we you your my me him her she"
).split()
#: A token starts with an ASCII letter or digit; what follows may be any Unicode word character or a hyphen.
TOKEN = r"(?U)\b[a-z0-9][\w-]*\b"
#: White space, Unicode's included where a pattern says so, and what parts sentences.
WHITE = r"\s"
SENTENCE_END = rf"(?<=[.!?]){WHITE}+"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def tokens(text: Column) -> Column:
    """Search tokens in order, repeats kept."""
    removed = [w for w in STOP_WORDS if len(w) > 2]
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(removed))


def sentences(text: Column) -> Column:
    """Parts between white space that follows a full stop, exclamation or question mark; blank parts dropped."""
    parts = F.transform(F.split(strip(text), rf"(?U){SENTENCE_END}"), strip)
    return F.filter(parts, lambda s: s != "")


def split_words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")


def snippet(text: Column, size: int = 200) -> Column:
    """The first size characters, with dots if there are more."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def identity_key(text: Column, size: int = 200) -> Column:
    """What makes two results one: the start of the stripped text in lower case."""
    return F.left(F.lower(strip(text)), F.lit(size))


def contains_folded(text: Column, part: Column) -> Column:
    return F.lower(text).contains(F.lower(part))


def tags(text: Column) -> Column:
    """A comma list as trimmed tags, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def object_key(tender_id: Column, path: Column) -> Column:
    return F.concat(F.lit("tenders/"), tender_id.cast("string"), F.lit("/"), basename(path))


def first_underscore(text: Column, by: str = " ") -> Column:
    """With the first underscore replaced, the others kept."""
    return F.regexp_replace(text, "^([^_]*)_", f"$1{by}")


def query_prefix(query: Column, model: Column, family: str, prefix: str) -> Column:
    """Models of an asymmetric family get an instruction before the query."""
    return F.when(F.lower(model).contains(family), F.concat(F.lit(prefix), query)).otherwise(query)


def source_badges(source: Column) -> Column:
    """Which retrievers a result came from, as its source names them; dense if it names none."""
    found = F.array_compact(F.array(*(F.when(F.lower(source).contains(k), F.lit(k)) for k in ("dense", "sparse", "graph"))))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit("dense")))


def fill(template: str, **values: Column) -> Column:
    """The template with each {name} replaced; {{ and }} stand for braces. A name without a value is an error."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def json_span(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def is_json(text: Column) -> Column:
    """Whether a text is JSON of whatever shape."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


ASSESSMENT = T.StructType([T.StructField("status", T.StringType()), T.StructField("explanation", T.StringType()), T.StructField("gaps", T.ArrayType(T.StringType())), T.StructField("suggestions", T.ArrayType(T.StringType()))])
REQUIREMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("category", T.StringType()), T.StructField("priority", T.StringType())]))


def assessment(answer: Column) -> Column:
    """A compliance answer as a struct; what isn't JSON becomes status unknown with the answer as explanation."""
    none = F.array().cast("array<string>")
    fallback = F.struct(F.lit("unknown").alias("status"), answer.alias("explanation"), none.alias("gaps"), none.alias("suggestions"))
    return F.when(is_json(answer), F.from_json(answer, ASSESSMENT)).otherwise(fallback.cast(ASSESSMENT))


def requirements(answer: Column) -> Column:
    """A requirement list; what isn't JSON becomes one general requirement of medium priority."""
    fallback = F.array(F.struct(answer.alias("text"), F.lit("general").alias("category"), F.lit("medium").alias("priority")))
    return F.when(is_json(answer), F.from_json(answer, REQUIREMENTS)).otherwise(fallback.cast(REQUIREMENTS))


_TREE = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])))])))])


def plain_text(tree: Column) -> Column:
    """The text of a rich-text tree in JSON: nodes parted by a blank line; its text field, or else the JSON itself."""
    t = F.from_json(tree, _TREE)
    leaves = lambda node: F.array_join(F.transform(F.coalesce(node["content"], F.array()), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    nodes = F.array_join(F.transform(t["content"], leaves), "\n\n")
    return F.when(t["content"].isNotNull(), nodes).otherwise(F.coalesce(t["text"], tree))


def rich_text(text: Column) -> Column:
    """Paragraphs parted by blank lines as a rich-text tree in JSON; blank ones dropped."""
    paragraphs = F.filter(F.split(text, r"\n\n"), lambda p: ~is_blank(p))
    node = lambda p: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), p.alias("text"))).alias("content"))
    return F.to_json(F.struct(F.lit("doc").alias("type"), F.transform(paragraphs, node).alias("content")))
