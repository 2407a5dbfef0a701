"""Sentences, chunks, sections and the JSON that models answer with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridspark.functions import text as X
from hybridspark.operators import chunking as C
from hybridspark.plans.registry import query, table, token_list
from hybridspark.sources.files import chunk_elements, full_text, sections, with_sections
from hybridspark.sources.store import spread


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


_STRIP = r"regexp_replace({}, '^[\s\x0B\x1C-\x1F\x85\p{{Z}}]+|[\s\x0B\x1C-\x1F\x85\p{{Z}}]+$', '', 'g')"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x0B\x85\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_SENTENCES})::BIGINT AS n, md5(array_to_string({_SENTENCES}, '|')) AS parts_md5 FROM documents")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = X.sentences(F.col("text"))
    return _texts(spark, d).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("parts_md5"))


_FIXED = f"""WITH RECURSIVE s AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents),
fold AS (SELECT doc_id, ss, 1 AS i, []::VARCHAR[] AS done, [ss[1]] AS now, length(ss[1]) AS size FROM s WHERE len(ss) > 1
UNION ALL SELECT doc_id, ss, i + 1, CASE WHEN size + length(ss[i + 1]) > 1500 THEN list_append(done, array_to_string(now, ' ')) ELSE done END,
CASE WHEN size + length(ss[i + 1]) > 1500 THEN [now[-1], ss[i + 1]] ELSE list_append(now, ss[i + 1]) END,
CASE WHEN size + length(ss[i + 1]) > 1500 THEN length(now[-1]) ELSE size END + length(ss[i + 1]) FROM fold WHERE i < len(ss)),
c AS (SELECT doc_id, list_append(done, array_to_string(now, ' ')) AS cs FROM fold WHERE i = len(ss) UNION ALL SELECT doc_id, ss FROM s WHERE len(ss) = 1)
SELECT doc_id, (unnest(range(0, len(cs))))::INT AS chunk_index, md5(unnest(cs)) AS chunk_md5 FROM c"""


FIXED_SQL, STRIP_SQL = _FIXED, _STRIP


@query(_FIXED)
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.chunk(_texts(spark, d), "fixed")
    return chunks.select("doc_id", "chunk_index", F.md5("text").alias("chunk_md5"))




_SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
_OVERSIZE = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_STRIP.format("text")}, '{_SPACES}'), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT doc_id, i, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, length(word) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w)),
hop AS (SELECT a.doc_id, a.i, greatest(coalesce(b.i, 1000000000), a.i + 1) AS nxt FROM e a ASOF LEFT JOIN e b ON a.doc_id = b.doc_id AND a.upto - a.n - 1 + 1500 < b.upto),
walk AS (SELECT doc_id, 1::BIGINT AS i, 0 AS chunk_index FROM w WHERE len(ws) > 0 UNION ALL SELECT walk.doc_id, nxt, chunk_index + 1 FROM walk JOIN hop USING (doc_id, i) WHERE nxt < 1000000000)
SELECT doc_id, chunk_index, md5(array_to_string(ws[i:nxt - 1], ' ')) AS chunk_md5 FROM walk JOIN hop USING (doc_id, i) JOIN w USING (doc_id)"""


@query(_OVERSIZE)
def chunk_oversize(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).select("doc_id", F.posexplode(C.split_oversize(F.col("text"))).alias("chunk_index", "text"))
    return docs.select("doc_id", "chunk_index", F.md5("text").alias("chunk_md5"))


_CUTS = f"""s AS (SELECT doc_id, unnest({_SENTENCES}) AS part, unnest(range(0, len({_SENTENCES}))) AS i FROM documents),
t AS (SELECT doc_id, i, token, count(*)::DOUBLE AS n FROM (SELECT doc_id, i, unnest({token_list("part")}) AS token FROM s) GROUP BY 1, 2, 3),
size AS (SELECT doc_id, i, sqrt(sum(n * n)) AS size FROM t GROUP BY 1, 2),
dot AS (SELECT b.doc_id, b.i, sum(a.n * b.n) AS dot FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.token = b.token AND b.i = a.i + 1 GROUP BY 1, 2),
c AS (SELECT s.doc_id, s.i FROM s LEFT JOIN dot USING (doc_id, i) LEFT JOIN size y USING (doc_id, i) LEFT JOIN size x ON x.doc_id = s.doc_id AND x.i = s.i - 1
WHERE s.i > 0 AND CASE WHEN coalesce(x.size, 0) * coalesce(y.size, 0) > 0 THEN coalesce(dot, 0) / (x.size * y.size) ELSE 0 END < 0.5)"""
_BOUNDARIES = f"""WITH {_CUTS}
SELECT doc_id, coalesce(string_agg(i, ',' ORDER BY i), '') AS cuts FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id"""


@query(_BOUNDARIES)
def semantic_boundaries(spark: SparkSession, d: str) -> DataFrame:
    parts = X.sentences(F.col("text"))
    rows = _texts(spark, d).select("doc_id", parts.alias("parts"))
    return rows.select("doc_id", F.array_join(C.boundaries(F.col("parts")).cast("array<string>"), ",").alias("cuts"))


_SEMANTIC = f"""WITH RECURSIVE {_CUTS},
p AS (SELECT doc_id, list(part ORDER BY i) AS parts FROM s GROUP BY 1),
k AS (SELECT doc_id, parts, coalesce(cuts, []) AS cuts FROM p LEFT JOIN (SELECT doc_id, list(i ORDER BY i) AS cuts FROM c GROUP BY 1) USING (doc_id)),
g AS (SELECT doc_id, list_transform(range(0, len(cuts) + 1), lambda j: array_to_string(parts[CASE WHEN j = 0 THEN 1 ELSE cuts[j] + 1 END:CASE WHEN j = len(cuts) THEN len(parts) ELSE cuts[j + 1] END], ' ')) AS segs FROM k WHERE len(parts) > 1),
fold AS (SELECT doc_id, segs, 0 AS i, []::VARCHAR[] AS done FROM g UNION ALL SELECT doc_id, segs, i + 1,
CASE WHEN len(done) > 0 AND length(segs[i + 1]) < 200 AND length(done[-1]) + 1 + length(segs[i + 1]) <= 1500 THEN list_append(done[1:len(done) - 1], done[-1] || ' ' || segs[i + 1]) ELSE list_append(done, segs[i + 1]) END FROM fold WHERE i < len(segs) - 1),
u AS (SELECT doc_id, unnest(range(0, len(done) + 1)) AS k, unnest(list_append(done, segs[-1])) AS text FROM fold WHERE i = len(segs) - 1),
w AS (SELECT doc_id, k, list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda x: x <> '') AS ws FROM u WHERE length(text) > 1500),
e AS (SELECT doc_id, k, i, sum(length(word) + 1) OVER (PARTITION BY doc_id, k ORDER BY i) AS upto, length(word) AS n FROM (SELECT doc_id, k, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w)),
hop AS (SELECT a.doc_id, a.k, a.i, greatest(coalesce(b.i, 1000000000), a.i + 1) AS nxt FROM e a ASOF LEFT JOIN e b ON a.doc_id = b.doc_id AND a.k = b.k AND a.upto - a.n - 1 + 1500 < b.upto),
walk AS (SELECT doc_id, k, 1::BIGINT AS i FROM w UNION ALL SELECT walk.doc_id, walk.k, nxt FROM walk JOIN hop USING (doc_id, k, i) WHERE nxt < 1000000000),
x AS (SELECT doc_id, k, 0 AS i, text FROM u WHERE length(text) <= 1500 UNION ALL SELECT doc_id, k, i, array_to_string(ws[i:nxt - 1], ' ') FROM walk JOIN hop USING (doc_id, k, i) JOIN w USING (doc_id, k)
UNION ALL SELECT doc_id, 0, 0, parts[1] FROM p WHERE len(parts) = 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1)::INT AS chunk_index, length(text)::INT AS size, md5(text) AS chunk_md5 FROM x"""


@query(_SEMANTIC)
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.chunk(_texts(spark, d))
    return chunks.select("doc_id", "chunk_index", F.length("text").alias("size"), F.md5("text").alias("chunk_md5"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "Title").otherwise("Text").alias("type"), "text")


_E = "e AS (SELECT conv_id AS doc_id, turn AS seq, role = 'user' AND coalesce(text, '') <> '' AS title, coalesce(text, '') AS text FROM conversations)"
_RUNS = f"WITH {_E}, r AS (SELECT *, sum(title::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM e), n AS (SELECT *, coalesce(max(CASE WHEN title THEN text END) OVER (PARTITION BY doc_id, run), 'Introduction') AS section FROM r)"


@query(f"{_RUNS} SELECT doc_id, seq, run::BIGINT AS run, md5(section) AS section_md5 FROM n")
def section_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return with_sections(_elements(spark, d)).select("doc_id", "seq", "run", F.md5("section").alias("section_md5"))


@query(f"""{_RUNS}, b AS (SELECT doc_id, section, run, string_agg(text, chr(10) ORDER BY seq, text) AS body FROM n WHERE text <> '' GROUP BY 1, 2, 3)
SELECT doc_id, md5(section) AS section_md5, md5(arg_max(body, run)) AS body_md5 FROM b GROUP BY doc_id, section""")
def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    return sections(_elements(spark, d)).select("doc_id", F.md5("section").alias("section_md5"), F.md5("body").alias("body_md5"))


@query(f"WITH {_E} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY seq, text)) AS text_md5 FROM e WHERE text <> '' GROUP BY 1")
def element_full_text(spark: SparkSession, d: str) -> DataFrame:
    return full_text(_elements(spark, d)).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, TRUE AS ok FROM events")
def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    """The object inside an answer with prose around it."""
    answer = F.concat(F.lit("Sure, here it is: "), F.col("props"), F.lit(" - anything else?"))
    span = X.json_span(answer)
    return table(spark, d, "events").select("event_id", F.get_json_object(span, "$.k").alias("k"), X.is_json(span).alias("ok"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'met' WHEN event_id % 3 = 1 THEN 'unknown' END AS status,
CASE WHEN event_id % 3 = 1 THEN 'no json: ' || event_type END AS explanation, (CASE WHEN event_id % 3 = 1 THEN 0 END)::INT AS gaps FROM events""")
def json_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A well-formed answer, one that isn't JSON, and JSON without the fields."""
    case = F.col("event_id") % 3
    answer = F.when(case == 0, F.lit('{"status": "met"}')).when(case == 1, F.concat(F.lit("no json: "), F.col("event_type"))).otherwise(F.col("props"))
    a = X.assessment(answer)
    return table(spark, d, "events").select("event_id", a["status"].alias("status"), a["explanation"].alias("explanation"), F.when(a["gaps"].isNotNull(), F.size(a["gaps"])).alias("gaps"))


@query("SELECT event_id, 1 AS n, 'not a list: ' || event_type AS text, 'general' AS category, 'medium' AS priority FROM events")
def requirements_fallback(spark: SparkSession, d: str) -> DataFrame:
    listed = X.requirements(F.concat(F.lit("not a list: "), F.col("event_type")))
    rows = table(spark, d, "events").select("event_id", F.size(listed).alias("n"), F.explode(listed).alias("r"))
    return rows.select("event_id", "n", "r.text", "r.category", "r.priority")


@query("""SELECT event_id, 2 AS n, event_type AS text, CASE WHEN event_id % 2 = 0 THEN 'technical' END AS category, 'high' AS priority FROM events
UNION ALL SELECT event_id, 2, 'also ' || user_id, 'legal', NULL FROM events""")
def requirements_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are lists: every field is taken, and one that is missing is null."""
    one = F.struct(F.col("event_type").alias("text"), F.when(F.col("event_id") % 2 == 0, "technical").alias("category"), F.lit("high").alias("priority"))
    two = F.struct(F.concat(F.lit("also "), F.col("user_id").cast("string")).alias("text"), F.lit("legal").alias("category"), F.lit(None).cast("string").alias("priority"))
    listed = X.requirements(F.to_json(F.array(one, two)))
    rows = table(spark, d, "events").select("event_id", F.size(listed).alias("n"), F.explode(listed).alias("r"))
    return rows.select("event_id", "n", "r.text", "r.category", "r.priority")


@query("SELECT conv_id, turn, md5(array_to_string(list_filter(string_split(text, chr(10) || chr(10)), lambda x: " + _STRIP.format("x") + " <> ''), chr(10) || chr(10))) AS text_md5 FROM conversations")
def richtext_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.plain_text(X.rich_text(F.col("text")))).alias("text_md5"))


_WS = r"[\s\x0B\x85\p{Z}]"
_LONG = 200
_PLACES = f"""{_RUNS.replace("WITH ", "WITH RECURSIVE ", 1)},
el AS (SELECT doc_id, seq, section, text, coalesce(sum(CASE WHEN text <> '' THEN length(text) + 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM n),
d AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM el WHERE text <> '' GROUP BY 1),
b AS (SELECT doc_id, length(text) - length(regexp_replace(text, '^{_WS}+', '')) AS lead, {_STRIP.format("text")} AS body FROM d),
p AS (SELECT doc_id, lead, string_split(regexp_replace(body, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)) AS parts, list_transform(regexp_extract_all(body, '[.!?]({_WS}+)', 1), lambda g: length(g)) AS gaps FROM b WHERE body <> ''),
u AS (SELECT doc_id, lead, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part, gaps FROM p),
s AS (SELECT doc_id, i, part, lead + coalesce(sum(length(part) + coalesce(gaps[i], 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM u),
l AS (SELECT doc_id, list(part ORDER BY i) AS parts, list(begin ORDER BY i) AS begins, list(length(part) ORDER BY i) AS sizes FROM s GROUP BY 1),
fold AS (SELECT doc_id, sizes, 1 AS i, 0 AS a, []::STRUCT(a INT, b INT)[] AS done, sizes[1] AS size FROM l
UNION ALL SELECT doc_id, sizes, i + 1, CASE WHEN size + sizes[i + 1] > {_LONG} THEN greatest(a, i - 1) ELSE a END,
CASE WHEN size + sizes[i + 1] > {_LONG} THEN list_append(done, {{'a': a, 'b': i}}) ELSE done END,
CASE WHEN size + sizes[i + 1] > {_LONG} THEN sizes[i] ELSE size END + sizes[i + 1] FROM fold WHERE i < len(sizes)),
ru AS (SELECT doc_id, unnest(list_append(done, {{'a': a, 'b': i}})) AS run, unnest(range(0, len(done) + 1)) AS chunk_index FROM fold WHERE i = len(sizes)),
c AS (SELECT doc_id, chunk_index, array_to_string(parts[run.a + 1:run.b], ' ') AS text, begins[run.a + 1] AS begin, begins[run.b] + sizes[run.b] AS "end" FROM ru JOIN l USING (doc_id))
SELECT c.doc_id AS document_id, chunk_index::INT AS chunk_index, md5(c.text) AS text_md5, begin::INT AS "begin", "end"::INT AS "end", 'chat.txt' AS source_file, md5(e.section) AS section_md5, (e.seq // 2 + 1)::INT AS page_number
FROM c ASOF JOIN (FROM el WHERE text <> '') e ON c.doc_id = e.doc_id AND c.begin >= e.at"""


@query(_PLACES)
def ingest_places(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of conversations with file, page, section and place; two turns are a page, a user's turn is a title."""
    elements = _elements(spark, d).withColumns({"page_number": (F.floor(F.col("seq") / 2) + 1).cast("int"), "filename": F.lit("chat.txt")})
    chunks = chunk_elements(elements, mode="fixed", max_size=_LONG)
    return chunks.select("document_id", "chunk_index", F.md5("text").alias("text_md5"), "begin", "end", "source_file", F.md5("section_title").alias("section_md5"), "page_number")
