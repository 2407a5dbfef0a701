"""A property graph as node and edge DataFrames, its upserts and its text search.

Nodes: project (id, name, description, category, year), member (id, name, title, years_experience, skills), client,
certification, category (name), requirement (id, text, category, priority). Edges: (src, dst, type, role).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridspark.functions.text import contains_folded, json_span
from hybridspark.operators.relational import upsert_latest
from hybridspark.operators.sparse import top_per_query
from hybridspark.operators.substring import Trigrams, build_trigrams, substring_matches
from hybridspark.sources.store import stored

PROJECT_SCORE, MEMBER_SCORE, TOP_K = 1.0, 0.9, 10


@dataclass(frozen=True)
class Graph:
    projects: DataFrame
    members: DataFrame
    edges: DataFrame
    project_grams: Trigrams | None = None
    member_grams: Trigrams | None = None


def upsert_nodes(nodes: DataFrame, more: DataFrame, key: str, newest: str) -> DataFrame:
    """nodes with more merged in: of each key the newest row."""
    return upsert_latest(nodes.unionByName(more, allowMissingColumns=True), key, [newest])


def upsert_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type); a role that is given replaces an older one; ends must be there."""
    both = edges.withColumn("__n", F.lit(0)).unionByName(more.withColumn("__n", F.lit(1)))
    return both.where("src is not null and dst is not null").groupBy("src", "dst", "type").agg(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("__n"))).alias("role"))


def project_edges(projects: DataFrame) -> DataFrame:
    """Edges that nested projects imply: client, category, certifications, and members with their roles.

    A member without an id goes by name."""
    one = lambda dst, kind: projects.select(F.col("id").alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("role"))
    members = projects.select(F.col("id"), F.explode("team_members").alias("m")).select(F.coalesce("m.id", "m.name").alias("src"), F.col("id").alias("dst"), F.lit("DELIVERED").alias("type"), F.col("m.role").alias("role"))
    certs = projects.select(F.col("id").alias("src"), F.explode("certifications").alias("dst"), F.lit("REQUIRES_CERT").alias("type"), F.lit(None).cast("string").alias("role"))
    return one(F.col("client"), "FOR_CLIENT").unionByName(one(F.col("category"), "HAS_CATEGORY")).unionByName(members).unionByName(certs).where("dst is not null and src is not null")


def member_edges(members: DataFrame) -> DataFrame:
    """HOLDS edges from members (id, name, certifications) to their certifications. A member without an id goes by name."""
    held = members.select(F.coalesce("id", "name").alias("src"), F.explode("certifications").alias("dst"), F.lit("HOLDS").alias("type"), F.lit(None).cast("string").alias("role"))
    return held.where("src is not null and dst is not null").distinct()


def requirements_of(requirements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, text, category, priority) and HAS_REQUIREMENT edges from tenders, of requirements with a tender_id."""
    nodes = requirements.select("id", "text", "category", "priority").where("id is not null")
    edges = requirements.select(F.col("tender_id").cast("string").alias("src"), F.col("id").alias("dst"), F.lit("HAS_REQUIREMENT").alias("type"), F.lit(None).cast("string").alias("role"))
    return nodes, edges.where("src is not null and dst is not null").distinct()


#: What a model answers when asked for a document's projects and people.
EXTRACTED = """projects array<struct<id:string,name:string,description:string,category:string,year:string,client:string,
certifications:array<string>,team_members:array<struct<id:string,name:string,title:string,role:string>>>>,
team_members array<struct<id:string,name:string,title:string,years_experience:int,skills:array<string>,certifications:array<string>>>"""


def extracted(answers: DataFrame, answer: str = "answer") -> Graph:
    """The graph that model answers describe: the first JSON object in each; answers without one add nothing.

    Projects and members without an id go by name; those without either are left out."""
    said = answers.select(F.from_json(json_span(F.col(answer)), EXTRACTED).alias("j"))
    rows = lambda name: said.select(F.explode(f"j.{name}").alias("x")).select("x.*").withColumn("id", F.coalesce("id", "name")).where("id is not null")
    projects, members = rows("projects"), rows("team_members")
    return Graph(projects.select("id", "name", "description", "category", "year").distinct(), members.select("id", "name", "title", "years_experience", "skills").distinct(), upsert_edges(project_edges(projects), member_edges(members)))


def _text(c: str | Column, other: str = "N/A") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(other))


def _people(items: Column) -> Column:
    """Names with roles in brackets; unnamed ones are left out, a missing role reads None."""
    named = F.filter(items, lambda x: x["name"].isNotNull() & (x["name"] != ""))
    return F.array_join(F.transform(named, lambda x: F.concat(x["name"], F.lit(" ("), F.coalesce(x["role"], F.lit("None")), F.lit(")"))), ", ")


def _relations(kind: str, targets: Column, role: bool = False) -> Column:
    """Relationships (type, target, role) whose target is there."""
    target = lambda x: x["name"] if role else x
    kept = F.filter(targets, lambda x: target(x).isNotNull() & (target(x) != ""))
    return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("type"), target(x).alias("target"), (x["role"] if role else F.lit(None).cast("string")).alias("role")))


def _near(edges: DataFrame, hits: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(__id, __other, type, role): the hits' edges of these kinds, each kind by its given end.

    Written, so that what is joined to them is planned by their size and not by that of the whole graph: then the few
    edges of the hits are what Spark broadcasts, never the names of all nodes."""
    ids = hits.select(F.col("id").alias("__id"))
    ends = lambda by: (F.col(by).alias("__id"), F.col("dst" if by == "src" else "src").alias("__other"))
    parts = [edges.where(F.col("type") == kind).select(*ends(by), "type", "role").join(ids, "__id", "left_semi") for kind, by in kinds.items()]
    return stored(reduce(DataFrame.unionByName, parts))


def _pairs(near: DataFrame, kind: str, names: DataFrame, into: str) -> DataFrame:
    """For each node the set of its neighbours' (name, role)."""
    n = names.select(F.col("id").alias("__other"), "name")
    return near.where(F.col("type") == kind).join(n, "__other").groupBy("__id").agg(F.array_sort(F.collect_set(F.struct("name", "role"))).alias(into))


def _names(near: DataFrame, kind: str, into: str) -> DataFrame:
    return near.where(F.col("type") == kind).groupBy("__id").agg(F.array_sort(F.collect_set("__other")).alias(into))


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _matching(nodes: DataFrame, queries: DataFrame, test: Column, fields: Column, index: Trigrams | None, top_k: int) -> DataFrame:
    """Nodes that a query occurs in, top_k of each query by id, written; the nodes' neighbours are fetched after this cut."""
    found = substring_matches(nodes, queries, test, "id", fields, index)
    return stored(top_per_query(found, top_k, F.col("id")).drop("rank"))


_PROJECT_TEXTS, _MEMBER_TEXTS = ("name", "description", "category"), ("name", "title")


def _project_fields() -> Column:
    return F.array(*_PROJECT_TEXTS)


def _member_fields() -> Column:
    return F.concat(F.array(*_MEMBER_TEXTS), F.coalesce("skills", F.array().cast("array<string>")))


def indexed(graph: Graph) -> Graph:
    """graph with the trigrams of its nodes' texts written once, for many searches."""
    return replace(graph, project_grams=build_trigrams(graph.projects, "id", _project_fields()), member_grams=build_trigrams(graph.members, "id", _member_fields()))


_OUT = ["query_id", "text", "score", "entity_type", "entity_id", "relationships"]


def search_projects(graph: Graph, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Projects whose name, description or category contains the whole query, as text with their relationships.

    Each relation is gathered by node before the join, so relations don't multiply. A project with two clients
    gives one result for each. What is found and its edges are written when this is called."""
    q = F.col("query")
    hits = _matching(graph.projects, queries, contains_folded(F.col("name"), q) | contains_folded(F.col("description"), q) | contains_folded(F.col("category"), q), _project_fields(), graph.project_grams, top_k)
    near = _near(graph.edges, hits, {"FOR_CLIENT": "src", "DELIVERED": "dst", "REQUIRES_CERT": "src"})
    clients = near.where("type = 'FOR_CLIENT'").select("__id", F.col("__other").alias("client"))
    team, certs = _pairs(near, "DELIVERED", graph.members, "team"), _names(near, "REQUIRES_CERT", "certs")
    rows = hits.withColumn("__id", F.col("id")).join(clients, "__id", "left").join(team, "__id", "left").join(certs, "__id", "left")
    people = F.coalesce("team", F.array().cast("array<struct<name:string,role:string>>"))
    names = F.coalesce("certs", F.array().cast("array<string>"))
    text = _lines(
        F.concat(F.lit("Project: "), _text("name", "Unknown")),
        F.concat(F.lit("Description: "), _text("description")),
        F.concat(F.lit("Category: "), _text("category")),
        F.concat(F.lit("Client: "), _text("client")),
        F.concat(F.lit("Year: "), _text("year")),
        F.concat(F.lit("Team: "), _people(people)),
        F.when(F.size(names) > 0, F.concat(F.lit("Certifications: "), F.array_join(names, ", "))),
    )
    relations = F.concat(_relations("FOR_CLIENT", F.array("client")), _relations("DELIVERED_BY", people, True), _relations("REQUIRES_CERT", names))
    return top_per_query(rows.select("query_id", text.alias("text"), F.lit(PROJECT_SCORE).alias("score"), F.lit("Project").alias("entity_type"), F.col("id").alias("entity_id"), relations.alias("relationships"), F.col("client").alias("__c")), top_k, F.col("entity_id"), F.col("__c")).select(_OUT)


def search_members(graph: Graph, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Team members whose name, title or one of whose skills contains the whole query."""
    q = F.col("query")
    skilled = F.exists(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.coalesce(contains_folded(s, q), F.lit(False)))
    hits = _matching(graph.members, queries, F.coalesce(contains_folded(F.col("name"), q), F.lit(False)) | F.coalesce(contains_folded(F.col("title"), q), F.lit(False)) | skilled, _member_fields(), graph.member_grams, top_k)
    near = _near(graph.edges, hits, {"HOLDS": "src", "DELIVERED": "src"})
    certs, projects = _names(near, "HOLDS", "certs"), _pairs(near, "DELIVERED", graph.projects, "projects")
    rows = hits.withColumn("__id", F.col("id")).join(certs, "__id", "left").join(projects, "__id", "left")
    done = F.coalesce("projects", F.array().cast("array<struct<name:string,role:string>>"))
    names = F.coalesce("certs", F.array().cast("array<string>"))
    text = _lines(
        F.concat(F.lit("Team Member: "), _text("name", "Unknown")),
        F.concat(F.lit("Title: "), _text("title")),
        F.concat(F.lit("Experience: "), _text("years_experience"), F.lit(" years")),
        F.when(F.size(names) > 0, F.concat(F.lit("Certifications: "), F.array_join(names, ", "))),
        F.concat(F.lit("Projects: "), _people(done)),
    )
    relations = F.concat(_relations("HOLDS_CERT", names), _relations("DELIVERED_PROJECT", done, True))
    return rows.select("query_id", text.alias("text"), F.lit(MEMBER_SCORE).alias("score"), F.lit("TeamMember").alias("entity_type"), F.col("id").alias("entity_id"), relations.alias("relationships"))


def graph_search(graph: Graph, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Projects, then members, top_k in all for each query, with their rank. Metadata filters don't apply here."""
    both = search_projects(graph, queries, top_k).unionByName(search_members(graph, queries, top_k))
    return top_per_query(both, top_k, F.desc("score"), F.col("entity_id"))


def compliance_context(graph: Graph, queries: DataFrame) -> DataFrame:
    return graph_search(graph, queries, 5)
