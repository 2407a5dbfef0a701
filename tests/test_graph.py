from pyspark.sql import functions as F

from hybridspark.operators import graph as G
from hybridspark.sources.schemas import PROJECTS


def test_search_and_rendering(spark):
    nested = spark.createDataFrame(
        [
            ("p1", "Bridge", "steel bridge", "civil", "City", None, "2020", [("m1", "Ann", None, "lead"), (None, "Bob", None, None)], ["ISO"]),
            ("p2", "Tunnel", None, "bridge works", None, None, None, [], []),
            ("p3", "Other", "none", "x", None, None, None, None, None),
        ],
        PROJECTS,
    )
    members = spark.createDataFrame([("m1", "Ann", "Engineer", 7, ["bridges"]), ("Bob", "Bob", None, None, None), ("m3", None, "Bridge lead", 1, [])], "id string, name string, title string, years_experience int, skills array<string>")
    edges = G.project_edges(nested)
    two = edges.unionByName(spark.createDataFrame([("p1", "Port", "FOR_CLIENT", None), ("m1", "PMP", "HOLDS", None)], "src string, dst string, type string, role string"))
    graph = G.Graph(nested.select("id", "name", "description", "category", "year"), members, two)
    queries = spark.createDataFrame([(1, "BRIDGE"), (2, "steel bridge")], "query_id int, query string")
    got = [r for r in G.graph_search(graph, queries).orderBy("query_id", "rank").collect()]
    assert [(r.query_id, r.entity_id) for r in got] == [(1, "p1"), (1, "p1"), (1, "p2"), (1, "m1"), (1, "m3"), (2, "p1"), (2, "p1")]
    assert got[0].text == "Project: Bridge\nDescription: steel bridge\nCategory: civil\nClient: City\nYear: 2020\nTeam: Ann (lead), Bob (None)\nCertifications: ISO"
    assert [(x.type, x.target, x.role) for x in got[0].relationships] == [("FOR_CLIENT", "City", None), ("DELIVERED_BY", "Ann", "lead"), ("DELIVERED_BY", "Bob", None), ("REQUIRES_CERT", "ISO", None)]
    assert got[2].text == "Project: Tunnel\nDescription: N/A\nCategory: bridge works\nClient: N/A\nYear: N/A\nTeam: " and got[2].relationships == []
    assert got[3].text == "Team Member: Ann\nTitle: Engineer\nExperience: 7 years\nCertifications: PMP\nProjects: Bridge (lead)"
    assert got[4].text == "Team Member: Unknown\nTitle: Bridge lead\nExperience: 1 years\nProjects: "
    assert G.graph_search(graph, queries, 2).where("query_id = 1").count() == 2 and G.compliance_context(graph, queries).where("query_id = 1").count() == 5


def test_upserts(spark):
    nodes = spark.createDataFrame([("a", 1, "old")], "id string, at int, name string")
    more = spark.createDataFrame([("a", 2, "new"), ("b", 1, "b")], "id string, at int, name string")
    assert sorted(r.name for r in G.upsert_nodes(nodes, more, "id", "at").collect()) == ["b", "new"]
    schema = "src string, dst string, type string, role string"
    old = spark.createDataFrame([("a", "p", "D", "x"), ("a", "p", "E", None)], schema)
    new = spark.createDataFrame([("a", "p", "D", "y"), ("a", "p", "D", None), ("a", None, "D", "z")], schema)
    assert sorted((r.type, r.role) for r in G.upsert_edges(old, new).collect()) == [("D", "y"), ("E", None)]


def test_no_table_of_nodes_is_broadcast(spark, tmp_path):
    """Names of all nodes stand in a file small enough for a broadcast; what is broadcast is of the size of the hits."""
    n = 60_000
    spark.range(n).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("hot bolt").alias("name"), F.lit("Brand#1").alias("description"), F.lit("x").alias("category"), F.lit("1").alias("year")).write.parquet(f"{tmp_path}/p")
    spark.range(n).select(F.concat(F.lit("m"), "id").alias("id"), F.lit("supplier").alias("name"), F.lit("t").alias("title"), F.lit(1).alias("years_experience"), F.array(F.lit("a")).alias("skills")).write.parquet(f"{tmp_path}/m")
    spark.range(n).select(F.concat(F.lit("m"), "id").alias("src"), F.concat(F.lit("p"), "id").alias("dst"), F.lit("DELIVERED").alias("type"), F.lit("N").alias("role")).write.parquet(f"{tmp_path}/e")
    graph = G.Graph(*(spark.read.parquet(f"{tmp_path}/{t}") for t in "pme"))
    queries = spark.createDataFrame([(1, "brand#1"), (2, "supplier")], "query_id int, query string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for search, want in ((G.search_projects, "Team: supplier (N)"), (G.search_members, "Projects: hot bolt (N)")):
            found = search(graph, queries)
            rows = found.collect()
            assert len(rows) == 10 and all(want in r.text for r in rows)
            lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
            depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
            for i, line in enumerate(lines):
                if "BroadcastExchange" in line:
                    below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
                    assert not any(f"{tmp_path}/{t}]" in x for x in lines[i:below] for t in "pm"), lines[i:below]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
