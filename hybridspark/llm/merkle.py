"""Merkle manifests: a root over all rows, a proof for each row, and what a changed row does to the root.

Leaves are numbered within their group and gathered into fixed-size ordered arrays of 8^3. One such block collapses
three levels inside its row with sequence, transform, slice and aggregate; its root is a leaf of the next round, until
each group has one node. The groups' roots make a tree of their own in the same way. Proofs come back down: a block
hands each of its nodes the siblings on the way up, joined with what lies above the block. A group of any size is many
blocks, so nothing but a block is ever in one task, and the number of rounds is a logarithm to the base 512.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, numbered, read
from .importance import CRC_TABLE, crc_sql

#: Nodes of a run, which become one; levels that a block collapses; leaves of a block.
ARITY, DEPTH = 8, 3
BLOCK = ARITY**DEPTH
#: Columns that make a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as UTF-8 byte count, colon and text, null as a hyphen."""

    def part(value: Column) -> Column:
        v = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def _joined(level: Column, begin: Column, n: Column) -> Column:
    return F.array_join(F.slice(level, begin + 1, n), "")


def _collapsed(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda r: F.sha2(_joined(level, r * ARITY, F.lit(ARITY)), 256))


def levels(digests: Column, first: Column) -> Column:
    """The levels of a block, its leaves first and its root, alone, last.

    Only a group's first block can be its only one, and then has as many levels as its leaves need; all others, and a
    first one that is full, have DEPTH."""
    needed = F.lit(DEPTH)
    for k in reversed(range(DEPTH)):
        needed = F.when(first & (F.size(digests) <= ARITY**k), k).otherwise(needed)
    up = lambda acc, k: F.when(k <= needed, F.concat(acc, F.array(_collapsed(F.element_at(acc, -1))))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(digests), up)


def siblings(built: Column, i: Column) -> Column:
    """(left, right) of the block's leaf i on each level but the root's: the other nodes of its run, joined."""

    def step(k: int) -> Column:
        level, at = F.get(built, F.lit(k)), F.shiftright(i, 3 * k)
        run = F.shiftright(at, 3) * ARITY
        left, right = _joined(level, run, at - run), _joined(level, at + 1, F.least(F.size(level), run + ARITY) - at - 1)
        return F.when(F.size(built) > k + 1, F.struct(left.alias("left"), right.alias("right")))

    return F.array_compact(F.array(*map(step, range(DEPTH))))


def _digests(items: Column) -> Column:
    return F.transform(items, lambda x: x["digest"])


def fold(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks (grp, block, items, root) over nodes (grp, place, digest, ...), and each grp's root as (grp, digest).

    Places count from 0 in each grp without gaps; an item has what its node had. Rounds are written."""
    rounds = []
    while True:
        item = F.struct("place", *(c for c in nodes.columns if c not in ("grp", "place")))
        block = F.floor(F.col("place") / BLOCK).alias("block")
        blocks = nodes.groupBy("grp", block).agg(F.array_sort(F.collect_list(item)).alias("items"))
        root = F.element_at(F.element_at(levels(_digests(F.col("items")), F.col("block") == 0), -1), 1)
        blocks = cut(blocks.withColumn("root", root))
        rounds.append(blocks)
        nodes = blocks.select("grp", F.col("block").alias("place"), F.col("root").alias("digest"))
        if not nodes.where("place > 0").limit(1).count():
            return rounds, nodes.select("grp", "digest")


def descend(rounds: list[DataFrame], tops: DataFrame, make: Callable[[Column, Column], Column]) -> DataFrame:
    """What make(item, path) gives for each leaf, a struct, with the columns that tops carries; path has the siblings on each level up
    to the grp's root and then what tops (grp, above, ...) says lies above that."""
    carried = [c for c in tops.columns if c not in ("grp", "above")]
    paths = tops.withColumn("block", F.lit(0).cast("long"))

    def through(blocks: DataFrame, of: Callable[[Column, Column], Column]) -> tuple[DataFrame, Column]:
        """blocks with what lies above them, and of(item, path) for each of their nodes."""
        each = lambda built: F.transform("items", lambda x, i: let(F.concat(siblings(built, i), F.col("above")), lambda p: of(x, p)))
        return blocks.drop("root").join(paths, ["grp", "block"]), F.inline(let(levels(_digests(F.col("items")), F.col("block") == 0), each))

    for blocks in reversed(rounds[1:]):
        rows, found = through(blocks, lambda x, p: F.struct(x["place"].alias("block"), p.alias("above")))
        paths = cut(rows.select("grp", *carried, found))
    rows, found = through(rounds[0], make)
    return rows.select(*carried, found)


def climbed(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right; that of nothing for a path without any."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, key: str = "doc_id", by: str = "lang", columns: tuple[str, ...] = COLUMNS, now: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    Leaves ascend by key (null first, repeated keys by leaf) within each value of by; subroots ascend by that value (null
    first, bytewise), and make the root. folded_root is what the proof gives for the row as now has it: columns that were
    changed since, and how; a row that is the same gives the root. Nulls count as values of their own, an empty text is
    not null, repeated rows are leaves of their own, further columns are left out. Empty docs have no row and no root."""
    later = [(now or {}).get(c, F.col(c)) for c in columns]
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-")).alias("grp"), leaf(*map(F.col, columns)).alias("digest"), leaf(*later).alias("found"))
    # texts are hashed once: these narrow rows are all that is sorted and moved
    rows = cut(own.withColumn("found", F.when(F.col("found") != F.col("digest"), F.col("found"))))
    rounds, roots = fold(numbered(rows, ["grp"], [F.asc_nulls_first("key"), F.asc("digest"), F.asc("found")]))
    # the tree over the groups' roots
    top_nodes = numbered(roots.withColumnRenamed("grp", "name"), [], [F.asc("name")]).withColumn("grp", F.lit(""))
    top_rounds, root = fold(top_nodes.select("grp", "place", "digest", "name"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    tops = descend(top_rounds, root.select("grp", none.alias("above"), F.col("digest").alias("root")), lambda x, path: F.struct(x["name"].alias("grp"), path.alias("above"), x["digest"].alias("subroot")))

    def row(x: Column, path: Column) -> Column:
        return F.struct(x["key"].alias(key), x["digest"].alias("leaf"), proof(path).alias("proof_sha256"), climbed(F.coalesce(x["found"], x["digest"]), path).alias("folded_root"))

    found = descend(rounds, cut(tops), row)
    return found.select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, now={"text": F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))})


def _tree_sql(p: str, most: int) -> str:
    """CTEs of a tree over {p}0 (grp, pos, d), at most most levels: nodes, their number in a grp, and their siblings."""
    out = []
    for k in range(most):
        out.append(f"{p}n{k} AS (SELECT grp, count(*) AS n FROM {p}{k} GROUP BY 1)")
        run = f"PARTITION BY a.grp, a.pos // {ARITY} ORDER BY a.pos"
        side = lambda frame: f"coalesce(string_agg(a.d, '') OVER ({run} ROWS BETWEEN {frame}), '')"
        left, right = side("UNBOUNDED PRECEDING AND 1 PRECEDING"), side("1 FOLLOWING AND UNBOUNDED FOLLOWING")
        out.append(f"{p}s{k} AS (SELECT a.grp, a.pos, n > 1 AS up, {left} AS l, {right} AS r FROM {p}{k} a JOIN {p}n{k} USING (grp))")
        out.append(f"{p}{k + 1} AS (SELECT grp, pos // {ARITY} AS pos, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {p}{k} JOIN {p}n{k} USING (grp) GROUP BY grp, pos // {ARITY})")
    return ",\n".join(out)


def _climb_sql(name: str, start: str, p: str, most: int, keep: str) -> str:
    """CTEs that take start (keep, grp, pos, f, proof) up the levels of a tree."""
    out = []
    for k in range(most):
        before = start if k == 0 else f"{name}{k - 1}"
        out.append(f"{name}{k} AS (SELECT {keep}, c.grp, c.pos // {ARITY} AS pos, CASE WHEN up THEN sha256(l || f || r) ELSE f END AS f, CASE WHEN up THEN proof || l || r ELSE proof END AS proof FROM {before} c JOIN {p}s{k} s ON s.grp = c.grp AND s.pos = c.pos)")
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')"
    return f"sha256({' || '.join(part(text if c == 'text' else c) for c in COLUMNS)})"


_LEVELS, _TOP_LEVELS = 8, 4

OP13_SQL = f"""
WITH {CRC_TABLE},
leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_leaf_sql('text')} AS d,
  CASE WHEN {crc_sql('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf_sql('text')} END AS found FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d, found) - 1 AS pos FROM leaves),
t0 AS (SELECT grp, pos, d FROM placed),
{_tree_sql('t', _LEVELS)},
u0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, d, grp AS name FROM t{_LEVELS}),
{_tree_sql('u', _TOP_LEVELS)},
begun AS (SELECT doc_id, d AS leaf, grp AS name, grp, pos, found AS f, '' AS proof FROM placed),
{_climb_sql('c', 'begun', 't', _LEVELS, 'doc_id, leaf, name')},
crossed AS (SELECT doc_id, leaf, u0.d AS subroot, u0.grp, u0.pos, f, proof FROM c{_LEVELS - 1} JOIN u0 USING (name)),
{_climb_sql('e', 'crossed', 'u', _TOP_LEVELS, 'doc_id, leaf, subroot')}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM e{_TOP_LEVELS - 1}, u{_TOP_LEVELS} r
"""
