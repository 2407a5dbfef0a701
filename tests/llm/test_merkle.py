import hashlib
import itertools

from pyspark.sql import functions as F

from hybridspark.llm import merkle as M

from .conftest import CLASHES, agrees_with_sql


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of a list of digests, and each one's (left, right) on the way up."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            run = at // 8 * 8
            paths[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        nodes, places = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [p // 8 for p in places]
    return nodes[0], paths


def plain(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    of = lambda r, t: leaf(r[0], r[3], r[2], r[4], t)
    made = sorted(((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, of(r, r[1]), of(r, changed(r)), r[0]) for r in rows))
    groups = [list(g) for _, g in itertools.groupby(made, key=lambda x: x[:2])]
    trees = [climb([x[4] for x in g]) for g in groups]
    root, tops = climb([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(groups, trees, tops, strict=True):
        for x, path in zip(g, paths, strict=True):
            f = x[5]
            for left, right in path + top:
                f = H(left, f, right)
            out.append((x[6], x[4], subroot, root, H(*(a + b for a, b in path + top)), f, f == root))
    return sorted(out, key=str)


def upper(text):
    return F.translate(text, M._UPPER, M._LOWER)


def test_sizes_agree_with_a_loop(spark):
    """Blocks of every fill, groups of one to nine blocks, and more groups than a run has."""
    sizes = [1, 2, 8, 9, 64, 65, 511, 512, 513, 4100]
    rows = [(i * 10 + k, f"Text {i}" if i % 5 else None, f"l{k}", None if i % 3 else "s", i) for k, n in enumerate(sizes) for i in range(n)]
    rows += [(5000 + i, f"T{i}", None, "s", None) for i in range(9)] + [(6000, "One", "é", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    now = {"text": F.when(F.col("doc_id") % 4 == 0, upper("text")).otherwise(F.col("text"))}
    got = sorted((tuple(r) for r in M.manifest(df, now=now).collect()), key=str)
    assert got == plain(rows, lambda r: r[1].lower() if r[1] and r[0] % 4 == 0 else r[1])


def test_edges(spark, docs, rows, none):
    """Nulls in every column, repeated rows, copies, very long texts, clashing names, many groups."""
    more = docs.withColumns({c: F.lit("x") for c in ("grp", "place", "digest", "block", "items", "root", "leaf", "above", "found") if c not in CLASHES})
    got = sorted((tuple(r) for r in M.manifest(more, by="source").collect()), key=str)
    swapped = [(r[0], r[1], r[3], r[2], r[4]) for r in rows]
    of = {r[0]: r for r in plain(swapped, lambda r: r[1])}
    assert len(got) == len(rows) and all(r[6] for r in got) and len({r[3] for r in got}) == 1
    assert len({r[2] for r in got}) == len({r[2] for r in swapped}) == len({r[2] for r in of.values()})
    assert M.manifest(none).count() == 0
    plainly = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((tuple(r) for r in M.manifest(plainly).collect()), key=str) == plain(rows, lambda r: r[1])


def test_a_removed_or_moved_row_changes_the_root(spark):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(20)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    roots = {M.manifest(spark.createDataFrame(r, kind)).first()["root"] for r in (rows, rows[1:], [*rows[:-1], (30, "t19", "en", "s", 1)], rows[::-1])}
    assert len(roots) == 3


def test_query_agrees_with_sql(spark):
    agrees_with_sql(spark, M.op13_merkle_manifest, M.OP13_SQL)
