import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from hybridspark.llm import simhash as M
from hybridspark.llm.minhash import sketch


def plain(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components_agree_with_brute_force(docs, rows):
    got = M.near_duplicates(docs)
    assert "size" in got.columns
    found = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got.collect())
    prints = {t: signed(plain(t)) for _, t, *_ in rows}
    fps = set(prints.values())
    root = groups(fps, [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2])
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            r = root[prints[t]]
            least[r] = min(i, least.get(r, i))
    assert found == sorted((i is None, i or 0, prints[t], least.get(root[prints[t]])) for i, t, *_ in rows)


def test_links_keep_every_connection(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.append(signed(x))
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << b
    fps += [0, signed(1 << 63), signed((1 << 63) | 1)]
    df = spark.createDataFrame([(f,) for f in fps * 2], "fingerprint long")
    got = {r.node: r.root for r in M.components(M.links(df)).collect()}
    want = groups(set(fps), [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2])
    assert {f: got.get(f, f) for f in set(fps)} == want


def test_long_chains_settle(spark):
    rng = random.Random(1)
    names = rng.sample(range(-(10**6), 10**6), 300)
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")
    assert {r.root for r in M.components(edges).collect()} == {min(names)}


def test_empty_table(none):
    assert M.near_duplicates(none).count() == 0


def test_hex(spark):
    assert spark.range(1).select(M.hex64(F.lit(5)).alias("h")).first().h == "0000000000000005"


def made_pairs(rng, n, changed):
    """Pairs of 200 words that differ in one run of so many words: 196 + 4 + changed shingles, 192 - changed in common."""
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:90] + [f"w{rng.randrange(10**6)}" for _ in range(changed)] + words[90 + changed :]))]
    return rows


@pytest.mark.parametrize("changed,share", [(17, 0.9), (11, 0.98), (5, 1.0)])
def test_bands_find_pairs_at_the_threshold(spark, changed, share):
    # similarities of 0.807, 0.858 and 0.912; the keys don't depend on how many texts there are
    rows = made_pairs(random.Random(11), 400, changed)
    keys = spark.createDataFrame(rows, "id long, text string").select(F.explode(M.bands(sketch(F.col("text"), 5))).alias("key"), "id")
    met = {}
    for r in M.shared(keys).collect():
        met.setdefault(r.key, set()).add(r.id)
    assert sum(any({2 * i, 2 * i + 1} <= m for m in met.values()) for i in range(400)) >= share * 400


def test_groups_agree_with_brute_force(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 30, 150]))]
        for _ in range(5):
            texts.append(" ".join(words))
            for _ in range(rng.choice([0, 1, 1, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(texts)
    shingles = {t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts}
    alike = [(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    want = groups(set(shingles), alike)
    got = M.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(shingles)
    names = {hashlib.md5(t.encode()).hexdigest(): t for t in texts}
    roots = {}
    for r in got:
        assert r.first.key == texts.index(names[r.md5])
        roots.setdefault(r.root, set()).add(names[r.md5])
    whole = {}
    for t, r in want.items():
        whole.setdefault(r, set()).add(t)
    # no group joins texts that are not connected; pairs at the very threshold may be missed
    assert all(any(g <= w for w in whole.values()) for g in roots.values())
    assert len(roots) <= len(whole) + 1


def test_every_pair_of_a_bucket_is_decided(spark, monkeypatch):
    # one member in turn is a stranger to all others, which make up two groups and loners
    monkeypatch.setattr(M, "DRAWS", 1)
    monkeypatch.setattr(M, "HEADS", 1)
    monkeypatch.setattr(M, "MOST", 1)
    ids = [0, 11, 12, 13, 21, 22, 30, 40]
    members = spark.createDataFrame([("k", i, i) for i in ids], "key string, id long, s long")
    tried = []

    def alike(pairs):
        tried.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("a div 10 = b div 10")

    roots = {r.node: r.root for r in M.decide(members, lambda x, y: x + y >= 0, alike).collect()}
    assert roots == {11: 11, 12: 11, 13: 11, 21: 21, 22: 21}
    assert all((a, b) in tried or roots.get(a) == roots.get(b) for a in ids for b in ids if a < b)


def test_pairs_of_several_buckets_meet_in_one(spark, monkeypatch):
    monkeypatch.setattr(M, "HEADS", 2)
    rng = random.Random(17)
    keys = {i: sorted(rng.sample(range(9), rng.randrange(1, 6))) for i in range(30)}
    rows = [(k, i, i, len(of), of) for i, of in keys.items() for k in of]
    members = spark.createDataFrame(rows, "key long, id long, s long, degree long, keys array<long>")
    rounds = []

    def alike(pairs):
        rounds.append([(r.a, r.b) for r in pairs.collect()])
        return pairs.where("a div 4 = b div 4")

    roots = {r.node: r.root for r in M.decide(members, lambda x, y: x + y >= 0, alike).collect()}
    tried = {p for r in rounds for p in r}
    meet = [(a, b) for a in keys for b in keys if a < b and set(keys[a]) & set(keys[b])]
    assert all(p in tried or roots.get(p[0], p[0]) == roots.get(p[1], p[1]) for p in meet) and tried <= set(meet)
    want = groups(set(keys), [(a, b) for a, b in meet if a // 4 == b // 4])
    assert {i: roots.get(i, i) for i in keys} == want
    # after the first draw no pair is tried in a second bucket
    later = [p for r in rounds[1:] for p in r]
    assert len(later) == len(set(later))
