import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hybridspark.llm import shingles as S
from hybridspark.llm import simhash as M
from hybridspark.llm.minhash import shingle_hashes, sketch


def test_hashes_are_those_of_the_library():
    rng = random.Random(1)
    strings = [rng.randbytes(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 23, 24, 31, 32, 33, 63, 64, 100, 511, 512, 513, 900])) for _ in range(600)]
    size = np.array([len(s) for s in strings])
    seeds = np.array([rng.getrandbits(64) for _ in strings], dtype=np.uint64)
    got = S.Strings(np.frombuffer(b"".join(strings) + bytes(8), dtype=np.uint8), np.cumsum(size) - size, size)
    want = [xxhash.xxh64_intdigest(s, int(seed)) for s, seed in zip(strings, seeds, strict=True)]
    assert got.hashes(seeds).tolist() == want and got.hashes(seeds[7:400], 7).tolist() == want[7:400]


@pytest.mark.parametrize(("step", "block"), [(1 << 14, 1 << 19), (3, 500)])
def test_prints_are_those_of_single_texts(spark, rows, monkeypatch, step, block):
    """Over awkward rows, also where texts and shingles are cut into many small steps."""
    run = S.prints.__globals__  # workers get the values that these hold when they are sent
    monkeypatch.setitem(run, "_STEP", step)
    monkeypatch.setitem(run, "_BLOCK", block)
    texts = [r[1] for r in rows if len(r[1] or "") < 3000] + ["a b", "a b c d e", "A B C D E F G", "ÀÉ Ü I İ x y", "a\xa0b c d e f g", f"{'x' * 3000} y z {'q' * 40}", *("lorem ipsum " * n for n in (2, 3, 4, 40))]
    k = 5
    if step == 3:
        # in this process: each text among others
        data = [(t or "").encode() for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        assert S.fingerprints(np.frombuffer(b"".join(data), dtype=np.uint8), starts, k).tolist() == [M.simhash(t, k) for t in texts]
        return
    lower = F.lower(F.coalesce("text", F.lit("")))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    df = df.select("id", S.prints(F.col("text"), k).alias("p"), S.distinct(F.col("text"), k).alias("d"), sketch(lower, k).alias("sketch"), F.array_sort(F.array_distinct(shingle_hashes(lower, k))).alias("hashes"))
    found = {r.id: r for r in df.collect()}
    assert [found[i].p.fingerprint for i in range(len(texts))] == [M.simhash(t, k) for t in texts]
    few = {}
    for r in found.values():
        assert r.p.sketch == r.sketch and r.d == r.hashes and (r.p.few is None) == (len(r.hashes) > S.FEW)
        if r.p.few is not None:
            few.setdefault(r.p.few, set()).add(tuple(r.hashes))
    assert all(len(s) == 1 for s in few.values()) and len(few) == len({tuple(r.hashes) for r in found.values() if len(r.hashes) <= S.FEW})


def test_texts_of_few_shingles_meet_only_their_like(spark, monkeypatch):
    """Sketches of one shingle hold four bits, so that one in sixteen of such texts had each key in common."""
    texts = [f"w{i} x" for i in range(300)] + [f"a{i} b c d e f g" for i in range(100)] + ["W7  x", "A9 b C d e\nf g"]
    seen, bring = [], M.bring
    monkeypatch.setattr(M, "bring", lambda pairs, values: seen.extend(map(tuple, pairs.collect())) or bring(pairs, values))
    got = M.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    roots = {}
    for r in got:
        roots.setdefault(r.root, set()).add(r.first.key)
    assert sorted(map(sorted, (x for x in roots.values() if len(x) > 1))) == [[7, 400], [309, 401]]
    assert len(set(seen)) <= 20
