import base64
import random

import public_tokenizers as public
import pytest
import tiktoken

from hybridspark.llm import bpe as M

RANKS = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_any_text_is_encoded_as_the_library_does(theirs):
    ours, rng = M.load(RANKS, public.PATTERN), random.Random(2)
    pools = ["ab 's", "a\n \t\x1c\x1d\x85 b", "é世界😀 12", "x'llre  \r\n-", "\U0003d09c똸 a1"]
    for _ in range(600):
        t = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.choice([3, 20, 200])))
        assert ours.encode(t) == theirs.encode_ordinary(t)
        assert ours.decode(ours.encode(t)) == t.encode()
    t = "".join(chr(c) + " a" for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    assert ours.encode(t) == theirs.encode_ordinary(t)


def test_whole_tables(docs, rows, theirs):
    got = M.encode(docs, RANKS, public.PATTERN, chunk=500, overlap=60)
    assert got.columns.count("ids") == 1 and "no" in got.columns and "text" not in got.columns
    found = sorted(((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in got.collect()), key=str)
    assert found == sorted(((i is None, i or 0, theirs.encode_ordinary(t or "")) for i, t, *_ in rows), key=str)
    back = M.decode(got.where("doc_id = 5"), RANKS).first()
    assert bytes(back.decoded).decode() == rows[5][1]


def test_pre_tokens_longer_than_the_overlap(spark, theirs):
    texts = {1: "ab " * 900 + "x" * 6000 + " tail " * 500, 2: " " * 5000 + "b", 3: "it's   fine\n\n " * 400}
    df = spark.createDataFrame(list(texts.items()) + [(1, texts[1])], "doc_id long, text string")
    got = M.encode(df, RANKS, public.PATTERN, chunk=1000, overlap=100).collect()
    assert len(got) == 4 and all(list(r.ids) == theirs.encode_ordinary(texts[r.doc_id]) for r in got)


def test_empty_table(none):
    assert M.decode(M.encode(none, RANKS, public.PATTERN), RANKS).count() == 0
