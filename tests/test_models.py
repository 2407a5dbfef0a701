import os
import time
import uuid

from pyspark.sql import functions as F

from hybridspark.operators.models import Memo, Model
from hybridspark.sources.snapshots import Snapshots
from hybridspark.sources.store import shared_folder


def counting(folder, fail=""):
    """A model that leaves a file for each load and each call, and fails where it reads fail."""

    def note(kind, n):
        open(f"{folder}/{kind}-{os.getpid()}-{n}-{uuid.uuid4().hex}", "w").close()

    def load():
        note("load", 0)

        def call(texts):
            note("call", len(texts))
            if fail and any(fail in t for t in texts):
                raise RuntimeError("no answer")
            return [t[::-1] for t in texts]

        return call

    return load


def notes(folder, kind):
    return [f.split("-") for f in os.listdir(folder) if f.startswith(kind)]


def test_one_load_a_worker_and_batches_of_32(spark, tmp_path):
    df = spark.range(1000).repartition(2).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    model = Model(f"m{uuid.uuid4()}", counting(tmp_path))
    for _ in range(2):
        got = df.withColumn("r", model(F.when(F.col("id") % 10 != 0, F.col("t")))).collect()
        assert all((r.r.value, r.r.error) == (r.t[::-1] if r.id % 10 else None, None) for r in got)
    workers = [n[1] for n in notes(tmp_path, "load")]
    assert len(workers) == len(set(workers)) <= 8
    sizes = [int(n[2]) for n in notes(tmp_path, "call")]
    assert max(sizes) == 32 and sum(sizes) == 1800 and len(sizes) <= 2 * (1800 // 64 + 4)


def test_errors_are_values(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id int, t string").coalesce(1)
    model = Model(f"m{uuid.uuid4()}", counting(tmp_path, fail="text 7"), attempts=2)
    got = {r.id: r.r for r in df.withColumn("r", model(F.col("t"))).collect()}
    assert got[7] == (None, "RuntimeError: no answer") and all(v.error is None and v.value for i, v in got.items() if i != 7)

    def slow():
        return lambda texts: [time.sleep(5 if "slow" in t else 0) or [1.0, 2.0] for t in texts]

    limited = Model(f"m{uuid.uuid4()}", slow, "array<double>", batch=1, attempts=1, seconds=0.5)
    rows = spark.createDataFrame([("slow",), ("quick",)], "t string").coalesce(1).withColumn("r", limited(F.col("t"))).collect()
    assert {r.t: (r.r.value, (r.r.error or "")[:12]) for r in rows} == {"slow": (None, "TimeoutError"), "quick": ([1.0, 2.0], "")}
    short = Model(f"m{uuid.uuid4()}", lambda: lambda texts: [], attempts=1)
    assert "0 values for 1" in short.answer(["x"])[0][1]


def test_a_prompt_is_asked_once(spark, tmp_path):
    memo = Memo(Snapshots(spark, shared_folder(spark)))
    model = Model(f"m{uuid.uuid4()}", counting(tmp_path, fail="bad"), attempts=1)
    rows = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, prompt string")
    sent = lambda: sum(int(n[2]) for n in notes(tmp_path, "call"))
    got = memo.answers(rows("one", "two", "one", None), model)
    assert sorted((r.id, r.answer, r.error) for r in got.collect()) == [(0, "eno", None), (1, "owt", None), (2, "eno", None), (3, None, None)]
    assert got.count() == 4 and sent() == 2
    assert {r.prompt: r.answer for r in memo.answers(rows("two", "three"), model).collect()} == {"two": "owt", "three": "eerht"} and sent() == 3
    for n in (4, 5):  # an error is not kept
        assert [r.error for r in memo.answers(rows("bad", "two"), model).orderBy("id").collect()] == ["RuntimeError: no answer", None] and sent() == n
    other = Model(f"m{uuid.uuid4()}", counting(tmp_path))
    memo.answers(rows("two"), other)
    assert sent() == 6
