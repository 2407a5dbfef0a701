"""Calls of models from Spark: loaded once a worker, in small batches of like length, with errors as values, and never twice for one prompt."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridspark.sources.snapshots import Manifest, Snapshots
from hybridspark.sources.store import stored

Call = Callable[[list[str]], list]
#: What this process has loaded, by name: a worker keeps it from one task to the next.
_LOADED: dict[str, Call] = {}


@dataclass(frozen=True)
class Model:
    """load gives a function from texts to as many values, of Spark type kind. The name stands for the model and its settings.

    batch: texts of a call. attempts: how often a call is tried. seconds: how long one may take, if given."""

    name: str
    load: Callable[[], Call]
    kind: str = "string"
    batch: int = 32
    attempts: int = 3
    seconds: float | None = None

    def ready(self) -> Call:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]

    def _once(self, texts: list[str]) -> list:
        call = self.ready()
        if self.seconds is None:
            found = call(texts)
        else:
            pool = ThreadPoolExecutor(1)
            try:
                found = pool.submit(call, texts).result(self.seconds)
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        if len(found) != len(texts):
            raise ValueError(f"{self.name} gave {len(found)} values for {len(texts)} texts")
        return list(found)

    def answer(self, texts: list[str]) -> list[tuple[object, str | None]]:
        """A value, or an error, for each text. A batch that fails each time is tried text by text, so one text spoils no other."""
        said = "not tried"
        for _ in range(self.attempts):
            try:
                return [(v, None) for v in self._once(texts)]
            except Exception as e:  # whatever a model or its server raises
                said = f"{type(e).__name__}: {e}".rstrip(": ")
        return [(None, said)] if len(texts) == 1 else [x for t in texts for x in self.answer([t])]

    def __call__(self, text: Column) -> Column:
        """A struct of value and error for each text; both are null for a null text, which is not sent."""

        @F.pandas_udf(f"value {self.kind}, error string")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in parts:
                out: list[tuple[object, str | None]] = [(None, None)] * len(texts)
                # those of like length together, so that a batch is padded little
                order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: len(texts.iloc[i]))
                for k in range(0, len(order), self.batch):
                    some = order[k : k + self.batch]
                    for i, x in zip(some, self.answer([texts.iloc[i] for i in some]), strict=True):
                        out[i] = x
                yield pd.DataFrame({"value": pd.Series([v for v, _ in out], dtype=object), "error": pd.Series([e for _, e in out], dtype=object)})

        return run(text)

    def value(self, text: Column) -> Column:
        """The value alone, as the engine takes a model."""
        return self(text)["value"]


class Memo:
    """Answers by the digest of model and prompt, kept from one job to the next."""

    def __init__(self, log: Snapshots) -> None:
        self.log = log

    def _known(self, m: Manifest, kind: str) -> DataFrame:
        schema, paths = f"__digest string, answer {kind}", m.get("memo", [])
        return self.log.spark.read.schema(schema).parquet(*paths) if paths else self.log.spark.createDataFrame([], schema)

    def answers(self, rows: DataFrame, model: Model, prompt: str = "prompt") -> DataFrame:
        """rows with answer and error. Each distinct prompt that was not answered before is sent once; errors are not kept.

        Null prompts have neither. Known answers and new ones are one change of the memo."""
        digest = F.sha2(F.concat(F.lit(f"{model.name}\0"), F.col(prompt)), 256)
        rows = stored(rows.withColumn("__digest", digest))
        known = self._known(self.log.manifest()[1], model.kind)
        new = rows.where("__digest is not null").groupBy("__digest").agg(F.first(prompt).alias("__prompt")).join(known, "__digest", "left_anti")
        # dealt anew, as what is left to ask may lie in few tasks; written, so that no later step asks again
        said = stored(new.repartition("__digest").withColumn("__r", model(F.col("__prompt"))).select("__digest", F.col("__r.value").alias("answer"), F.col("__r.error").alias("error")))

        def grown(m: Manifest) -> Manifest:
            if said.where("error is null").isEmpty():
                return m
            path = self.log.new_part()
            said.where("error is null").select("__digest", "answer").write.parquet(path)
            return {**m, "memo": [*m.get("memo", []), path]}

        self.log.update(grown)
        every = known.withColumn("error", F.lit(None).cast("string")).unionByName(said)
        return rows.join(every, "__digest", "left").drop("__digest")
