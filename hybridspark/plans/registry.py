"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hybridspark.functions.text import STOP_WORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS if len(w) > 2)


def token_list(text: str) -> str:
    """SQL for the search tokens of a text."""
    raw = rf"list_transform(regexp_extract_all(lower({text}), '(?:^|[^\p{{L}}\p{{N}}_])([a-z0-9][\p{{L}}\p{{N}}_-]*)', 1), lambda x: rtrim(x, '-'))"
    return f"list_filter({raw}, lambda x: NOT list_contains([{_STOP}], x))"
