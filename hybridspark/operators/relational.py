"""Listings, details, changes and indicators of ordinary tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hybridspark.functions.numbers import days_until, percent
from hybridspark.sources.store import stored


def where_given(df: DataFrame, equal: Mapping[str, object] | None = None, like: Mapping[Iterable[str] | str, str | None] | None = None, tags: Mapping[str, str | None] | None = None, unequal: Mapping[str, object] | None = None) -> DataFrame:
    """Rows that meet every predicate that is given; a None leaves its predicate out.

    like: a column, or a tuple of which one must match, to a text; % and _ in it are wildcards."""
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(c) != v for c, v in (unequal or {}).items() if v is not None]
    for names, text in (like or {}).items():
        if text:
            names = (names,) if isinstance(names, str) else names
            tests.append(reduce(Column.__or__, (F.col(c).ilike(f"%{text}%") for c in names)))
    tests += [F.array_contains(c, v) for c, v in (tags or {}).items() if v is not None]
    return reduce(DataFrame.where, tests, df)


def page(df: DataFrame, newest: str, key: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page by descending newest, nulls first, then by key."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must be 0 or more, limit from 1 to 100")
    return df.orderBy(F.desc_nulls_first(newest), key).offset(skip).limit(limit)


def total(df: DataFrame) -> DataFrame:
    """The number of rows before paging, as one row."""
    return df.agg(F.count("*").alias("total"))


def newest_per(df: DataFrame, by: str, newest: str, key: str, n: int = 50) -> DataFrame:
    """The n newest rows of each value of by, with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_first(newest), F.desc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_children(parents: DataFrame, children: DataFrame, key: str, parent_key: str, order: list[str], columns: list[str], into: str) -> DataFrame:
    """parents with an array of their children, in order (null as 0), and their number; empty where there are none.

    Children are gathered before the join, one row a parent."""
    sort = [F.coalesce(F.col(c), F.lit(0)).alias(f"__{c}") for c in order]
    lists = children.groupBy(F.col(parent_key).alias("__parent")).agg(F.array_sort(F.collect_list(F.struct(*sort, *columns))).alias("__all"))
    lists = lists.select("__parent", F.transform("__all", lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(into))
    joined = parents.join(lists, parents[key] == lists["__parent"], "left").drop("__parent")
    empty = F.array().cast(lists.schema[into].dataType)
    return joined.withColumn(into, F.coalesce(into, empty)).withColumn(f"{into}_count", F.size(into).cast("long"))


def insert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df with rows appended; they get ids above the largest, in the order of their other columns.

    Rows are dealt into ranges, repeated ones too, which are written once; an id is the number of rows in the ranges
    before, one row a range, and the place within its own."""
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("__top"))
    order = [*(F.col(f"`{c}`") for c in rows.columns if c != key), F.col("__tie")]
    dealt = rows.drop(key).withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    dealt = stored(dealt.withColumn("__range", F.spark_partition_id()))
    before = F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    bases = dealt.groupBy("__range").agg(F.count("*").alias("__rows")).select("__range", F.coalesce(before, F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    numbered = dealt.withColumn("__n", place).join(F.broadcast(bases), "__range").crossJoin(F.broadcast(top))
    numbered = numbered.withColumn(key, F.col("__top") + F.col("__base") + F.col("__n"))
    return df.unionByName(numbered.drop("__top", "__base", "__n", "__tie", "__range"), allowMissingColumns=True)


def default_children(parents: DataFrame, key: str, titles: list[str]) -> DataFrame:
    """For each parent one row a title, numbered from 0."""
    return parents.select(F.col(key), F.posexplode(F.array(*map(F.lit, titles))).alias("order", "title"))


def apply_patch(df: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the columns that a patch sets; patches have key and, for each column, its value and a flag set_<column>.

    A flag that is set writes a null too. One patch a key."""
    p = patches.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns), *(F.col(f"set_{c}").alias(f"__set_{c}") for c in columns))
    joined = df.join(p, df[key] == p["__key"], "left")
    changed = {c: F.when(F.coalesce(f"__set_{c}", F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).select(df.columns)


def add_counts(df: DataFrame, events: DataFrame, key: str, event_key: str, counter: str) -> DataFrame:
    """df with counter raised by the number of its events, null as 0."""
    n = events.groupBy(F.col(event_key).alias("__key")).agg(F.count("*").alias("__n"))
    joined = df.join(n, df[key] == n["__key"], "left")
    return joined.withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("__n", F.lit(0))).select(df.columns)


def delete_cascade(parents: DataFrame, gone: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parents and children without the keys in gone; rows whose key is null stay."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    left = lambda df, c: df.join(ids, df[c] == ids["__gone"], "left_anti")
    return {"parents": left(parents, key)} | {name: left(df, c) for name, (df, c) in children.items()}


def delete_where(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and how many go; where the test is null the row stays."""
    goes = F.coalesce(test, F.lit(False))
    return df.where(~goes), df.agg(F.count_if(goes).alias("deleted"))


def upsert_latest(df: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """The last row of each key, by newest."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in newest))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that a uniqueness constraint would refuse."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def with_column_if_missing(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """df with a default in place of each null, and of each column that it lacks; an empty list is one of texts."""

    def value(v: object) -> Column:
        return F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)

    return df.withColumns({c: F.coalesce(F.col(c), value(v)) if c in df.columns else value(v) for c, v in defaults.items()})


def by_status(df: DataFrame, status: str, shown: list[str]) -> DataFrame:
    """How many rows each shown status has, 0 included, in the given order."""
    dim = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, shown))).alias("position", "status"))
    n = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return dim.join(n, "status", "left").select("position", "status", F.coalesce("n", F.lit(0)).alias("n"))


def kpis(df: DataFrame, status: str, deadline: str, as_of: Column, active: list[str], won: str, lost: str) -> DataFrame:
    """One row: active, won and decided rows, the win rate in percent, and active rows due within 14 days."""
    s, days = F.col(status), days_until(F.col(deadline), as_of)
    counts = df.agg(
        F.count_if(s.isin(active)).alias("active"),
        F.count_if(s == won).alias("won"),
        F.count_if(s.isin(won, lost)).alias("decided"),
        F.count_if((days > 0) & (days <= 14)).alias("pending"),
    )
    return counts.withColumn("win_rate", percent(F.col("won"), F.col("decided")))


def expired(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Rows whose expiry lies before as_of; rows without one never expire."""
    return df.where(F.col(expires) < as_of)


def lookup(asked: DataFrame, owners: DataFrame, owned: DataFrame, name: str, owner_key: str, owned_key: str) -> DataFrame:
    """The rows of owned that belong to the owners of the asked names: names to owners, owners to their rows."""
    keys = asked.select(name).distinct().join(owners.select(name, owner_key), name)
    return keys.join(owned, F.col(owner_key) == F.col(owned_key))


def status_counts(df: DataFrame, by: str, status: str) -> DataFrame:
    """(by, status, n): for each parent how many rows have each status; a status without rows is left out."""
    return df.groupBy(by, status).agg(F.count("*").alias("n"))


def progress(df: DataFrame, by: str, status: str, done: list[str]) -> DataFrame:
    """For each parent its rows, and the share of those that are done."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(status).isin(done)).alias("done")).withColumn("share", F.col("done") / F.greatest("n", F.lit(1)))


def insert_unique(df: DataFrame, rows: DataFrame, key: str, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """df with those of rows that a unique, non-null key lets in, and the others with the reason why not.

    Reasons: no key; stored already; repeated, where an earlier one of rows by order (all columns, if not given) has the
    key. The stored side of the join is its key alone, and Spark prunes it by a Bloom filter of the new keys at run time
    where that pays. Hold rows to the same values if they are computed: both results read them."""
    names = order or [c for c in rows.columns if c != key]
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(f"`{c}`") for c in names)))
    known = df.select(F.col(key).alias("__known")).where("__known is not null").distinct()
    keyed = rows.where(F.col(key).isNotNull())
    judged = keyed.withColumn("__nth", nth).join(known, F.col(key) == F.col("__known"), "left")
    reason = F.when(F.col("__known").isNotNull(), "stored already").when(F.col("__nth") > 1, "repeated")
    judged = judged.withColumn("reason", reason).drop("__nth", "__known")
    refused = rows.where(F.col(key).isNull()).withColumn("reason", F.lit("no key")).unionByName(judged.where("reason is not null"))
    return df.unionByName(judged.where("reason is null").drop("reason"), allowMissingColumns=True), refused
