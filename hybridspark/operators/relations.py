"""What tables have to do with one another: deletes that cascade, details of several levels, rows without a parent."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridspark.operators.relational import with_children
from hybridspark.sources.store import dealt


@dataclass(frozen=True)
class Relation:
    """child.column refers to the key of parent. cascade: a child goes with its parent; else it stays, and is an orphan.

    order: columns that a parent's children are listed by; into: their name in a detail, that of the table if empty."""

    child: str
    column: str
    parent: str
    cascade: bool = True
    order: tuple[str, ...] = ()
    into: str = ""

    @property
    def name(self) -> str:
        return self.into or self.child


class Relations:
    """A catalogue of keys and relations. Tables are mappings from name to DataFrame; a relation whose tables aren't both there is passed over."""

    def __init__(self, keys: Mapping[str, str], relations: list[Relation]) -> None:
        self.keys, self.relations = dict(keys), list(relations)
        for r in relations:
            if r.parent not in self.keys or r.child not in self.keys:
                raise ValueError(f"{r.child}.{r.column}: a table without a key")
        try:
            graph = {t: {r.parent for r in relations if r.child == t} for t in self.keys}
            self.order = list(TopologicalSorter(graph).static_order())
        except CycleError as e:
            raise ValueError(f"relations in a circle: {' '.join(e.args[1])}") from e

    def _of(self, tables: Mapping[str, DataFrame], **ends: str) -> list[Relation]:
        return [r for r in self.relations if r.parent in tables and r.child in tables and all(getattr(r, k) == v for k, v in ends.items())]

    def delete(self, tables: Mapping[str, DataFrame], table: str, gone: DataFrame) -> dict[str, DataFrame]:
        """tables without the rows of table whose keys gone has, and without all that cascades from them, however deep.

        Level by level, parents first: a table's rows go if any cascading relation names a row that goes, by semi-joins
        on keys. Rows that refer to nothing stay. Tables with a cascading relation are counted, and keys that go are dealt to
        partitions by that, so that the join's tasks don't grow with the table."""
        keys = gone.select(F.col(self.keys[table]).alias("__gone")).where("__gone is not null").distinct()
        left, going = dict(tables), {table: keys}
        left[table] = tables[table].join(keys, tables[table][self.keys[table]] == keys["__gone"], "left_anti")
        for name in self.order:
            cascading = [r for r in self._of(tables, child=name) if r.cascade and r.parent in going]
            n = tables[name].count() if cascading else 0
            for r in cascading:
                df, ids = tables[name], dealt(going[r.parent], "__gone", rows=n)
                hit = df.join(ids, df[r.column] == ids["__gone"], "left_semi").select(F.col(self.keys[name]).alias("__gone")).where("__gone is not null")
                going[name] = dealt(hit if name not in going else going[name].unionByName(hit), "__gone", rows=n).distinct()
                left[name] = left[name].join(ids, left[name][r.column] == ids["__gone"], "left_anti")
            if name in going and name != table:
                # what goes by one relation is gone for all: its key stands in no other row
                left[name] = left[name].join(going[name], left[name][self.keys[name]] == going[name]["__gone"], "left_anti")
        return left

    def detail(self, tables: Mapping[str, DataFrame], table: str, levels: int = 1) -> DataFrame:
        """table with its children in arrays, in order, and their numbers; theirs within them, down to so many levels.

        Children are gathered from the lowest level up, one row a parent, so that relations don't multiply."""
        df = tables[table]
        for r in self._of(tables, parent=table) if levels > 0 else []:
            children = self.detail(tables, r.child, levels - 1)
            df = with_children(df, children, self.keys[table], r.column, list(r.order), children.columns, r.name)
        return df

    def orphans(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """(child, column, parent, value, n): values that refer to a row that isn't there, and how many rows do."""
        found = []
        for r in self._of(tables):
            df, parent = tables[r.child], tables[r.parent]
            values = df.where(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("value")).agg(F.count("*").alias("n"))
            lost = values.join(parent.select(F.col(self.keys[r.parent]).alias("value")), "value", "left_anti")
            found.append(lost.select(F.lit(r.child).alias("child"), F.lit(r.column).alias("column"), F.lit(r.parent).alias("parent"), F.col("value").cast("string").alias("value"), "n"))
        if not found:
            raise ValueError("no relation has both its tables")
        return reduce(DataFrame.unionByName, found)
