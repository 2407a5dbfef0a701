"""Arithmetic of vectors, dates and indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hybridspark.functions.text import once


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalized(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def rrf_term(rank: Column, weight: Column, k: int = 60) -> Column:
    return weight / (F.lit(k) + rank)


def days_until(deadline: Column, as_of: Column) -> Column:
    """Whole days to a deadline, rounded up; less than a day ago is 0."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.ceil((micros(deadline) - micros(as_of)) / F.lit(86_400_000_000))


def in_minutes(as_of: Column, minutes: int) -> Column:
    """The time so many minutes after as_of."""
    return as_of.cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes))


def iso_time(moment: Column) -> Column:
    """A time as text, to the second, in the session's time zone."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def from_iso(text: Column) -> Column:
    """The time that a text names, with or without a time of day; null for what isn't one."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def key_count(entries: Column) -> Column:
    """How many keys a map has; 0 for none and null."""
    return F.when(entries.isNull(), 0).otherwise(F.size(F.map_keys(entries)))


def deadline_flags(deadline: Column, as_of: Column) -> dict[str, Column]:
    days = days_until(deadline, as_of)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return {"urgent": flag((days > 0) & (days <= 7)), "past": flag(days < 0), "pending": flag((days > 0) & (days <= 14))}


def percent(part: Column, whole: Column) -> Column:
    """A rounded percentage, 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole * 100)).otherwise(F.lit(0.0)).cast("long")


def band(score: Column) -> Column:
    return F.when(score > 0.85, "high").when(score > 0.7, "medium").otherwise("low")


def cpu_percent(cpu: Column, cpu_before: Column, system: Column, system_before: Column, cpus: Column) -> Column:
    a, b = cpu - cpu_before, system - system_before
    return F.when((a > 0) & (b > 0), F.round(a / b * cpus * 100, 2)).otherwise(0.0)


def memory_percent(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, F.round(used / limit * 100, 2)).otherwise(0.0)


def mebibytes(size: Column) -> Column:
    return F.round(size / (1024 * 1024), 2)


def or_default(value: Column, default: object) -> Column:
    """Null and zero alike count as not given."""
    return F.when(value.isNotNull() & (value != 0), value).otherwise(F.lit(default))


def running_sums(values: Column, block: int = 128) -> Column:
    """For each value the sum of those before it, as longs. Within blocks and over the blocks' sums, as a fold copies what it has built."""
    long = "array<long>"

    def before(xs: Column) -> Column:
        grown = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))
        return F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast(long).alias("all")), grown, lambda acc: acc["all"])

    def over(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x))
        return F.flatten(F.zip_with(parts, before(totals), lambda p, base: F.transform(before(p), lambda x: x + base)))

    def cut(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda k: F.slice(xs, k * block + 1, F.lit(block)))
        return F.when(F.size(xs) > 0, once(parts, over)).otherwise(F.array().cast(long))

    return once(values, cut)


def last_at_most(ascending: Column, value: Column) -> Column:
    """The place of the last element that is at most value, by halving; -1 if all are greater."""
    def halved(xs: Column) -> Column:
        steps = F.filter(F.array(*(F.lit(1 << b) for b in reversed(range(31)))), lambda s: s <= F.size(xs))
        return F.aggregate(steps, F.lit(-1), lambda at, s: F.when(F.get(xs, at + s) <= value, at + s).otherwise(at))

    return once(ascending, halved)
