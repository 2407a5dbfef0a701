"""URL filters: rules for hosts and path prefixes, and a long list of single URLs behind a blocked Bloom filter.

Listed URLs are made canonical and hashed. A hash names one block of 512 bits and a bit in each of its eight words, so a
test touches one block. The filter is built by or-ing words with partial aggregates, broadcast (its size has a bound
that does not grow with the list), and tested in Arrow batches. Only rows that may be listed are shuffled: an exact join
with the list decides them, so false positives cost time and never a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

#: Words of a block, of 64 bits each.
WORDS = 8
#: Bits for each listed URL: about one false positive in a thousand at 16.
BITS = 16
#: A filter has this many blocks at most (64 MB); a longer list makes it denser, and more rows go to the exact join.
MOST_BLOCKS = 1 << 20
#: Rules stand in the expression of each row, so there is a bound on them; longer lists are lists of URLs.
MOST_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://; empty without one, and for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling for the URLs that name one page; null where there is no host.

    Scheme, user, the usual ports, a host's last dot, fragment, slashes at the end and utm_ parameters are left out,
    parameters are sorted and separated by &, the host is in lower case."""
    name = F.regexp_replace(F.regexp_replace(host(url), "^.*@", ""), r"\.?(:(80|443)?)?$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.array_sort(F.split(query, "&")), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_")))
    page = F.concat(name, F.regexp_replace(path(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(name != "", page)


def rule_of(url_host: Column, url_path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule (rule, verdict) that fits, null if none does.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the path starts with its own. The longest
    text of host and path wins, then the longer host, then block."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: list URLs instead")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(set(rules), key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block", r)):
        name = F.lit(h.translate(str.maketrans(_UPPER, _LOWER)))
        fits = ((url_host == name) | F.endswith(url_host, F.concat(F.lit("."), name))) & F.startswith(url_path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _hashes(url: Column) -> tuple[Column, Column]:
    """What names the block, and what the bits: two hashes that have nothing to do with one another."""
    return F.xxhash64(url), F.xxhash64(url, F.lit("bits"))


def blocked_bloom(listed: DataFrame, bits: int = BITS, most_blocks: int = MOST_BLOCKS) -> np.ndarray:
    """The filter (blocks, WORDS) of listed (url), distinct and canonical: a power of two of blocks, most_blocks at most.

    The driver gets one row for each block with a bit in it."""
    need = max(1, -(-listed.count() * bits // (64 * WORDS)))
    n = min(most_blocks, 1 << (need - 1).bit_length())
    where, which = _hashes(F.col("url"))
    # six bits of the second hash name a word's bit
    words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(which, {6 * i}) & 63 as int))")).alias(f"w{i}") for i in range(WORDS)]
    built = listed.select(F.pmod(where, F.lit(n)).alias("block"), which.alias("which")).groupBy("block").agg(*words).toArrow()
    out = np.zeros((n, WORDS), np.uint64)
    if built.num_rows:
        out[built["block"].to_numpy()] = np.stack([built[f"w{i}"].to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
    return out


def may_be_listed(rows: DataFrame, bloom: np.ndarray, url: str = "canonical") -> DataFrame:
    """rows with maybe: false means that url is not in the filter; null urls never are."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom)
    shifts = np.arange(0, 6 * WORDS, 6, dtype=np.uint64)

    where, which = _hashes(F.col(url))
    hashed = rows.withColumns({"__block": F.pmod(where, F.lit(len(bloom))), "__which": which})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at = rows.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for b in batches:
            block, bits = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy().view(np.uint64)
            masks = np.uint64(1) << ((bits[:, None] >> shifts) & np.uint64(63))
            hit = ((bloom[block] & masks) == masks).all(axis=1) & b.column(at).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(hit)], names=[*b.schema.names[:-2], "maybe"])

    return hashed.mapInArrow(run, f"{fields}, maybe boolean")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url", listed_url: str = "url", bits: int = BITS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(key, host, path, rule, verdict, canonical, listed) of every row of pages.

    verdict: the rule's if one fits, else block if the canonical URL is listed and allow if not. Null URLs, and those
    without ://, have an empty host and path, fit no rule and are never listed. Repeated rows come back as often as they
    are there; listed may repeat URLs, spell them in other ways or be empty; further columns are left out."""
    known = cut(listed.select(canonical(F.col(listed_url)).alias("url")).where("url is not null").distinct())
    rows = pages.select(F.col(key).alias("key"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("key", "host", "path", "canonical", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
    # written, so that the filter runs once for the rows that it lets through and those that it doesn't
    tested = cut(may_be_listed(rows, blocked_bloom(known, bits, most_blocks)))
    exact = tested.where("maybe").join(known.select(F.col("url").alias("canonical"), F.lit(True).alias("listed")), "canonical", "left")
    out = exact.select("key", "host", "path", "rule", "verdict", "canonical", F.coalesce("listed", F.lit(False)).alias("listed"))
    out = out.unionByName(tested.where(~F.col("maybe")).select("key", "host", "path", "rule", "verdict", "canonical", F.lit(False).alias("listed")))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))).withColumnRenamed("key", key)


#: The rules of the query, and the host names whose pages make its list.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op12_blocked_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: all pages of hosts that have one of LISTED_NAMES among their names."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.arrays_overlap(F.split(host(F.col("url")), r"\."), F.array(*map(F.lit, LISTED_NAMES))))
    return judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


def _fits_sql(h: str, p: str) -> str:
    return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"


def _rules_sql(what: int) -> str:
    whole = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN {_fits_sql(h, p)} THEN '{(h + p, v)[what]}'" for h, p, v in whole) + " END"


OP12_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_filter(list_sort(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&')), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS kept FROM r),
n AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:(80|443)?)?$', '') AS name FROM p),
c AS (SELECT *, CASE WHEN name <> '' THEN name || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM n),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND list_has_any(string_split(host, '.'), {list(LISTED_NAMES)}))
SELECT page_id, host, path, {_rules_sql(0)} AS rule,
  coalesce({_rules_sql(1)}, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM c
"""
