"""URL filters by a temporal list join.

Dated list changes (``add`` or ``remove`` of a pattern) become validity intervals, open at the end where nothing follows;
a capture is blocked by the patterns whose interval holds its fetch time.  A pattern is a domain, which covers its
subdomains, or a host with a path prefix that ends in a slash.  A capture's host suffixes and path prefixes are the join
keys, so the as-of join is an equality join with a condition on time.  Only DataFrame operations are used.

Hosts compare without case, paths with it.  Keys are made as deep as the listed paths go, and only those that some list
has reach the join, so a bare top-level label is no hot key unless a list blocks it.

Rows: a null or unreadable URL or a null fetch time is never blocked; list rows with a null pattern, date or action are
passed over; of several changes of a pattern on one date ``remove`` counts before ``add``, so the pattern stays
listed; repeated captures each keep their row; empty lists block nothing; other columns of the captures stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilens.llm.common import cut, maybe_broadcast


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and final dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def url_keys(url: Column, depth: Column) -> Column:
    """Patterns that could cover a URL: every suffix of its host by labels, and the host with each leading part of its
    path that ends in a slash, up to ``depth`` parts (as many as the longest listed path has)."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1), "/")
    parts = F.least(F.size(path) - 2, depth)
    none = F.array().cast("array<string>")
    prefixes = F.when(parts >= 1, F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), lambda i: F.concat(host, F.array_join(F.slice(path, 1, i + 1), "/"), F.lit("/")))).otherwise(none)
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(none)


def _pattern(p: Column) -> Column:
    """A listed pattern with its host in lower case."""
    host = F.regexp_extract(p, r"^[^/]*", 0)
    return F.concat(F.lower(host), F.substring(p, F.length(host) + 1, F.length(p)))


def validity_intervals(changes: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (excluded; null: open) from ``changes(list, pattern, dated, action)``."""
    known = changes.withColumn("pattern", _pattern(F.col("pattern"))).filter(F.col("pattern").isNotNull() & F.col("dated").isNotNull() & F.col("action").isin("add", "remove"))
    per_day = known.groupBy("list", "pattern", "dated").agg(F.min("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("dated")
    turns = per_day.withColumn("_was", F.lag("action").over(w)).filter(F.col("_was").isNull() | (F.col("_was") != F.col("action")))
    return turns.withColumn("valid_to", F.lead("dated").over(w)).filter("action = 'add'").select("list", "pattern", F.col("dated").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, changes: DataFrame, *, url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """``captures`` with blocked, list, pattern and listed_on of the longest pattern active at fetch time (ties: first
    list by name, then the earliest interval).  Columns of these names in ``captures`` are replaced."""
    made = ("blocked", "list", "pattern", "listed_on")
    captures = captures.drop(*made)
    asked = captures.select(F.col(url_col).alias("_url"), F.col(time_col).alias("_at")).dropna().distinct()
    intervals = cut(validity_intervals(changes))
    depth = intervals.agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 2), F.lit(0)).alias("_depth"))  # one row
    keys = asked.join(F.broadcast(depth)).withColumn("_key", F.explode(url_keys(F.col("_url"), F.col("_depth")))).drop("_depth")
    entries = maybe_broadcast(intervals)
    active = keys.join(entries, (F.col("_key") == F.col("pattern")) & (F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    best = active.groupBy("_url", "_at").agg(F.min(F.struct((-F.length("pattern")).alias("n"), "list", F.col("valid_from").alias("listed_on"), "pattern")).alias("_best"))
    out = captures.join(best, (F.col(url_col) == F.col("_url")) & (F.col(time_col) == F.col("_at")), "left")
    return out.select(*captures.columns, F.col("_best").isNotNull().alias("blocked"), F.col("_best.list").alias("list"), F.col("_best.pattern").alias("pattern"), F.col("_best.listed_on").alias("listed_on"))
