"""URL verdicts from host and path rules, found through hash prefixes.

Every URL is expanded into host-suffix and path-prefix expressions, of the shapes (number of
labels, path length) that occur among the rules and no others. Expressions meet the rules in an
equi-join on the first bytes of their SHA-256; the whole digest then confirms the match. The
longest fitting rule wins; equal lengths are decided by the longer host, then block before allow.

Distinct URLs are judged once, so a URL or a host that owns many rows costs no more than others.
Null URLs and URLs without ``://`` have an empty host and path and take the default verdict.
Repeated rows are kept, an empty table gives no rows, other columns are not read. Rules with a null or empty
host fit nothing; a null rule path is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8  # hexadecimal digits of the short hash


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    mark = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(mark > 0, url.substr(mark + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _expression(host: Column, path: Column) -> Column:
    """A host has no slash, so the first one separates host and path."""
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def judge_urls(
    pages: DataFrame, rules: DataFrame, keep: Sequence[str] = (), url: str = "url", default: str = "allow",
) -> DataFrame:
    """The ``keep`` columns of every row with its host, path, rule (or null) and verdict.

    ``rules`` has host, path and verdict (allow or block). The shapes of the rules are collected:
    at most one entry per number of labels and path length, however many rules there are.
    """
    known = rules.select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).filter("r_host <> ''")
    shapes = known.select(
        F.size(F.split("r_host", "[.]")).alias("labels"), F.length("r_path").alias("length"),
    ).distinct().collect()
    known = known.select("*", _expression(F.col("r_host"), F.col("r_path")).alias("r_digest"))
    known = known.select("*", F.substring("r_digest", 1, PREFIX).alias("r_prefix"))

    distinct = pages.select(F.col(url).alias("u")).filter("u IS NOT NULL").distinct()
    host, path = host_and_path(F.col("u"))
    distinct = distinct.select("u", host.alias("host"), path.alias("path")).filter("host <> ''")
    labels = F.split("host", "[.]")
    expansions = [
        F.when(
            (F.size(labels) >= s.labels) & (F.length("path") >= s.length),
            _expression(F.array_join(F.slice(labels, -s.labels, s.labels), "."), F.substring("path", 1, s.length)),
        )
        for s in shapes
    ]
    digests = F.array_compact(F.array(*expansions)) if expansions else F.array().cast("array<string>")
    asked = distinct.select("u", F.explode(digests).alias("digest"))
    asked = asked.select("*", F.substring("digest", 1, PREFIX).alias("prefix"))
    found = asked.join(known, F.col("prefix") == F.col("r_prefix")).filter("digest = r_digest")
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"), F.length("r_host").alias("host_length"),
        (F.col("r_verdict") == "block").alias("block"), F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = found.groupBy("u").agg(F.max(rank).alias("best"))
    host, path = host_and_path(F.col("u0"))
    rows = pages.select(*keep, F.col(url).alias("u0"))
    return rows.join(best, F.col("u0") == F.col("u"), "left").select(
        *keep, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
