"""URL filters by hashed expressions.

A URL is expanded into host suffixes times path prefixes. Expressions and rules meet in an
equi-join on a short prefix of their SHA-256; full digests confirm, and the longest rule wins.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8  # hex digits of the digest that the join compares


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a URL; both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every input row.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the path
    starts with the rule's. The longest rule wins (its text, then its host, then block before
    allow); without one the verdict is ``default``. Null URLs and those without ``://`` have
    an empty host and path; equal URLs are judged once and repeated rows stay repeated; an
    empty table gives no rows; other columns are ignored; rules with nulls are left out.
    """
    known = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .distinct()
        .select(_digest(F.col("host"), F.col("path")).alias("rule_digest"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX))
    )
    # a path can only start with a rule's path at one of the lengths rules have
    lengths = sorted(r[0] for r in rules.where("path IS NOT NULL").select(F.length("path")).distinct().collect())
    host, path = split_url(F.col("url"))
    urls = pages.select(pages[id_column].alias("page_id"), pages[url_column].cast("string").alias("url"))
    places = urls.select(host.alias("host"), path.alias("path")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expanded = (
        places.withColumn("suffix", F.explode(suffixes))
        .withColumn("cut", F.explode(cuts))
        .withColumn("digest", _digest(F.col("suffix"), F.expr("substring(path, 1, cut)")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX))
    )
    met = expanded.join(known, "prefix").where("digest = rule_digest")
    rank = F.struct(F.length("rule"), "host_length", F.col("verdict") == "block", "rule")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return (
        urls.select("page_id", host.alias("host"), path.alias("path"))
        .join(best, ["host", "path"], "left")
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def apply_rules_sql(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    """SQL twin over ``pages``: every rule tested against every URL."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {listed}),
rest AS (SELECT row_number() OVER () AS r, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
parsed AS (SELECT r, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
best AS (SELECT r, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM parsed JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM parsed LEFT JOIN best USING (r)"""
