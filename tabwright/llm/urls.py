"""URL filters: host-suffix and path-prefix expressions joined with rules by hash prefix.

A rule is a host, a path and a verdict. It fits its host and all subdomains when
the URL's path starts with the rule's path; the longest rule that fits decides.
Every distinct URL is expanded into one expression per host suffix and per length
that a rule path has. Expressions meet the rules on the first characters of their
SHA-256, and the full digest confirms the match. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh, written

PREFIX_DIGITS = 8
ALLOW, BLOCK = "allow", "block"


def parts(url: str) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, and
    from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + F.lit(3), F.length(u))).otherwise(F.lit(""))
    # translate changes A-Z only; lower() would change other letters too
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))


def _digest(host: str, path: str) -> Column:
    """SHA-256 of the expression; the line feed cannot stand in for part of a host."""
    return F.sha2(F.concat_ws("\n", host, path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """``rules(host, path, verdict)`` with digests; of equal rules a block outranks an allow.

    Rules without host, path or a known verdict fit nothing.
    """
    lower = F.translate("host", _UPPER, _UPPER.lower())
    return (
        rules.select(lower.alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .filter(F.col("r_host") != "")
        .filter(F.col("r_path").isNotNull() & F.col("r_verdict").isin(ALLOW, BLOCK))
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("r_digest", _digest("r_host", "r_path"))
        .withColumn("prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    )


def expressions(urls: DataFrame, lengths: Column) -> DataFrame:
    """``urls(url, host, path)`` to a row per host suffix and rule-path length that the path has."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    return (
        urls.filter("host <> ''").withColumn("lengths", lengths)
        .select("url", "path", "lengths", F.explode(suffixes).alias("suffix"))
        .select("url", "suffix", F.explode(F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("start"))
        .withColumn("digest", _digest("suffix", "start"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """All rows of ``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``pages`` may hold nulls, repeated rows and columns of the same names; those are
    replaced. A URL without host gets the default, as does one that no rule fits. Of
    rules of equal length the one with the longer host decides. Repeated URLs are
    judged once. The different lengths of the rules' paths, numbers of which there are no more
    than characters in the longest path, are a scalar of the plan; each URL is cut at those it has.
    """
    known = rule_table(rules)
    lengths = known.agg(F.sort_array(F.collect_set(F.length("r_path")))).scalar()
    host, path = parts("url")
    urls = pages.select(F.col(url).alias("url")).filter("url is not null").distinct().select("url", host.alias("host"), path.alias("path"))
    same = fresh(pages, "_url")
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.concat("r_host", "r_path").alias("rule"), "r_verdict")
    best = (
        expressions(urls, lengths).join(known, "prefix").filter("digest = r_digest")
        .groupBy("url").agg(F.max(rank).alias("best"))
        .select(F.col("url").alias(same), F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias("verdict"))
    )
    # written, so that a hot URL's rows come from a shuffle that Spark can split; merged,
    # since verdicts grow with the URLs and files are smaller than what a broadcast holds
    best = written(best, "verdicts").hint("merge")
    own = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict"} or c == url]
    host, path = parts(url)
    return (
        pages.select(*own, host.alias("host"), path.alias("path"))
        .join(best, F.col(url) == F.col(same), "left")
        .select(*own, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
