"""URL filters by hashed expressions.

A rule is a host and the start of a path. A URL fits it if the URL's host is the rule's or a subdomain of it and the
URL's path starts with the rule's. Each URL is expanded into host suffixes joined with path prefixes: first every different
host into its suffixes of as many labels as some rule has, which are looked up among the rules' hosts, then a URL's path into
the lengths that the rules of the hosts found have. An expression is looked up by the first ``PREFIX_DIGITS`` digits of its
SHA-256; what the equi-join on these finds is confirmed by the whole digest. The work for a URL thus follows the rules of its
own hosts, not the whole list. Of a URL's rules the longest (host and path together) wins, then the one with the longer host,
then a block before an allow.

Everything is DataFrame functions. Verdicts are found once per distinct host and path start and joined back, so a host
that holds a third of all URLs is one row while it is judged.

A null URL or one without ``://`` has empty host and path. Empty labels of a host count as labels. Nulls in a rule's
host, path or verdict make the rule fit nothing. Repeated rules count once, repeated pages each get a row. Very long URLs are
read whole. Without rules every verdict is ``DEFAULT``, without pages there is no row. Other columns than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concord.llm.base import ascii_lower, written

PREFIX_DIGITS = 8
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # no host holds a slash and no path starts without one, but rules may be anything: a line break keeps the two apart
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def hashed_rules(rules: DataFrame) -> DataFrame:
    """rule_host, rule, verdict, path_length, digest, prefix of each distinct rule, and its precedence."""
    digest = _digest(F.col("host"), F.col("path"))
    return (
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
        .distinct()
        .select(
            F.col("host").alias("rule_host"),
            F.concat("host", "path").alias("rule"),
            "verdict",
            F.length("path").alias("path_length"),
            digest.alias("digest"),
            F.left(digest, F.lit(PREFIX_DIGITS)).alias("prefix"),
            F.struct(
                F.length(F.concat("host", "path")).alias("length"),
                F.length("host").alias("host_length"),
                (F.col("verdict") == "block").alias("block"),
            ).alias("precedence"),
        )
    )


def _looked_up(df: DataFrame, host: Column, path: Column) -> DataFrame:
    """``df`` with the ``digest`` of an expression and the ``prefix`` by which it is looked up."""
    return df.withColumn("digest", _digest(host, path)).withColumn("prefix", F.left("digest", F.lit(PREFIX_DIGITS)))


def hosts_with_rules(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """``host, rule_host, lengths``: the rules' hosts that a host is or is below, and how long the paths of their rules are."""
    ruled = known.groupBy("rule_host").agg(F.collect_set("path_length").alias("lengths"))
    ruled = _looked_up(ruled, F.col("rule_host"), F.lit("")).withColumnRenamed("digest", "whole")
    # one row: how many labels the hosts of rules have
    labels = known.agg(F.collect_set(_labels(F.col("rule_host")))).scalar()
    expanded = hosts.select("host", F.explode(labels).alias("n")).where(F.col("n") <= _labels(F.col("host")))
    suffix = F.when(F.col("n") == _labels(F.col("host")), F.col("host")).otherwise(F.expr("substring_index(host, '.', -n)"))
    found = _looked_up(expanded, suffix, F.lit("")).join(ruled, "prefix").where("digest = whole")
    return found.select("host", "rule_host", "lengths")


def expressions(urls: DataFrame, ruled: DataFrame) -> DataFrame:
    """``urls`` (host, path) with ``digest`` and ``prefix`` of each expression that a rule of their hosts may be."""
    each = urls.join(ruled, "host").select("host", "path", "rule_host", F.explode("lengths").alias("n"))
    fits = each.where(F.col("n") <= F.length("path"))
    return _looked_up(fits, F.col("rule_host"), F.left("path", F.col("n"))).select("host", "path", "digest", "prefix")


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict for each row of ``pages`` (url); ``rules`` has host, path, verdict."""
    known = hashed_rules(rules)
    longest = F.coalesce(known.agg(F.max("path_length")).scalar(), F.lit(0))
    split = pages.select(
        F.col(id_column), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("start", F.left("path", longest))
    urls = split.select("host", F.col("start").alias("path")).distinct()
    # stored, so that its size is known where it is joined
    ruled = written(hosts_with_rules(urls.select("host").distinct(), known), "url-hosts")
    found = (
        expressions(urls, ruled)
        .join(known.withColumnRenamed("digest", "whole"), "prefix")
        .where("digest = whole")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), "precedence").alias("best"))
        .select("host", F.col("path").alias("start"), "best.rule", "best.verdict")
    )
    # stored, so that the join below reads two plain shuffles and a host with many URLs can be split there
    found = written(found, "url-verdicts")
    return split.join(found, ["host", "start"], "left").select(
        id_column, "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict")
    )
