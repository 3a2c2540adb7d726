"""URL filters, in DataFrame functions only.

Each URL is expanded into host-suffix and path-prefix expressions, only for the
label counts and path lengths that some rule has.  The expressions meet the
rules in an equi-join on a short hash prefix; full digests confirm; the longest
rule wins (ties: longer host, then block before allow).

Defined results: a null URL, or one without ``://``, has empty host and path
and no rule; a URL without a path fits no rule, as every rule's path starts
with ``/``.  Repeated rows come back as often as they went in.  Empty tables
give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that the join compares.
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"
#: Rules that may be broadcast (about 200 bytes each).
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules from (action, ``host/path``) pairs: action, rule, rule_host, rule_path."""
    rows = [(action, text, text.split("/", 1)[0], "/" + text.split("/", 1)[1]) for action, text in rules]
    return spark.createDataFrame(rows, "action string, rule string, rule_host string, rule_path string")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule and verdict of each row of ``pages``.

    ``rules`` has the columns of :func:`rule_table`.  Of rules with the same
    host and path, block wins.  The rules' label counts (at most 128 in a host
    name) and path lengths come to the driver, never the rules.  Up to
    :data:`BROADCAST_RULES` rules are broadcast; more meet the expressions in a
    shuffled join, where adaptive execution splits an expression that very many
    URLs share.
    """
    rules = rules.where(F.col("rule_path").startswith("/") & (F.col("rule_host") != ""))
    keyed = (
        rules.groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"), F.max("rule").alias("rule"))
        .withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256))
        .select(
            F.substring("digest", 1, PREFIX_DIGITS).alias("short"),
            F.col("digest").alias("rule_digest"),
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                F.col("action"),
                F.col("rule"),
            ).alias("hit"),
        )
    )
    shape = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    if shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)

    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    fits = [
        F.when(
            (F.size(F.split("host", r"\.")) >= n) & (F.length("path") >= m) & (F.col("host") != ""),
            F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)),
        )
        for n in shape["labels"]
        for m in shape["lengths"]
    ]
    # element 0 stands for the row itself: it keeps rows without a fit, and counts repeated rows
    spread = parts.select("*", F.posexplode(F.array_compact(F.array(F.lit(""), *fits))).alias("at", "expression"))
    # it has a join key of its own, so that a shuffled join doesn't meet one key of all rows
    digest = F.sha2("expression", 256)
    alone = F.concat(F.lit("-"), F.pmod(F.xxhash64(key, "host", "path"), F.lit(1 << 20)).cast("string"))
    short = F.when(F.col("at") == 0, alone).otherwise(F.substring(digest, 1, PREFIX_DIGITS))
    found = spread.withColumns({"digest": digest, "short": short}).join(keyed, "short", "left")
    best = found.groupBy(key, "host", "path").agg(
        F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("copies"),
        F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("hit"))).alias("hit"),
    )
    return best.select(
        key,
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.action", F.lit(DEFAULT_VERDICT)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
