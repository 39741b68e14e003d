"""URL filtering with pattern rules that are found through their rarest literal token.

Every rule is a regular expression over `host + path` with the literal tokens that each of
its matches contains. A rule is filed under the one of its tokens that the fewest URLs
have. The tokens of a URL fetch candidate rules, and only those run their expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import packed, small_table
from veilframe.plans.scale import small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`site` rules beat `pattern` rules, and longer names beat shorter ones."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    kind: str = "site"


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains and all paths that start with `path`."""
    ended = re.sub("[A-Za-z0-9]+$", "", path)  # the last token may go on in the URL
    tokens = tuple(t for t in re.split(SEPARATORS, f"{host}/{ended}") if t)
    # Java and Python escape alike what can occur here
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, pattern, tokens, verdict)


def word_rule(words: str, verdict: str = "block") -> Rule:
    """A rule for URLs that have these words in a row, joined by one separator each."""
    tokens = tuple(words.split())
    inner = "[^A-Za-z0-9/]".join(tokens)
    return Rule(words, f"(?:^|[^A-Za-z0-9]){inner}(?:$|[^A-Za-z0-9])", tokens, verdict, "pattern")


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(target, SEPARATORS), lambda t: t != ""))


def rule_index(targets: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rules with the token each is filed under: the one that the fewest targets have."""
    if any(not r.tokens for r in rules):
        raise ValueError("each rule needs a literal token")
    spark = targets.sparkSession
    rows = [(i, r.name, r.pattern, r.verdict, r.kind, t) for i, r in enumerate(rules) for t in r.tokens]
    listed = small_table(
        spark, rows, "rule_no int, name string, pattern string, verdict string, kind string, token string"
    )
    wanted = small(listed.select("token").distinct())
    found = targets.select(F.explode(url_tokens(F.col("target"))).alias("token"))
    counts = found.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarity = F.struct(F.coalesce("urls", F.lit(0)), F.col("token"))
    return (
        listed.join(small(counts), "token", "left")
        .groupBy("rule_no", "name", "pattern", "verdict", "kind")
        .agg(F.min_by("token", rarity).alias("token"))
    )


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """`df` with host, path, rule and verdict of each row's URL.

    Equal URLs are judged once. `rule` is the longest fitting site rule, or null; then any
    fitting pattern rule decides (block beats allow), and `default` if there is none. Null
    URLs and those without `://` have an empty host and path and get the default. Columns of
    `df` with the names of the four results are replaced; rows are kept, repeated ones too.
    The rules are the only broadcast side, and they are counted first.
    """
    plain = url_host(F.col("url")), url_path(F.col("url"))
    urls = df.select(F.col(url).alias("url")).where("url is not null").distinct()
    targets = urls.select("url", F.concat(*plain).alias("target"))
    index = small(rule_index(targets, rules))
    fetched = targets.select("url", "target", F.explode(url_tokens(F.col("target"))).alias("token"))
    fits = fetched.join(index, "token").where(F.expr("regexp_like(target, pattern)"))
    site, pattern = F.col("kind") == "site", F.col("kind") == "pattern"
    best = F.struct(F.length("name").alias("n"), F.col("name"), F.col("verdict"))
    judged = fits.groupBy("url").agg(
        F.max(F.when(site, best)).alias("_site"),
        F.max(F.when(pattern, F.col("verdict"))).alias("_pattern"),
    )
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    rows = packed(df, _url=F.col(url))
    joined = rows.join(judged, F.col("_url") == F.col("url"), "left")
    verdict = F.coalesce("_site.verdict", "_pattern", F.lit(default))
    of = [F.col("_row")[c].alias(c) for c in kept]
    return joined.select(
        *of,
        url_host(F.col("_url")).alias("host"),
        url_path(F.col("_url")).alias("path"),
        F.col("_site.name").alias("rule"),
        verdict.alias("verdict"),
    )
