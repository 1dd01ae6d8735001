"""URL filters: host and path rules, and block decisions that follow redirects and canonical links to aliases."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.operators.components import connected_components
from corpusloom.session import staged

# (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

# links that make two urls one page: <link rel=canonical href=...>, and <meta http-equiv=refresh content="0; url=...">
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def lower_ascii(c) -> object:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url) -> object:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; null or without ://: empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url) -> object:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: tuple = RULES) -> DataFrame:
    """`df` (host, path) with rule and rule_verdict of the longest rule that fits, null where none does.

    Rules are few and fixed, so they are one CASE over the row, the longest first; ties go to allow."""
    out = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("rule_verdict"))).otherwise(out)
    return df.withColumn("__rule", out).withColumn("rule", F.col("__rule.rule")).withColumn("rule_verdict", F.col("__rule.rule_verdict")).drop("__rule")


def node_of(url) -> object:
    """What urls of one page have in common: host and path with the query, without scheme and fragment; no ://: null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _resolved(url: str, to: str) -> str | None:
    to = html.unescape(to)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", to):
        return to
    try:
        return urljoin(url, to)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolved(urls: pd.Series, targets: pd.Series) -> pd.Series:
    """Links as urls: character references decoded, then whatever is relative taken from the page's url."""
    return pd.Series([_resolved(u, t) for u, t in zip(urls, targets)], dtype=object)


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(u, v) of url nodes: what each page's canonical link and refresh name, and the given (src, dst) redirects.

    Targets are decoded and resolved against the page's url; only the links that are found pass through Python."""
    found = pages.where(F.col("html").isNotNull() & F.col("url").contains("://")).select("url", F.explode(F.array_union(F.regexp_extract_all("html", F.lit(CANONICAL), 1), F.regexp_extract_all("html", F.lit(REFRESH), 1))).alias("to"))
    found = found.select("url", resolved("url", "to").alias("to"))
    edges = found.select(node_of(F.col("url")).alias("u"), node_of(F.col("to")).alias("v"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    return edges.where("u is not null and v is not null and u <> v")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict.

    A url's own rule decides for it. Without one, its aliases do (the urls of its component over canonical links and
    redirects, among them urls that no page has): blocked if a rule blocks one of them and none allows one, since an
    explicit allow goes before a block; else allowed. Urls that nothing links are never shuffled. Null urls have empty host
    and path, no rule, and are allowed; null html has no links. Repeated pages are judged each; other columns are
    not read."""
    edges = staged(alias_edges(pages, redirects), "url-edges")
    judged = with_rule(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    parts = staged(connected_components(edges), "url-components")
    held = F.concat(F.lit("x://"), F.col("node"))
    ruled = with_rule(parts.withColumn("host", host_of(held)).withColumn("path", path_of(held)), rules)
    decided = ruled.groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "block").alias("b"), F.bool_or(F.col("rule_verdict") == "allow").alias("a"))
    blocked = parts.join(decided.where("b and not coalesce(a, false)"), "component", "left_semi").select("node", F.lit("block").alias("alias_verdict"))
    met = judged.withColumn("node", node_of(F.col("url"))).join(blocked, "node", "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"))
