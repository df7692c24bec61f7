"""URL filters with redirect equivalence.

Explicit rules (host and path prefix, longest wins) judge single URLs. Redirect
and canonical-link edges make aliases of URLs; a blocked URL blocks every alias
in its connected component, except aliases that a rule of their own allows.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.llm.common import stored
from quire.llm.components import connected_components

#: Rules up to this number are sent to every task; more are joined by a shuffle on the host.
BROADCAST_RULES = 10_000
#: Longest part of a page in which a link tag or a meta tag is read; the whole page is searched for them.
LINK_TAG = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b[^>]*>"""
META_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    raw = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The form in which URLs are compared as aliases: scheme and host in lower case, without a fragment."""
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    scheme = F.lower(F.substring_index(url, "://", 1))
    return F.when(after_scheme(url).isNotNull(), F.concat(scheme, F.lit("://"), host_of(url), rest))


@F.pandas_udf(StringType())
def _resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b, x):
        try:
            return urljoin(b or "", x.strip())
        except ValueError:
            return None
    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype="object")


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) from a page's URL to its canonical link or refresh target, searched in the whole page.

    Pages without either, with a null URL or null html, and links that cannot be read give none."""
    attribute = lambda tag, name: F.regexp_extract(
        tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", 0)
    value = lambda text: F.regexp_replace(F.regexp_replace(
        text, r"(?is)^[^=]*=\s*", ""), r"""^["']|["']$""", "")
    html = F.col(html_col).cast("string")
    link = value(attribute(F.regexp_extract(html, LINK_TAG, 0), "href"))
    refresh = F.regexp_extract(value(attribute(F.regexp_extract(html, META_TAG, 0), "content")),
                               r"""(?is)\burl\s*=\s*["']?([^"']+)""", 1)
    found = (pages.where(html.ilike("%canonical%") | html.ilike("%refresh%"))
             .select(F.col(url_col).cast("string").alias("a"), F.explode(F.array(link, refresh)).alias("to"))
             .where(F.col("a").isNotNull() & (F.col("to") != "")))
    return found.select("a", _resolved("a", F.regexp_replace("to", "&amp;", "&")).alias("b")).where("b is not null")


def longest_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path) with the columns rule and action of the longest fitting rule, null if none fits.

    ``rules`` has host, path and action (allow or block). A rule fits its host
    and all subdomains where the URL's path starts with the rule's path. Of
    equally long ones, block wins. A URL's host is exploded into its domain
    suffixes, which meet the rules in an equality join.
    """
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action").distinct()
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)),
                         lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.col("action"))
    best = (distinct.select("host", "path", F.explode(suffix).alias("rule_host")).join(rules, "rule_host")
            .where(F.col("path").startswith(F.col("rule_path")))
            .groupBy("host", "path")
            .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), rank).alias("best")))
    return (urls.join(best, ["host", "path"], "left")
            .select(*[urls[c] for c in urls.columns], F.col("best.rule").alias("rule"),
                    F.col("best.action").alias("action")))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``redirects`` (a, b) adds redirect edges to those found in the pages; URLs
    on them need not be pages. The verdict is the rule's own where one fits, so
    an explicit allow always takes precedence. Otherwise it is block if the
    URL's component holds a URL that a rule blocks, else allow. A null URL or
    one without ``://`` has an empty host and path, no rule and no alias. Rows
    that repeat a URL are judged alike, one row each.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    src = src.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                     node_of(F.col("url")).alias("node"))
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("a").cast("string"), F.col("b").cast("string")))
    edges = stored(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
                   .where("a is not null and b is not null"), "redirects")
    parts = stored(connected_components(edges), "aliases")
    named = parts.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    blocked = (longest_rule(named, rules).where("action = 'block'").select("component").distinct())
    tainted = parts.join(blocked, "component").select("node", F.lit("block").alias("passed_on"))
    return (longest_rule(src, rules).join(tainted, "node", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("action", "passed_on", F.lit("allow")).alias("verdict")))
