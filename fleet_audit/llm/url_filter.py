"""Allow and block rules for URLs, carried over to the aliases of a page.

A redirect or a canonical link says that two URLs are one page. Components over such edges are
the pages with all their names; a page that no rule names is blocked when a rule blocks one of
its other names. A rule that fits the URL itself always decides, so an explicit allow holds
whatever the aliases are.

Null or malformed URLs have an empty host and path, meet no rule, have no alias and are allowed.
Null or empty HTML gives no edge. Repeated rows are each judged. An empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleet_audit.llm.components import connected_components
from fleet_audit.llm.shared import kept

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEME, _HOST, _PATH = r"(?s)^(.*?)://", r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
_LINK_TAG, _META_TAG = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_CANONICAL, _REFRESH = r"(?is)\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH_URL = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*'?([^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for a host, its subdomains and the paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule], of) -> Column:
    """``of(rule)`` of the longest rule that fits, an allow before a block of equal length; null when none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(of(rule))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """The name under which a URL is compared: host in lower case, without the fragment; null where there is no host."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", ""), r"(?s)#.*$", "")
    return F.when(host_of(url) != "", F.concat(F.lower(F.regexp_extract(url, _SCHEME, 1)), F.lit("://"), host_of(url), rest))


def resolved(link: Column, base: Column) -> Column:
    """The absolute URL of a link on the page ``base``."""
    scheme = F.regexp_extract(base, _SCHEME, 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.rlike(r"^[?#]"), F.concat(site, path_of(base), link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``a, b``: the nodes of a page and of what its canonical links and redirects (meta refresh) point at."""

    def targets(tag: str, mark: str, link: str) -> Column:
        tags = F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(mark))
        return F.transform(tags, lambda t: F.regexp_replace(F.regexp_extract(t, link, 1), "&amp;", "&"))

    links = F.concat(targets(_LINK_TAG, _CANONICAL, _HREF), targets(_META_TAG, _REFRESH, _REFRESH_URL))
    found = pages.filter("html is not null and url is not null").select("url", F.explode(links).alias("link")).filter("link != ''")
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("link"), F.col("url"))).alias("b")).dropna()


def judge_urls(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, blocked_alias`` for every row of ``pages`` (``page_id, url, html``).

    ``edges`` (``a, b``: nodes, see :func:`node_of`) may add redirects seen while crawling.
    """
    pages = pages.select("page_id", "url", "html")
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    members = connected_components(links)
    own = longest_rule(host_of(F.col("node")), path_of(F.col("node")), rules, lambda r: r.action)
    blocked = kept(members.withColumn("action", own).groupBy("root").agg(F.max(F.col("action") == "block").alias("blocked")).filter("blocked"), "blocked")
    aliases = members.join(blocked.select("root"), "root", "left_semi").select("node", F.lit(True).alias("blocked_alias"))
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules, lambda r: r.name))
    judged = judged.withColumn("action", longest_rule(F.col("host"), F.col("path"), rules, lambda r: r.action))
    judged = judged.join(aliases, "node", "left").withColumn("blocked_alias", F.coalesce("blocked_alias", F.lit(False)))
    verdict = F.coalesce("action", F.when(F.col("blocked_alias"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "blocked_alias")
