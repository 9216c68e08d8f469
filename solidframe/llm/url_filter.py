"""URL filters with redirect equivalence. DataFrame functions only.

A rule is (host, path, action): it fits its host and all subdomains if the URL's path starts with the rule's
path; the longest rule wins, of equally long ones an allowing one. A URL without a rule gets the decision of
its aliases: redirect (meta refresh) and canonical-link edges tie URLs into components, an explicit allow in
a component outweighs blocks, else one blocked alias blocks all; without a decision a URL is allowed.

Rules are grouped by host and the start of their path, and joined once for each number of labels that rule hosts
have and each length of start, so URLs are not exploded and, with few rules, not shuffled; a larger list is joined
by a shuffle. Starts are the first ``START`` characters of a rule's path, so that a host with many rules is many
small groups; shorter paths are a group of their own length. Components are computed on
distinct edges only (see ``components``), and decisions reach the pages by one join with the alias table.

Cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; null html
has no edges; equal rows get equal rows; edges to URLs outside the table count, with the rules that fit
them; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a rule's path by which the rules of a host are told apart.
START = 8
#: Rules that are broadcast at most; longer lists are joined by a shuffle.
BROADCAST_RULES = 100_000


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A URL without scheme and fragment: what redirects between http and https, or to an anchor, don't change."""
    return F.concat(host_of(url), F.regexp_extract(rest_of(url), r"^[^/?#]*([^#]*)", 1))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes that canonical links and meta refreshes of ``pages`` (url, html) tie together."""
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = lambda name, what: F.regexp_extract(html, rf"(?is)<{name}\b[^>]*{what}[^>]*>", 0)
    canonical = F.regexp_extract(tag("link", r"""rel\s*=\s*["']?canonical\b"""), r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(tag("meta", r"""http-equiv\s*=\s*["']?refresh\b"""), r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1)
    found = pages.filter(F.instr("url", "://") > 0).select("url", F.explode(F.filter(F.array(canonical, refresh), lambda x: x != "")).alias("to"))
    to, scheme = F.col("to"), F.regexp_extract("url", r"^.*?://", 0)
    base = F.concat(scheme, host_of(F.col("url")))
    folder = F.regexp_replace(path_of(F.col("url")), r"[^/]*$", "")
    whole = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract("url", r"^.*?:", 0), to))
        .when(to.startswith("/"), F.concat(base, to))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    return found.select(node_of(F.col("url")).alias("a"), node_of(whole).alias("b")).filter("a <> b").distinct()


def _fitting(labels: int, start: int, path: Column) -> Column:
    """The joined rules with so many host labels and such a start whose path fits, as (n, allow, rule, action)."""
    host, rules = F.col(f"_h{labels}_{start}"), F.coalesce(F.col(f"_r{labels}_{start}"), F.array().cast("array<struct<path:string,action:string>>"))
    as_rule = lambda x: F.struct((F.length(host) + F.length(x["path"])).alias("n"), (x["action"] == "allow").alias("allow"), F.concat(host, x["path"]).alias("rule"), x["action"].alias("action"))
    return F.transform(F.filter(rules, lambda x: F.startswith(path, x["path"])), as_rule)


def match_rules(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """``urls`` with ``rule`` (host and path) and ``action`` of the longest rule that fits, null where none does."""
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL AND action IN ('allow', 'block')").select("host", "path", "action").distinct()
    rules = rules.withColumns({"labels": F.size(F.split("host", r"\.")), "start": F.least(F.length("path"), F.lit(START))})
    # one join for each: as many as host names have labels, times START + 1
    kinds = sorted((r["labels"], r["start"]) for r in rules.select("labels", "start").distinct().collect())
    grouped = rules.groupBy("host", "labels", "start", F.substring("path", 1, START).alias("head")).agg(F.sort_array(F.collect_list(F.struct("path", "action"))).alias("_rules"))
    small = rules.count() <= BROADCAST_RULES
    keep = urls.columns
    for d, n in kinds:
        name = f"{d}_{n}"
        own = grouped.filter((F.col("labels") == d) & (F.col("start") == n)).select(F.col("host").alias(f"_h{name}"), F.col("head").alias(f"_p{name}"), F.col("_rules").alias(f"_r{name}"))
        fits = (F.substring_index(F.col(host), ".", -d) == F.col(f"_h{name}")) & (F.substring(F.col(path), 1, n) == F.col(f"_p{name}"))
        urls = urls.join(F.broadcast(own) if small else own, fits, "left")
    found = [_fitting(d, n, F.col(path)) for d, n in kinds]
    if not found:
        return urls.select(*keep, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    best = urls.select(*keep, F.array_max(reduce(F.concat, found)).alias("_best"))
    return best.select(*keep, F.col("_best.rule").alias("rule"), F.col("_best.action").alias("action"))


def url_filter(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): host, path, rule, verdict, and whether an alias decided.

    ``edges`` (a, b: URLs) may add redirects known from elsewhere, such as a crawl log.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))).filter("a <> b AND a <> '' AND b <> ''")
    links = materialize(links)
    judged = match_rules(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    if links.isEmpty():
        return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(False).alias("by_alias"))
    members = connected_components(links)
    named = members.select("node", "component", F.regexp_extract("node", r"^[^/?#]*", 0).alias("host"), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    decided = match_rules(named, rules).filter("action IS NOT NULL").groupBy("component").agg(F.max(F.col("action") == "allow").alias("ok"))
    aliases = members.join(decided, "component").select(F.col("node").alias("_node"), F.when(F.col("ok"), "allow").otherwise("block").alias("_alias"))
    out = judged.withColumn("_node_of", node_of(F.col("url"))).join(aliases, F.col("_node_of") == F.col("_node"), "left")
    return out.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("action", "_alias", F.lit("allow")).alias("verdict"), (F.col("action").isNull() & F.col("_alias").isNotNull()).alias("by_alias")
    )
