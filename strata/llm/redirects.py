"""URL rules with redirect equivalence.

Explicit rules name a host and a path prefix and fit the host, its subdomains
and all paths that begin with the prefix; the longest fitting rule decides a
URL. A URL that no rule fits takes the decision of its aliases: URLs are nodes;
edges lead from each page's URL to its canonical form (without ``www.`` or
``m.``, fragment, tracking parameters, closing slash or ``.html``), to the targets
of its canonical links, and to those of its meta refreshes (relative ones resolved against
the page, ``&amp;`` read as ``&``). Components of that graph
are found by distributed star contraction. If a member of the component has an
explicit allow, its undecided members are allowed, else if one has a block they
are blocked, else allowed.

All of it is DataFrame code. A null url, or one without ``://``, has an empty
host and path, no rule and no alias: allowed. Repeated rows give repeated rows.
Null or empty html has no links. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import components, staged

# The rules of the query, (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def canonical(node: Column) -> Column:
    """The canonical form of ``host/path?query#fragment``."""
    node = F.regexp_replace(node, r"(?s)#.*$", "")
    node = F.regexp_replace(node, r"^(?:www|m)\.(?=[^/?]*\.)", "")
    node = F.regexp_replace(node, r"(?<=[?&])(?:utm_[a-z]+|ref)=[^&]*(?:&|$)", "")
    node = F.regexp_replace(node, r"[?&]$", "")
    return F.regexp_replace(node, r"(?:\.html|/)(?=\?|$)", "")


def node(url: Column) -> Column:
    """A URL as a node: its host in lower case and all that follows; null without ``://``."""
    h = host(url)
    return F.when(rest(url) != "", F.concat(h, F.substring(rest(url), F.length(h) + 1, F.length(url))))


def without_dots(path: Column) -> Column:
    """A path from its first ``/`` on without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(kept: Column, part: Column) -> Column:
        # The first segment is empty: what lies before the first slash.
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    closed = F.when(last.isin(".", "..") | (F.size(kept) == 1), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), closed)


def target(base: Column, href: Column) -> Column:
    """The node that a link in a page at node ``base`` leads to; null for what is no page (``mailto:`` and the like)."""
    href = F.replace(F.btrim(href), F.lit("&amp;"), F.lit("&"))
    authority = F.regexp_extract(base, r"^[^/?#]*", 0)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    query = F.regexp_extract(base, r"^[^#]*", 0)
    folder = F.regexp_extract(base, r"^[^/?#]*((?:[^?#]*/)?)", 1)
    # What is resolved: the path up to a query or fragment, which stay as they are.
    own = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.substring(href, F.length(own) + 1, F.length(href))
    path = F.when(own.startswith("/"), own).when(folder == "", F.concat(F.lit("/"), own)).otherwise(F.concat(folder, own))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), node(href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), node(F.concat(F.lit("x:"), href)))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(query, href))
        .when(href != "", F.concat(authority, without_dots(path), tail))
    )


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    html = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select(
        "page_id",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        node(F.col("url")).alias("node"),
        F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), 1), F.regexp_extract_all(html, F.lit(REFRESH), 1)).alias("links"),
    )
    read = staged(read, "redirects-pages")
    links = F.concat(
        F.array(canonical(F.col("node"))), F.transform(F.array_distinct("links"), lambda href: target(F.col("node"), href))
    )
    # A target's own canonical form is its alias, too.
    edges = read.where("node IS NOT NULL").select("node", F.explode(links).alias("to")).where("to IS NOT NULL").distinct()
    ends = edges.select("to").distinct().select(F.col("to").alias("node"), canonical(F.col("to")).alias("to"))
    edges = staged(edges.unionByName(ends).distinct(), "redirects-edges")
    joined = staged(components(edges, "node", "to", "redirects-star"), "redirects-components")
    as_url = F.concat(F.lit("x://"), F.col("id"))
    said = joined.withColumn("said", rule(host(as_url), path(as_url), rules)[1]).where("said IS NOT NULL")
    decided = said.groupBy("component").agg(F.min("said").alias("alias_verdict"))  # "allow" comes before "block"
    nodes = joined.join(decided, "component").select(F.col("id").alias("_node"), "alias_verdict")
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    return read.join(nodes, F.col("node") == F.col("_node"), "left").select(
        "page_id",
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, F.col("alias_verdict"), F.lit("allow")).alias("verdict"),
    )


ORACLE = r"""
WITH a AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), b AS (
  SELECT page_id, rest,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM a
), c AS (
  SELECT *, host || substr(rest, length(host) + 1) AS node FROM b
), d AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    node, '(?s)#.*$', ''), '^(?:www|m)\.([^/?]*\.)', '\1'),
    '([?&])(?:utm_[a-z]+|ref)=[^&]*(?:&|$)', '\1', 'g'), '[?&]$', ''), '(?:\.html|/)(\?|$)', '\1') AS canon,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM c
), e AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM d
), canons AS (
  SELECT DISTINCT canon, regexp_extract(canon, '^[^/?#]*', 0) AS host, regexp_extract(canon, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM e
), also AS (
  SELECT canon, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'allow'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block' END AS said FROM canons
), f AS (
  SELECT canon, min(said) AS alias_said FROM (SELECT canon, said FROM e UNION ALL SELECT canon, said FROM also) GROUP BY canon
)
SELECT page_id, host, path, rule, coalesce(said, alias_said, 'allow') AS verdict
FROM e LEFT JOIN f ON e.canon = f.canon"""
