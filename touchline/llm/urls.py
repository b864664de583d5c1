"""URL filter with redirect equivalence: rules by host and path, and block decisions passed on to aliases.

Everything is DataFrame functions; the equivalence is a distributed connected-components job over links between addresses.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import components, cut, table
from touchline.llm.registry import query

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Tags that name another address of a page: canonical links and refresh redirects.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*['"]?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_hit(h: Column, p: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits a host or one of its parent domains and starts the path; null if none."""
    hit = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((h == rule_host) | F.endswith(h, F.lit("." + rule_host))) & F.startswith(p, F.lit(rule_path))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        hit = F.when(fits, value) if hit is None else hit.when(fits, value)
    return hit


def address(url: Column) -> Column:
    """The address under which equal pages meet: host and path without scheme, query, fragment, a leading `www.` and a trailing slash.

    A url without `://` is its own address; null stays null.
    """
    plain = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""))
    return F.when(F.contains(url, F.lit("://")), plain).otherwise(url)


def page_links(pages: DataFrame) -> DataFrame:
    """Links (a, b) between addresses, from canonical links and refresh redirects in the html. Relative targets stay on the host."""
    html = F.coalesce("html", F.lit(""))
    found = pages.where(F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh"))).select(
        "url", F.explode(F.array(F.regexp_extract(html, CANONICAL, 1), F.regexp_extract(html, REFRESH, 1))).alias("to")).where("to <> ''")
    base = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*", 0)
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).when(
        F.col("to").startswith("/"), F.concat(base, "to")).otherwise(F.col("to"))
    return found.select(address(F.col("url")).alias("a"), address(to).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, links: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of pages (page_id, url, html); more links (a, b) between addresses may be given.

    A page that a rule fits has the rule's verdict. Others take it from their aliases: the addresses connected to theirs by
    redirects and canonical links. An explicit allow among them wins over a block; without either the page is allowed. Null urls and urls
    without `://` have empty host and path and are allowed unless linked. Repeated rows stay. An empty table gives no rows.
    """
    rows = pages.select("page_id", "url", "html")
    edges = page_links(rows)
    edges = edges if links is None else edges.unionByName(links.select("a", "b"))
    groups = components(edges)
    judged = cut(rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("node"))
                 .withColumn("hit", rule_hit(F.col("host"), F.col("path"), rules)))
    # what the rules say of an address counts once per address, not per page
    said = judged.where("hit is not null and node is not null").groupBy("node").agg(
        F.max((F.col("hit.verdict") == "allow").cast("int")).alias("allow"), F.max((F.col("hit.verdict") == "block").cast("int")).alias("block"))
    by_group = said.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.max("allow").alias("allow"), F.max("block").alias("block"))
    open_nodes = judged.where("hit is null and node is not null").select("node").distinct()
    alias = cut(open_nodes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
                .join(by_group, "root").where("block = 1 and allow = 0").select("node", F.lit("block").alias("passed_on")))
    out = judged.join(alias, "node", "left")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                      F.coalesce("hit.verdict", "passed_on", F.lit("allow")).alias("verdict"))


_FIT = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{{{i}}}'"
                for i, (v, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2])))
#: The check SQL follows links by a recursive query; the components come out the same.
_SQL = f"""
WITH RECURSIVE split AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
judged AS (
  SELECT *, CASE {_FIT.format(*[h + p for _, h, p in RULES])} END AS rule, CASE {_FIT.format(*[v for v, _, _ in RULES])} END AS said,
         CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') ELSE url END AS node FROM split),
targets AS (
  SELECT node AS a, url, unnest([
    regexp_extract(regexp_extract(html, '<link[^>]*rel\\s*=\\s*["'']?canonical[^>]*>', 0, 'is'), 'href\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is'),
    regexp_extract(regexp_extract(html, '<meta[^>]*http-equiv\\s*=\\s*["'']?refresh[^>]*>', 0, 'is'), 'url\\s*=\\s*[''"]?([^"''\\s>]+)', 1, 'is')]) AS t FROM judged),
full_urls AS (SELECT a, CASE WHEN prefix(t, '//') THEN 'http:' || t WHEN prefix(t, '/') THEN regexp_extract(url, '^.*?://[^/?#]*', 0, 's') || t ELSE t END AS t FROM targets WHERE t <> ''),
links AS (
  SELECT a, CASE WHEN contains(t, '://') THEN regexp_replace(translate(regexp_extract(t, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\\.', '')
         || regexp_replace(regexp_extract(t, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '/+$', '') ELSE t END AS b FROM full_urls),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT node AS a, node AS b FROM judged WHERE node IS NOT NULL UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
spread AS (SELECT reach.a AS node, max(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) AS allow, max(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS block
  FROM reach JOIN judged ON reach.b = judged.node GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN block = 1 AND allow = 0 THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN spread USING (node)
"""


@query("op6_url_filter", _SQL)
def op6_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
