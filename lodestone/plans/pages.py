"""Queries over web pages: URL keys, publishers, HTML fields, findings, crawler access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import html, urls
from ..operators import board, readiness, report, robots
from ..sources.tables import table
from .registry import query

_P = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"


def _part(n: int) -> str:
    return f"regexp_extract(url, {_P}, {n})"


_HOST = f"lower({_part(3)})"
_SITE = f"regexp_replace({_HOST}, '^www\\.', '')"


@query(f"""
WITH p AS (SELECT page_id, url, {_SITE} AS site FROM pages), u AS (SELECT site, url, min(page_id) AS o, count(*) AS c FROM p GROUP BY ALL)
SELECT site, CAST(sum(c) AS BIGINT) AS n, arg_min(url, o) AS first_url, count(*) AS n_urls, string_agg(url, ' ' ORDER BY o) AS urls FROM u GROUP BY site
""")
def publisher_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", urls.site(F.col("url")).alias("site"))
    return board.publishers(pages, "site", "url", "page_id")


def _kept(drop: str) -> str:
    q = f"list_filter(string_split({_part(6)}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(string_split(p, '=')[1]), '{drop}'))"
    return f"CASE WHEN len({q}) > 0 THEN '?' || array_to_string({q}, '&') ELSE '' END"


@query(f"""
SELECT page_id, lower({_part(1)}) || '://' || {_HOST} || CASE WHEN {_part(5)} = '' THEN '/' ELSE {_part(5)} END || {_kept('^variant$')} AS canonical_key,
  lower({_part(1)}) || '://' || {_HOST} || regexp_replace({_part(5)}, '/$', '') || {_kept('^(utm_.*|ref|source)$')} AS provider_key,
  regexp_replace(lower({_part(1)}) || '://' || {_HOST} || {_part(5)} || CASE WHEN {_part(6)} <> '' THEN '?' || {_part(6)} ELSE '' END, '/$', '') AS classifier_key, {_SITE} AS site FROM pages
""")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_key(u).alias("canonical_key"), urls.provider_key(u).alias("provider_key"), urls.classifier_key(u).alias("classifier_key"), urls.site(u).alias("site"))


_NORMAL = f"string_split(trim({_part(5)}, '/'), '/')"


@query(f"""
SELECT page_id, CASE WHEN lower({_part(1)}) <> 'https' THEN 'HTTPS_REQUIRED' WHEN {_part(2)} <> '' THEN 'CREDENTIALS_NOT_ALLOWED'
  WHEN regexp_matches({_HOST}, '^(localhost|instance-data|metadata\\.google)$|(\\.localhost|\\.local|\\.internal|\\.localdomain)$|^[0-9]+(\\.[0-9]+){{3}}$') THEN 'PRIVATE_TARGET'
  WHEN NOT regexp_matches({_part(5)}, '/products/[^/]+/*$') THEN 'UNSUPPORTED_PRODUCT_PATH' END AS issue FROM pages
""")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.issue(F.col("url")).alias("issue"))


@query(f"""
WITH p AS (SELECT page_id, {_HOST} AS host, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)
SELECT page_id, contains(title, 'tion') OR contains(title, 'ment') AS named, host = 'example.org' OR host LIKE '%.example.org' OR host = 'example.net' OR host LIKE '%.example.net' AS on_domain FROM p
""")
def target_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    out = report.target_match(urls.host(F.col("url")), title, F.lit(None).cast("string"), ["example.org", "example.net"], ["tion", "ment", "the"])
    return table(spark, sf_dir, "pages").select("page_id", out.alias("m")).select("page_id", "m.*")


_ENTITY = "replace(replace(replace({}, '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')"


@query(f"""
SELECT page_id, nullif(trim(regexp_replace({_ENTITY.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')), '') AS title,
  nullif(trim(regexp_replace({_ENTITY.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '\\s+', ' ', 'g')), '') AS h1, CAST(NULL AS VARCHAR) AS canonical, 0 AS json_ld_nodes FROM pages
""")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "pages").select("page_id", html.parse_page("html").alias("p"))
    return page.select("page_id", "p.title", "p.h1", "p.canonical", F.size("p.json_ld").alias("json_ld_nodes"))


@query("""
WITH c AS (SELECT page_id, 0 AS ord, 'MISSING_CANONICAL' AS code, 'warning' AS severity FROM pages UNION ALL SELECT page_id, 1, 'MALFORMED_JSON_LD', 'warning' FROM pages WHERE NOT contains(html, '</body>')
UNION ALL SELECT page_id, 2, 'AJAX_PRODUCT_UNAVAILABLE', 'warning' FROM pages WHERE contains(url, '?'))
SELECT page_id, ord, code, severity FROM c
""")
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "pages").select("page_id", "url", (~F.contains("html", F.lit("</body>"))).alias("cut"), html.parse_page("html")["canonical"].alias("canonical"))
    return readiness.findings(page, "page_id", {"MISSING_CANONICAL": F.col("canonical").isNull(), "MALFORMED_JSON_LD": F.col("cut"), "AJAX_PRODUCT_UNAVAILABLE": F.contains("url", F.lit("?"))})


ROBOTS = """# rules
User-agent: *
Disallow: /fr/
Allow: /fr/8
Disallow: /*9$

User-agent: GPTBot
User-agent: Other
Disallow: /en
Allow: /en/2

User-agent: OAI-SearchBot
Disallow:
"""


@query(f"""
WITH p AS (SELECT page_id, {_part(5)} AS path FROM pages),
g AS (SELECT page_id, 'general_crawl' AS kind, CASE WHEN path LIKE '/fr/8%' THEN 5 ELSE 0 END AS a, greatest(CASE WHEN path LIKE '/fr/%' THEN 4 ELSE 0 END, CASE WHEN path LIKE '/%9' THEN 2 ELSE 0 END) AS d FROM p
UNION ALL SELECT page_id, 'openai_training', CASE WHEN path LIKE '/en/2%' THEN 5 ELSE 0 END, CASE WHEN path LIKE '/en%' THEN 3 ELSE 0 END FROM p UNION ALL SELECT page_id, 'openai_search', 0, 0 FROM p)
SELECT page_id, kind, a >= d AS allowed FROM g
""")
def robots_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.lit("site").alias("site"), urls.part(F.col("url"), 5).alias("path"))
    parsed = robots.rules(spark.range(1).select(F.lit("site").alias("site"), F.lit(ROBOTS).alias("body")), "site")
    return robots.access(pages, parsed, "site").select(F.col("page").alias("page_id"), "kind", "allowed")
