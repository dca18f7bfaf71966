"""Queries on web pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import text
from ticketloom.operators import web
from ticketloom.session import read

START, END, HELP = "<h1>", "</main>", "/en/"


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "web_pages")


def page_title(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).where("html is not null").select("page_id", text.page_title(F.col("html")).alias("title"))


def page_article(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).select("page_id", text.first_article(F.col("html")).alias("article"))


def page_section_between_markers(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).select("page_id", text.between(F.col("html"), START, END).alias("section"))


def page_links(spark: SparkSession, root: str) -> DataFrame:
    return web.links(_pages(spark, root))


def page_links_filtered(spark: SparkSession, root: str) -> DataFrame:
    return web.page_links(_pages(spark, root))


def help_links(spark: SparkSession, root: str) -> DataFrame:
    return web.marked_links(_pages(spark, root), HELP)


def page_filename(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).where("url is not null").select("page_id", text.file_name(F.col("url")).alias("filename"))


def page_filename_last_wins(spark: SparkSession, root: str) -> DataFrame:
    return web.last_by_name(_pages(spark, root))


def page_markdown(spark: SparkSession, root: str) -> DataFrame:
    pages = _pages(spark, root).where("html is not null")
    body = web.markdown_of(F.coalesce(text.first_article(F.col("html")), F.lit("")))
    return pages.select("page_id", text.markdown_page(text.page_title(F.col("html")), F.col("url"), body).alias("content"))


def page_text(spark: SparkSession, root: str) -> DataFrame:
    pages = _pages(spark, root).where("html is not null")
    body = web.text_of(F.coalesce(text.first_article(F.col("html")), F.lit("")))
    return pages.select("page_id", text.text_page(text.page_title(F.col("html")), F.col("url"), body).alias("content"))


def page_sections(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).where("html is not null").select("page_id", web.sections(F.col("html")).alias("sections"))


def page_latest(spark: SparkSession, root: str) -> DataFrame:
    return web.latest(_pages(spark, root)).select("page_id", "url")


def crawl_frontier(spark: SparkSession, root: str) -> DataFrame:
    """From the parentless tickets along `relates`, an edge list with cycles."""
    t = read(spark, root, "tickets").select("issue_key", "relates").where("relates is not null").distinct()
    start = read(spark, root, "tickets").where("parent_id is not null").select(F.col("issue_key").alias("url"))
    return web.crawl(t.select(F.col("issue_key").alias("url"), F.col("relates").alias("link")), start).select("url")


def crawl_counters(spark: SparkSession, root: str) -> DataFrame:
    """Pages by what became of their fetch."""
    state = F.when(F.col("html").isNull(), "error").when(text.first_article(F.col("html")).isNull(), "no content").otherwise("processed")
    return _pages(spark, root).groupBy(state.alias("status")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        page_title, page_article, page_section_between_markers, page_links, page_links_filtered, help_links, page_filename, page_filename_last_wins, page_markdown, page_text,
        page_sections, page_latest, crawl_frontier, crawl_counters,
    )
}

_WS = text.WS


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def _decoded(x: str) -> str:
    for name, value in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{value}')"
    return x


def _element(tag: str) -> str:
    inner = rf"regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>([^<]*)</{tag}\s*>', 1)"
    return f"nullif({_strip(_decoded(inner))}, '')"


def _outer(tag: str) -> str:
    return rf"nullif(regexp_extract(html, '(?is)(<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>)', 1), '')"


_LINKS = r"""select distinct url, href from (select url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a(?:\s[^>]*?)?\shref="([^"]*)"', 1))) as href from web_pages where url is not null or true)"""
_HOST = r"regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_SCHEME = r"regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
_RESOLVED = rf"""regexp_replace(case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '/') then {_SCHEME.format('url')} || '://' || {_HOST.format('url')} || href
  when href = '' or starts_with(href, '#') then url else regexp_replace(url, '[^/]*$', '') || href end, '#.*$', '')"""
_NAME = rf"""
with p as (select page_id, list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') as parts from web_pages where url is not null),
j as (select page_id, case when len(parts) = 0 then 'index' else array_to_string(list_concat(parts[1:len(parts) - 1], [regexp_replace(parts[len(parts)], '(.)\.[^.]*$', '\1')]), '_') end as n from p),
f as (select page_id, regexp_replace(regexp_replace(regexp_replace(n, '[^\p{{L}}\p{{M}}\p{{N}}_\-]+', '_', 'g'), '^_+|_+$', '', 'g'), '^-+|-+$', '', 'g') as s from j),
named as (select page_id, substr(case when s = '' then 'page' else s end, 1, 100) || '.md' as filename from f)"""

SQL = {
    "page_title": f"select page_id, coalesce({_element('title')}, {_element('h1')}, 'Untitled') as title from web_pages where html is not null",
    "page_article": f"select page_id, coalesce({_outer('article')}, {_outer('main')}) as article from web_pages",
    "page_section_between_markers": f"""
select page_id, case when a > 0 and b > 0 then {_strip("substr(rest, 1, b - 1)")} end as section
from (select *, strpos(rest, '{END}') as b from (select page_id, strpos(html, '{START}') as a, substr(html, strpos(html, '{START}') + {len(START)}) as rest from web_pages))""",
    "page_links": _LINKS,
    "page_links_filtered": rf"""select distinct url, link from (select url, {_RESOLVED} as link from ({_LINKS}) where not regexp_matches(href, '^(?:#|mailto:|tel:|\s*$)'))
where {_HOST.format('link')} = {_HOST.format('url')} and lower({_SCHEME.format('link')}) in ('http', 'https')
  and not regexp_matches(lower(regexp_replace(link, '\?.*$', '')), '({'|'.join(e.replace('.', r'\.') for e in web.NO_PAGES)})$')""",
    "help_links": f"select distinct url, {_RESOLVED} as link from ({_LINKS}) where contains(href, '{HELP}')",
    "page_filename": f"{_NAME} select page_id, filename from named",
    "page_filename_last_wins": f"{_NAME} select filename, max(page_id) as page_id from named group by filename",
    "page_latest": "select page_id, url from (select *, row_number() over (partition by url order by fetched_at desc, page_id desc) as r from web_pages) where r = 1",
    "crawl_frontier": """
with recursive e as (select distinct issue_key as a, relates as b from tickets where relates is not null),
r(url) as (select issue_key from tickets where parent_id is not null union select b from r join e on a = url) select url from r""",
    "crawl_counters": f"select case when html is null then 'error' when coalesce({_outer('article')}, {_outer('main')}) is null then 'no content' else 'processed' end as status, count(*) as n from web_pages group by 1",
}
