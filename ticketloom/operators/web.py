"""Links, texts and the crawl of web pages."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ticketloom.functions import text
from ticketloom.functions.html import sections_of, to_markdown, to_text
from ticketloom.session import written

# Paths that are no pages.
NO_PAGES = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".zip", ".xml", ".json", ".svg", ".ico", ".css", ".js"]


def _udf(f):
    return F.pandas_udf(f, StringType())


def resolved(base: Column, href: Column) -> Column:
    """The href against its page, without its fragment."""

    def join(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        def one(b, h):
            try:
                return urldefrag(urljoin(b, h))[0]
            except ValueError:  # not a URL
                return None

        return pd.Series([one(b, h) if b and h is not None else None for b, h in zip(bases, hrefs)], dtype=object)

    return _udf(join)(base, href)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, href): the distinct href values of a page's anchors."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a(?:\s[^>]*?)?\shref="([^"]*)"'), F.lit(1)))
    return pages.select(F.col(url).alias("url"), F.explode(found).alias("href")).distinct()


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link): resolved links to pages of the same host."""
    raw = links(pages, url, html).where(~F.col("href").rlike(r"^(?:#|mailto:|tel:|\s*$)"))
    out = raw.select("url", resolved(F.col("url"), F.col("href")).alias("link"))
    path = F.lower(F.coalesce(F.try_parse_url("link", F.lit("PATH")), F.lit("")))
    for e in NO_PAGES:
        out = out.where(~path.endswith(e))
    same = F.try_parse_url("link", F.lit("AUTHORITY")) == F.try_parse_url("url", F.lit("AUTHORITY"))
    return out.where(same & F.try_parse_url("link", F.lit("PROTOCOL")).isin("http", "https")).distinct()


def marked_links(pages: DataFrame, part: str, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link): resolved links whose href holds `part`."""
    raw = links(pages, url, html).where(F.col("href").contains(part))
    return raw.select("url", resolved(F.col("url"), F.col("href")).alias("link")).distinct()


def markdown_of(html: Column) -> Column:
    return _udf(lambda s: s.map(to_markdown))(html)


def text_of(html: Column) -> Column:
    return _udf(lambda s: s.map(to_text))(html)


def sections(html: Column, container: str | None = None) -> Column:
    """All section elements joined in document order, each with all that it holds, so nested ones come again; null without any.

    container: only those below the first div of that class."""
    return _udf(lambda s: s.map(lambda h: sections_of(h, container), na_action="ignore"))(html)


def last_by_name(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """(filename, order): of pages with one file name the last one is kept."""
    named = pages.where("url is not null").select(order, text.file_name(F.col("url")).alias("filename"))
    return named.groupBy("filename").agg(F.max(order).alias(order))


#: So many written rounds are read as a union before they are written as one table.
_PARTS = 12


def crawl(edges: DataFrame, start: DataFrame, limit: int | None = None, with_content: DataFrame | None = None) -> DataFrame:
    """(url, depth): what can be reached from `start` (url) over `edges` (url, link), breadth first, each page once.

    Only pages in `with_content` (url), by default all, are processed, that is give links. `limit` bounds the processed pages:
    they are taken by depth, then by url, and pages without content do not count. Depth has no bound: it ends when nothing new
    comes. Each round is written, so the lineage stays short and a lost executor costs one round."""
    frontier = written(start.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    parts, left, depth = [frontier], limit, 0
    while True:
        depth += 1
        pages = frontier.select("url")
        if with_content is not None:
            pages = pages.join(with_content.select("url").distinct(), "url", "left_semi")
        if left is not None:
            pages = written(pages.orderBy("url").limit(left))  # the limit is the caller's
            left -= pages.count()
        new = pages.join(edges.select("url", "link"), "url").select(F.col("link").alias("url")).where("url is not null").distinct()
        for part in parts:
            new = new.join(part.select("url"), "url", "left_anti")
        frontier = written(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > _PARTS:
            parts = [written(_union(parts))]
        if left == 0:
            break
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest(pages: DataFrame, key: str = "url", order: tuple[str, ...] = ("fetched_at", "page_id")) -> DataFrame:
    """One row a key: the last fetched."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return pages.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
