"""Links of landed pages into typed document records, by a table of patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import absolute_url, date_of_slug_or_title


@dataclass(frozen=True)
class LinkPattern:
    """regex: of an absolute address, with one or two groups of eight digits; title: Java date pattern behind a prefix."""

    regex: str
    doc_type: str
    id_prefix: str
    title: str
    institution: str = ""
    format: str = "pdf"
    groups: int = 1


def match_links(links: DataFrame, patterns: list[LinkPattern], base: str, first: str, last: str | Column | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Records of links that a pattern matches and whose date lies in [first, last]; the first of each doc_id stays.

    links: page, pos, href.  Each pattern is a projection of the same scan; known documents go by an anti-join."""
    to = F.current_date() if last is None else F.lit(last).cast("date") if isinstance(last, str) else last
    at = links.withColumn("address", absolute_url("href", base))
    out: DataFrame | None = None
    for order, p in enumerate(patterns):
        digits = F.coalesce(*(F.nullif(F.regexp_extract("address", p.regex, i + 1), F.lit("")) for i in range(p.groups)))
        found = at.where(F.col("address").rlike(p.regex)).withColumn("d", F.try_to_date(digits, "yyyyMMdd"))
        one = found.where(F.col("d").between(F.lit(first).cast("date"), to)).select(
            F.concat(F.lit(p.id_prefix), F.date_format("d", "yyyyMMdd")).alias("doc_id"), F.lit(p.institution).alias("institution"), F.lit(p.doc_type).alias("doc_type"),
            F.date_format("d", "yyyy-MM-dd").alias("date"), F.date_format("d", p.title).alias("title"), F.col("address").alias("url"), F.lit(p.format).alias("format"),
            F.struct(F.lit(order).alias("pattern"), F.col("page"), F.col("pos")).alias("place"),
        )
        out = one if out is None else out.unionByName(one)
    rest = [c for c in out.columns if c not in ("doc_id", "place")]
    firsts = out.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "place").alias("r")).select("doc_id", *(F.col(f"r.{c}").alias(c) for c in rest))
    return firsts if seen is None else firsts.join(seen.select("doc_id"), "doc_id", "left_anti")


def dated_links(links: DataFrame, word: str, base: str) -> DataFrame:
    """page, pos, address, title, date of links whose address has the word and whose slug or title tells a date."""
    kept = links.where(F.lower("href").contains(word.lower()))
    return kept.select("page", "pos", absolute_url("href", base).alias("address"), F.col("link_text").alias("title"), date_of_slug_or_title("href", "link_text").alias("date")).where("date is not null")


def preferred_pdf(links: DataFrame, slug: Column, base: str) -> DataFrame:
    """page, address: of each hub page the link called 'PDF', else one with the slug, else any PDF among uploads."""
    href = F.lower("href")
    priority = (
        F.when((F.upper(F.trim("link_text")) == "PDF") & href.contains(".pdf"), 0)
        .when(F.col("href").contains(slug) & href.endswith(".pdf"), 1)
        .when(href.endswith(".pdf") & F.col("href").contains("/wp-content/"), 2)
    )
    return links.withColumn("p", priority).where("p is not null").groupBy("page").agg(absolute_url(F.min_by("href", F.struct("p", "pos")), base).alias("address"))


def dated_addresses(dates: DataFrame, template: str, date: str = "date") -> DataFrame:
    """Addresses made from dates; in the template, {y}, {m}, {d} and {iso} stand for their parts."""
    out = F.lit(template)
    for mark, pattern in (("{y}", "yyyy"), ("{m}", "MM"), ("{d}", "dd"), ("{iso}", "yyyy-MM-dd")):
        out = F.replace(out, F.lit(mark), F.date_format(F.col(date).cast("date"), pattern))
    return dates.withColumn("url", out)


def hub_documents(listing: DataFrame, hubs: DataFrame, word: str, base: str, slug: Column) -> DataFrame:
    """Two hops: the dated links of listing pages, each joined with the PDF that its hub page prefers.

    listing, hubs: page, pos, href, link_text, where a hub's page is its address.  page, address, title, date, pdf; a hub that
    hasn't landed, or has no PDF, leaves pdf null."""
    found = dated_links(listing, word, base)
    pdf = preferred_pdf(hubs, slug, base).select(F.col("page").alias("address"), F.col("address").alias("pdf"))
    return found.join(pdf, "address", "left").select("page", "address", "title", "date", "pdf")


def titled(pages: DataFrame, fallback: Column, html: str = "html") -> DataFrame:
    """``pages`` with ``title``: the text of the first h1, else the fallback."""
    heading = F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", " ")
    text = F.trim(F.regexp_replace(heading, r"\s+", " "))
    return pages.withColumn("title", F.when(text != "", text).otherwise(fallback))
