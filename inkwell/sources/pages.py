"""Fetched pages and feeds as tables: text, links, images, tables, article fields. JVM-side only.

Markup is read by expressions, so malformed markup follows these patterns and no repair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators.dedup import first_per_group

BLOCKS = r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/section|/article)\b[^>]*>"


def page_title(html: Column, fallback: Column) -> Column:
    t = X.compact(X.unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(t != "", t).otherwise(fallback)


def page_text(html: Column, most: int = 12_000) -> Column:
    """Text nodes outside scripts, styles, noscript and the title, a line each."""
    body = F.regexp_replace(X.page_body(html), r"(?is)<!--.*?-->|<title[^>]*>.*?</title>", "")
    return F.substring(F.array_join(F.transform(X.markup_lines(body), X.unescaped), "\n"), 1, most)


def pages_as_material(pages: DataFrame, html: str = "html", fallback: str = "url") -> DataFrame:
    """Add title, content, tags, and ``error`` for pages without text."""
    out = pages.withColumn("title", page_title(F.col(html), F.col(fallback))).withColumn("content", page_text(F.col(html)))
    return out.withColumn("tags", F.array(F.lit("web"))).withColumn("error", F.when(F.col("content") == "", "no text"))


def article_region(html: Column) -> Column:
    """The first of article, main, the js_content block, body, or the whole."""
    found = [F.regexp_extract(html, p, 1) for p in (r"(?is)<article\b[^>]*>(.*?)</article>", r"(?is)<main\b[^>]*>(.*?)</main>", r"""(?is)<div\b[^>]*id=["']js_content["'][^>]*>(.*?)</div>""", r"(?is)<body\b[^>]*>(.*?)</body>")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], html)


def imported(pages: DataFrame, html: str = "html", url: str = "url", least: int = 80) -> DataFrame:
    """title, content, summary and error of an imported page."""
    body = F.regexp_replace(F.regexp_replace(article_region(X.page_body(F.col(html))), BLOCKS, "\n"), r"(?s)<[^>]*>", "")
    lines = F.filter(F.transform(F.split(X.unescaped(body), "\n", -1), X.compact), lambda s: F.length(s) > 1)
    out = pages.withColumn("content", F.array_join(lines, "\n"))
    og = F.regexp_extract(html, r"""(?i)<meta\b[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", 1)
    title = F.coalesce(F.nullif(X.compact(X.unescaped(og)), F.lit("")), F.nullif(page_title(F.col(html), F.lit("")), F.lit("")), X.host_of(F.col(url)))
    short = X.compact(F.col("content"))
    out = out.withColumn("title", title).withColumn("summary", F.when(F.length(short) > 80, F.concat(F.substring(short, 1, 80), F.lit("…"))).otherwise(short))
    return out.withColumn("error", F.when(F.length("content") < least, "too short"))


def content_kind(body: Column, content_type: Column) -> Column:
    kind = F.lower(content_type)
    return F.when(kind.contains("xml") | kind.contains("rss") | kind.contains("atom") | F.ltrim(body).startswith("<?xml"), "feed").otherwise("page")


def feed_items(feeds: DataFrame, key: str, body: str, most: int = 5) -> DataFrame:
    """The first ``most`` items or entries of each RSS or Atom body: title, link, summary."""
    block = r"(?is)<(?:\w+:)?(?:item|entry)\b.*?</(?:\w+:)?(?:item|entry)>"
    items = feeds.select(key, F.posexplode(F.slice(F.regexp_extract_all(body, F.lit(block), F.lit(0)), 1, most)).alias("pos", "_item"))

    def tag(*names: str) -> Column:
        got = [F.regexp_extract("_item", rf"(?is)<(?:\w+:)?{n}\b[^>]*>(.*?)</(?:\w+:)?{n}>", 1) for n in names]
        plain = [F.regexp_replace(F.regexp_replace(g, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"(?s)<[^>]*>", "") for g in got]
        return F.coalesce(*[F.nullif(X.compact(X.unescaped(p)), F.lit("")) for p in plain], F.lit(""))

    href = F.regexp_extract("_item", r"""(?is)<(?:\w+:)?link\b[^>]*href=["']([^"']*)["']""", 1)
    return items.select(key, "pos", tag("title").alias("title"), F.coalesce(F.nullif(tag("link"), F.lit("")), href).alias("link"), tag("description", "summary").alias("summary"))


#: Tags at which a link's surroundings begin and end.
AROUND = r"(?i)</?(?:li|p|div|td|tr|ul|ol|dl|dt|dd|nav|main|section|article|table|body|h[1-6])\b[^>]*>"
ANCHOR = r"""(?is)<a\b[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""


def plain(markup: Column, tag: str = "") -> Column:
    """Compact text of markup, each tag read as ``tag``."""
    return X.compact(X.unescaped(F.regexp_replace(markup, r"(?s)<[^>]*>", tag)))


def listing_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 6, longest: int = 60, n: int = 20, same_site: bool = True, gate=None, year: Column | None = None, most: int = 120) -> DataFrame:
    """The first ``n`` candidate links of each page: pos, title, link, summary and published_at.

    A link's text has a fitting length; it is resolved, and leads to the page's site or one
    below it, or (unless ``same_site``) to that host or a government's. What stands around it
    in its block gives the date (a date without year is of ``year``, by default this one) and,
    without the title, the summary. ``gate`` reads title and summary.
    """
    anchor = ANCHOR
    blocks = F.transform(F.split(F.col(html), AROUND, -1), lambda b: F.transform(F.regexp_extract_all(b, F.lit(anchor), F.lit(0)), lambda a: F.struct(a.alias("a"), b.alias("block"))))
    a = pages.select(key, url, F.posexplode(F.flatten(blocks)).alias("pos", "_found")).select(key, url, "pos", "_found.*").withColumnRenamed("a", "_a")
    a = a.withColumn("href", F.trim(F.regexp_extract("_a", anchor, 1)))
    a = a.withColumn("title", plain(F.regexp_extract("_a", anchor, 2)))
    a = a.filter(F.length("title").between(least, longest) & ~F.lower("href").rlike("^(javascript:|#|mailto:|tel:)") & (F.col("href") != ""))
    a = a.withColumn("link", X.resolve_url(F.col(url), F.col("href")))
    site, host = X.host_of(F.col(url)), X.host_of(F.col("link"))
    a = a.filter((host == site) | (host.endswith(F.concat(F.lit("."), site)) if same_site else X.is_government(host)))
    a = a.withColumn("block", plain(F.col("block"), " "))
    rest = F.trim(F.replace("block", "title", F.lit("")))
    a = a.withColumn("summary", F.when(F.length(rest) > most, F.concat(F.substring(rest, 1, most), F.lit("…"))).otherwise(rest))
    a = a.withColumn("published_at", X.extract_date(F.col("block"), F.year(F.current_date()) if year is None else year))
    if gate is not None:
        a = a.filter(gate(F.concat_ws(" ", "title", "summary")))
    return first_per_group(a.select(key, "pos", "title", "link", "summary", "published_at"), [key], [F.col("pos")], n)


def image_refs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Image addresses (data-src ahead of src) once a page, in order, with their alt text; no data: addresses."""
    tags = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))).alias("pos", "_img"))
    attr = lambda n: F.regexp_extract("_img", rf"""(?is)\s{n}=["']([^"']*)["']""", 1)
    out = tags.select(key, "pos", F.coalesce(F.nullif(attr("data-src"), F.lit("")), attr("src")).alias("src"), attr("alt").alias("alt"))
    out = out.filter((F.col("src") != "") & ~F.col("src").startswith("data:"))
    return first_per_group(out, [key, "src"], [F.col("pos")], 1)


def page_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, cells) of all HTML tables; row 0 is the header."""
    t = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("table_no", "_t"))
    r = t.select(key, "table_no", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("row_no", "_r"))
    cells = F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    r = r.withColumn("cells", F.transform(cells, lambda c: X.compact(X.unescaped(F.regexp_replace(c, r"(?s)<[^>]*>", "")))))
    return r.filter(F.size("cells") > 0).select(key, "table_no", "row_no", "cells")


def _holds(word: str):
    return lambda c: c.contains(word)


def table_stats(rows: DataFrame, key: str, name_words, group_words, count_words, most: int = 3) -> DataFrame:
    """Per table: data rows, distinct names and groups, and the sum of the count column's first integers. Columns are found by header words, earlier words first."""

    def column(words) -> Column:
        at = [F.array_position(F.transform("cells", _holds(w)), True) for w in words]
        return F.coalesce(*[F.nullif(a, F.lit(0)) for a in at])

    head = rows.filter("row_no = 0").select(key, "table_no", column(name_words).alias("_n"), column(group_words).alias("_g"), column(count_words).alias("_c"))
    body = rows.filter("row_no > 0").join(head, [key, "table_no"])
    cell = lambda c: F.nullif(F.try_element_at("cells", F.col(c).cast("int")), F.lit(""))
    out = body.groupBy(key, "table_no").agg(
        F.count("*").alias("n_rows"), F.countDistinct(cell("_n")).alias("n_names"), F.countDistinct(cell("_g")).alias("n_groups"),
        F.coalesce(F.sum(F.regexp_extract(cell("_c"), "[0-9]+", 0).try_cast("long")), F.lit(0)).alias("total"),
    )
    return first_per_group(out, [key], [F.col("table_no")], most)


def article_fields(pages: DataFrame, html: str = "html", most: int = 20_000) -> DataFrame:
    """title, account, author, published_at and body text, from script variables and the article region."""
    var = lambda n: X.unescaped(F.regexp_extract(html, rf"""(?is)var\s+{n}\s*=\s*["']([^"']*)["']""", 1))
    lines = X.markup_lines(article_region(X.page_body(F.col(html))))
    return pages.withColumns({
        "title": F.coalesce(F.nullif(var("msg_title"), F.lit("")), page_title(F.col(html), F.lit(""))), "account": var("nickname"), "author": var("author"),
        "published_at": F.timestamp_seconds(F.nullif(F.regexp_extract(html, r"""var\s+ct\s*=\s*["']([0-9]+)["']""", 1), F.lit("")).try_cast("long")),
        "content": F.substring(F.array_join(F.transform(lines, X.unescaped), "\n"), 1, most),
    })
