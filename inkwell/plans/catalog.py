"""One query an operator over the given tables, and its SQL.

Views map the tables to the engine's schemas: documents as raw items and materials, pages,
events as videos and candidates, conversations as transcripts. The words are Latin ones that
occur in these tables; weights and limits are those of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import lexicon as L
from inkwell.functions import text as X
from inkwell.operators import dedup, distil, feed, match, store, substrings, tasks
from inkwell.plans import words as W
from inkwell.sources import adapters
from inkwell.sources import pages as P
from inkwell.sources import payloads as J

AS_OF = "2024-02-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# --- Views -------------------------------------------------------------------------------


def raw_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as listing items: the first line is the title; URLs meet again by source and length."""
    n = F.col("doc_id")
    return read(spark, d, "documents").select(
        n.alias("pos"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60).alias("title"),
        F.concat(F.lit("HTTP://"), F.upper("source"), F.lit(".Example.org/a/"), F.col("n_chars").cast("string"), F.lit("/;v=1?q="), F.col("lang"), F.lit("#top")).alias("url"),
        F.substring("text", 1, 180).alias("summary"), F.col("source").alias("source_name"), F.col("lang"),
        F.when(n % 7 != 0, F.expr(f"timestamp'{AS_OF}' - make_dt_interval(cast(doc_id % 200 as int), 1)")).alias("published_at"),
    )


RAW = f"""raw AS (SELECT doc_id AS pos, substr(split_part(text, chr(10), 1), 1, 60) AS title,
  'HTTP://' || upper(source) || '.Example.org/a/' || n_chars || '/;v=1?q=' || lang || '#top' AS url,
  substr(text, 1, 180) AS summary, source AS source_name, lang,
  CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 200 AS INT)) - INTERVAL 1 HOUR END AS published_at FROM documents)"""


def videos(spark: SparkSession, d: str) -> DataFrame:
    """Events by user: clicks are likes, purchases are saves."""
    u = F.col("user_id")
    e = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("likes"), F.count_if(F.col("event_type") == "purchase").alias("saves"), F.max("ts").cast("timestamp").alias("published_at"))
    return e.select(
        u.alias("id"), F.concat(F.lit("video "), u.cast("string")).alias("title"), F.concat(F.lit("maker"), (u % 13).cast("string")).alias("creator"),
        F.when(u % 2 == 0, "short").otherwise("long").alias("platform"), F.when(u % 3 == 0, "local").when(u % 3 == 1, "wide").otherwise("odd").alias("scope"),
        F.concat(F.lit("https://v.example.com/share/video/"), (u % 97).cast("string"), F.lit("?from="), u.cast("string")).alias("original_url"),
        F.when(u % 4 == 0, F.concat(F.lit("https://m.example.com/"), u.cast("string"))).otherwise("").alias("play_url"), "likes", "saves", "published_at",
    )


VIDEOS = """videos AS (SELECT user_id AS id, 'video ' || user_id AS title, 'maker' || (user_id % 13) AS creator,
  CASE WHEN user_id % 2 = 0 THEN 'short' ELSE 'long' END AS platform,
  CASE user_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'wide' ELSE 'odd' END AS scope,
  'https://v.example.com/share/video/' || (user_id % 97) || '?from=' || user_id AS original_url,
  CASE WHEN user_id % 4 = 0 THEN 'https://m.example.com/' || user_id ELSE '' END AS play_url, likes, saves, published_at
  FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS likes, count(*) FILTER (event_type = 'purchase') AS saves, max(ts) AS published_at FROM events GROUP BY user_id))"""

LIMITS = (("short", "local", 12, 14), ("long", "local", 10, 12), ("short", "wide", 15, 18), ("long", "wide", 14, 16))
LIMITS_SQL = "limits(platform, scope, like_limit, save_limit) AS (VALUES " + ", ".join(f"('{p}', '{s}', {a}, {b})" for p, s, a, b in LIMITS) + ")"


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in LIMITS], "platform string, scope string, likes int, saves int")


def materials(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60).alias("title"), F.col("text").alias("content"), F.lit("").alias("summary"), F.array("lang", "source").alias("tags"), F.col("source").alias("source_name"), F.when(F.col("doc_id") % 3 == 0, "done").otherwise("pending").alias("status"))


MATERIALS = "materials AS (SELECT doc_id AS id, substr(split_part(text, chr(10), 1), 1, 60) AS title, text AS content, '' AS summary, [lang, source] AS tags, source AS source_name, CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE 'pending' END AS status FROM documents)"


# --- SQL twins of the expressions -------------------------------------------------------------

_BLANKS = r"[\s\p{Z}]+"


def s_compact(c: str) -> str:
    return rf"trim(regexp_replace({c}, '{_BLANKS}', ' ', 'g'))"


def s_url(c: str) -> str:
    u = "'" + X.URL.replace("'", "''") + "'"
    part = lambda k: f"regexp_extract(trim({c}), {u}, {k})"
    return rf"(lower({part(1)}) || '://' || lower({part(2)}) || regexp_replace(regexp_replace({part(3)}, ';[^/]*$', ''), '/+$', '') || CASE WHEN {part(4)} <> '' THEN '?' || {part(4)} ELSE '' END)"


def s_host(c: str) -> str:
    return f"lower(regexp_extract(trim({c}), '{X.URL}', 2))"


def s_title_key(c: str) -> str:
    out = rf"regexp_replace(lower(trim({c})), '[\s　\p{{Z}}]+', '', 'g')"
    out = rf"regexp_replace({out}, '^[·•\-—_【\[\(（]+', '')"
    out = f"regexp_replace({out}, '(?:{'|'.join(L.TITLE_TAILS)})$', '')"
    out = rf"regexp_replace({out}, '([一-鿿])[0-9]$', '\1')"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def s_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def s_count(c: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{w}') AS INT)" for w in words) + ")"


def s_label(c: str, rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {s_any(c, words)} THEN '{name}'" for name, words in rules) + f" ELSE '{other}' END"


def s_relevance(c: str, r: L.Relevance = W.LATIN) -> str:
    return "(" + " + ".join(f"{s_count(c, words)} * ({w})" for words, w in r.weighted) + ")"


def s_relevant(c: str, r: L.Relevance = W.LATIN) -> str:
    return f"(NOT ({s_any(c, r.noise)} AND NOT {s_any(c, r.rescue)}) AND {s_relevance(c, r)} >= {r.least})"


def s_age(c: str) -> str:
    return f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({c})) / 86400000000.0) AS BIGINT)"


ITEM = "title || ' ' || summary"


def item() -> Column:
    return F.concat_ws(" ", "title", "summary")


# --- A: sources, sinks, extraction ------------------------------------------------------------

_PAGE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<noscript\b.*?</noscript>', '', 'g'), '(?is)<!--.*?-->|<title[^>]*>.*?</title>', '', 'g')"""


def s_unescape(c: str) -> str:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def s_lines(c: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({c}, '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: {s_compact('x')}), lambda x: x <> '')"


_TITLE = s_compact(s_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


@query("a1_page_text", f"SELECT page_id, CASE WHEN {_TITLE} <> '' THEN {_TITLE} ELSE url END AS title, substr(array_to_string(list_transform({s_lines(_PAGE)}, lambda x: {s_unescape('x')}), chr(10)), 1, 12000) AS content FROM pages")
def a1(spark, d):
    return P.pages_as_material(read(spark, d, "pages")).select("page_id", "title", "content")


_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<noscript\b.*?</noscript>', '', 'g')"
_REGION = rf"coalesce(nullif(regexp_extract(b, '(?is)<article\b[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(b, '(?is)<main\b[^>]*>(.*?)</main>', 1), ''), nullif(regexp_extract(b, '(?is)<body\b[^>]*>(.*?)</body>', 1), ''), b)"
_FLAT = rf"regexp_replace(regexp_replace({_REGION}, '{P.BLOCKS}', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"


@query("a2_import_page", f"""WITH x AS (SELECT page_id, url, {_BARE} AS b, {_TITLE} AS t FROM pages),
c AS (SELECT page_id, url, t, array_to_string(list_filter(list_transform(string_split({s_unescape(_FLAT)}, chr(10)), lambda z: {s_compact('z')}), lambda z: len(z) > 1), chr(10)) AS content FROM x)
SELECT page_id, CASE WHEN t <> '' THEN t ELSE {s_host('url')} END AS title, content, CASE WHEN len({s_compact('content')}) > 80 THEN substr({s_compact('content')}, 1, 80) || '…' ELSE {s_compact('content')} END AS summary, CASE WHEN len(content) < 80 THEN 'too short' END AS error FROM c""")
def a2(spark, d):
    return P.imported(read(spark, d, "pages")).select("page_id", "title", "content", "summary", "error")


@query("a4_dispatch", r"SELECT page_id, CASE WHEN regexp_matches(lower(split_part(url, '?', 1)), 'xml|rss|atom') OR starts_with(ltrim(html), '<?xml') THEN 'feed' ELSE 'page' END AS kind FROM pages")
def a4(spark, d):
    return read(spark, d, "pages").select("page_id", P.content_kind(F.col("html"), F.split_part("url", F.lit("?"), F.lit(1))).alias("kind"))


_ANCHOR, _AROUND = P.ANCHOR.replace("'", "''"), P.AROUND
_BLOCK_TEXT = s_compact(s_unescape("regexp_replace(block, '(?s)<[^>]*>', ' ', 'g')"))


@query("a5_listing_links", f"""WITH s AS (SELECT page_id, url, unnest(x) AS block, unnest(range(len(x))) AS part FROM (SELECT page_id, url, string_split_regex(html, '{_AROUND}') AS x FROM pages)),
u AS (SELECT page_id, url, block, part, unnest(regexp_extract_all(block, '{_ANCHOR}')) AS a, unnest(range(len(regexp_extract_all(block, '{_ANCHOR}')))) AS inside FROM s),
a AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part, inside) - 1 AS INT) AS pos FROM u),
b AS (SELECT page_id, url, pos, {_BLOCK_TEXT} AS block_text, trim(regexp_extract(a, '{_ANCHOR}', 1)) AS href, {s_compact(s_unescape(f"regexp_replace(regexp_extract(a, '{_ANCHOR}', 2), '(?s)<[^>]*>', '', 'g')"))} AS title FROM a),
c AS (SELECT page_id, pos, title, trim(replace(block_text, title, '')) AS rest, regexp_extract(url, '^(https?)', 1) || '://' || regexp_extract(url, '{X.URL}', 2) || href AS link FROM b WHERE len(title) BETWEEN 6 AND 60 AND starts_with(href, '/') AND NOT starts_with(href, '//')),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM c)
SELECT page_id, pos, title, link, CASE WHEN len(rest) > 120 THEN substr(rest, 1, 120) || '…' ELSE rest END AS summary FROM r WHERE k <= 3""")
def a5(spark, d):
    return P.listing_links(read(spark, d, "pages"), n=3, year=F.lit(2024)).drop("published_at")


def listing(spark, d):
    """Orders of a customer as a listing page: two links to its own site, one below it, one to a government's, one elsewhere."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    host = F.when(k % 5 == 2, "sub.x.org").when(k % 5 == 3, "edu.gov").when(k % 5 == 4, "else.org").otherwise("x.org")
    item = F.concat(F.lit("<li><a href='http://"), host, F.lit("/o/"), k.cast("string"), F.lit("'>order number "), k.cast("string"), F.lit("</a> <i>"), F.date_format("o_orderdate", "yyyy-M-d"), F.lit("</i> "), F.col("o_orderstatus"), F.lit("</li>"))
    items = F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("item"))))
    return o.groupBy("o_custkey").agg(F.concat(F.lit("<ul>"), F.array_join(F.transform(items, lambda x: x["item"]), ""), F.lit("</ul>")).alias("html"), F.lit("http://x.org/list").alias("url"))


def _s_listing(hosts: str) -> str:
    return f"""WITH l AS (SELECT o_custkey, o_orderkey AS k, o_orderdate, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS pos, CASE o_orderkey % 5 WHEN 2 THEN 'sub.x.org' WHEN 3 THEN 'edu.gov' WHEN 4 THEN 'else.org' ELSE 'x.org' END AS host FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS n FROM l WHERE host IN ({hosts}) AND o_orderstatus <> 'P')
SELECT o_custkey, pos, 'order number ' || k AS title, 'http://' || host || '/o/' || k AS link, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS published_at,
 year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) || ' ' || o_orderstatus AS summary FROM r WHERE n <= 5"""


@query("a5_dated_links", _s_listing("'x.org', 'sub.x.org'"))
def a5b(spark, d):
    """The gate reads the summary: pending orders stay out."""
    return P.listing_links(listing(spark, d), "o_custkey", n=5, gate=lambda t: ~t.rlike(" P$")).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("a5_official_links", _s_listing("'x.org', 'edu.gov'"))
def a5c(spark, d):
    links = P.listing_links(listing(spark, d), "o_custkey", n=5, same_site=False, gate=lambda t: ~t.rlike(" P$"))
    return links.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("a9_payload", """SELECT event_id, greatest(coalesce(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT), 0), 0) AS likes, greatest(coalesce(nullif(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT), 0), 0), 0) AS saves FROM events""")
def a9(spark, d):
    return read(spark, d, "events").select("event_id", J.count_of("props", "$.likes", "$.k").alias("likes"), J.count_of("props", "$.k", "$.saves").alias("saves"))


@query("a10_fanout", """WITH i AS (SELECT event_type AS query, 'u' || (user_id % 10) AS topic, user_id % 10 AS topic_pos, event_id AS item_pos, 'e' || (event_id % 50) AS url, ts AS published_at FROM events),
t AS (SELECT query, topic, row_number() OVER (PARTITION BY query ORDER BY topic_pos, topic) AS k FROM (SELECT DISTINCT query, topic, topic_pos FROM i)),
j AS (SELECT i.*, row_number() OVER (PARTITION BY query, topic ORDER BY item_pos) AS k2 FROM i JOIN (SELECT query, topic FROM t WHERE k <= 3) USING (query, topic)),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY query, topic_pos, item_pos) AS k3 FROM j WHERE k2 <= 20)
SELECT query, topic, topic_pos, item_pos, url, published_at FROM f WHERE k3 = 1""")
def a10(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("query"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("topic"), (F.col("user_id") % 10).alias("topic_pos"), F.col("event_id").alias("item_pos"), F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")).alias("url"), F.col("ts").alias("published_at"))
    return J.fanout(e).select("query", "topic", "topic_pos", "item_pos", "url", "published_at")


@query("a14_listing", f"WITH {VIDEOS} SELECT id, likes, saves, likes >= 15 AS is_hot FROM videos ORDER BY is_hot DESC, published_at DESC, id DESC")
def a14(spark, d):
    v = videos(spark, d).withColumn("is_hot", F.col("likes") >= 15).withColumn("collected_at", F.col("published_at"))
    return store.listed(v, "videos").select("id", "likes", "saves", "is_hot")


@query("a15_upsert", """WITH b AS (SELECT o_orderkey, o_totalprice, o_orderdate, 0 AS n FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1, o_orderdate, 1 FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, n DESC) AS k FROM b) SELECT o_orderkey, round(o_totalprice, 2) AS price, o_orderdate FROM r WHERE k = 1""")
def a15(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    new = o.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return store.upsert(o.filter("o_orderkey % 3 != 0"), new, "o_orderkey", "o_orderdate").select("o_orderkey", F.round("o_totalprice", 2).alias("price"), "o_orderdate")


@query("a15_append_ids", "WITH s AS (SELECT max(s_suppkey) AS top FROM supplier) SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) + top AS BIGINT) AS id FROM customer, s")
def a15b(spark, d):
    new, stored = read(spark, d, "customer").select("c_custkey"), read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return store.with_new_ids(new, stored, [F.col("c_custkey")]).select("c_custkey", "id")


@query("a17_thresholds", f"""WITH {VIDEOS}, {LIMITS_SQL}, c AS (SELECT platform, scope, CASE WHEN scope = 'local' THEN 'many' ELSE CAST(max(likes) - 30 AS VARCHAR) END AS likes, CAST(min(saves) AS VARCHAR) AS saves FROM videos WHERE platform = 'short' GROUP BY platform, scope)
SELECT platform, scope, greatest(0, coalesce(try_cast(c.likes AS INT), like_limit)) AS likes, greatest(0, coalesce(try_cast(c.saves AS INT), save_limit)) AS saves FROM limits LEFT JOIN c USING (platform, scope)""")
def a17(spark, d):
    v = videos(spark, d).filter("platform = 'short'").groupBy("platform", "scope").agg(F.max("likes").alias("l"), F.min("saves").cast("string").alias("saves"))
    config = v.select("platform", "scope", F.when(F.col("scope") == "local", "many").otherwise((F.col("l") - 30).cast("string")).alias("likes"), "saves")
    return feed.complete_thresholds(config, LIMITS)


@query("a18_seed", "SELECT n_name AS name, 0 AS seed FROM nation UNION ALL SELECT s_name, 1 FROM supplier WHERE s_name NOT IN (SELECT n_name FROM nation)")
def a18(spark, d):
    n, s = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(0).alias("seed")), read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit(1).alias("seed"))
    return store.seeded(n, s)


# --- B: scalars --------------------------------------------------------------------------------


@query("b1_url", f"SELECT page_id, {s_url('url')} AS url_key FROM pages")
def b1(spark, d):
    return read(spark, d, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url_key"))


@query("b2_title_key", f"WITH {RAW} SELECT pos, {s_title_key('title')} AS title_key FROM raw")
def b2(spark, d):
    return raw_items(spark, d).select("pos", X.title_key(F.col("title")).alias("title_key"))


@query("b3_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE make_timestamp(2023, month(o_orderdate), day(o_orderdate), 0, 0, 0) END AS found FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS o_orderdate FROM orders)")
def b3(spark, d):
    o = read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "'issued 'yyyy/M/d' x'")).otherwise(F.date_format("o_orderdate", "'on 'M.d"))
    return o.select("o_orderkey", X.extract_date(text, F.lit(2023)).cast("timestamp_ntz").alias("found"))


@query("b4_video_key", rf"WITH {VIDEOS} SELECT id, CASE WHEN id % 5 = 0 THEN 'https://w.example.com/p/' || id ELSE 'douyin:' || regexp_extract(original_url, '/(?:share/)?(?:video|note)/([0-9]+)', 1) END AS url_key FROM videos")
def b4(spark, d):
    url = F.when(F.col("id") % 5 == 0, F.concat(F.lit("https://w.example.com/p/"), F.col("id").cast("string"), F.lit("//?x=1"))).otherwise(F.col("original_url"))
    return videos(spark, d).select("id", X.video_url_key(url).alias("url_key"))


NAMES = (("example.com", "Example"), ("blog.example.net", "Net Blog"), ("example.org", "Org"))


@query("b5_source_name", f"""WITH h AS (SELECT page_id, {s_host('url')} AS host FROM pages) SELECT page_id, CASE {' '.join(f"WHEN host = '{k}' OR ends_with(host, '.{k}') THEN '{v}'" for k, v in NAMES)} ELSE host END AS source_name FROM h""")
def b5(spark, d):
    return match.source_names(read(spark, d, "pages").select("page_id", X.host_of(F.col("url")).alias("host")), "page_id", NAMES).select("page_id", "source_name")


@query("b6_is_gov", f"SELECT page_id, ends_with({s_host('url')}, '.gov.cn') OR ends_with({s_host('url')}, '.gov') AS gov FROM pages")
def b6(spark, d):
    return read(spark, d, "pages").select("page_id", X.is_government(X.host_of(F.col("url"))).alias("gov"))


@query("b7_resolve", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)', 1) AS s, regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)', 2) AS h, regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)', 3) AS path FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://other.example/x' WHEN 1 THEN s || '://cdn.example/y' WHEN 2 THEN s || '://' || h || '/z?q=1' ELSE s || '://' || h || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || 'rel/w.html' END AS link FROM p""")
def b7(spark, d):
    k = F.col("page_id") % 4
    link = F.when(k == 0, "https://other.example/x").when(k == 1, "//cdn.example/y").when(k == 2, "/z?q=1").otherwise("rel/./a/../w.html")
    return read(spark, d, "pages").select("page_id", X.resolve_url(F.col("url"), link).alias("link"))


TAGS = (("film", "tion"), ("song", "heit"), ("food", "ing"), ("town", "que"), ("home", "thea"), ("road", "ble"))


_RULE_TAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({{c}}, '{p}') THEN '{t}' END" for t, p in TAGS) + "], lambda t: t IS NOT NULL)"


@query("b8_source_type", f"WITH t AS (SELECT page_id, url, {_RULE_TAGS.format(c='html')} AS tags FROM pages) SELECT page_id, CASE WHEN contains(url, 'blog.') THEN 'blog' WHEN contains(url, '.net') THEN 'network' ELSE 'web' END AS kind, CASE WHEN len(tags) = 0 THEN 'web' ELSE array_to_string(tags[1:5], ',') END AS tags FROM t")
def b8(spark, d):
    kind = match.source_kind(F.col("url"), (("blog", ("blog.",)), ("network", (".net",))))
    return read(spark, d, "pages").select("page_id", kind.alias("kind"), F.array_join(match.rule_tags(F.col("html"), TAGS), ",").alias("tags"))


@query("b9_tags", f"WITH {MATERIALS}, t AS (SELECT id, list_filter(tags, lambda x: x <> 'en') AS own, {_RULE_TAGS.format(c='content')} AS more FROM materials) SELECT id, array_to_string((own || list_filter(more, lambda x: NOT list_contains(own, x)))[1:5], ',') AS tags FROM t")
def b9(spark, d):
    tags = match.organized_tags(F.col("tags"), F.col("content"), TAGS, ("en",))
    return materials(spark, d).select("id", F.array_join(tags, ",").alias("tags"))


@query("b10_summary", f"SELECT doc_id, substr({s_compact('text')}, 1, 180) AS summary FROM documents")
def b10(spark, d):
    return read(spark, d, "documents").select("doc_id", X.summary(F.col("text")).alias("summary"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in W.LATIN_KEYWORDS) + "]"
_HITS = f"list_filter({_WORDS}, lambda w: contains(content, w))"
_MERGED = f"(tags || list_filter({_HITS}, lambda w: NOT list_contains(tags, w)))[1:10]"


@query("b11_excerpt", rf"""WITH e AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({s_compact('text')}, '([。！？!?；;])\s*', E'\\1\x01', 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '') AS p FROM documents),
o AS (SELECT doc_id, coalesce(nullif(array_to_string(p[1:2], ''), ''), 'none') AS o FROM e) SELECT doc_id, CASE WHEN len(o) > 110 THEN substr(o, 1, 108) || '...' ELSE o END AS excerpt FROM o""")
def b11(spark, d):
    return read(spark, d, "documents").select("doc_id", X.excerpt(F.col("text"), F.lit("none")).alias("excerpt"))


@query("b12_keywords", f"WITH {MATERIALS} SELECT id, array_to_string({_MERGED}, ',') AS keywords FROM materials")
def b12(spark, d):
    return materials(spark, d).select("id", F.array_join(match.keyword_hits(F.col("content"), F.col("tags"), W.LATIN_KEYWORDS), ",").alias("keywords"))


@query("b13_infer_tags", f"""WITH {MATERIALS}, k AS (SELECT id, tags, source_name, {_MERGED} AS kw FROM materials), e AS (SELECT id, ['web'] || tags || [source_name] || kw[1:4] AS e FROM k)
SELECT id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i)[1:8], ',') AS tags FROM e""")
def b13(spark, d):
    kw = match.keyword_hits(F.col("content"), F.col("tags"), W.LATIN_KEYWORDS)
    return materials(spark, d).select("id", F.array_join(match.infer_tags(F.lit("web"), F.col("tags"), F.col("source_name"), kw), ",").alias("tags"))


@query("b14_defaults", f"WITH {MATERIALS} SELECT id, trim(title) AS title, CASE WHEN trim(summary) = '' THEN substr(trim(content), 1, 120) ELSE trim(summary) END AS summary FROM materials")
def b14(spark, d):
    m = materials(spark, d)
    return m.select("id", F.trim("title").alias("title"), F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.substring(F.trim("content"), 1, 120)).alias("summary"))


@query("b15_keyword_list", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a,b' ELSE event_type END AS words FROM events")
def b15(spark, d):
    words = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit(" "), F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))))
    return read(spark, d, "events").select("event_id", F.array_join(match.keyword_list(words, ("a", "b")), ",").alias("words"))


_HOT = f"""WITH {VIDEOS}, {LIMITS_SQL}, h AS (SELECT v.*, coalesce(like_limit, 0) AS ll, coalesce(save_limit, 0) AS sl, likes >= coalesce(like_limit, 0) OR saves >= coalesce(save_limit, 0) AS is_hot FROM videos v LEFT JOIN limits USING (platform, scope))"""


@query("b16_reason", _HOT + " SELECT id, CASE WHEN is_hot THEN 'met' ELSE 'not met' END || ': ' || likes || ' likes, ' || saves || ' saves; rule ' || scope || ' ' || platform || ': ' || ll || ' likes or ' || sl || ' saves' AS reason FROM h")
def b16(spark, d):
    return feed.with_hotness(videos(spark, d), limits(spark)).select("id", "reason")


@query("b17_patch", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new ' || c_custkey ELSE c_name END AS c_name, c_mktsegment FROM customer")
def b17(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = c.filter("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("new "), F.col("c_custkey").cast("string")).alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return store.patched(c, patch, "c_custkey", ["c_name", "c_mktsegment"])


@query("b18_caution", "SELECT doc_id, regexp_matches(text, 'rumou?r|forecast|20[0-9]{2}') AS caution FROM documents")
def b18(spark, d):
    return read(spark, d, "documents").select("doc_id", F.col("text").rlike("rumou?r|forecast|20[0-9]{2}").alias("caution"))


@query("b19_mask", "SELECT conv_id, turn, regexp_replace(text, '[a-z]{1,2}(tion|heit)', '某\\1', 'g') AS text FROM conversations")
def b19(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", X.masked_persons(F.col("text"), ("tion", "heit"), "a-z").alias("text"))


_RULES = (("^The", "One"), ("tion(s)?", "ment"), ("und", "and"))


@query("b20_condense", f"""WITH s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text), '^The', 'One', 'g'), 'tion(s)?', 'ment', 'g'), 'und', 'and', 'g'), '[!！]{{2,}}', '。', 'g'), '^[ ，。；：、]+|[ ，。；：、]+$', '', 'g') AS s FROM conversations)
SELECT conv_id, turn, substr(s, 1, 46) AS text FROM s""")
def b20(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", X.condensed(F.col("text"), 46, _RULES).alias("text"))


@query("b23_share_id", f"WITH {VIDEOS} SELECT id, CASE WHEN id % 2 = 0 THEN CAST(id % 97 AS VARCHAR) WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) END AS vid FROM videos")
def b23(spark, d):
    n = F.col("id")
    url = F.when(n % 2 == 0, F.col("original_url")).when(n % 3 == 0, F.concat(F.lit("https://w.example.com/?modal_id="), n.cast("string"))).otherwise("https://w.example.com/x")
    return videos(spark, d).select("id", X.share_id(url).alias("vid"))


@query("b24_word_count", rf"SELECT doc_id, CAST(len(regexp_replace(text, '{_BLANKS}', '', 'g')) AS INT) AS n FROM documents")
def b24(spark, d):
    return read(spark, d, "documents").select("doc_id", F.length(F.regexp_replace("text", r"(?U)\s+", "")).alias("n"))


@query("b25_split_list", "SELECT c_custkey, array_to_string(list_filter(list_transform(regexp_split_to_array(c_name || ' , ,' || c_mktsegment, '[，,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM customer")
def b25(spark, d):
    text = F.concat("c_name", F.lit(" , ,"), "c_mktsegment")
    return read(spark, d, "customer").select("c_custkey", F.array_join(F.filter(F.transform(F.split(text, "[，,]", -1), lambda w: F.trim(w)), lambda x: x != ""), "|").alias("parts"))


# --- C: scores and classes ----------------------------------------------------------------------


@query("c1_score", f"WITH {RAW} SELECT pos, {s_relevance(ITEM)} AS score FROM raw")
def c1(spark, d):
    return raw_items(spark, d).select("pos", X.relevance(item(), W.LATIN).alias("score"))


@query("c2_relevant", f"WITH {RAW} SELECT pos, {s_relevant(ITEM)} AS relevant FROM raw")
def c2(spark, d):
    return raw_items(spark, d).select("pos", X.is_relevant(item(), W.LATIN).alias("relevant"))


@query("c3_category", f"WITH {RAW} SELECT pos, {s_label(ITEM, W.LATIN_CATEGORIES, 'other')} AS category FROM raw")
def c3(spark, d):
    return raw_items(spark, d).select("pos", X.label(item(), W.LATIN_CATEGORIES, "other").alias("category"))


@query("c4_importance", f"WITH {RAW} SELECT pos, {s_label(ITEM, W.LATIN_IMPORTANCE, 'plain')} AS importance FROM raw")
def c4(spark, d):
    return raw_items(spark, d).select("pos", X.label(item(), W.LATIN_IMPORTANCE, "plain").alias("importance"))


_UI_PLUS, _UI_MINUS = ("tion", "thea", "heit", "que"), ("###", "trash")
_UI = f"{s_count(ITEM, _UI_PLUS)} * 12 - {s_count(ITEM, _UI_MINUS)} * 18 + CASE WHEN {s_label(ITEM, W.LATIN_CATEGORIES, 'other')} IN ('alpha', 'beta') THEN 16 ELSE 0 END + CASE WHEN {s_label(ITEM, W.LATIN_IMPORTANCE, 'plain')} = 'top' THEN 4 ELSE 0 END"


@query("c5_ui_score", f"WITH {RAW} SELECT pos, {_UI} AS score, {_UI} >= 12 AS shown FROM raw")
def c5(spark, d):
    t = item()
    score = X.count_hits(t, _UI_PLUS) * 12 - X.count_hits(t, _UI_MINUS) * 18 + F.when(X.label(t, W.LATIN_CATEGORIES, "other").isin("alpha", "beta"), 16).otherwise(0) + F.when(X.label(t, W.LATIN_IMPORTANCE, "plain") == "top", 4).otherwise(0)
    return raw_items(spark, d).select("pos", score.alias("score")).withColumn("shown", F.col("score") >= 12)


@query("c6_topic", f"WITH {VIDEOS} SELECT id, contains(title || ' ' || creator, '7') OR contains(title || ' ' || creator, 'maker1') AS on_topic FROM videos")
def c6(spark, d):
    return videos(spark, d).select("id", feed.topic_match(F.concat_ws(" ", "title", "creator"), F.array(F.lit(" 7 "), F.lit(""), F.lit("maker1"))).alias("on_topic"))


@query("c7_scope", f"WITH {VIDEOS} SELECT id, NOT contains(title || ' ' || creator, '13') AND contains(title || ' ' || creator, '1') AS in_scope FROM videos")
def c7(spark, d):
    return videos(spark, d).select("id", X.in_scope(F.concat_ws(" ", "title", "creator"), ("1",), ("13",)).alias("in_scope"))


_REC = f"likes + 2 * saves + 120 * greatest(30 - greatest({s_age('published_at')}, 0), 0) + CASE WHEN id % 3 = 0 THEN 800 ELSE 0 END"


@query("c8_recommend", f"WITH {VIDEOS} SELECT id, CAST({_REC} AS BIGINT) AS score FROM videos")
def c8(spark, d):
    return videos(spark, d).select("id", X.recommendation(F.col("likes"), F.col("saves"), F.col("published_at"), F.col("id") % 3 == 0, as_of()).alias("score"))


@query("c9_hot", _HOT + " SELECT id, is_hot, ll AS like_limit, sl AS save_limit FROM h")
def c9(spark, d):
    return feed.with_hotness(videos(spark, d), limits(spark)).select("id", "is_hot", "like_limit", "save_limit")


@query("c10_garbage", "SELECT conv_id, turn, len(trim(text)) < 15 OR len(regexp_replace(trim(text), '[^A-Za-z]', '', 'g')) < 3 AS garbage FROM conversations")
def c10(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", distil.is_garbage(F.col("text"), "A-Za-z").alias("garbage"))


_S = W.LATIN_SPEECH
_T = "trim(text)"
_PARTS = rf"list_filter(list_transform(regexp_split_to_array({_T}, '[。！？!?\n,，]+'), lambda s: trim(s)), lambda s: len(s) >= 3)"
_FLATT = rf"regexp_replace(regexp_replace({_T}, '#[\p{{L}}\p{{N}}_]+|#', ' ', 'g'), '\s+', '', 'g')"
_SENT = rf"list_filter(regexp_split_to_array({_T}, '[。！？!?\n]+'), lambda s: len(trim(s)) >= 5)"
_LYRIC = rf"(len({_PARTS}) >= 4 AND len(list_filter({_PARTS}, lambda s: len(s) <= 12)) * 100 >= len({_PARTS}) * 65 OR {s_count(rf'''regexp_replace({_T}, '\s+', '', 'g')''', _S.lyric)} >= 3)"


@query("c11_class", rf"""SELECT conv_id, turn, CASE WHEN {s_any(f'lower({_T})', _S.markers)} THEN 'lyrics' WHEN NOT {s_any(_T, _S.domain)} AND regexp_replace({_T}, '\s+', '', 'g') <> '' AND {_LYRIC} THEN 'lyrics'
WHEN len({_FLATT}) < 15 THEN 'title_only' WHEN len({_SENT}) >= 4 AND 1 - len(list_distinct({_SENT})) / len({_SENT})::DOUBLE >= 0.4 THEN 'lyrics' ELSE 'valid' END AS class FROM conversations""")
def c11(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", distil.content_class(F.col("text"), F.lit(""), _S).alias("class"))


@query("c12_lyric_look", rf"SELECT conv_id, turn, regexp_replace({_T}, '\s+', '', 'g') <> '' AND {_LYRIC} AS lyric FROM conversations")
def c12(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", distil.looks_like_lyrics(F.trim("text"), _S).alias("lyric"))


_DOMAIN, _DATA = ("tion", "heit", "thea", "que"), "[0-9]+ *(%|km)|[0-9]{4}"
def s_sentences(docs: str) -> str:
    """Sentences of the texts of ``docs``, with their places."""
    return r"""sent AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, s AS sentence FROM (SELECT doc_id, ss[i] AS s, i FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(list_transform(string_split_regex(regexp_replace(text, '([。！？!?；;])', E'\\1\x01', 'g'), '[\x01\n]'), lambda s: regexp_replace(trim(s), '^\s*([0-9]{1,2}[、.．)）]|[一二三四五六七八九十]{1,3}[、.]|[①-⑩])\s*', '')), lambda s: regexp_replace(s, '^[ \-—·•]+|[ \-—·•]+$', '', 'g')), lambda s: len(s) >= 8) AS ss FROM """ + docs + "))))"


_SENTENCES = s_sentences("documents")
_BIGRAMS = """letters AS (SELECT doc_id, regexp_replace(sentence, '[^a-z]', '', 'g') AS s FROM sent), grams AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, substr(s, CAST(i AS BIGINT), 2) AS token FROM (SELECT doc_id, s, unnest(range(1, len(s))) AS i FROM letters WHERE len(s) >= 2)) GROUP BY doc_id, token HAVING count(*) >= 3)"""
_SCORE = f"""{s_count('sentence', _DOMAIN)} * 160 + coalesce(p, 0) + CASE WHEN regexp_matches(sentence, '{_DATA}') THEN 220 ELSE 0 END + CASE WHEN len(sentence) BETWEEN 25 AND 70 THEN 150 WHEN len(sentence) < 15 THEN -150 WHEN len(sentence) > 110 THEN -100 ELSE 0 END - CASE WHEN regexp_matches(rtrim(sentence), '[？?]$') THEN 80 ELSE 0 END"""
_SCORES = f"{_BIGRAMS}, pairs AS (SELECT s.doc_id, s.pos, sum(least(n, 5) * 25) AS p FROM sent s JOIN grams g ON s.doc_id = g.doc_id AND contains(s.sentence, g.token) GROUP BY ALL), scored AS (SELECT s.doc_id, s.pos, sentence, CAST({_SCORE} AS BIGINT) AS score FROM sent s LEFT JOIN pairs USING (doc_id, pos))"
_SCORED = f"WITH {_SENTENCES}, {_SCORES}"


def doc_sentences(spark, d):
    return distil.sentence_table(read(spark, d, "documents"), "doc_id", "text")


def doc_scores(spark, d, rows=None):
    """Scores of all sentences, which are read once."""
    rows = doc_sentences(spark, d) if rows is None else rows
    return distil.scored_sentences(rows, "doc_id", _DOMAIN, "a-z", _DATA)


@query("c13_sentence_score", _SCORED + " SELECT doc_id, pos, score FROM scored")
def c13(spark, d):
    return doc_scores(spark, d).select("doc_id", "pos", "score")


@query("c14_sentence_flags", f"WITH {_SENTENCES} SELECT doc_id, pos, regexp_matches(sentence, '{_DATA}') AND len(sentence) <= 90 AS data, regexp_matches(sentence, 'thea|que') AND len(sentence) BETWEEN 15 AND 120 AS example FROM sent")
def c14(spark, d):
    s, n = F.col("sentence"), F.length("sentence")
    return doc_sentences(spark, d).select("doc_id", "pos", (s.rlike(_DATA) & (n <= 90)).alias("data"), (s.rlike("thea|que") & n.between(15, 120)).alias("example"))


# --- D: filters and search ------------------------------------------------------------------------


@query("d1_fresh", f"WITH {RAW} SELECT pos FROM raw WHERE published_at IS NULL OR {s_age('published_at')} <= 90")
def d1(spark, d):
    return raw_items(spark, d).filter(X.fresh(F.col("published_at"), as_of())).select("pos")


_CAT = s_label(ITEM, W.LATIN_CATEGORIES, "other")
_GATED = f"({ITEM} || ' ' || {_CAT})"


def gated_items(spark, d):
    items = raw_items(spark, d).withColumn("category", X.label(item(), W.LATIN_CATEGORIES, "other"))
    return items.filter(X.is_relevant(F.concat_ws(" ", item(), "category"), W.LATIN))


@query("d2_gate", f"WITH {RAW} SELECT pos, {_CAT} AS category FROM raw WHERE {s_relevant(_GATED)}")
def d2(spark, d):
    return gated_items(spark, d).select("pos", "category")


@query("d3_search", f"""WITH {MATERIALS}, q(query) AS (VALUES ('The '), ('SRC1'), ('heit'), ('ción de'), ('')) SELECT query, id FROM q, materials
WHERE contains(lower(concat_ws(' ', title, summary, content, array_to_string(tags, ' '))), lower(trim(query)))""")
def d3(spark, d):
    q = spark.createDataFrame([("The ",), ("SRC1",), ("heit",), ("ción de",), ("",)], "query string")
    return substrings.searched(materials(spark, d), q, [F.col("title"), F.col("summary"), F.col("content"), F.array_join("tags", " ")])


@query("d3_search_index", f"""WITH {MATERIALS}, q AS (SELECT DISTINCT substr(text, 5, 6 + CAST(doc_id // 20 % 30 AS INT)) AS query FROM documents WHERE doc_id % 20 = 0) SELECT query, id FROM q, materials
WHERE contains(lower(concat_ws(' ', title, summary, content, array_to_string(tags, ' '))), lower(trim(query)))""")
def d3_index(spark, d):
    """A piece of every twentieth document, of 6 to 35 characters, looked for in all rows."""
    docs = read(spark, d, "documents").filter("doc_id % 20 = 0")
    q = docs.select(F.substring("text", F.lit(5), (6 + F.expr("doc_id div 20 % 30")).cast("int")).alias("query"))
    return substrings.searched(materials(spark, d), q, [F.col("title"), F.col("summary"), F.col("content"), F.array_join("tags", " ")])


@query("d4_status", f"WITH {MATERIALS} SELECT id, title FROM materials WHERE status = 'pending'")
def d4(spark, d):
    return materials(spark, d).filter("status = 'pending'").select("id", "title")


@query("d5_tab", f"WITH {RAW} SELECT pos FROM raw WHERE {_CAT} = 'beta'")
def d5(spark, d):
    return raw_items(spark, d).filter(X.label(item(), W.LATIN_CATEGORIES, "other") == "beta").select("pos")


def creators(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    return n.filter("n_nationkey < 10").select(F.concat(F.lit("maker"), F.col("n_nationkey").cast("string")).alias("name"), F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("keywords"), (F.col("n_nationkey") % 4 != 0).alias("enabled"))


CREATORS = "creators AS (SELECT 'maker' || n_nationkey AS name, n_nationkey % 4 <> 0 AS enabled FROM nation WHERE n_nationkey < 10)"


@query("d6_enabled", f"WITH {VIDEOS}, {CREATORS} SELECT id FROM videos LEFT JOIN creators ON creator = name WHERE coalesce(enabled, true)")
def d6(spark, d):
    c = creators(spark, d).select(F.col("name").alias("creator"), "enabled")
    return videos(spark, d).join(c, "creator", "left").filter(F.coalesce("enabled", F.lit(True))).select("id")


_NOISE, _LABELS = ("Licensed under[^.\\n]{0,60}", "[#%&*$]{3}"), ("The", "and", "thea")
_EDGE = r"[\s　，。、；：!?！?]"


def s_less_noise(noise: tuple[str, ...], labels: tuple[str, ...]) -> str:
    """The text without noise and labels. A label between two edges takes the one ahead of it along; RE2 has no lookahead, so the one behind is put back, and all goes again for neighbours."""
    out = "text"
    for p, n in (*[(p, "") for p in noise], ("[ \\t　]+", " "), ("\\n{2,}", "\n")):
        out = f"regexp_replace({out}, '{p}', '{n}', 'g')"
    out, any_ = f"trim({out})", "|".join(labels)
    for p, n in ((rf"[\s　]*[0-9]{{1,2}}[\s　]*(?:{any_})", " "), *[(rf"(?:^|{_EDGE})(?:{any_})({_EDGE}|$)", r"\1")] * 8, (r"^\s*[0-9]{1,2}\s+", ""), (r"\s{2,}", " ")):
        out = f"regexp_replace({out}, '{p}', '{n}', 'g')"
    return f"trim({out})"


@query("d7_noise", f"SELECT doc_id, {s_less_noise(_NOISE, _LABELS)} AS text FROM documents")
def d7(spark, d):
    return read(spark, d, "documents").select("doc_id", distil.without_noise(F.col("text"), _NOISE, _LABELS).alias("text"))


@query("d8_promo", f"WITH {_SENTENCES} SELECT doc_id, pos FROM sent WHERE NOT regexp_matches(sentence, 'License|copyright|@mail')")
def d8(spark, d):
    return distil.without_promotion(doc_sentences(spark, d), ("License", "copyright", "@mail")).select("doc_id", "pos")


@query("d9_min_content", "SELECT doc_id, CASE WHEN len(text) < 50 THEN 'core too short' WHEN len(text) < 120 THEN 'too short' ELSE '' END AS error FROM documents")
def d9(spark, d):
    return read(spark, d, "documents").select("doc_id", distil.too_short(F.col("text"), F.col("text")).alias("error"))


@query("d10_validate", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'balance' END, CASE WHEN len(c_name) BETWEEN 1 AND 18 THEN NULL ELSE 'name' END, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE 'segment' END) AS errors FROM customer")
def d10(spark, d):
    checks = {"balance": F.col("c_acctbal") >= 0, "name": F.length("c_name").between(1, 18), "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    return store.validated(read(spark, d, "customer"), checks).select("c_custkey", F.array_join("errors", ",").alias("errors"))


# --- E: joins --------------------------------------------------------------------------------------


@query("e1_threshold", _HOT + " SELECT id, ll AS like_limit, sl AS save_limit FROM h")
def e1(spark, d):
    return feed.with_hotness(videos(spark, d), limits(spark)).select("id", "like_limit", "save_limit")


_KEYED = f"{RAW}, keyed AS (SELECT pos, nullif({s_url('url')}, '') AS u, nullif({s_title_key('title')}, '') AS t FROM raw)"


def keyed_items(spark, d):
    return raw_items(spark, d).select("pos", X.normalize_url(F.col("url")).alias("url_key"), X.title_key(F.col("title")).alias("title_key"))


@query("e2_incremental", f"WITH {_KEYED} SELECT n.pos AS pos FROM keyed n WHERE n.pos % 2 = 1 AND NOT EXISTS (SELECT 1 FROM keyed s WHERE s.pos % 2 = 0 AND s.u = n.u) AND NOT EXISTS (SELECT 1 FROM keyed s WHERE s.pos % 2 = 0 AND s.t = n.t)")
def e2(spark, d):
    k = keyed_items(spark, d)
    keys = {"url_key": F.col("url_key"), "title_key": F.col("title_key")}
    return dedup.not_stored(k.filter("pos % 2 = 1"), k.filter("pos % 2 = 0"), keys).select("pos")


@query("e3_video_new", f"WITH {VIDEOS} SELECT id FROM videos WHERE id % 2 = 1 AND id % 97 NOT IN (SELECT id % 97 FROM videos WHERE id % 2 = 0)")
def e3(spark, d):
    v = videos(spark, d).withColumn("url_key", X.video_url_key(F.col("original_url")))
    return dedup.not_stored(v.filter("id % 2 = 1"), v.filter("id % 2 = 0"), {"url_key": F.col("url_key")}).select("id")


@query("e4_creator_upsert", f"WITH {VIDEOS}, {CREATORS} SELECT DISTINCT creator AS name, true AS enabled FROM videos WHERE creator NOT IN (SELECT name FROM creators)")
def e4(spark, d):
    return feed.missing_creators(videos(spark, d), creators(spark, d)).select("name", "enabled")


@query("e5_backfill", f"""WITH {VIDEOS}, c AS (SELECT id % 97 AS k, arg_min(play_url, id) AS p FROM videos WHERE id % 2 = 0 AND play_url <> '' GROUP BY 1)
SELECT id, CASE WHEN play_url <> '' THEN play_url ELSE coalesce(p, '') END AS play_url FROM videos LEFT JOIN c ON id % 97 = k WHERE id % 2 = 1""")
def e5(spark, d):
    v = videos(spark, d)
    return feed.backfilled(v.filter("id % 2 = 1"), v.filter("id % 2 = 0"), "id").select("id", "play_url")


@query("e6_tasks", "SELECT o_orderkey AS task_id, CAST(o_orderkey % 30 AS INT) AS source_id, n_name AS name, CASE WHEN n_name IS NULL THEN NULL WHEN n_regionkey = 1 THEN 'note ' || n_nationkey ELSE 'collect ' || n_name END AS goal, CASE WHEN n_name IS NULL THEN 'unknown source' END AS error FROM orders LEFT JOIN nation ON o_orderkey % 30 = n_nationkey")
def e6(spark, d):
    n = read(spark, d, "nation")
    s = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("web").alias("type"), F.when(F.col("n_regionkey") == 1, F.concat(F.lit("note "), F.col("n_nationkey").cast("string"))).otherwise(" ").alias("note"))
    r = read(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 30).cast("int").alias("source_id"))
    return tasks.tasks_of(r, s).select("task_id", "source_id", "name", "goal", "error")


@query("e7_materials", f"""WITH t AS (SELECT n_nationkey, n_name, page_id AS task_id, CASE WHEN page_id % 7 = 0 THEN 'http://gone.example/' || page_id ELSE url END AS url FROM pages LEFT JOIN nation ON page_id % 25 = n_nationkey),
f AS (SELECT url, CASE WHEN {_TITLE} <> '' THEN {_TITLE} ELSE url END AS title, substr(array_to_string(list_transform({s_lines(_PAGE)}, lambda x: {s_unescape('x')}), chr(10)), 1, 12000) AS content FROM pages WHERE page_id IN (SELECT min(page_id) FROM pages GROUP BY url))
SELECT task_id, n_name AS source_name, CASE WHEN content <> '' THEN title END AS title, CASE WHEN content <> '' THEN substr(content, 1, 120) END AS summary,
 CASE WHEN content <> '' THEN 'done' ELSE 'failed' END AS status, CASE WHEN content IS NULL THEN 'not fetched' WHEN content = '' THEN 'no text' END AS error FROM t LEFT JOIN f USING (url)""")
def e7(spark, d):
    """Every seventh task asks for a page that isn't there."""
    pages, n = read(spark, d, "pages"), read(spark, d, "nation")
    sources = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("web").alias("type"), F.lit("").alias("note"))
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("http://gone.example/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    asked = pages.select(F.col("page_id").alias("task_id"), url.alias("url"), (F.col("page_id") % 25).cast("int").alias("source_id"))
    fetched = P.pages_as_material(dedup.first_per_group(pages, ["url"], [F.col("page_id")], 1))
    return tasks.materials_of(tasks.tasks_of(asked, sources), fetched).select("task_id", "source_name", "title", "summary", "status", "error")


PHRASES = {"views": ("theat", "schein", "ouvi", "doaz"), "style": ("trash", "clown", "License", "%%%"), "topics": ("the", "und", "les", "las")}


def _s_profile() -> str:
    cols = [f"concat_ws(',', {', '.join(f'''CASE WHEN bool_or(contains(text, '{p}')) THEN '{p}' END''' for p in ps)}) AS {n}" for n, ps in PHRASES.items()]
    return f"SELECT source, count(*) AS content_count, {', '.join(cols)} FROM documents GROUP BY source"


@query("e8_profile_join", """WITH c AS (SELECT source, text FROM documents), p AS (SELECT DISTINCT source AS name FROM documents UNION SELECT n_name FROM nation),
f AS (PROFILE) SELECT name, coalesce(content_count, 0) AS content_count, coalesce(views, '') AS views, coalesce(style, '') AS style, coalesce(topics, '') AS topics FROM p LEFT JOIN f ON source = name""".replace("PROFILE", _s_profile()))
def e8(spark, d):
    """Profiles are the sources of documents and all nations, which have no contents."""
    docs = read(spark, d, "documents")
    names = docs.select(F.col("source").alias("name")).distinct().union(read(spark, d, "nation").select("n_name"))
    return feed.profiled(names, docs, "name", "source", "text", PHRASES)


@query("e9_snapshot_diff", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type <> 'error')")
def e9(spark, d):
    e = read(spark, d, "events")
    return dedup.snapshot_diff(e.select("event_id"), e.filter("event_type != 'error'").select("event_id"), "event_id")


def _s_letters(a: str) -> str:
    return f"list_distinct(string_split({a}, ''))"


def _s_fold(parts: str, keep: str) -> str:
    """Goes over a list with what was taken so far: ``keep`` makes of a (taken) and x (the next, alone in a list) the new list."""
    return f"list_reduce(list_transform({parts}, lambda s: [s]), lambda a, x: {keep}, CAST([] AS VARCHAR[]))"


def _s_picked(ordered: str, limit: int, most: float) -> str:
    x, y = _s_letters("p"), _s_letters("x[1]")
    alike = f"len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct({x} || {y})) > {most}"
    return _s_fold(ordered, f"CASE WHEN len(a) < {limit} AND len(list_filter(a, lambda p: {alike})) = 0 THEN a || x ELSE a END")


def _s_evidence() -> str:
    """The points of g6 with their places; a sentence that occurs twice is at its best place, the first of equal scores."""
    x, y = "list_distinct(string_split(p.sentence, ''))", "list_distinct(string_split(f.sentence, ''))"
    return f"""{_SCORED}, b AS (SELECT doc_id, list(sentence ORDER BY score DESC, pos) AS b FROM scored GROUP BY doc_id),
k AS (SELECT doc_id, unnest({_s_picked('b', 5, 0.62)}) AS sentence FROM b), p AS (SELECT doc_id, sentence, arg_min(pos, (-score, pos)) AS pos FROM k JOIN scored USING (doc_id, sentence) GROUP BY doc_id, sentence),
f AS (SELECT * FROM sent WHERE regexp_matches(sentence, '{_DATA}|tion')),
m AS (SELECT p.doc_id, p.pos, min(f.pos) AS fact FROM p JOIN f USING (doc_id) WHERE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct({x} || {y})) > 0.12 GROUP BY ALL)
SELECT doc_id, pos, sentence, fact FROM p LEFT JOIN m USING (doc_id, pos)"""


@query("e11_evidence", _s_evidence())
def e11(spark, d):
    """The key points of every document, each with the first of its data sentences that is alike."""
    rows = dedup.written(doc_sentences(spark, d), "sentences")
    points = distil.key_points(doc_scores(spark, d, rows), "doc_id")
    facts = rows.filter(F.col("sentence").rlike(f"{_DATA}|tion"))
    return match.evidence(points, facts, "doc_id").select("doc_id", "pos", "sentence", "fact")


@query("e12_unique_names", "SELECT s_suppkey, s_name, lower(s_name) IN (SELECT lower(n_name) FROM nation) OR s_suppkey % 3 = 0 AS rejected FROM supplier")
def e12(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_name")
    taken = read(spark, d, "nation").select(F.lower("n_name").alias("k")).union(s.filter("s_suppkey % 3 = 0").select(F.lower("s_name"))).distinct().withColumn("hit", F.lit(True))
    return s.withColumn("k", F.lower(F.trim("s_name"))).join(taken, "k", "left").select("s_suppkey", "s_name", F.coalesce("hit", F.lit(False)).alias("rejected"))


# --- F: aggregates ------------------------------------------------------------------------------------


@query("f1_category_counts", f"WITH {RAW}, c AS (SELECT {_CAT} AS category FROM raw WHERE {s_relevant(_GATED)}) SELECT coalesce(category, 'all') AS category, count(*) AS n FROM c GROUP BY ROLLUP (category)")
def f1(spark, d):
    return gated_items(spark, d).rollup("category").agg(F.count("*").alias("n")).select(F.coalesce("category", F.lit("all")).alias("category"), "n")


@query("f2_kpi", "SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) AS total FROM orders")
def f2(spark, d):
    status = F.col("o_orderstatus")
    return feed.counted(read(spark, d, "orders"), {"open": status == "O", "done": status == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"})


_OUTCOMES = f"""{_HOT}, {CREATORS}, g AS (SELECT h.*, CASE WHEN NOT is_hot THEN 'not_hot' WHEN id % 97 IN (SELECT id % 97 FROM videos WHERE id % 5 = 0) THEN 'duplicate' WHEN NOT coalesce(enabled, true) THEN 'disabled'
 WHEN NOT (contains(title || ' ' || creator, '1') OR contains(title || ' ' || creator, '2') OR contains(title || ' ' || creator, '3')) THEN 'off_topic' ELSE 'created' END AS gate FROM h LEFT JOIN creators ON creator = name WHERE id % 5 <> 0),
o AS (SELECT id, CASE WHEN gate = 'created' AND id > min(id) FILTER (gate = 'created') OVER (PARTITION BY id % 97) THEN 'repeated' ELSE gate END AS outcome FROM g)"""


def run_outcomes(spark, d):
    v = videos(spark, d)
    return feed.outcomes(v.filter("id % 5 != 0"), limits(spark), v.filter("id % 5 = 0"), creators(spark, d), ("1", "2", "3"), "id")


@query("f3_outcomes", _OUTCOMES + " SELECT id, outcome FROM o")
def f3a(spark, d):
    return run_outcomes(spark, d).select("id", "outcome")


@query("f3_run_summary", _OUTCOMES + """, n AS (SELECT count(*) AS discovered, count(*) FILTER (outcome <> 'not_hot') AS hot_matched, count(*) FILTER (outcome IN ('duplicate', 'repeated')) AS duplicate_skipped, count(*) FILTER (outcome = 'created') AS created FROM o)
SELECT *, 0 AS scope_rejected, 'success' AS status, 'discovered ' || discovered || ', created ' || created || ', skipped ' || duplicate_skipped AS message FROM n""")
def f3(spark, d):
    return feed.run_summary(run_outcomes(spark, d))


@query("f4_profiles", _s_profile())
def f4(spark, d):
    return feed.profiles(read(spark, d, "documents"), "source", "text", PHRASES)


@query("f5_bigrams", f"WITH {_SENTENCES}, {_BIGRAMS} SELECT doc_id, token, n FROM grams")
def f5(spark, d):
    return distil.bigrams(doc_sentences(spark, d), "doc_id", "a-z")


@query("f7_dup_ratio", f"SELECT conv_id, turn, CASE WHEN len({_SENT.replace('trim(text)', 'text')}) >= 4 THEN round(1 - len(list_distinct({_SENT.replace('trim(text)', 'text')})) / len({_SENT.replace('trim(text)', 'text')})::DOUBLE, 6) ELSE 0.0 END AS ratio FROM conversations")
def f7(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.round(distil.duplicate_ratio(F.col("text")), 6).alias("ratio"))


def recomputed(spark, d):
    old = feed.with_hotness(videos(spark, d), limits(spark))
    lower = limits(spark).withColumn("likes", F.col("likes") - 2)
    return old, feed.with_hotness(videos(spark, d), lower)


_HOT2 = _HOT.replace("SELECT v.*, coalesce(like_limit, 0) AS ll", "SELECT v.*, likes >= coalesce(like_limit - 2, 0) OR saves >= coalesce(save_limit, 0) AS hot2, coalesce(like_limit, 0) AS ll")


@query("f8_recompute", _HOT2 + " SELECT count(*) FILTER (is_hot <> hot2) AS changed FROM h")
def f8(spark, d):
    old, new = recomputed(spark, d)
    return store.changed_rows(old, new, "id", ["is_hot"]).agg(F.count("*").alias("changed"))


@query("f9_exists", "SELECT page_id, contains(url, 'blog') AS known FROM pages")
def f9(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    return store.with_known(p, p.filter(F.col("url").contains("blog")), "url").select("page_id", "known")


@query("f10_rejects", "SELECT CASE WHEN len(text) < 50 THEN 'core too short' WHEN len(text) < 120 THEN 'too short' ELSE '' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def f10(spark, d):
    return d9(spark, d).groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("n"))


# --- G: order and picks ---------------------------------------------------------------------------------


def _s_rounds(n: int = 6) -> str:
    out, open_ = [], "keyed"
    for k in range(n):
        out.append(f"m{k} AS (SELECT pos, u, t, (u IS NULL OR pos = min(pos) OVER (PARTITION BY u)) AND (t IS NULL OR pos = min(pos) OVER (PARTITION BY t)) AS keep FROM {open_})")
        out.append(f"o{k} AS (SELECT pos, u, t FROM m{k} x WHERE NOT keep AND NOT EXISTS (SELECT 1 FROM m{k} y WHERE y.keep AND y.u = x.u) AND NOT EXISTS (SELECT 1 FROM m{k} y WHERE y.keep AND y.t = x.t))")
        open_ = f"o{k}"
    union = " UNION ALL ".join(f"SELECT pos FROM m{k} WHERE keep" for k in range(n))
    return f"WITH {_KEYED}, {', '.join(out)} {union}"


@query("g1_dedup", _s_rounds())
def g1(spark, d):
    return dedup.first_wins(keyed_items(spark, d), "pos", F.col("url_key"), F.col("title_key")).select("pos")


@query("g2_news_rank", f"WITH {RAW} SELECT pos, {s_relevance(ITEM)} AS score FROM raw ORDER BY score DESC, published_at IS NOT NULL DESC, published_at DESC, pos LIMIT 50")
def g2(spark, d):
    r = raw_items(spark, d).withColumn("score", X.relevance(item(), W.LATIN))
    return r.orderBy(F.col("score").desc(), F.col("published_at").isNotNull().desc(), F.col("published_at").desc(), "pos").limit(50).select("pos", "score")


@query("g3_video_rank", f"WITH {VIDEOS} SELECT id, CAST({_REC} AS BIGINT) AS score, CAST(row_number() OVER (ORDER BY {_REC} DESC, id DESC) AS INT) AS rank FROM videos ORDER BY rank LIMIT 20")
def g3(spark, d):
    v = videos(spark, d).withColumn("score", X.recommendation(F.col("likes"), F.col("saves"), F.col("published_at"), F.col("id") % 3 == 0, as_of()))
    top = v.orderBy(F.col("score").desc(), F.col("id").desc()).limit(20)
    rank = F.row_number().over(dedup.Window.orderBy(F.col("score").desc(), F.col("id").desc()))  # over 20 rows
    return top.select("id", "score", rank.alias("rank"))


_RANK = f"CASE {s_label(ITEM, W.LATIN_IMPORTANCE, 'plain')} WHEN 'top' THEN 3 WHEN 'high' THEN 2 ELSE 1 END"


@query("g4_sorts", f"""WITH {RAW}, r AS (SELECT pos, published_at, {_RANK} AS imp, {_UI} AS score FROM raw)
SELECT 'importance' AS mode, pos FROM (SELECT pos FROM r ORDER BY imp DESC, coalesce(epoch_us(published_at), 0) DESC, pos LIMIT 10) UNION ALL
SELECT 'published', pos FROM (SELECT pos FROM r ORDER BY coalesce(epoch_us(published_at), 0) DESC, pos LIMIT 10) UNION ALL
SELECT 'relevance', pos FROM (SELECT pos FROM r ORDER BY score DESC, coalesce(epoch_us(published_at), 0), pos LIMIT 10)""")
def g4(spark, d):
    t = item()
    score = X.count_hits(t, _UI_PLUS) * 12 - X.count_hits(t, _UI_MINUS) * 18 + F.when(X.label(t, W.LATIN_CATEGORIES, "other").isin("alpha", "beta"), 16).otherwise(0) + F.when(X.label(t, W.LATIN_IMPORTANCE, "plain") == "top", 4).otherwise(0)
    imp = X.label(t, W.LATIN_IMPORTANCE, "plain")
    r = raw_items(spark, d).select("pos", F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("at"), F.when(imp == "top", 3).when(imp == "high", 2).otherwise(1).alias("imp"), score.alias("score"))
    modes = {"importance": [F.col("imp").desc(), F.col("at").desc()], "published": [F.col("at").desc()], "relevance": [F.col("score").desc(), F.col("at")]}
    parts = [r.orderBy(*o, "pos").limit(10).select(F.lit(m).alias("mode"), "pos") for m, o in modes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("g5_first_n", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def g5(spark, d):
    return dedup.first_per_group(read(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 3).select("source", "doc_id")


def _s_pick(ordered: str, limit: int, most: float) -> str:
    return f"array_to_string({_s_picked(ordered, limit, most)}, '|')"


@query("g6_diverse_topk", f"{_SCORED}, b AS (SELECT doc_id, list(sentence ORDER BY score DESC, pos) AS b FROM scored GROUP BY doc_id) SELECT doc_id, {_s_pick('b', 5, 0.62)} AS points FROM b")
def g6(spark, d):
    rows = doc_scores(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "sentence"))).alias("_b"))
    return rows.select("doc_id", F.array_join(distil.pick(F.transform("_b", lambda x: x["sentence"]), 5, 0.62), "|").alias("points"))


@query("g7_key_data", f"WITH {_SENTENCES}, b AS (SELECT doc_id, list(sentence ORDER BY pos) AS b FROM sent WHERE regexp_matches(sentence, '{_DATA}') AND len(sentence) <= 90 GROUP BY doc_id) SELECT doc_id, {_s_pick('b', 6, 0.7)} AS key_data FROM b")
def g7(spark, d):
    rows = doc_sentences(spark, d).filter(F.col("sentence").rlike(_DATA) & (F.length("sentence") <= 90))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("_b"))
    return rows.select("doc_id", F.array_join(distil.pick(F.transform("_b", lambda x: x["sentence"]), 6, 0.7), "|").alias("key_data"))


@query("g8_panels", f"WITH {RAW}, {VIDEOS} SELECT * FROM (SELECT 'news' AS panel, pos AS id FROM raw ORDER BY published_at DESC NULLS LAST, pos DESC LIMIT 4) UNION ALL SELECT * FROM (SELECT 'video', id FROM videos ORDER BY likes DESC, id DESC LIMIT 4) UNION ALL SELECT * FROM (SELECT 'log', event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)")
def g8(spark, d):
    """Four news, four videos and the last five entries of the log."""
    log = read(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(5).select(F.lit("log").alias("panel"), F.col("event_id").alias("id"))
    news = raw_items(spark, d).orderBy(F.col("published_at").desc_nulls_last(), F.col("pos").desc()).limit(4).select(F.lit("news").alias("panel"), F.col("pos").alias("id"))
    return news.union(videos(spark, d).orderBy(F.col("likes").desc(), F.col("id").desc()).limit(4).select(F.lit("video"), "id")).union(log)


@query("g9_log_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def g9(spark, d):
    return read(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", "event_type")


# --- H: sets ------------------------------------------------------------------------------------------------


def five_adapters(spark, d):
    r = raw_items(spark, d).select("pos", "title")

    def unreachable():
        raise ConnectionError("no answer")

    torn = r.withColumn("title", F.when(F.col("pos") % 50 == 7, F.raise_error(F.lit("torn page"))).otherwise(F.col("title")).cast("string"))
    good = {str(k): (lambda k=k: r.filter(F.col("pos") % 3 == k)) for k in range(3)}
    return adapters.gathered(spark, {**good, "unreachable": unreachable, "torn": lambda: torn}, "pos long, title string")


@query("h1_union", f"WITH {RAW} SELECT 0 AS adapter, pos, title FROM raw WHERE pos % 3 = 0 UNION ALL SELECT 1, pos, title FROM raw WHERE pos % 3 = 1 UNION ALL SELECT 2, pos, title FROM raw WHERE pos % 3 = 2")
def h1(spark, d):
    """Three adapters' items; two more fail, one when it is called and one when its rows are made."""
    return five_adapters(spark, d)[0].select(F.col("adapter").cast("int").alias("adapter"), "pos", "title")


@query("h1_outcomes", f"WITH {RAW} SELECT CAST(pos % 3 AS VARCHAR) AS adapter, count(*) AS items, false AS failed FROM raw GROUP BY 1 UNION ALL SELECT 'unreachable', 0, true UNION ALL SELECT 'torn', 0, true")
def h1_outcomes(spark, d):
    """How many items each adapter gave, and which failed."""
    items, failures = five_adapters(spark, d)
    lost = spark.createDataFrame([(f.adapter, 0, True) for f in failures], "adapter string, items long, failed boolean")
    return items.groupBy("adapter").agg(F.count("*").alias("items"), F.lit(False).alias("failed")).union(lost)


@query("h2_distinct_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) SELECT doc_id, array_to_string(list_filter(x, lambda y, i: list_position(x, y) = i), chr(10)) AS text FROM l")
def h2(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n").alias("text"))


# --- I: text pipelines -----------------------------------------------------------------------------------------

_FILL = "|".join(_S.fillers)
_CLEAN = r"""regexp_replace(replace(regexp_replace(text, '#[\p{L}\p{N}_]+', ' ', 'g'), '#', ' '), 'a{2,}', 'a', 'g')"""
for _v in "eiou":
    _CLEAN = f"regexp_replace({_CLEAN}, '{_v}{{2,}}', '{_v}', 'g')"
_LINES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({_CLEAN}, '[{_S.ends}]', chr(10), 'g'), '({_FILL})', '', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '{_BLANKS}', ' ', 'g'), '^[ ，,；;：:　]+|[ ，,；;：:　]+$', '', 'g')), lambda x: x <> '')"


@query("i1_transcript", f"WITH l AS (SELECT conv_id, turn, {_LINES} AS x FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(x, lambda y, i: list_position(x, y) = i), chr(10)) AS text FROM l")
def i1(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", distil.clean_transcript(F.col("text"), _S).alias("text"))


@query("i2_sentences", f"WITH {_SENTENCES} SELECT doc_id, pos, sentence FROM sent")
def i2(spark, d):
    return doc_sentences(spark, d)


def scripts(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", distil.script_sentences(F.col("text"), _BREAKS).alias("s"))


#: All texts here have end marks, so the cut of unpunctuated ones, which SQL lacks, isn't met.
_SCRIPT = r"""list_filter(list_transform(regexp_split_to_array(text, '[。！？;.!?；\n]+'), lambda s: regexp_replace(regexp_replace(s, '\s+', '', 'g'), '^[ ，,；;：:　、]+|[ ，,；;：:　、]+$', '', 'g')), lambda s: len(s) >= 4)"""
_ALIKE = f"p = x[1] OR len(list_intersect({_s_letters('p')}, {_s_letters('x[1]')}))::DOUBLE / least(len({_s_letters('p')}), len({_s_letters('x[1]')})) > 0.8"


@query("i3_script_sentences", f"SELECT conv_id, turn, array_to_string({_SCRIPT}, '|') AS sentences FROM conversations")
def i3(spark, d):
    return scripts(spark, d).select("conv_id", "turn", F.array_join("s", "|").alias("sentences"))


def _s_merged(parts: str, least: int = 12) -> str:
    return _s_fold(parts, f"CASE WHEN len(a) > 0 AND len(x[1]) < {least} THEN a[1:len(a) - 1] || [a[len(a)] || x[1]] ELSE a || x END")


def s_unpunctuated(text: str, breaks: tuple[str, ...], chunk: int = 50) -> str:
    """Cut ahead of connectives; while a part is longer than ``chunk``, behind the last of the first particle that stands near, else there."""
    words = "|".join(sorted(breaks, key=len, reverse=True))
    parts = rf"list_filter(string_split(regexp_replace(regexp_replace({text}, '\s+', '', 'g'), '({words})', chr(1) || '\1', 'g'), chr(1)), lambda p: p <> '')"
    area = f"substr(a[len(a)], {chunk - 9}, 15)"
    k = " ".join(f"WHEN contains({area}, '{p}') THEN len({area}) - instr(reverse({area}), '{p}') + 1 + {chunk - 10}" for p in L.PARTICLES)
    k = f"CASE {k} ELSE {chunk} END"
    step = f"CASE WHEN len(a[len(a)]) > {chunk} THEN a[1:len(a) - 1] || [substr(a[len(a)], 1, {k}), substr(a[len(a)], {k} + 1)] ELSE a END"
    chopped = f"list_transform({parts}, lambda q: list_filter(list_reduce(list_transform(range(len(q) // {chunk // 2} + 1), lambda i: ['']), lambda a, x: {step}, [q]), lambda r: r <> ''))"
    return f"list_filter({_s_merged(f'flatten({chopped})', 6)}, lambda s: len(s) >= 4)"


_BREAKS = ("then", "thea", "und")


@query("i4_unpunctuated", rf"""SELECT conv_id, turn, array_to_string({s_unpunctuated("regexp_replace(text, '[.,;!?" + chr(10) + "]', ' ', 'g')", _BREAKS)}, '|') AS parts FROM conversations""")
def i4(spark, d):
    text = F.regexp_replace("text", "[.,;!?\n]", " ")
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(distil.unpunctuated(text, _BREAKS), "|").alias("parts"))


def _s_distinct(parts: str) -> str:
    return _s_fold(parts, f"CASE WHEN len(list_filter(a, lambda p: {_ALIKE})) > 0 THEN a ELSE a || x END")


def _s_paragraphs(parts: str) -> str:
    """A first sentence that waits for a second has a mark in front."""
    single = lambda s: f"CASE WHEN regexp_matches({s}, '[。！？!?;；]$') THEN {s} WHEN {s_any(s, L.QUESTIONS)} THEN {s} || '？' ELSE {s} || '。' END"
    both = "regexp_replace(substr(a[len(a)], 2) || '，' || x[1], '[，。、；：!?！？]+$', '') || '。'"
    folded = _s_fold(parts, f"CASE WHEN len(a) > 0 AND starts_with(a[len(a)], chr(1)) THEN a[1:len(a) - 1] || [{both}] WHEN len(x[1]) >= 90 THEN a || [{single('x[1]')}] ELSE a || [chr(1) || x[1]] END")
    return f"array_to_string(list_transform({folded}, lambda p: CASE WHEN starts_with(p, chr(1)) THEN {single('substr(p, 2)')} ELSE p END), chr(10) || chr(10))"


@query("i5_distinct_sentences", f"SELECT conv_id, turn, array_to_string({_s_distinct(_SCRIPT)}, '|') AS sentences FROM conversations")
def i5(spark, d):
    return scripts(spark, d).select("conv_id", "turn", F.array_join(distil.distinct_sentences(F.col("s")), "|").alias("sentences"))


@query("i6_merge_fragments", f"SELECT conv_id, turn, array_to_string({_s_merged(_SCRIPT)}, '|') AS sentences FROM conversations")
def i6(spark, d):
    return scripts(spark, d).select("conv_id", "turn", F.array_join(distil.merged(F.col("s")), "|").alias("sentences"))


@query("i7_paragraphs", f"SELECT conv_id, turn, {_s_paragraphs(_SCRIPT)} AS script FROM conversations")
def i7(spark, d):
    return scripts(spark, d).select("conv_id", "turn", distil.paragraphs(F.col("s")).alias("script"))


@query("i8_manuscript", f"SELECT conv_id, turn, {_s_paragraphs(_s_merged(_s_distinct(_SCRIPT)))} AS script FROM conversations")
def i8(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", distil.manuscript(F.col("text"), _S).alias("script"))


_TEXT_CLASS = rf"""CASE WHEN len({_T}) < 15 OR len(regexp_replace({_T}, '[^A-Za-z]', '', 'g')) < 3 THEN 'garbage' WHEN {s_any(f'lower({_T})', _S.markers)} THEN 'lyrics' WHEN NOT {s_any(_T, _S.domain)} AND regexp_replace({_T}, '\s+', '', 'g') <> '' AND {_LYRIC} THEN 'lyrics'
WHEN {_FLATT} <> '' AND core <> '' AND starts_with(core, {_FLATT}) AND len({_FLATT}) < 30 THEN 'title_only' WHEN len({_FLATT}) < 15 THEN 'title_only' WHEN len({_SENT}) >= 4 AND 1 - len(list_distinct({_SENT})) / len({_SENT})::DOUBLE >= 0.4 THEN 'lyrics' ELSE 'valid' END"""
_ANY_SCRIPT = f"CASE WHEN len({_SCRIPT}) <= 1 AND len(text) > 20 AND NOT regexp_matches(text, '[。！？.!?]') THEN {s_unpunctuated('text', _S.breaks)} ELSE {_SCRIPT} END"


@query("i9_transcript_job", rf"""WITH l AS (SELECT conv_id, turn, regexp_replace(substr(text, 1, 20), '#[\p{{L}}\p{{N}}_]+|#|\s+', '', 'g') AS core, {_LINES} AS x FROM conversations),
t AS (SELECT conv_id, turn, core, array_to_string(list_filter(x, lambda y, i: list_position(x, y) = i), chr(10)) AS text FROM l), o AS (SELECT *, {_TEXT_CLASS} AS outcome, {_ANY_SCRIPT} AS parts FROM t)
SELECT conv_id, turn, outcome, CASE WHEN outcome = 'valid' THEN {_s_paragraphs(_s_merged(_s_distinct('parts')))} ELSE '' END AS manuscript FROM o""")
def i9(spark, d):
    c = read(spark, d, "conversations").withColumn("title", F.substring("text", 1, 20))
    return distil.transcript_job(c, "title", "text", _S).select("conv_id", "turn", "outcome", "manuscript")


_TITLE_KEPT = r"""regexp_replace(regexp_replace(trim(regexp_replace(title, '[|｜_–—]\s*[^|｜]*$', '')), '^[【\[（(][^】\])）]{0,10}[】\])）]\s*', ''), '[，。；：、:]+$', '')"""
_PROMOTED = ("License", "@mail")


def s_tidy(ordered: str, limit: int) -> str:
    return f"array_to_string(list_transform({_s_picked(ordered, limit, 0.7)}, lambda s: regexp_replace(s, '[，。；：]+$', '')), '|')"


@query("i10_distil", rf"""WITH base AS (SELECT * FROM (SELECT doc_id, {s_less_noise((), L.CHAPTERS)} AS text FROM documents) WHERE len(text) >= 50), {s_sentences('base').replace('sent AS', 'cut AS', 1)},
sent AS (SELECT * FROM cut WHERE NOT regexp_matches(sentence, '{'|'.join(_PROMOTED)}')), {_SCORES},
b AS (SELECT doc_id, list(sentence ORDER BY score DESC, pos) AS best, list(sentence ORDER BY pos) AS every FROM scored GROUP BY doc_id),
t AS (SELECT doc_id, {_TITLE_KEPT} AS title FROM (SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 60) AS title FROM documents)),
p AS (SELECT doc_id, CASE WHEN len(title) >= 8 THEN title ELSE regexp_replace(substr(best[1], 1, 60), '[，。；：、]+$', '') END AS thesis, {_s_pick('best', 5, 0.62)} AS key_points,
 {s_tidy(f"list_filter(every, lambda s: regexp_matches(s, '{_DATA}') AND len(s) <= 90)", 6)} AS key_data, {s_tidy("list_filter(every, lambda s: regexp_matches(s, 'thea|que') AND len(s) BETWEEN 15 AND 120)", 3)} AS cases FROM t JOIN b USING (doc_id))
SELECT doc_id, coalesce(thesis, '') AS thesis, coalesce(key_points, '') AS key_points, coalesce(key_data, '') AS key_data, coalesce(cases, '') AS cases FROM documents LEFT JOIN p USING (doc_id)""")
def i10(spark, d):
    docs = read(spark, d, "documents").withColumn("title", F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60))
    out = distil.distilled(docs, "doc_id", "title", "text", _DOMAIN, "a-z", _DATA, "thea|que", _PROMOTED, ())
    return out.select("doc_id", "thesis", *[F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|").alias(c) for c in ("key_points", "key_data", "cases")])


# --- J: streaming ----------------------------------------------------------------------------------------------


@query("j1_stream_news", _s_rounds())
def j1(spark, d):
    """Documents as a stream of files into a stored table, run to the end of what is there."""
    from inkwell.streaming.collect import collect_news, stored_news

    items = dedup.written(keyed_items(spark, d), "incoming")
    base = dedup.shared_path(items, "stream")
    keyed_items(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(items.schema).parquet(f"{base}/in")
    q = collect_news(stream.withColumnsRenamed({"url_key": "u", "title_key": "t"}), f"{base}/news", f"{base}/log", f"{base}/checkpoint", lambda: (F.col("u"), F.col("t")), lambda: F.lit(True))
    q.awaitTermination()
    return stored_news(spark, f"{base}/news", "pos bigint, u string, t string, url_key string, title_key string, batch bigint").select("pos")


# --- K: maintenance ----------------------------------------------------------------------------------------------


@query("k1_recompute", _HOT2 + " SELECT id, hot2 AS is_hot FROM h WHERE is_hot <> hot2")
def k1(spark, d):
    old, new = recomputed(spark, d)
    return store.changed_rows(old, new, "id", ["is_hot"]).select("id", "is_hot")


@query("k2_delete", "SELECT o_orderkey FROM orders WHERE NOT starts_with(o_orderpriority, '1') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def k2(spark, d):
    bad = read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.deleted(read(spark, d, "orders"), F.col("o_orderpriority").startswith("1"), bad, "o_custkey").select("o_orderkey")


@query("k3_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def k3(spark, d):
    return store.updated(read(spark, d, "customer"), F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("DEBT")}).select("c_custkey", "c_mktsegment")


@query("k4_add_column", "SELECT n_nationkey, n_name, 'none' AS note FROM nation")
def k4(spark, d):
    return store.with_default(read(spark, d, "nation"), "note", F.lit("none")).select("n_nationkey", "n_name", "note")


# --- Flagship ------------------------------------------------------------------------------------------------------


@query("best_pages", f"""WITH p AS (SELECT page_id, CASE WHEN {_TITLE} <> '' THEN {_TITLE} ELSE url END AS title, {s_url('url')} AS url_key, substr(array_to_string(list_transform({s_lines(_PAGE)}, lambda x: {s_unescape('x')}), chr(10)), 1, 12000) AS content FROM pages)
SELECT page_id, url_key, {s_title_key('title')} AS title_key, {s_relevance("title || ' ' || content")} AS score FROM p WHERE {s_relevant("title || ' ' || content")} ORDER BY score DESC, page_id LIMIT 20""")
def best_pages(spark, d):
    p = P.pages_as_material(read(spark, d, "pages"))
    t = F.concat_ws(" ", "title", "content")
    p = p.filter(X.is_relevant(t, W.LATIN)).withColumn("score", X.relevance(t, W.LATIN)).orderBy(F.col("score").desc(), "page_id").limit(20)
    return p.select("page_id", X.normalize_url(F.col("url")).alias("url_key"), X.title_key(F.col("title")).alias("title_key"), "score")
