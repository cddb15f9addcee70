"""Queries over forms that collectors meet: feeds, articles, images, tables, payloads, snapshots, streams.

The given tables hold none of these, so Spark writes each row of one as the form it would have
arrived in; the operator reads it back, and the SQL gives what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators import dedup, distil, store
from inkwell.plans import catalog as C
from inkwell.sources import pages as P
from inkwell.sources import payloads as J
from inkwell.streaming import collect, cycles

query, read = C.query, C.read


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def spread(rows: DataFrame) -> DataFrame:
    """Short rows from which much is made, dealt to all cores: a file of few bytes would be one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


# --- Pages ------------------------------------------------------------------------------------


@query("a3_feed_items", """WITH i AS (SELECT c_custkey, c_name, c_mktsegment, unnest(range(1 + c_custkey % 7)) AS k FROM customer)
SELECT c_custkey, CAST(k AS INT) AS pos, c_name || ' & part ' || k AS title, 'http://x.org/' || c_custkey || '/' || k AS link, lower(c_mktsegment) AS summary FROM i WHERE k < 5""")
def a3(spark, d):
    """One to seven entries a customer, in RSS for even keys and Atom for odd ones."""
    c, even = spread(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")), F.col("c_custkey") % 2 == 0

    def entry(k: Column) -> Column:
        title, link, text = joined(F.col("c_name"), " &amp; part ", k), joined("http://x.org/", F.col("c_custkey"), "/", k), F.lower("c_mktsegment")
        rss = joined("<item><title>", title, "</title><link>", link, "</link><description><![CDATA[<b>", text, "</b>]]></description></item>")
        return F.when(even, rss).otherwise(joined("<a:entry><a:title type='html'>", title, "</a:title><a:link rel='x' href='", link, "'/><a:summary>", text, "</a:summary></a:entry>"))

    body = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 7).cast("int")), entry), "\n")
    feeds = c.select("c_custkey", joined("<?xml version='1.0'?><feed><title>all</title>", body, "</feed>").alias("body"))
    return P.feed_items(feeds, "c_custkey", "body")


@query("a6_article_fields", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Plain ' || o_orderkey ELSE 'Order & ' || o_orderkey END AS title, 'c' || o_custkey AS account, o_orderstatus AS author,
 CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS published_at, o_orderpriority || chr(10) || 'total < ' || o_custkey AS content FROM orders""")
def a6(spark, d):
    k = F.col("o_orderkey")
    title = F.when(k % 4 != 0, joined('var msg_title = "Order &amp; ', k, '";')).otherwise("")
    stamp = F.when(k % 5 != 0, joined("var ct = '", F.unix_timestamp("o_orderdate"), "';")).otherwise("")
    script = joined("<script>", title, " var nickname = 'c", F.col("o_custkey"), "'; var author = \"", F.col("o_orderstatus"), '"; ', stamp, "</script>")
    body = joined("<div id='js_content'><p>", F.col("o_orderpriority"), "</p><!-- x --><p>total &lt; ", F.col("o_custkey"), "</p></div>")
    pages = read(spark, d, "orders").select(k, joined("<html><title>Plain ", k, "</title><body>side", script, body, "</body></html>").alias("html"))
    return P.article_fields(pages).select("o_orderkey", "title", "account", "author", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "content")


@query("a7_image_refs", """WITH i AS (SELECT p_partkey, unnest(['http://i.org/' || p_partkey, 'http://i.org/' || p_size]) AS src, unnest([1, 2]) AS pos, unnest([p_name, '']) AS alt FROM part)
SELECT p_partkey, CAST(min(pos) AS INT) AS pos, src, arg_min(alt, pos) AS alt FROM i GROUP BY p_partkey, src""")
def a7(spark, d):
    p = read(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    html = joined("<img src='data:image/png;base64,xx'><p><img class=a data-src='http://i.org/", key, "' src='lazy.gif' alt='", F.col("p_name"), "'/></p><img  src=\"http://i.org/", size, '"><IMG src=\'http://i.org/', size, "' alt='again'>")
    return P.image_refs(p.select("p_partkey", html.alias("html")), "p_partkey", "html").select("p_partkey", "pos", "src", "alt")


def plan_tables(spark, d) -> DataFrame:
    """A page a customer, with its orders as a table; every third has a heading table ahead."""
    row = joined("<tr><td>", F.col("o_orderstatus"), "</td><td> <b>", F.col("o_orderpriority"), "</b> </td><td>about ", F.col("o_shippriority_or_key"), " places</td></tr>")
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 50).alias("o_shippriority_or_key"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]), "")
    table = joined("<table class='t'><tr><th>School name</th><th>Subject</th><th>Planned number</th></tr>", rows, "</table>")
    lead = F.when(F.col("o_custkey") % 3 == 0, "<table><tr><td>only &amp; head</td></tr></table>").otherwise("")
    return o.groupBy("o_custkey").agg(table.alias("_t")).select("o_custkey", joined(lead, "<p>x</p>", F.col("_t")).alias("html"))


@query("a8_page_tables", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), f AS (SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS n FROM orders)
SELECT o_custkey, CAST(0 AS INT) AS table_no, CAST(0 AS INT) AS row_no, 'only & head' AS cells FROM f WHERE n = 1
UNION ALL SELECT o_custkey, n, 0, 'School name|Subject|Planned number' FROM f
UNION ALL SELECT o_custkey, n, CAST(k AS INT), o_orderstatus || '|' || o_orderpriority || '|about ' || o_orderkey % 50 || ' places' FROM o JOIN f USING (o_custkey)""")
def a8(spark, d):
    return P.page_tables(plan_tables(spark, d), "o_custkey", "html").withColumn("cells", F.array_join("cells", "|"))


@query("f6_table_stats", """SELECT o_custkey, CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS table_no, count(*) AS n_rows, count(DISTINCT o_orderstatus) AS n_names, count(DISTINCT o_orderpriority) AS n_groups, CAST(sum(o_orderkey % 50) AS BIGINT) AS total FROM orders GROUP BY o_custkey""")
def f6(spark, d):
    tables = P.page_tables(plan_tables(spark, d), "o_custkey", "html")
    return P.table_stats(tables, "o_custkey", ("name", "School"), ("Subject",), ("number", "Planned"))


# --- Payloads ------------------------------------------------------------------------------------


@query("a11_transcript_pick", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'said ' || user_id WHEN event_id % 3 = 0 THEN 'caption ' || event_type WHEN event_id % 2 = 0 THEN 'video ' || user_id ELSE '' END AS transcript,
 CASE WHEN event_id % 5 = 0 THEN 'speech' ELSE CASE WHEN event_id % 3 = 0 THEN 'caption' WHEN event_id % 2 = 0 THEN 'video text' ELSE 'none' END || CASE WHEN event_id % 7 = 0 THEN '; speech failed: the download broke' ELSE '' END END AS transcript_source FROM events""")
def a11(spark, d):
    """Hashtags alone are no text; a soft failure isn't told."""
    n = F.col("event_id")
    rows = read(spark, d, "events").select(
        n, F.when(n % 5 == 0, joined("said ", F.col("user_id"))).otherwise("#tag #x").alias("speech_text"), F.when(n % 3 == 0, joined("caption ", F.col("event_type"))).alias("caption"),
        F.when(n % 2 == 0, joined("video ", F.col("user_id"))).otherwise(" # ").alias("video_text"), F.when(n % 7 == 0, "the download broke").when(n % 4 == 0, "slow").alias("speech_error"),
    )
    return J.picked_transcript(rows).select("event_id", "transcript", "transcript_source")


@query("a12_recognition", """SELECT conv_id, turn, turn % 3 <> 2 AS good, CASE WHEN turn % 2 = 0 THEN text ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) END AS text FROM conversations WHERE length(text) > 0""")
def a12(spark, d):
    """A direct text for even turns, utterances for odd ones; two of three results succeeded."""
    c, t = read(spark, d, "conversations").filter("length(text) > 0"), F.col("turn")
    code = F.when(t % 3 == 0, "1000").when(t % 3 == 1, "Success").otherwise("500")
    parts = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("text")))
    payload = F.when(t % 2 == 0, F.to_json(F.struct(code.alias("code"), F.struct(F.col("text").alias("text")).alias("result")))).otherwise(F.to_json(F.struct(code.alias("status"), F.struct(parts.alias("utterances")).alias("data"))))
    good, text = J.recognized("payload")
    return c.select("conv_id", "turn", payload.alias("payload")).select("conv_id", "turn", good.alias("good"), text.alias("text"))


@query("a13_search_hits", """SELECT page_id, CAST(0 AS INT) AS pos, 'page ' || page_id AS title, url, CASE WHEN page_id % 2 = 0 THEN 'own' ELSE 'web' END AS source_name, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'short' END AS summary FROM pages
UNION ALL SELECT page_id, 2, 'second "quoted"', url || '#2', 'web', 'x' FROM pages""")
def a13(spark, d):
    """Three hits a page; the one without title goes."""
    k = F.col("page_id")

    def hit(title: Column, url: Column, source: Column, summary: Column) -> Column:
        return F.struct(title.alias("title"), url.alias("url"), source.alias("source"), summary.alias("summary"), F.lit("2024-01-01").alias("datetime"))

    text = lambda v: F.lit(v).cast("string")
    first = hit(joined(" page ", k, " "), F.col("url"), F.when(k % 2 == 0, " own "), F.when(k % 3 != 0, "short"))
    hits = F.array(first, hit(text(" "), F.col("url"), text(None), text("gone")), hit(text('second "quoted"'), joined(F.col("url"), "#2"), text(""), text("x")))
    return J.search_hits(read(spark, d, "pages").select(k, F.to_json(F.struct(hits.alias("articles"))).alias("payload")), "page_id", "payload")


@query("b22_media_url", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'http://a.org/' || event_id WHEN event_id % 3 = 1 THEN 'https://b.org/' || user_id ELSE '' END AS url FROM events""")
def b22(spark, d):
    n = F.col("event_id")
    first = F.when(n % 3 == 0, F.array(F.lit("cdn/x"), joined("http://a.org/", n), F.lit("http://later"))).otherwise(F.array(F.lit("ftp://y")))
    second = F.when(n % 3 != 2, F.array(joined("https://b.org/", F.col("user_id"))))
    video = F.struct(F.struct(first.alias("url_list")).alias("play_addr"), F.struct(second.alias("url_list")).alias("download_addr"))
    return read(spark, d, "events").select("event_id", F.to_json(F.struct(video.alias("video"))).alias("item")).select("event_id", J.media_url("item").alias("url"))


@query("b21_clean_title", """SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' of ' || lower(c_mktsegment) ELSE '' END AS title FROM customer""")
def b21(spark, d):
    tail = F.when(F.col("c_custkey") % 2 == 0, joined(" of ", F.lower("c_mktsegment"), "，")).otherwise(" — Site of the firm")
    return read(spark, d, "customer").select("c_custkey", distil.clean_title(joined("【", F.col("c_nationkey"), "】", F.col("c_name"), tail)).alias("title"))


# --- Snapshots and streams ---------------------------------------------------------------------------


@query("a16_snapshot", "SELECT 'orders' AS entity, o_orderkey AS id, o_orderstatus AS text FROM orders UNION ALL SELECT 'suppliers', s_suppkey, s_name FROM supplier")
def a16(spark, d):
    """Two tables written as a snapshot and read back."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("text"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("text"))
    store.export_snapshot({"orders": o, "suppliers": s}, path := dedup.shared_path(o, "snapshot"), "2024-02-01")
    back = store.import_snapshot(spark, path, dict.fromkeys(("orders", "suppliers"), "id long, text string"))
    return back["orders"].select(F.lit("orders").alias("entity"), "id", "text").union(back["suppliers"].select(F.lit("suppliers"), "id", "text"))


VIDEO = "pos bigint, title string, creator string, platform string, scope string, original_url string, play_url string, likes bigint, saves bigint"


def video_stream(spark, d):
    """Videos in two batches: those of ids that 5 divides first, then the others. Returns the table's path."""
    v = C.videos(spark, d).select(F.col("id").alias("pos"), "title", "creator", "platform", "scope", "original_url", "play_url", "likes", "saves")
    v = dedup.written(v, "videos")
    base = dedup.shared_path(v, "stream")
    for n in (v.filter("pos % 5 = 0"), v.filter("pos % 5 != 0")):
        n.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(VIDEO).parquet(f"{base}/in")
        q = collect.collect_videos(stream, f"{base}/videos", f"{base}/log", f"{base}/checkpoint", C.limits(spark), lambda: C.creators(spark, d), ("1", "2", "3"))
        q.awaitTermination()
    return f"{base}/videos"


_GATES = f"""{C._HOT}, {C.CREATORS}, g AS (SELECT h.*, id % 97 AS k, coalesce(enabled, true) AS enabled, contains(title || ' ' || creator, '1') OR contains(title || ' ' || creator, '2') OR contains(title || ' ' || creator, '3') AS topic FROM h LEFT JOIN creators ON creator = name),
a AS (SELECT * FROM g WHERE id % 5 = 0 AND is_hot AND enabled AND topic QUALIFY id = min(id) OVER (PARTITION BY k)),
b AS (SELECT * FROM g WHERE id % 5 <> 0 AND is_hot AND enabled AND topic AND k NOT IN (SELECT k FROM a) QUALIFY id = min(id) OVER (PARTITION BY k)),
new AS (SELECT *, 0 AS batch FROM a UNION ALL SELECT *, 1 FROM b)"""


@query("j2_stream_videos", _GATES + """, late AS (SELECT k, play_url, 0 AS batch, id FROM g WHERE id % 5 = 0 AND is_hot AND enabled AND topic AND id NOT IN (SELECT id FROM new) AND play_url <> ''
 UNION ALL SELECT k, play_url, 1, id FROM g WHERE id % 5 <> 0 AND is_hot AND (k IN (SELECT k FROM a) OR enabled AND topic AND id NOT IN (SELECT id FROM new)) AND play_url <> ''),
first AS (SELECT k, arg_min(play_url, batch * 1000000000 + id) AS late FROM late GROUP BY k)
SELECT new.id AS pos, CAST(new.batch AS BIGINT) AS batch, CASE WHEN play_url <> '' THEN 'own' WHEN late IS NOT NULL THEN 'filled' ELSE 'none' END AS play FROM new LEFT JOIN first USING (k)""")
def j2(spark, d):
    """Created videos, their batch, and whether their play URL is their own or came with a later candidate."""
    own = C.videos(spark, d).select(F.col("id").alias("pos"), F.col("play_url").alias("_own"))
    stored = collect.stored_videos(spark, video_stream(spark, d), VIDEO).join(own, "pos")
    play = F.when(F.col("_own") != "", "own").when(F.col("play_url") != "", "filled").otherwise("none")
    return stored.select("pos", F.col("batch").cast("long").alias("batch"), play.alias("play"))


@query("j2_stream_creators", _GATES + """, met AS (SELECT creator, id, platform, scope, 0 AS batch FROM g WHERE id % 5 = 0 AND is_hot AND enabled AND (NOT topic OR id IN (SELECT id FROM new))
 UNION ALL SELECT creator, id, platform, scope, 1 FROM g WHERE id % 5 <> 0 AND is_hot AND enabled AND k NOT IN (SELECT k FROM a) AND (NOT topic OR id IN (SELECT id FROM new)))
SELECT creator AS name, arg_min(platform, batch * 1000000000 + id) AS platform, arg_min(scope, batch * 1000000000 + id) AS scope, CAST(min(batch) AS BIGINT) AS batch FROM met WHERE creator NOT IN (SELECT name FROM creators) GROUP BY creator""")
def j2b(spark, d):
    """Creators that nobody knew, stored with the batch that brought them."""
    found = collect.stored_creators(spark, f"{video_stream(spark, d)}-creators")
    return found.select("name", "platform", "scope", F.col("batch").cast("long").alias("batch"))


@query("j3_rerun", C.ORACLES["g1_dedup"])
def j3(spark, d):
    """The stream of j1, run again over the same files: nothing is added."""
    items = dedup.written(C.keyed_items(spark, d), "incoming")
    base = dedup.shared_path(items, "stream")
    items.write.parquet(f"{base}/in")
    for _ in range(2):
        stream = spark.readStream.schema(items.schema).parquet(f"{base}/in").withColumnsRenamed({"url_key": "u", "title_key": "t"})
        collect.collect_news(stream, f"{base}/news", f"{base}/log", f"{base}/checkpoint", lambda: (F.col("u"), F.col("t")), lambda: F.lit(True)).awaitTermination()
    return collect.stored_news(spark, f"{base}/news", "pos bigint, u string, t string, url_key string, title_key string, batch bigint").select("pos")


@query("j4_arrived", _GATES + " SELECT id AS pos FROM b")
def j4(spark, d):
    """Videos of the last batch, which may have brought none."""
    path = video_stream(spark, d)
    return collect.arrived(collect.stored_videos(spark, path, VIDEO), runs=cycles.run_log(spark, f"{path.removesuffix('videos')}log")).select("pos")


@query("f3_stream_log", _GATES + """ SELECT CAST(batch AS BIGINT) AS batch, created, discovered FROM (SELECT 0 AS batch, (SELECT count(*) FROM a) AS created, count(*) AS discovered FROM g WHERE id % 5 = 0 UNION ALL SELECT 1, (SELECT count(*) FROM b), count(*) FROM g WHERE id % 5 <> 0)""")
def f3c(spark, d):
    """The run log of both batches."""
    path = video_stream(spark, d).removesuffix("videos") + "log"
    return spark.read.parquet(path).select(F.col("batch").cast("long").alias("batch"), "created", "discovered")
