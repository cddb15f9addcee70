"""Small hand-made cases of the engine's rules, most of them on Chinese content."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkwell.functions import lexicon as L
from inkwell.functions import text as X
from inkwell.operators import dedup, distil, feed, match, store, substrings
from inkwell.plans import catalog
from inkwell.sources import pages as P
from inkwell.sources import payloads as J


def values(spark, column, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.select(column(F.col("t")).alias("v"), "k").orderBy("k").collect()]


def test_title_keys(spark):
    a, b, c, d = values(spark, X.title_key, "【2024年 高考招生政策5", "2024年高考招生政策", "· Hello  World 更多", None)
    assert a == b == "2024年高考招生政策" and c == "helloworld" and d is None


def test_urls(spark):
    got = values(spark, X.normalize_url, " HTTP://Ex.Org:80/a/b//;p=1?q=1#f ", "http://ex.org", "http://ex.org/?", "")
    assert got == ["http://ex.org:80/a/b?q=1", "http://ex.org", "http://ex.org", "://"]
    keys = values(spark, X.video_url_key, "https://d.com/share/video/77/?x=1", "https://d.com/note/77", "https://d.com/u/?y=2")
    assert keys == ["douyin:77", "douyin:77", "https://d.com/u"]


def test_dates(spark):
    got = values(spark, lambda t: X.extract_date(t, F.lit(2024)), "发布于2023年5月6日", "更新 3.5", "2023-13-40 又 2-29", "无")
    assert got == [datetime(2023, 5, 6), datetime(2024, 3, 5), None if got[2] is None else got[2], None]


def test_relevance(spark):
    texts = ("江苏高考志愿填报与强基计划招生简章", "学校食堂供餐安排", "消防安全演练培训会", "高校招生录取分数线")
    assert values(spark, X.is_relevant, *texts) == [True, False, False, True]
    scores = values(spark, X.relevance, *texts)
    assert scores[0] > 30 and scores[1] < 0 and scores[2] < 0
    assert values(spark, lambda t: X.label(t, L.IMPORTANCE, L.OTHER_IMPORTANCE), "关于学区调整的说明", "校园开放日", "新闻") == ["重大", "重要", "普通"]
    assert values(spark, lambda t: X.label(t, L.CATEGORIES, L.OTHER_CATEGORY), "小升初与中考", "中考成绩", "其他") == ["小升初", "初升高", "媒体"]


def test_discovery_scope(spark):
    assert values(spark, X.in_scope, "高考志愿 老师", "中考 高考", "做饭") == [True, False, False]


def walk(rows):
    urls, titles, kept = set(), set(), []
    for pos, u, t in sorted(rows):
        if (u and u in urls) or (t and t in titles):
            continue
        kept.append(pos)
        urls |= {u} - {None, ""}
        titles |= {t} - {None, ""}
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_first_wins_is_the_walk(spark, seed):
    rng = random.Random(seed)
    one = lambda p, n: rng.choice([None, "", *[f"{p}{i}" for i in range(n)]])
    rows = [(i, one("u", 40), one("t", 40)) for i in range(150)]
    rows += [(200 + i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(12)]  # a chain of conflicts
    df = spark.createDataFrame(rows, "pos int, u string, t string")
    got = sorted(r[0] for r in dedup.first_wins(df, "pos", F.col("u"), F.col("t")).collect())
    assert got == walk(rows)
    assert dedup.first_wins(df.limit(0), "pos", F.col("u"), F.col("t")).count() == 0


def test_dropped_rows_take_nothing(spark):
    df = spark.createDataFrame([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u3", "t2")], "pos int, u string, t string")
    assert sorted(r[0] for r in dedup.first_wins(df, "pos", F.col("u"), F.col("t")).collect()) == [1, 3]


def test_not_stored_ignores_empty_keys(spark):
    new = spark.createDataFrame([(1, "", "a"), (2, "x", "b"), (3, None, "c"), (4, "y", "")], "id int, u string, t string")
    old = spark.createDataFrame([("", ""), ("x", "z"), (None, "c")], "u string, t string")
    assert sorted(r.id for r in dedup.not_stored(new, old, {"u": F.col("u"), "t": F.col("t")}).collect()) == [1, 4]


def test_thresholds_and_hotness(spark):
    config = spark.createDataFrame([("抖音", "常州本地", "-5", "x")], "platform string, scope string, likes string, saves string")
    got = {(r.platform, r.scope): (r.likes, r.saves) for r in feed.complete_thresholds(config).collect()}
    assert len(got) == 4 and got["抖音", "常州本地"] == (0, 50) and got["微信视频号", "常州本地"] == (50, 18)
    videos = spark.createDataFrame([("微信视频号", "常州本地", 51, 10), ("抖音", "全国大博主", 10, 10), ("别处", "x", 0, 0)], "platform string, scope string, likes int, saves int")
    limits = spark.createDataFrame([tuple(t) for t in L.THRESHOLDS], "platform string, scope string, likes int, saves int")
    assert {r.platform: r.is_hot for r in feed.with_hotness(videos, limits).collect()} == {"微信视频号": True, "抖音": False, "别处": True}


def test_outcomes_and_rerun(spark):
    limits = spark.createDataFrame([("a", "b", 100, 100)], "platform string, scope string, likes int, saves int")
    cols = "pos int, title string, creator string, platform string, scope string, original_url string, play_url string, likes int, saves int"
    rows = [(1, "高考", "m", "a", "b", "https://d/video/1?x", "", 200, 0), (2, "高考", "m", "a", "b", "https://d/video/1?y", "p", 200, 0), (3, "高考", "m", "a", "b", "https://d/video/2", "", 10, 0), (4, "做饭", "m", "a", "b", "https://d/video/3", "", 200, 0), (5, "高考", "off", "a", "b", "https://d/video/4", "", 200, 0)]
    c = spark.createDataFrame(rows, cols)
    creators = spark.createDataFrame([("off", ["高考"], False)], "name string, keywords array<string>, enabled boolean")
    first = feed.outcomes(c, limits, c.limit(0), creators)
    assert {r.pos: r.outcome for r in first.collect()} == {1: "created", 2: "repeated", 3: "not_hot", 4: "off_topic", 5: "disabled"}
    again = feed.outcomes(c, limits, first.filter("outcome = 'created'").select("original_url"), creators)
    assert feed.run_summary(again).first()["created"] == 0
    stored = c.filter("pos = 1")
    assert feed.backfilled(stored, c.filter("pos = 2")).first()["play_url"] == "p"


def test_pages_and_feeds(spark):
    page = "<html><title> A &amp; B </title><script>var x='<p>no</p>'</script><body><p>one  two</p><div>three</div></body></html>"
    r = P.pages_as_material(spark.createDataFrame([("http://e/", page), ("http://f/", "<script>x</script>")], "url string, html string")).collect()
    assert (r[0].title, r[0].content, r[0].error) == ("A & B", "one two\nthree", None) and r[1].error == "no text" and r[1].title == "http://f/"
    rss = "<?xml version='1.0'?><rss><channel><title>t</title>" + "".join(f"<item><title>T{i}</title><link>http://l/{i}</link><description><![CDATA[<b>d{i}</b>]]></description></item>" for i in range(7)) + "</channel></rss>"
    atom = "<feed xmlns='a'><entry><title>E</title><link href='http://a/1'/><summary>S</summary></entry></feed>"
    got = P.feed_items(spark.createDataFrame([(1, rss), (2, atom), (3, "<rss")], "id int, body string"), "id", "body").orderBy("id", "pos").collect()
    assert len(got) == 6 and (got[0].title, got[0].link, got[0].summary) == ("T0", "http://l/0", "d0") and (got[5].title, got[5].link, got[5].summary) == ("E", "http://a/1", "S")


def test_tables_images_articles(spark):
    html = "<table><tr><th>院校名称</th><th>专业</th><th>计划数</th></tr><tr><td>甲</td><td>数学</td><td>12人</td></tr><tr><td>甲</td><td>物理</td><td>x</td></tr></table><img src='data:x'><img data-src='http://i/1' src='y' alt='z'><img src='http://i/1'>"
    df = spark.createDataFrame([(1, html)], "id int, html string")
    stats = P.table_stats(P.page_tables(df, "id", "html"), "id", ("院校", "学校"), ("专业",), ("计划", "人数")).collect()
    assert [(s.n_rows, s.n_names, s.n_groups, s.total) for s in stats] == [(2, 1, 2, 12)]
    assert [(r.src, r.alt) for r in P.image_refs(df, "id", "html").collect()] == [("http://i/1", "z")]
    art = spark.createDataFrame([("<script>var msg_title = 'T'; var nickname='N'; var ct = '1700000000';</script><div id='js_content'><p>body</p></div>",)], "html string")
    r = P.article_fields(art).first()
    assert (r.title, r.account, r.content) == ("T", "N", "body") and r.published_at.year == 2023


def test_payloads(spark):
    item = '{"aweme_id":"9","desc":"高考","author":{"nickname":"n"},"statistics":{"digg_count":1300,"collect_count":600},"create_time":1700000000,"video":{"play_addr":{"url_list":["x","http://p"]}}}'
    rows = [(1, f'{{"data":{{"aweme_list":[],"mix_list":[{item}]}}}}'), (2, '{"aweme_list":[{"desc":"","author":{}}]}'), (3, "junk")]
    got = J.videos_of(spark.createDataFrame(rows, "id int, p string"), "id", "p").collect()
    assert [(r.id, r.likes, r.saves, r.original_url, r.play_url) for r in got] == [(1, 1300, 600, "https://www.douyin.com/video/9", "http://p")]
    t = spark.createDataFrame([("真话", "c", "v", None), (None, "#tag #x", "v 文字", None), (None, "cap", "", "download failed"), ("#a", None, None, "slow")], "speech_text string, caption string, video_text string, speech_error string")
    got = [(r.transcript, r.transcript_source) for r in J.picked_transcript(t).collect()]
    assert got == [("真话", "speech"), ("v 文字", "video text"), ("cap", "caption; speech failed: download failed"), ("", "none")]
    asr = spark.createDataFrame([('{"code":1000,"result":{"text":"ab"}}',), ('{"code":"fail","utterances":[{"text":"a"},{"text":" b "}]}',)], "p string")
    good, text = J.recognized("p")
    assert [tuple(r) for r in asr.select(good, text).collect()] == [(True, "ab"), (False, "a\nb")]
    hits = spark.createDataFrame([(1, '{"articles":[{"title":" t ","url":"u"},{"title":"","url":"v"}]}')], "id int, p string")
    assert [(r.title, r.url, r.source_name) for r in J.search_hits(hits, "id", "p").collect()] == [("t", "u", "web")]


def test_transcripts(spark):
    clean, = values(spark, distil.clean_transcript, "嗯嗯大家好，今天讲高考志愿填报。#高考 然后看位次！今天讲高考志愿填报。")
    assert "高考志愿填报" in clean and "大家好" not in clean and "#" not in clean and clean.count("今天讲高考志愿填报") == 1
    kind = lambda t: distil.content_class(t, F.lit(""))
    assert values(spark, kind, "原唱：某某 伴奏版本来了哦哦哦哦", "高考志愿填报要看位次和分数，不要只看学校名字，先选专业再选院校。", "短") == ["lyrics", "valid", "title_only"]
    assert values(spark, distil.is_garbage, "by bwd6", "这是一段足够长的中文文稿内容没有问题") == [True, False]
    cut, = values(spark, lambda t: F.array_join(distil.unpunctuated(t), "|"), "我们先说志愿填报的事情然后说专业的选择方法最后说录取结果")
    assert cut == "我们先说志愿填报的事情|然后说专业的选择方法|最后说录取结果"
    script, = values(spark, distil.manuscript, "今天我们来讲一讲高考志愿怎么填报才合理。先看位次再看专业最后看学校的层次。怎么选")
    assert script.endswith(("。", "？")) and "，" in script


def test_distil(spark):
    text = "升学规划要趁早，高考志愿填报需要看位次和分数。\n2023年全省录取人数为12万人，比上年增加3%。\n例如某同学考了600分，最后被一所大学的强基计划录取。\n我们是一家专注升学的机构，欢迎关注。\n01 这里是普通的一句话没有什么信息。"
    docs = spark.createDataFrame([(1, "高考志愿填报怎么做才好 | 某号", text), (2, "短", "太短")], "id int, title string, text string")
    got = {r.id: r for r in distil.distilled(docs, "id", "title", "text").collect()}
    assert got[1].thesis == "高考志愿填报怎么做才好" and any("12万人" in s for s in got[1].key_data) and any("某同学" in s for s in got[1].cases)
    assert not any("一家专注" in s for s in got[1].key_points) and got[2].thesis == "" and got[2].key_points is None


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "id int, v string, at int")
    assert {r.id: r.v for r in store.upsert(old, new, "id", "at").collect()} == {1: "c", 2: "b", 3: "e"}
    ids = store.with_new_ids(new.withColumnRenamed("id", "n"), old, [F.col("n")])
    assert sorted((r.n, r.id) for r in ids.collect()) == [(1, 3), (2, 4), (3, 5)]
    store.export_snapshot({"materials": old, "tasks": new.limit(0)}, str(tmp_path), "2024-02-01")
    back = store.import_snapshot(spark, str(tmp_path), {"materials": "id int, v string, at int", "tasks": "id int, v string, at int"})
    assert sorted(map(tuple, back["materials"].collect())) == [(1, "a", 1), (2, "b", 5)] and back["tasks"].count() == 0
    with pytest.raises(ValueError):
        store.import_snapshot(spark, str(tmp_path), {"drafts": "id int"})
    docs = spark.createDataFrame([('{"sources":[],"tasks":[1],"materials":[],"drafts":[]}',), ('{"sources":{},"tasks":[],"materials":[],"drafts":[]}',), ("x",)], "document string")
    assert [r.valid for r in store.parse_snapshot(docs).collect()] == [True, False, False]


def test_new_ids_are_distinct_and_gapless(spark):
    """Above the rows that a range partitioning samples."""
    n = 2_000_000
    new = spark.range(n).select((F.col("id") * 7919 % n).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    ids = store.with_new_ids(new, spark.createDataFrame([(41,)], "id long"), [F.col("n")])
    r = ids.agg(F.countDistinct("id").alias("d"), F.min("id").alias("a"), F.max("id").alias("z"), F.max(F.abs(F.col("id") - F.col("n") - 42)).alias("gap")).first()
    assert (r.d, r.a, r.z, r.gap) == (n, 42, n + 41, 0)


def test_texts_are_computed_once(spark):
    """However many words a gate looks for, the plan has each derived text a few times only."""
    plan = catalog.QUERIES["d2_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    optimized = plan[plan.index("== Optimized") : plan.index("== Physical")]
    assert optimized.count("split_part") < 12


def test_chapters_and_noise(spark):
    assert values(spark, distil.without_chapters, "01 不同的阶段 说明", "他说，提到升学规划。好", "12  开头", "第不同的阶段") == ["说明", "他说。好", "开头", "第不同的阶段"]


def test_search_goes_in_blocks(spark):
    rows = spark.createDataFrame([(k, f"w{k}x") for k in range(30)], "id int, title string")
    q = spark.createDataFrame([(f"w{k}x",) for k in range(25)] + [(None,)], "query string")
    got = substrings.searched(rows, q, [F.col("title")], few=2).collect()
    assert sorted((r.query, r.id) for r in got) == sorted((f"w{k}x", k) for k in range(25))
    assert substrings.searched(rows, q.limit(0), [F.col("title")]).count() == 0


def test_evidence_by_hand(spark):
    """Every point of every document against all of its facts, in plain loops."""
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 9)))
    points, facts = ([(d, p, text()) for d in range(6) for p in range(5)] for _ in range(2))
    schema = "doc_id int, pos int, sentence string"

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0

    want = {(d, p): min([q for e, q, f in facts if e == d and alike(s, f) > 0.3], default=None) for d, p, s in points}
    got = match.evidence(spark.createDataFrame(points, schema), spark.createDataFrame(facts, schema), "doc_id", 0.3).collect()
    assert {(r.doc_id, r.pos): r.fact for r in got} == want


def test_keywords_and_search(spark):
    tags = spark.createDataFrame([("常州高校招生政策", ["web"])], "t string, tags array<string>")
    kw = tags.select(match.keyword_hits(F.col("t"), F.col("tags")).alias("k")).first().k
    assert kw == ["web", "常州", "招生", "政策", "高校"]
    rows = spark.createDataFrame([(1, "Alpha", "x"), (2, "b", "ALPHA")], "id int, title string, content string")
    q = spark.createDataFrame([(" alpha ",), ("",), ("a x",)], "query string")
    got = sorted((r.query, r.id) for r in substrings.searched(rows, q, [F.col("title"), F.col("content")]).collect())
    assert got == [("", 1), ("", 2), (" alpha ", 1), (" alpha ", 2), ("a x", 1)]


def test_stream_rerun_adds_nothing(spark, tmp_path):
    from inkwell.streaming.collect import collect_news, stored_news

    schema = "pos int, url string, title string"
    rows = [(1, "http://a/1", "t1"), (2, "http://a/1/", "t2"), (3, "http://a/3", "t1"), (4, "http://a/4", "t4")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = collect_news(stream, str(tmp_path / "news"), str(tmp_path / "log"), str(tmp_path / "cp"), lambda: (X.normalize_url(F.col("url")), X.title_key(F.col("title"))), lambda: F.col("title") != "")
        q.awaitTermination()
        return sorted(r.pos for r in stored_news(spark, str(tmp_path / "news"), f"{schema}, url_key string, title_key string, batch bigint").collect())

    assert go() == [1, 4]
    assert go() == [1, 4]
    spark.createDataFrame([(5, "http://a/4", "new"), (6, "http://a/6", "t6")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert go() == [1, 4, 6]
    assert spark.read.parquet(str(tmp_path / "log")).agg(F.sum("created")).first()[0] == 3


def test_small_rewrites(spark):
    assert values(spark, lambda t: X.excerpt(t, F.lit("f")), "一。 二！三", "", "长" * 200) == ["一。二！", "f", "长" * 108 + "..."]
    assert values(spark, X.masked_persons, "小明同学和张某某家长") == ["某同学和张某家长"]
    assert values(spark, lambda t: X.rewritten(t, owner="某社"), "我们觉得很重要！！", "，如果可以。") == ["某社觉得不容忽视", "若可考虑"]
    assert values(spark, X.rewritten, "我们觉得很重要！！") == ["我们的判断是不容忽视"]
    assert values(spark, lambda t: X.condensed(t, 10), "一二三四五六，七八九十十一", "一，二三四五六七八九十十一", "短") == ["一二三四五六", "一，二三四五六七八九", "短"]
    assert values(spark, X.needs_caution, "预计明年", "2024年", "平常") == [True, True, False]


def test_video_stream(spark, tmp_path):
    from inkwell.streaming.collect import collect_videos

    cols = "pos int, title string, creator string, platform string, scope string, original_url string, play_url string, likes int, saves int"
    row = lambda p, u, n: (p, "高考", "m", "a", "b", f"https://d/video/{u}", "", n, 0)
    limits = spark.createDataFrame([("a", "b", 100, 100)], "platform string, scope string, likes int, saves int")
    none = spark.createDataFrame([], "name string, keywords array<string>, enabled boolean")
    path = lambda n: str(tmp_path / n)

    def go(rows):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(path("in"))
        collect_videos(spark.readStream.schema(cols).parquet(path("in")), path("t"), path("log"), path("cp"), limits, lambda: none, ("高考",)).awaitTermination()
        return sorted(r.pos for r in spark.read.schema(f"{cols}, batch bigint").parquet(path("t")).collect())

    assert go([row(1, 1, 200), row(2, 1, 300), row(3, 2, 5)]) == [1]
    assert go([row(4, 1, 200), row(5, 3, 200)]) == [1, 5]


def test_video_stream_creators_and_play_urls(spark, tmp_path):
    from inkwell.streaming.collect import arrived, collect_videos, stored_creators, stored_videos

    cols = "pos int, title string, creator string, platform string, scope string, original_url string, play_url string, likes int, saves int"
    row = lambda p, u, who, play="": (p, "高考", who, "a", "b", f"https://d/video/{u}", play, 200, 0)
    limits = spark.createDataFrame([("a", "b", 100, 100)], "platform string, scope string, likes int, saves int")
    known = spark.createDataFrame([("off", ["高考"], False)], "name string, keywords array<string>, enabled boolean")
    path = lambda n: str(tmp_path / n)

    def go(rows):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(path("in"))
        collect_videos(spark.readStream.schema(cols).parquet(path("in")), path("t"), path("log"), path("cp"), limits, lambda: known, ("高考",)).awaitTermination()
        return stored_videos(spark, path("t"), cols)

    first = go([row(1, 1, "new"), row(2, 2, "off"), row(3, 3, "two", "own")])
    assert {r.pos: r.play_url for r in first.collect()} == {1: "", 3: "own"}
    assert {(r.name, r.platform, r.enabled) for r in stored_creators(spark, path("t-creators")).collect()} == {("new", "a", True), ("two", "a", True)}
    second = go([row(4, 1, "new", "late"), row(5, 3, "two", "other"), row(6, 4, "new")])
    assert {r.pos: r.play_url for r in second.collect()} == {1: "late", 3: "own", 6: ""}
    assert [r.pos for r in arrived(second).collect()] == [6] and arrived(second, -1).count() == 3
    assert stored_creators(spark, path("t-creators")).count() == 2


def test_arrived_in_a_last_batch_that_stored_nothing(spark, tmp_path):
    from inkwell.streaming.collect import arrived, collect_videos, stored_videos
    from inkwell.streaming.cycles import run_log

    cols = "pos int, title string, creator string, platform string, scope string, original_url string, play_url string, likes int, saves int"
    limits = spark.createDataFrame([("a", "b", 100, 100)], "platform string, scope string, likes int, saves int")
    none = spark.createDataFrame([], "name string, keywords array<string>, enabled boolean")
    path = lambda n: str(tmp_path / n)

    def go(pos, likes):
        row = (pos, "高考", "who", "a", "b", "https://d/video/1", "", likes, 0)
        spark.createDataFrame([row], cols).coalesce(1).write.mode("append").parquet(path("in"))
        collect_videos(spark.readStream.schema(cols).parquet(path("in")), path("t"), path("log"), path("cp"), limits, lambda: none, ("高考",)).awaitTermination()
        return [r.pos for r in arrived(stored_videos(spark, path("t"), cols), runs=run_log(spark, path("log"))).collect()]

    assert go(1, 200) == [1]
    assert go(2, 300) == []  # its key is stored already
    assert go(3, 5) == []


def test_sentence_pairs_are_counted_alike_in_short_and_long_sentences(spark):
    import random

    from inkwell.operators.distil import scored_sentences

    rng = random.Random(5)
    rows = [(k // 40, k % 40, "".join(rng.choice("abcd .9") for _ in range(rng.randint(8, 300)))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, sentence string")
    got = [{(r.doc_id, r.pos): r.score for r in scored_sentences(df, "doc_id", ("ab c",), "a-c", "99", short=n).collect()} for n in (0, 100, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 400 and len(set(got[0].values())) > 20


def test_evidence_is_the_first_fact_alike(spark):
    import random

    from inkwell.operators.match import evidence

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, n)))
    points, facts = [(k % 7, k, text(6)) for k in range(40)], [(k % 6, k, text(6)) for k in range(90)]
    alike = lambda a, b: bool(a and b) and len(set(a) & set(b)) / len(set(a) | set(b)) > 0.3
    want = {p: next((q for e, q, t in facts if e == d and alike(s, t)), None) for d, p, s in points}
    got = evidence(spark.createDataFrame(points, "d int, pos int, sentence string"), spark.createDataFrame(facts, "d int, pos int, sentence string"), "d", 0.3)
    assert {r.pos: r.fact for r in got.collect()} == want and None in want.values()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "filter(" not in plan  # facts behind the first are not compared


def test_feed_rows_are_dealt_to_all_cores(spark):
    from inkwell.plans.collected import a3

    assert a3(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_labels_of_a_long_run_all_go(spark):
    from inkwell.operators.distil import without_noise

    df = spark.createDataFrame([("Ouea " + "The " * 600 + "end, and a The",), ("The " * 300,)], "t string")
    assert [r[0] for r in df.select(without_noise(F.col("t"), (), ("The", "and"))).collect()] == ["Ouea end, a", ""]
