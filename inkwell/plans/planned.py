"""Queries of what the reference's design plans: vector search, and more below."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import chunks, dedup, store, trends, vectors, versions
from inkwell.plans import catalog as C
from inkwell.streaming import horizon

query, read = C.query, C.read


# --- Vector search ------------------------------------------------------------------------------


@query("m3_vector_search", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.id, v.id AS neighbour, round(list_cosine_similarity(q.e, v.e), 9) AS sim FROM v q JOIN v ON v.id <> q.id WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS rank FROM s)
SELECT id AS vec_id, CAST(rank AS INT) AS rank, neighbour, round(sim, 6) AS similarity FROM r WHERE rank <= 10""")
def m3(spark, d):
    """The ten nearest others of every twentieth vector, exactly."""
    rows = read(spark, d, "embeddings")
    found = vectors.nearest(rows, rows.filter("vec_id % 20 = 0"), dedup.shared_path(rows, "nearest"), "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("similarity", 6).alias("similarity"))


@query("m3_vector_index")
def m3_index(spark, d):
    """The same from lists of near vectors; recall, measured in the tests, is 0.9 or more."""
    rows = read(spark, d, "embeddings")
    index = vectors.build(rows, dedup.shared_path(rows, "index"), "vec_id", "embedding")
    found = vectors.search(spark, index, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("similarity", 6).alias("similarity"))


# --- Pieces for retrieval -----------------------------------------------------------------------

_SENTENCE = chunks.pattern().replace("\n", "\\n")


@query("m2_chunks", f"""WITH l AS (SELECT doc_id, text AS t, regexp_extract_all(text, '{_SENTENCE}') AS s FROM documents),
e AS (SELECT doc_id, t, s, generate_subscripts(s, 1) AS i FROM l),
o AS (SELECT doc_id, t, CAST(coalesce(list_sum(list_transform(s[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(s[i]) AS n FROM e),
w AS (SELECT doc_id, t, a, a + n AS b, unnest(range(greatest(0, CAST(floor((a - 800) / 600) AS BIGINT) + 1), a // 600 + 1)) AS k FROM o),
p AS (SELECT doc_id, k, min(a) AS a, max(b) AS b, any_value(t) AS t FROM w GROUP BY doc_id, k)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS piece, a AS start, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS fresh, b AS "end", sha256(substr(t, a + 1, b - a)) AS sha256 FROM p""")
def m2(spark, d):
    made = chunks.pieces(read(spark, d, "documents"), "doc_id")
    return made.withColumn("sha256", F.sha2("text", 256)).drop("text")


@query("m2_rebuilt", "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text <> ''")
def m2_rebuilt(spark, d):
    """Every text from its pieces again."""
    made = chunks.rebuilt(chunks.pieces(read(spark, d, "documents"), "doc_id"), "doc_id")
    return made.select("doc_id", F.sha2("text", 256).alias("sha256"))


# --- Versions -------------------------------------------------------------------------------------

_CHANGES = "h AS (SELECT user_id, ts, event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"


def event_history(spark, d):
    """What each user did last, as versions: a third of the events arrive late and are merged."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    early = versions.history(e.filter("event_id % 3 <> 0"), "user_id", "ts", "event_id")
    return versions.merged(early, e.filter("event_id % 3 = 0"), "user_id", "ts", "event_id")


@query("m4_versions", f"WITH {_CHANGES} SELECT * FROM h")
def m4(spark, d):
    return event_history(spark, d).select("user_id", "ts", "event_id", "event_type", "valid_to")


@query("m4_as_of", f"WITH {_CHANGES}, t AS (SELECT epoch_ms((epoch_ms(min(ts)) + epoch_ms(max(ts))) // 2) AS t FROM events) SELECT user_id, event_id, event_type FROM h, t WHERE ts <= t AND (valid_to IS NULL OR valid_to > t)")
def m4_as_of(spark, d):
    """What held in the middle of the time that the events cover."""
    half = read(spark, d, "events").agg(*[F.unix_millis(f(F.col("ts").cast("timestamp"))).alias(n) for n, f in (("a", F.min), ("b", F.max))]).first()
    time = F.timestamp_millis(F.lit(((half["a"] or 0) + (half["b"] or 0)) // 2))
    return versions.as_of(event_history(spark, d), "ts", time).select("user_id", "event_id", "event_type")


@query("m4_condensed", f"""WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT * FROM c WHERE q IS NULL OR p IS DISTINCT FROM event_type) SELECT user_id, ts, event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM s""")
def m4_condensed(spark, d):
    held = versions.condensed(event_history(spark, d), "user_id", "ts", "event_id", ["event_type"])
    return held.select("user_id", "ts", "event_id", "event_type", "valid_to")


# --- Reports by period -----------------------------------------------------------------------------


@query("m6_trends", """WITH c AS (SELECT event_type, DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7.0) * 7 AS INT) AS period, count(*) AS n, coalesce(sum(value), 0) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
f AS (SELECT event_type, CAST(unnest(generate_series(min(period) OVER (), max(period) OVER (), INTERVAL 7 DAY)) AS DATE) AS period FROM c), e AS (SELECT DISTINCT * FROM f)
SELECT event_type, period, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total, coalesce(n, 0) - lag(coalesce(n, 0)) OVER (PARTITION BY event_type ORDER BY period) AS change FROM e LEFT JOIN c USING (event_type, period)""")
def m6(spark, d):
    return trends.by_period(read(spark, d, "events"), "event_type", "ts", "value").withColumn("total", F.round("total", 4))


# --- Bounded memory of a stream, documents of workspaces ------------------------------------------


@query("j5_horizon", "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL UNION ALL SELECT user_id FROM events WHERE user_id IS NULL")
def j5(spark, d):
    """Users in the order of their arrival, each once: all come inside one horizon."""
    e = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    base = dedup.shared_path(e, "horizon")
    e.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/in")
    once = horizon.first_within(stream, F.col("user_id"), "ts", "36500 days")
    q = once.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{base}/out").select("user_id")


@query("a16_documents", "SELECT s_nationkey AS workspace, 'sources' AS entity, s_suppkey AS id, s_name AS text FROM supplier UNION ALL SELECT c_nationkey, 'tasks', c_custkey, c_name FROM customer")
def a16_documents(spark, d):
    """Suppliers and customers of each nation as one document, and all of them read back."""
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("workspace"), F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("text"))
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("workspace"), F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("text"))
    made = store.export_documents({"sources": s, "tasks": c, "materials": s.limit(0), "drafts": s.limit(0)}, "workspace", C.AS_OF)
    back, _ = store.import_documents(dedup.written(made, "documents"), "workspace", dict.fromkeys(("sources", "tasks", "materials", "drafts"), "id: BIGINT, text: STRING"))
    parts = [df.select("workspace", F.lit(n).alias("entity"), "id", "text") for n, df in back.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
