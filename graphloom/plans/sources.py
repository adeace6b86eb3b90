"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.registry import query
from graphloom.session import new_path
from graphloom.sources import files, html, specs
from graphloom.sources.relational import table
from graphloom.streaming import events as streams


_SPECS_SQL = "specs AS (SELECT DISTINCT source AS id, ['feed', 'register', 'leak'][ord(right(source, 1)) % 3 + 1] AS adapter, ['hourly', 'daily', 'weekly'][ord(right(source, 1)) % 3 + 1] AS cadence FROM documents WHERE source IS NOT NULL)"


def _specs(spark, d):
    """The documents' sources as a registry."""
    at = F.ascii(F.right("source", F.lit(1))) % 3
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), at)
    sources = table(spark, d, "documents").select("source").where("source IS NOT NULL").distinct()
    return sources.select(F.col("source").alias("id"), pick("feed", "register", "leak").alias("adapter"), pick("hourly", "daily", "weekly").alias("cadence"))


@query(f"WITH {_SPECS_SQL} SELECT id, adapter, cadence FROM specs WHERE id IN ('src1', 'src11') OR adapter = 'leak'")
def s01_resolve_specs(spark, d):
    """Sources asked for by their id or by their adapter."""
    return specs.resolve(_specs(spark, d), ["SRC1", "src11", "Leak", "no such source"])


@query(f"WITH {_SPECS_SQL} SELECT 'hourly' AS tier, id FROM specs WHERE cadence = 'hourly' UNION ALL SELECT 'daily', id FROM specs WHERE cadence = 'daily' UNION ALL SELECT 'weekly', id FROM specs")
def s02_cadence(spark, d):
    """What the runs of each tier take; an unknown one is an error."""
    registry = _specs(spark, d)
    runs = [specs.for_tier(registry, tier).select(F.lit(tier).alias("tier"), "id") for tier in ("hourly", "daily", "weekly")]
    return runs[0].unionAll(runs[1]).unionAll(runs[2])


@query("SELECT CAST(p_partkey AS VARCHAR) AS part_key, p_name AS part_name, CAST(p_size AS VARCHAR) AS size FROM part")
def s03_delimited_file(spark, d):
    """Written as a tab-separated file with free-form headers, then read by sniffing and aliases."""
    path = new_path(spark, "tsv")
    table(spark, d, "part").select(F.col("p_partkey").alias("Part Key"), F.col("p_name").alias("Part-Name"), F.col("p_size").alias("SIZE (mm)")).write.option("header", True).option("sep", "\t").csv(path)
    return files.read_delimited(spark, path, {"size": ["length", "size_mm"]}).select("part_key", "part_name", "size")


@query("SELECT c_custkey AS company, unnest([c_mktsegment, 'N' || c_nationkey]) AS officer FROM customer")
def s07_json_envelope(spark, d):
    """A register's JSON: records under a dotted path, nested officers."""
    envelope = F.to_json(F.struct(F.struct(F.array(F.struct("c_custkey", F.array("c_mktsegment", F.concat(F.lit("N"), "c_nationkey")).alias("officers"))).alias("companies")).alias("results")))
    records = files.json_records(envelope, ["items", "results.companies"], "struct<c_custkey: long, officers: array<string>>")
    return table(spark, d, "customer").select(F.explode(records).alias("r")).select(F.col("r.c_custkey").alias("company"), F.explode("r.officers").alias("officer"))


@query("WITH c AS (SELECT c_nationkey || '/' || c_mktsegment || '/' || floor(c_acctbal / 1000)::BIGINT AS org, c_name FROM customer), p AS (SELECT a.org, a.c_name AS a, b.c_name AS b, row_number() OVER (PARTITION BY a.org ORDER BY a.c_name, b.c_name) AS k FROM c a JOIN c b ON a.org = b.org AND a.c_name < b.c_name WHERE a.org IN (SELECT org FROM c GROUP BY 1 HAVING count(*) <= 24)) SELECT org, a, b FROM p WHERE k <= 12")
def s13_co_members(spark, d):
    """Pairs of one organisation: groups of 24 at most, twelve pairs each, by name."""
    org = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("string"))
    c = table(spark, d, "customer").select(org.alias("org"), "c_name")
    small = c.groupBy("org").agg(F.count("*").alias("n")).where("n <= 24").select("org")
    kept = c.join(small, "org", "left_semi")
    pairs = kept.withColumnRenamed("c_name", "a").join(kept.withColumnRenamed("c_name", "b"), "org").where("a < b")
    return pairs.withColumn("k", F.row_number().over(W.partitionBy("org").orderBy("a", "b"))).where("k <= 12").select("org", "a", "b")


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size > 25 THEN p_name ELSE ' ' END), ''), p_brand) AS value FROM part")
def s30_first_present(spark, d):
    p = table(spark, d, "part").withColumn("first", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(" "))
    return p.select("p_partkey", files.first_present(p, ["missing", "first", "p_brand"]).alias("value"))


@query(
    "WITH h AS (SELECT doc_id, source, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash FROM documents WHERE len(trim(text)) > 0), k AS (SELECT content_hash FROM h WHERE doc_id % 10 = 0) "
    "SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM h WHERE content_hash NOT IN (SELECT content_hash FROM k) GROUP BY content_hash"
)
def s31_intake(spark, d):
    from graphloom.functions.hashing import content_hash

    docs = table(spark, d, "documents")
    known = docs.where("doc_id % 10 = 0").select(content_hash(F.col("text")).alias("content_hash"))  # what an earlier run had taken in
    return files.intake(docs, known).select("doc_id", "source")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM (SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM (SELECT doc_id, source, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM documents WHERE len(trim(text)) > 0) GROUP BY h)) WHERE k <= 5")
def s32_source_cap(spark, d):
    docs = table(spark, d, "documents")
    none = spark.createDataFrame([], "content_hash string")
    return files.intake(docs, none, cap=5).select("doc_id", "source")


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 365 DAY")
def s34_window(spark, d):
    from graphloom.functions.dates import recent_or_unknown

    return table(spark, d, "orders").where(recent_or_unknown(F.col("o_orderdate"), F.lit("1998-08-02").cast("timestamp_ntz"), 365)).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.html?$') THEN 'html' WHEN regexp_matches(trim(html), '^(?i)<(!doctype html|html)') THEN 'html' ELSE 'text' END AS kind FROM pages")
def s35_payload_kind(spark, d):
    return table(spark, d, "pages").select("page_id", files.payload_kind(F.lit(""), F.col("url"), F.substring("html", 1, 200)).alias("kind"))


@query("SELECT feed, url FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS feed, url, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY url) AS k FROM pages WHERE md5(url) >= '4') WHERE k <= 3")
def s26_feed_entries(spark, d):
    """All pages as entries of their hosts' feeds; a quarter of the addresses is known from before."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("feed"), "url", F.lit(None).cast("timestamp").alias("published"))
    known = p.where(F.md5("url") < "4").select("url").distinct()
    return files.feed_entries(p, known, 3, F.lit("2000-01-01").cast("timestamp")).select("feed", "url")


@query()
def t02_html_text(spark, d):
    return html.extracted(table(spark, d, "pages"))


@query("SELECT r_regionkey, CAST(to_json({'key': r_regionkey, 'name': r_name}) AS VARCHAR) AS record FROM region")
def k15_json_records(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("record"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k17_report_round_trip(spark, d):
    """A report written as JSON lines and read back."""
    path = new_path(spark, "report")
    table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("event_type string, n long").json(path)


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def r01_stream_dedupe(spark, d):
    """Within a window longer than the table, a stream keeps what a batch calls distinct."""
    e = streams.file_stream(spark, f"{d}/events.parquet").withColumn("key", F.concat_ws("|", "user_id", "event_type")).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.drain(streams.first_seen(e, "key", "ts", "400 days").select("user_id")).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "WITH RECURSIVE o AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), s AS (SELECT user_id, min(ts) AS ts FROM o GROUP BY 1 UNION ALL "
    "SELECT s.user_id, (SELECT min(o.ts) FROM o WHERE o.user_id = s.user_id AND o.ts >= s.ts + INTERVAL 24 HOUR) FROM s WHERE s.ts IS NOT NULL) SELECT user_id, count(ts) AS sent FROM s GROUP BY 1"
)
def r03_suppression(spark, d):
    e = streams.file_stream(spark, f"{d}/events.parquet").where("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return streams.drain(streams.suppressed(e, "user_id", "ts", 24)).groupBy("user_id").agg(F.count("*").alias("sent"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def r06_daily_ledger(spark, d):
    e = streams.file_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = streams.drain(streams.windowed(e, "ts", "event_type", "value", "1 day", "60 days"), "complete")
    return counted.select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "WITH s AS (SELECT user_id, ts::DATE AS day, count(*) AS degree FROM events GROUP BY 1, 2), l AS (SELECT *, lag(degree) OVER w AS prev, lag(day) OVER w AS prev_day FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day)) "
    "SELECT user_id, day, round(CASE WHEN prev IS NOT NULL AND day - prev_day <= 1 THEN least(1.0, greatest(0.0, (degree - prev) / greatest(1, prev)::DOUBLE / 3)) ELSE 0 END, 6)::DOUBLE AS spike FROM l"
)
def r04_spike(spark, d):
    """How far activity is above that of the previous snapshot, if that is a day old at most."""
    s = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("degree"))
    w = W.partitionBy("user_id").orderBy("day")
    prev, near = F.lag("degree").over(w), F.datediff("day", F.lag("day").over(w)) <= 1
    jump = (F.col("degree") - F.col("prev")) / F.greatest(F.lit(1), F.col("prev")) / 3
    spike = F.when(F.col("prev").isNotNull() & F.col("near"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), jump))).otherwise(0.0)
    return s.withColumn("prev", prev).withColumn("near", near).select("user_id", "day", F.round(spike, 6).alias("spike"))
