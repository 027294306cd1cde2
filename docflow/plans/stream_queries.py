"""Streaming queries over the event table, drained with availableNow, beside SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.streaming import operators as S

from .bindings import table
from .registry import register


def events(spark, d):
    e = S.read_table(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("key", F.col("user_id"))


#: In append mode a window comes out once the watermark, ten minutes behind the newest row, has passed its end.
_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM {})"


def _sessions_sql(gap):
    return f"""s AS (SELECT user_id AS key, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  g AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM s), x AS (SELECT key, no, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY 1, 2 HAVING max(ts) + INTERVAL {gap} <= {_MARK.format('events')})"""


@register(f"""WITH e AS (SELECT * FROM events WHERE event_type = 'error'), w AS (SELECT user_id AS key, make_timestamp(CAST((epoch_us(ts) // 21600000000 - i) * 21600000000 AS BIGINT)) AS start FROM e, range(4) t(i)),
  g AS (SELECT key, start, count(*) AS n FROM w GROUP BY 1, 2) SELECT key, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n FROM g WHERE n >= 2 AND start + INTERVAL 1 DAY <= {_MARK.format('e')}""")
def st1_bursts(spark, d):
    return S.drain(S.stream_bursts(events(spark, d).filter("event_type = 'error'"), 2, 86400, 21600)).select("key", F.col("start").cast("string").alias("start"), "n")


@register()
def st2_rate_limit(spark, d):
    return S.drain(S.stream_rate_limit(events(spark, d), 3, 43200.0))


@register(f"WITH {_sessions_sql('2 HOUR')} SELECT key, epoch_us(first) AS start_us, n FROM x")
def st3_sessions(spark, d):
    return S.drain(S.stream_sessions(events(spark, d))).select("key", F.unix_micros("start").alias("start_us"), "n")


@register(f"WITH {_sessions_sql('6 HOUR')} SELECT key, epoch_us(last) AS last_seen_us FROM x")
def st4_stale(spark, d):
    return S.drain(S.stream_stale(events(spark, d), "6 hours")).select("key", F.unix_micros("last_seen").alias("last_seen_us"))


@register("SELECT user_id AS key, CAST(ts AS DATE) AS day, count(*) AS docs, round(sum(value), 6) AS carbon_g FROM events GROUP BY 1, 2")
def st5_daily_trend(spark, d):
    out = S.latest(S.drain(S.stream_daily_trend(events(spark, d)), "update"), "key", "day")
    return out.select("key", "day", "docs", F.round("carbon_g", 6).alias("carbon_g"))


@register("""WITH p AS (SELECT user_id AS key, event_id AS seq, list_extract(['queued', 'indexing', 'carbon', 'analytics'], CAST(event_id % 4 + 1 AS INTEGER)) AS phase, list_extract([0, 1, 3, 4], CAST(event_id % 4 + 1 AS INTEGER)) AS r FROM events) SELECT key, arg_max(phase, r::BIGINT * 1000000000 + seq) AS phase, arg_max(seq, r::BIGINT * 1000000000 + seq) AS seq FROM p GROUP BY 1""")
def st6_latest_state(spark, d):
    phase = F.element_at(F.array(*[F.lit(p) for p in ("queued", "indexing", "carbon", "analytics")]), (F.col("event_id") % 4 + 1).cast("int"))
    return S.latest(S.drain(S.stream_latest_state(events(spark, d).withColumn("phase", phase)), "update"), "key")


@register("""WITH o AS (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT key, round(sum(value * pow(0.75, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.25 END), 6) AS ema, max(n) AS n FROM o GROUP BY 1""")
def st7_ema(spark, d):
    out = S.latest(S.drain(S.stream_ema(events(spark, d).withColumn("key", F.col("event_type"))), "update"), "key")
    return out.select("key", F.round("ema", 6).alias("ema"), "n")


@register("""WITH e AS (SELECT event_id, user_id % 5 AS zone, ts FROM events WHERE event_type <> 'view'), r AS (SELECT user_id % 5 AS zone, ts AS read_at, 200.0::DOUBLE + value AS intensity FROM events WHERE event_type = 'view') SELECT event_id, round(arg_max(intensity, read_at), 6) AS intensity FROM e JOIN r USING (zone) WHERE ts >= read_at AND ts <= read_at + INTERVAL 2 HOUR GROUP BY 1""")
def st8_intensity(spark, d):
    e = events(spark, d).withColumn("zone", F.col("user_id") % 5)
    r = events(spark, d).filter("event_type = 'view'").select((F.col("user_id") % 5).alias("zone"), "ts", (F.lit(200.0) + F.col("value")).alias("intensity"))
    out = S.drain(S.stream_intensity(e.filter("event_type <> 'view'").select("event_id", "zone", "ts"), r, "2 hours"))
    return out.groupBy("event_id").agg(F.round(F.max_by("intensity", F.struct("read_at", "intensity")), 6).alias("intensity"))


@register("SELECT event_id, event_type FROM events")
def st9_dedupe(spark, d):
    e = events(spark, d)
    twice = e.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return S.drain(S.stream_dedupe(twice)).select("event_id", "event_type")


@register("""WITH e AS (SELECT user_id AS key, ts, max(ts) OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR)), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events)
  SELECT key, count(*) AS n_rows, count_if(ts < newest - INTERVAL 2 DAY) AS late_rows, coalesce(max(CASE WHEN ts < newest - INTERVAL 2 DAY THEN epoch_us(newest) - epoch_us(ts) END), 0) AS most_late_us FROM e GROUP BY 1""")
def st10_late_rows(spark, d):
    """Events that arrive in an order shuffled by hash, so that some are late."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.struct(F.md5(F.col("event_id").cast("string").cast("binary")).alias("h"), "event_id").alias("arrival"))
    return S.late_rows(e, "2 days")
