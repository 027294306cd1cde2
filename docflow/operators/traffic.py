"""Request classes, limits, a sliding-window limiter and burst alerts."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Paths by class, agents of automated clients, limits a window of 60 s, alert thresholds.
EXEMPT_PATHS = ("/", "/api/health", "/api/ready", "/api/worker/health")
AI_PATHS = ("/summarize", "/rag-query", "/rag-query/stream", "/chat")
SCRAPE_PATHS = ("/documents", "/jobs", "/dashboard-stats", "/queue")
SCRAPE_PREFIXES = ("/documents/", "/job-status/", "/job-result/", "/job-events/")
BOT_AGENTS = r"(?i)(python-requests|httpx|scrapy|curl/|wget|go-http-client|libwww-perl|java/|php/|node-fetch|axios/|postmanruntime|bot|spider|crawler|scraper)"
LIMITS = {"ai": 20, "scrape": 60, "auth": 40, "api": 120}
GUEST_AI_LIMIT, BOT_FACTOR, WINDOW_S = 10, 0.25, 60
AUTH_BURST, ERROR_BURST = (300, 8), (60, 40)


def classify_request(path: Column, method: Column) -> Column:
    """TRF1: exempt, auth, ai, scrape or api."""
    p = F.regexp_replace(path, "/+$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    starts = lambda *xs: path.rlike("^(" + "|".join(xs) + ")")
    return (
        F.when(p.isin(*EXEMPT_PATHS) | path.isin(*EXEMPT_PATHS), F.lit("exempt"))
        .when(starts("/auth/", "/guest/"), F.lit("auth"))
        .when(p.isin(*AI_PATHS), F.lit("ai"))
        .when(p.isin(*SCRAPE_PATHS), F.lit("scrape"))
        .when((F.upper(method) == "GET") & starts(*SCRAPE_PREFIXES), F.lit("scrape"))
        .otherwise(F.lit("api"))
    )


def is_bot(agent: Column) -> Column:
    a = F.coalesce(agent, F.lit(""))
    return (F.trim(a) == "") | a.rlike(BOT_AGENTS)


def bucket_limit(bucket: Column, bot: Column, guest: Column) -> Column:
    """TRF2: requests a window; guests have fewer AI calls, bots a quarter, one at least."""
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv]), bucket), F.lit(LIMITS["api"]))
    n = F.when((bucket == "ai") & guest, F.lit(GUEST_AI_LIMIT)).otherwise(n)
    return F.when(bot, F.greatest(F.lit(1), F.floor(n * BOT_FACTOR).cast("int"))).otherwise(n)


def rate_limit(log: DataFrame, limit: int, window_s: float = WINDOW_S) -> DataFrame:
    """TRF3: (key, event_id, t seconds) -> allowed, retry_after; denied hits are not counted.

    A denied hit leaves no trace, so what is allowed depends on all before it: one ordered pass a key, in
    batches, that holds no more than `limit` times. Rows without a key are not limited and do not come back.
    """
    def replay(frames):
        held: deque = deque()
        now = object()
        for pdf in frames:
            allowed, retry = [], []
            for key, t in zip(pdf["key"], pdf["t"]):
                if key != now:
                    now = key
                    held.clear()
                while held and t - held[0] > window_s:
                    held.popleft()
                ok = len(held) < limit
                allowed.append(ok)
                retry.append(0.0 if ok else max(0.0, window_s - (t - held[0])))
                if ok:
                    held.append(t)
            yield pdf[["key", "event_id"]].assign(allowed=allowed, retry_after=retry)

    rows = log.filter("key is not null").select("key", "event_id", "t").repartition("key").sortWithinPartitions("key", "t", "event_id")
    return rows.mapInPandas(replay, "key long, event_id long, allowed boolean, retry_after double")


def burst_alerts(log: DataFrame, window_s: int, threshold: int) -> DataFrame:
    """TRF4: rows of (key, event_id, t seconds) at which a key has threshold rows in window_s."""
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-window_s, 0)
    return log.withColumn("n", F.count("*").over(w)).filter(F.col("n") >= threshold)
