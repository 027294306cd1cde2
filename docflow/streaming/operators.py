"""Streaming operators. Late rows past a watermark are dropped and counted (late_row_report).

Streams of events have event_id, ts (timestamp), key and what the operator names. Every operator takes
and returns a streaming DataFrame; drain() runs one over what there is and gives a table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docflow.operators.jobs import phase_rank
from docflow.session import shared_folder

# Lateness allowed, windows and thresholds of alerts, sessions, freshness of a reading, smoothing.
LATENESS, BURST_S, SLIDE_S, SESSION, READING_TTL, ALPHA = "10 minutes", 300, 10, "2 hours", "300 seconds", 0.25
#: Time of the reading of an event that has none yet.
NEVER = -(1 << 63)


def read_table(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A parquet table as a stream, `files` of its files a batch."""
    static = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is (availableNow) into files of the shared folder, and read them.

    In update and complete mode the rows of each batch carry its number as `batch`.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", f"{base}/out")
    else:
        w = w.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out"))
    w.start().awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(f"{base}/out")


def stream_bursts(log: DataFrame, threshold: int, window_s: int = BURST_S, slide_s: int = SLIDE_S) -> DataFrame:
    """ST1: keys with threshold rows or more in a sliding window."""
    w = F.window("ts", f"{window_s} seconds", f"{slide_s} seconds")
    g = log.withWatermark("ts", LATENESS).groupBy("key", w).agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)
    return g.select("key", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def stream_rate_limit(log: DataFrame, limit: int, window_s: float) -> DataFrame:
    """ST2: allowed or denied hits of a key; the state holds the times of allowed hits only."""
    def replay(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        out = []
        for t, i in zip(rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, rows["event_id"]):
            held = [x for x in held if t - x <= window_s]
            out.append((key[0], i, len(held) < limit))
            if out[-1][2]:
                held.append(t)
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed"])

    return log.select("key", "event_id", "ts").groupBy("key").applyInPandasWithState(replay, "key long, event_id long, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_sessions(events: DataFrame, gap: str = SESSION) -> DataFrame:
    """ST3: sessions of a key that end after `gap` without a row."""
    s = events.withWatermark("ts", LATENESS).groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_stale(heartbeats: DataFrame, ttl: str = "60 seconds") -> DataFrame:
    """ST4: keys whose heartbeat stopped for ttl: each silence ends a session, whose end is when it was noticed."""
    s = heartbeats.withWatermark("ts", LATENESS).groupBy("key", F.session_window("ts", ttl)).agg(F.max("ts").alias("last_seen"))
    return s.select("key", "last_seen", F.col("session_window.end").alias("stale_at"))


def stream_daily_trend(jobs: DataFrame) -> DataFrame:
    """ST5: grams and documents of a key by day (update mode)."""
    g = jobs.withWatermark("ts", LATENESS).groupBy("key", F.window("ts", "1 day")).agg(F.count("*").alias("docs"), F.sum("value").alias("carbon_g"))
    return g.select("key", F.to_date("window.start").alias("day"), "docs", "carbon_g")


def stream_latest_state(updates: DataFrame) -> DataFrame:
    """ST6: the furthest phase of each job, never back (update mode)."""
    best = F.max(F.struct(phase_rank("phase").alias("r"), F.col("event_id").alias("seq"), "phase"))
    return updates.groupBy("key").agg(best.alias("b")).select("key", F.col("b.phase").alias("phase"), F.col("b.seq").alias("seq"))


def latest(updated: DataFrame, *keys: str) -> DataFrame:
    """The last batch's row of each key, of what drain() gave in update mode."""
    rest = [c for c in updated.columns if c not in (*keys, "batch")]
    return updated.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def stream_ema(obs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """ST7: the exponential average of a key after each batch (update mode); rows in order of event_id."""
    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, n = state.get if state.exists else (None, 0)
        for v in pd.concat(list(pdfs)).sort_values("event_id")["value"]:
            if v is not None and v >= 0:
                ema, n = v if ema is None else (1 - alpha) * ema + alpha * v, n + 1
        state.update((ema, n))
        yield pd.DataFrame([(key[0], ema, n)], columns=["key", "ema", "n"])

    return obs.select("key", "event_id", "value").groupBy("key").applyInPandasWithState(fold, "key string, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)


def stream_intensity(events: DataFrame, readings: DataFrame, ttl: str = READING_TTL) -> DataFrame:
    """ST8: events with the newest reading of their zone at most ttl old, as known when they come.

    An event comes out again when a later batch brings a better reading (the caller takes its maximum by read_at and intensity). Readings without
    a value do not count; of several at one time the largest does. A group is a span of ttl of one zone, with the readings of that span
    and the one before; it is dropped when the watermark has passed it.
    """
    wide = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {ttl}"))
    span = F.floor(F.col("us") / F.col("wide"))
    id_type, zone_type = (events.schema[c].dataType.simpleString() for c in ("event_id", "zone"))
    rows = lambda df, is_event, event, value: df.filter("zone is not null and ts is not null").select("zone", "ts", F.unix_micros("ts").alias("us"), wide.alias("wide"), F.lit(is_event).alias("is_event"), event.cast("string").alias("event_id"), value.cast("double").alias("intensity"))
    e = rows(events.withWatermark("ts", LATENESS), True, F.col("event_id"), F.lit(None)).withColumn("span", span)
    r = rows(readings.filter("intensity is not null").withWatermark("ts", LATENESS), False, F.lit(None), F.col("intensity")).withColumn("span", F.explode(F.array(span, span + 1)))
    named = ["zone", "span", "ts", "us", "wide", "is_event", "event_id", "intensity"]

    def fold(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        read_at, value, ids, at, best, found = (list(x) for x in state.get) if state.exists else ([], [], [], [], [], [])
        for new in pdfs:
            width = int(new["wide"].iloc[0])
            r, e = new[~new["is_event"]], new[new["is_event"]]
            read_at, value = read_at + r["us"].tolist(), value + r["intensity"].tolist()
            ids, at, best, found = ids + e["event_id"].tolist(), at + e["us"].tolist(), best + [NEVER] * len(e), found + [0.0] * len(e)
        order = np.lexsort((value, read_at))
        times, values, t = np.array(read_at, np.int64)[order], np.array(value, float)[order], np.array(at, np.int64)
        place = np.searchsorted(times, t, "right") - 1
        ok = np.zeros(len(t), bool)
        ok[place >= 0] = times[place[place >= 0]] >= t[place >= 0] - width
        now, seen = np.array(best, np.int64), np.array(found, float)
        fresh = np.flatnonzero(ok)
        fresh = fresh[(times[place[fresh]] != now[fresh]) | (values[place[fresh]] != seen[fresh])]
        now[fresh], seen[fresh] = times[place[fresh]], values[place[fresh]]
        state.update((times.tolist(), values.tolist(), ids, at, now.tolist(), seen.tolist()))
        state.setTimeoutTimestamp(int(key[1] + 1) * width // 1000 + 1)
        yield pd.DataFrame({"event_id": [ids[i] for i in fresh], "zone": [key[0]] * len(fresh), "at": t[fresh], "read": now[fresh], "intensity": seen[fresh]})

    out = e.select(named).union(r.select(named)).groupBy("zone", "span").applyInPandasWithState(
        fold, f"event_id string, zone {zone_type}, at long, read long, intensity double",
        f"read_at array<long>, value array<double>, ids array<string>, at array<long>, best array<long>, found array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("event_id").cast(id_type).alias("event_id"), "zone", F.timestamp_micros("at").alias("ts"), F.timestamp_micros("read").alias("read_at"), F.coalesce("intensity", F.lit(float("nan"))).alias("intensity"))  # pandas gives NaN as null


def stream_dedupe(events: DataFrame) -> DataFrame:
    """ST9: one row an event_id, of sources that write the same event twice within the lateness."""
    return events.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def late_row_report(query) -> int:
    """ST10: rows that a query's stateful operators dropped as later than the watermark, so far."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


class LateRowCounter(StreamingQueryListener):
    """ST10: rows that stateful operators drop as late, of every batch of every query while it is registered.

    recentProgress keeps the last hundred batches only; this keeps a sum a query, by its id, and the batches seen.
    spark.streams.addListener(counter) before the query starts; events come in their own thread, shortly after a batch.
    """

    def __init__(self):
        self.dropped: Counter = Counter()
        self.batches: Counter = Counter()
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.id)] += 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches[str(p.id)] += 1
        self.dropped[str(p.id)] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        """Nothing to count."""

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


def late_rows(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """ST10: (key, ts, arrival) of a finished log -> rows of each key, those that came later than a watermark
    `lateness` behind the newest row of the key so far, and how late the latest was."""
    seen = F.max("ts").over(Window.partitionBy("key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    late = F.col("ts") < F.col("newest") - F.expr(f"interval {lateness}")
    behind = F.unix_micros("newest") - F.unix_micros("ts")
    g = log.withColumn("newest", seen).groupBy("key")
    return g.agg(F.count("*").alias("n_rows"), F.count_if(late).alias("late_rows"), F.coalesce(F.max(F.when(late, behind)), F.lit(0).cast("long")).alias("most_late_us"))
