"""The count of late rows over more batches than a query remembers."""

import math
import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docflow.streaming import operators as S


def test_late_rows_of_more_than_a_hundred_batches(spark, tmp_path):
    rows = spark.range(0, 105, 1, 1).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.col("id").alias("key"))
    schema, base = rows.schema, 1_700_000_000
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(105):  # each file moves the watermark on by an hour, and from the third on brings a row far behind it
        times = [base + 3600 * i] + ([base] if i > 1 else [])
        (folder / f"f{i:04d}.json").write_text("".join(f'{{"ts": "{time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(t))}", "key": {i}}}\n' for t in times))
        os.utime(folder / f"f{i:04d}.json", (base + i, base + i))  # files are read in the order of their times
    counter = S.LateRowCounter()
    spark.streams.addListener(counter)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute")).count()
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        q = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if str(q.id) in counter.ended:
                break
            time.sleep(0.1)
        assert counter.batches[str(q.id)] > 100 and len(q.recentProgress) <= 100
        # The watermark of the batch before tells late rows, so the first row from behind is in time.
        assert counter.dropped[str(q.id)] == 102 > S.late_row_report(q)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.streams.removeListener(counter)


def test_newest_reading_of_a_dense_zone(spark, tmp_path):
    """One row an event, not one for every reading of its zone; later batches bring better readings; odd rows go."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    nan = float("nan")
    kept = [("r", 0, at(i), 1, float(i)) for i in range(0, 400)] + [("r", 0, at(350), 1, 9999.0), ("r", 0, at(360), 1, None), ("r", 0, None, 1, 5.0), ("r", 0, at(370), None, 7.0), ("r", 0, at(760), 2, nan)]
    asked = [("e", (1 << 60) + i, at(s), z, None) for i, (s, z) in enumerate([(350, 1), (360, 1), (699, 1), (700, 1), (399, 2), (-1, 1), (250, None), (770, 2)])]
    late = [("r", 0, at(698), 1, -1.0)]
    for n, part in enumerate((kept + asked, late)):
        spark.createDataFrame(part, "kind string, event_id long, ts timestamp, zone long, intensity double").coalesce(1).write.parquet(f"{tmp_path}/p{n}")
    log = lambda kind: spark.readStream.schema("kind string, event_id long, ts timestamp, zone long, intensity double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path)).filter(f"kind = '{kind}'")
    out = S.drain(S.stream_intensity(log("e").select("event_id", "zone", "ts"), log("r").select("zone", "ts", "intensity")))
    assert out.count() == 6  # two of them for the event that the late reading corrects
    got = {r.event_id - (1 << 60): r.x for r in out.groupBy("event_id").agg(F.max_by("intensity", F.struct("read_at", "intensity")).alias("x")).collect()}
    assert math.isnan(got.pop(7)) and got == {0: 9999.0, 1: 360.0, 2: -1.0, 3: -1.0}
