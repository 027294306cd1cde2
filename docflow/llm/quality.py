"""Quality by hierarchical empirical Bayes.

A document classifier (logistic regression on byte statistics of the whole text, fitted on about
`sample` distinct labelled rows outside the held-out fold) gives each document its own evidence. Hosts and paths get Beta posteriors by grouped
aggregation: a path is shrunk toward its host, a host toward the global rate, with strengths fitted
by moments over all groups, so that sparse sites fall back on their parents. A document's posterior
combines its evidence with the posterior of its path, its own share left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, share_below
from .toxicity import fit_linear, held_out

SAMPLE = 20_000
FEATURES = 11


def _classes() -> np.ndarray:
    """Byte -> class: 0 other, 1 small, 2 capital, 3 digit, 4 white space, 5 sentence mark, 6 symbol."""
    out = np.zeros(256, np.int64)
    for lo, hi, c in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (9, 13, 4), (32, 32, 4), (33, 47, 6), (58, 64, 6), (91, 96, 6), (123, 126, 6)):
        out[lo : hi + 1] = c
    out[[ord(c) for c in ".,;:?'\"-"]] = 5
    return out


_CLASS = _classes()


def _packed(data: bytes) -> float:
    """Compressed share of the whole text, fed in pieces."""
    z = zlib.compressobj(1)
    return (sum(len(z.compress(data[at : at + (1 << 16)])) for at in range(0, len(data), 1 << 16)) + len(z.flush())) / len(data)


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes, runs of symbols, repeated lines and words, word and line lengths, compression."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(FEATURES)
    b = np.frombuffer(data, np.uint8)
    c = _CLASS[b]
    n = len(b)
    share = np.bincount(c, minlength=7) / n
    words, lines = data.split(), data.split(b"\n")
    pairs = float(((c[1:] == 6) & (c[:-1] == 6)).sum()) / n
    letters = share[0] + share[1] + share[2] + 1e-9
    return np.array([
        share[2] / letters, share[3] * 10, share[5] * 10, share[6] * 10, pairs * 10,
        1 - len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / len(lines),
        min(n / max(1, len(words)), 20) / 10, np.log1p(n) / 10, np.log1p(n / len(lines)) / 10,
        _packed(data),
    ])


def site_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, keep_at: float = 0.5) -> DataFrame:
    """documents + labels -> doc_id, evidence, host_rate, path_rate, quality, keep.

    evidence is the classifier's log odds, quality the posterior (0 to 1), keep quality >= keep_at.
    host and path name the columns of the two levels; their nulls are one group each. Null and empty
    texts have zero features. Repeated rows count each time. Without labels of both classes the
    evidence is 0 and the rates are 0.5. Other columns are ignored. Empty in, empty out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("\0")).alias("path"), F.col("text").cast("string"))

    def run(batches):
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x, pa.binary())], names=["doc_id", "host", "path", "x"])

    seen = materialize(rows.mapInArrow(run, "doc_id long, host string, path string, x binary"), "quality-features")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("quality").alias("y")).filter(~held_out("l_id"))
    # Labels and the rows they meet are each counted and then drawn by a threshold, so that neither many
    # labels nor many rows of one doc_id reach one task or the driver.
    known = known.filter(share_below(2 * sample / max(1, known.count()), "l_id"))
    met = seen.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("l_id", "x", "y").distinct()
    train = met.filter(share_below(sample / max(1, met.count()), "l_id", "x")).select("x", "y").collect()
    y = np.array([r.y for r in train], float)
    x = np.array([np.frombuffer(r.x) for r in train]).reshape(len(train), FEATURES)
    rate = float(y.mean()) if len(y) else 0.5
    w = fit_linear(x, y, 1e-2) if 0 < rate < 1 else None

    def judge(batches):
        for b in batches:
            m = np.frombuffer(b"".join(b.column(3).to_pylist()), float).reshape(-1, FEATURES)
            z = np.zeros(len(m)) if w is None else np.clip(m @ w[1:] + w[0], -30, 30)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z)], names=["doc_id", "host", "path", "evidence"])

    scored = seen.mapInArrow(judge, "doc_id long, host string, path string, evidence double")
    p = 1 / (1 + F.exp(-F.col("evidence")))
    scored = scored.withColumn("p", p)
    paths = scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    top = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    prior = min(max(top.s / top.n if top.n else 0.5, 1e-3), 1 - 1e-3)

    def strength(groups: DataFrame, mean, n, parent) -> float:
        """Pseudo-documents of the parent: by moments, from the spread of group means around their parent's beyond sampling."""
        m = groups.filter(n >= 2).agg(F.avg((mean - parent) ** 2).alias("v"), F.avg(parent * (1 - parent) / n).alias("e"), F.avg(parent * (1 - parent)).alias("s")).first()
        between = max((m.v or 0.0) - (m.e or 0.0), 1e-4)
        return float(min(max((m.s or 0.25) / between - 1, 1.0), 1e4))

    groups = paths.join(hosts, "host")
    kh = strength(hosts, F.col("hs") / F.col("hn"), F.col("hn"), F.lit(prior))
    # A path that is all of its host says nothing about the spread within hosts.
    kp = strength(groups.filter("n < hn"), F.col("s") / F.col("n"), F.col("n"), F.col("hs") / F.col("hn"))
    out = scored.join(groups, ["host", "path"])
    others = lambda s, n, k, mean: (F.col(s) - F.col("p") + k * mean) / (F.col(n) - 1 + k)
    out = out.withColumn("host_rate", others("hs", "hn", kh, F.lit(prior)))
    out = out.withColumn("path_rate", others("s", "n", kp, F.col("host_rate")))
    odds = lambda r: F.log(r / (1 - r))
    bounded = F.least(F.greatest(F.col("path_rate"), F.lit(1e-3)), F.lit(1 - 1e-3))
    z = F.col("evidence") + odds(bounded) - odds(F.lit(prior))
    out = out.withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= keep_at).alias("keep"))
