"""Toxicity by weak supervision.

Voters are lexicons and patterns. Lexicon entries are words, beginnings of words, and beginnings that two or three different
words of a text share; they are looked for on a bounded sample of labelled rows outside the held-out fold, near copies counted
once (else every word of a much copied toxic document would look like a toxic word). An entry must be hardly known to
clean texts (PURITY), and so telling that at most one false entry of its kind is to be expected by chance, at any size of the table. Entries of a kind are dealt into voters by their evidence. Some
pattern voters look at how many entries a text hits, others at its shape alone. A generative model of the
votes (two latent classes, fitted by expectation maximisation, the labels being one voter of fixed accuracy) estimates each voter's rates in either
class, given the vote of one other voter where the two hang together (a tree of pairwise terms, the
pairs chosen by their information). A linear classifier is trained on the model's posterior labels
and scores whole texts in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import fresh, materialize, share_below

#: Labelled rows the model is fitted on, at most.
SAMPLE = 20_000
FOLDS = 5
#: Bytes that part words: all ASCII but small letters (texts are lower-cased first).
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BEGINNINGS = (4, 5, 6, 7)
VOTERS_A_KIND = 4
#: Whole words, then for each beginning: a word, two words, three words that share it.
KINDS = 1 + 3 * len(BEGINNINGS)
#: Rows that a candidate of a kind must be in, toxic ones at least.
LEAST = [3, *[3] * len(BEGINNINGS), *[3] * len(BEGINNINGS), *[2] * len(BEGINNINGS)]
PATTERNS = 6
#: Least share of toxic documents among those with a lexicon entry.
PURITY = 0.9
#: Minimum hashes that tell near copies: a row stays if it comes first among its equals in each.
SKETCH = 4


def distinct_words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def traits(words: set[bytes]) -> list[tuple[int, bytes]]:
    """(kind, entry) of a text's distinct words."""
    out = [(0, w) for w in words]
    for k, n in enumerate(BEGINNINGS, 1):
        for start, times in Counter(w[:n] for w in words if len(w) >= n).items():
            out += [(k + i * len(BEGINNINGS), start) for i in range(min(3, times))]
    return out


def shape(text: str) -> tuple[bool, bool]:
    """Mostly capitals; a word three times in a row. Neither looks at what the words are."""
    small, words = sum(map(text.count, "aeinrst")), text.split()
    return sum(map(text.count, "AEINRST")) > max(10, small), any(a == b == c for a, b, c in zip(words, words[1:], words[2:]))


def sketch(text: str | None) -> list[int]:
    """SKETCH minimum hashes of the three-word shingles; equal texts have equal ones, near copies most."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = np.fromiter(map(xxh64_intdigest, shingles), np.uint64, len(shingles))
    out = []
    for k in range(SKETCH):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        out.append(int(h.min().view(np.int64)))
    return out


def one_of_each(rows: DataFrame) -> DataFrame:
    """(l_id, text, toxic) -> (text, toxic) without near copies; rows are a bounded sample."""
    def run(batches):
        for b in batches:
            marks = pa.array([sketch(t.as_py()) for t in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, marks], names=[*b.schema.names, "marks"])

    df = rows.select("l_id", "text", "toxic").mapInArrow(run, "l_id long, text string, toxic int, marks array<long>")
    df = materialize(df, "toxic-sample")
    kept = df
    for k in range(SKETCH):
        first = df.groupBy(F.get("marks", F.lit(k)).alias("mark")).agg(F.min("l_id").alias("l_id")).select("l_id")
        kept = kept.join(first, "l_id", "left_semi")
    return kept.select("text", "toxic")


@dataclass
class Model:
    """voter_of: (kind, entry) -> voter."""

    voter_of: dict[tuple[int, bytes], int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    base: float = 0.0

    def __post_init__(self):
        #: Beginnings that entries of any count have, and the entries that one word gives.
        self.shared = {entry for kind, entry in self.voter_of if kind > len(BEGINNINGS)}

    def _known(self, word: bytes) -> tuple[list[int], list[bytes]]:
        """Voters that the word alone moves, and beginnings to be counted."""
        starts = [word[:n] for n in BEGINNINGS if len(word) >= n]
        ones = [(0, word), *((k, word[:n]) for k, n in enumerate(BEGINNINGS, 1) if len(word) >= n)]
        return [self.voter_of[t] for t in ones if t in self.voter_of], [x for x in starts if x in self.shared]

    def votes(self, text: str | None, memo: dict) -> np.ndarray:
        """1 where a voter votes toxic: lexicon voters first, then the patterns."""
        words, out = distinct_words(text), np.zeros(KINDS * VOTERS_A_KIND + PATTERNS)
        clean, known = memo.setdefault("clean", set()), memo.setdefault("known", {})
        if len(clean) > 1_000_000:
            clean.clear()
        bad, hits, counted = 0, 0, Counter()
        for w in words - clean:
            if w not in known:
                known[w] = self._known(w)
                if not any(known[w]):
                    del known[w]
                    clean.add(w)
                    continue
            found, starts = known[w]
            counted.update(starts)
            if found:
                bad += 1
                hits += len(found)
                out[found] = 1
        for start, times in counted.items():
            for i in range(1, min(3, times)):
                voter = self.voter_of.get((BEGINNINGS.index(len(start)) + 1 + i * len(BEGINNINGS), start))
                if voter is not None:
                    hits += 1
                    out[voter] = 1
        out[-PATTERNS:] = bad >= 2, bad >= 3, hits >= 2, hits >= 4, *shape(text or "")
        return out

    def score(self, text: str | None, memo: dict) -> float:
        if self.weights is None:
            return self.base
        x = self.votes(text, memo)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30))))


def held_out(doc_id: str = "doc_id"):
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % FOLDS == 0


def pair_tree(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each voter the voter that it hangs on, given the class, or -1: the forest of most information (Chow and Liu).

    A pair counts only if its information pays for its parameters (the logarithm of the rows, halved, for each class).
    """
    n, m = votes.shape
    info = np.zeros((m, m))
    for w in (p, 1 - p):
        total = w.sum() + 1e-9
        one = (w @ votes) / total
        both = (votes * w[:, None]).T @ votes / total
        for cell, x, y in ((both, one[:, None], one[None]), (one[:, None] - both, one[:, None], 1 - one[None]), (one[None] - both, 1 - one[:, None], one[None]), (1 - one[:, None] - one[None] + both, 1 - one[:, None], 1 - one[None])):
            cell, apart = np.clip(cell, 0, 1), x * y
            info += total * np.where((cell > 1e-12) & (apart > 1e-12), cell * np.log(np.maximum(cell, 1e-12) / np.maximum(apart, 1e-12)), 0)
    info -= np.log(max(n, 2))
    np.fill_diagonal(info, -np.inf)
    parent, inside = np.full(m, -1), np.zeros(m, bool)
    best, via = np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):
        i = int(np.where(inside, -np.inf, best).argmax()) if (~inside & (best > 0)).any() else int(np.flatnonzero(~inside)[0])
        parent[i] = via[i] if best[i] > 0 else -1
        inside[i] = True
        closer = info[i] > best
        best[closer], via[closer] = info[i][closer], i
    return parent


def rates(votes: np.ndarray, p: np.ndarray, parent: np.ndarray, hold: float = 2.0) -> np.ndarray:
    """P(voter votes toxic | class, parent's vote) as (class, parent's vote, voter), rare cases held near the voter's rate in the class."""
    above = np.where(parent >= 0, votes[:, parent], 0.0)
    out = np.empty((2, 2, votes.shape[1]))
    for c, w in enumerate((1 - p, p)):
        alone = (w @ votes + (0.5 if c else 0.05)) / (w.sum() + 1.0)
        for v, side in enumerate((1 - above, above)):
            out[c, v] = (w @ (votes * side) + hold * alone) / (w @ side + hold)
    return np.clip(out, 1e-4, 1 - 1e-4)


#: How far the label model trusts a label: a voter of this accuracy.
TRUST = 0.98


def posterior(votes: np.ndarray, prior: float, rate: np.ndarray, parent: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """P(toxic | votes, and labels as one voter more) under the model.

    With labels a voter that is silent says nothing: texts of which only one lexicon knows the words would else be drowned. Without them
    silence counts as well, as nothing else tells a lone vote from several.
    """
    above = np.where(parent >= 0, votes[:, parent], 0.0)
    z = np.full(len(votes), np.log(prior / (1 - prior)))
    if labels is not None:
        z += (2 * labels - 1) * np.log(TRUST / (1 - TRUST))
    for c, sign in ((1, 1), (0, -1)):
        q = np.where(above > 0, rate[c, 1], rate[c, 0])
        z += sign * (votes * np.log(q) + ((1 - votes) * np.log(1 - q) if labels is None else 0)).sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(k, n, rate: float):
    """Logarithm of the likelihood ratio of k toxic among n rows against the common rate."""
    share = np.clip(k / n, 1e-12, 1 - 1e-12)
    return k * np.log(share / rate) + (n - k) * np.log((1 - share) / (1 - rate))


def least_evidence(sizes: dict[int, int], pure: list[tuple[int, int]], rate: float, least: int, most_false: float = 1.0) -> float:
    """The evidence from which on at most `most_false` entries of a kind are to be expected by chance, and at most a third of those found.

    sizes: how many candidates have n rows; pure: (k, n) of those found. A candidate without bearing has as many toxic rows
    as n draws at the common rate.
    """
    chance: list[tuple[float, float]] = []
    for n, many in sizes.items():
        p = (1 - rate) ** n
        for k in range(n + 1):
            if k >= least and k / n >= max(PURITY, rate):
                chance.append((float(evidence(k, n, rate)), many * p))
            p *= (n - k) / (k + 1) * rate / (1 - rate)
    chance.sort(reverse=True)
    expected, at, out = 0.0, 0, float("inf")
    found = sorted((float(evidence(k, n, rate)) for k, n in pure), reverse=True)
    for i, x in enumerate(found):
        if i + 1 < len(found) and found[i + 1] == x:
            continue
        while at < len(chance) and chance[at][0] >= x - 1e-9:
            expected += chance[at][1]
            at += 1
        if expected > most_false:
            break
        if expected <= (i + 1) / 3:
            out = x
    return out


def label_model(votes: np.ndarray, balance: float | None = None, labels: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Posterior of the toxic class from 0/1 votes; starts from the number of lexicon votes. Labels, where there are any, are a voter of accuracy TRUST.

    The balance of the classes is given, or the share of texts with two votes: votes for one class alone do not tell it.
    """
    lexicon = votes[:, : KINDS * VOTERS_A_KIND].sum(1) if votes.shape[1] > PATTERNS else votes.sum(1)
    p = np.where(lexicon >= 2, 0.95, np.where(lexicon >= 1, 0.6, 0.02))
    prior = float(np.clip((lexicon >= 2).mean() if balance is None else balance, 1e-3, 0.4))
    parent = np.full(votes.shape[1], -1)
    for r in range(rounds):
        if r in (3, 10):
            parent = pair_tree(votes, p)
        new = posterior(votes, prior, rates(votes, p, parent), parent, labels)
        if np.abs(new - p).max() < 1e-6 and r > 10:
            break
        p = new
    return p


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the first weight is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    keep[0] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(keep), x.T @ (y - q) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, keep=None) -> DataFrame:
    """(l_id, text, label): about `sample` distinct labelled texts, at random by hash; the larger of repeated labels.

    Both the labels and the rows they meet are counted first and then drawn by a threshold, so that
    neither many labels nor many texts of one doc_id reach one task or the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(label).cast("int").alias(label))
    known = known if keep is None else known.filter(keep)
    # The broadcast side is bounded by this draw: twice the sample, give or take its root.
    known = known.filter(share_below(2 * sample / max(1, known.count()), "l_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("l_id"), F.xxhash64("text").alias("h")).join(F.broadcast(known.select("l_id")), "l_id")
    share = sample / max(1, rows.distinct().count())
    met = docs.select(F.col("doc_id").cast("long").alias("l_id"), F.col("text").cast("string")).join(F.broadcast(known), "l_id")
    return met.filter(share_below(share, "l_id", "text")).dropDuplicates(["l_id", "text"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about `sample` labelled texts outside the held-out fold, drawn by hash."""
    rows = one_of_each(labelled(docs, labels, "toxic", sample, ~held_out("l_id"))).persist()
    try:
        count = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, total = count.get(1, 0), sum(count.values())
        if not toxic or toxic == total:
            return Model(base=1.0 if toxic else 0.0)

        def spread(batches):
            for b in batches:
                for part in range(0, b.num_rows, 256):
                    cut, kinds, entries, ys = b.slice(part, 256), [], [], []
                    for t, y in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist()):
                        found = traits(distinct_words(t))
                        kinds += [k for k, _ in found]
                        entries += [x for _, x in found]
                        ys += [y] * len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(entries, pa.binary()), pa.array(ys, pa.int64())], names=["kind", "entry", "toxic"])

        k, n = F.col("bad"), F.col("n")
        least = F.element_at(F.array(*[F.lit(x) for x in LEAST]), F.col("kind") + 1)
        seen = materialize(rows.mapInArrow(spread, "kind int, entry binary, toxic long").groupBy("kind", "entry").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).filter(n >= least), "toxic-traits")
        rate = toxic / total
        sizes: dict[int, dict[int, int]] = {}
        # As many rows as kinds and numbers of texts, of which the sample has SAMPLE at most.
        for r in seen.groupBy("kind", "n").count().collect():
            sizes.setdefault(r.kind, {})[r.n] = r["count"]
        found = seen.filter((k >= least) & (k / n >= max(PURITY, rate))).collect()
        lexicon = []
        for kind in range(KINDS):
            own = [r for r in found if r.kind == kind]
            bar = least_evidence(sizes.get(kind, {}), [(r.bad, r.n) for r in own], rate, LEAST[kind])
            lexicon += [(kind, bytes(r.entry), x) for r in own if (x := float(evidence(r.bad, r.n, rate))) >= bar - 1e-9]
        if not lexicon and found:  # nothing stands out: the best there is
            best = max(float(evidence(r.bad, r.n, rate)) for r in found)
            lexicon = [(r.kind, bytes(r.entry), best) for r in found if float(evidence(r.bad, r.n, rate)) == best]
        voter_of = {}
        for kind in range(KINDS):
            own = sorted((-x, entry) for k_, entry, x in lexicon if k_ == kind)
            voter_of |= {(kind, entry): kind * VOTERS_A_KIND + i * VOTERS_A_KIND // len(own) for i, (_, entry) in enumerate(own)}
        model = Model(voter_of, base=rate)

        def vote(batches):
            memo: dict = {}
            for b in batches:
                out = [model.votes(t.as_py(), memo).astype(np.uint8).tobytes() for t in b.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1)], names=["votes", "toxic"])

        cast = rows.mapInArrow(vote, "votes binary, toxic int").collect()
    finally:
        rows.unpersist()
    votes = np.frombuffer(b"".join(bytes(r.votes) for r in cast), np.uint8).reshape(len(cast), -1).astype(float)
    model.weights = fit_linear(votes, label_model(votes, rate, np.array([r.toxic for r in cast], float)))
    return model


def with_score(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """docs with one more column, the score of its text, and the column's name; all others are carried."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    [name] = fresh(docs, "toxic_score")
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    docs = docs.withColumn(docs.columns[at], F.col("text").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        m, memo = shared.value, {}
        for b in batches:
            scores = pa.array([m.score(t.as_py(), memo) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, name])

    return docs.mapInArrow(run, f"{fields}, `{name}` double"), name


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) for every row of docs.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0. Null and empty texts
    hit no voter and score low; repeated rows score alike; a null doc_id counts as the empty text in
    the fold rule. Without labels of both classes every score is 0 (1 if all labels are 1). Of
    labels that repeat a doc_id the larger counts. Empty documents give no rows.
    """
    model = train(docs, labels, sample)
    out, score = with_score(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of docs that score under 0.5, all columns as they came, whatever their names; nulls and repeats as in toxicity()."""
    out, score = with_score(docs, train(docs, labels, sample))
    return out.filter(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
