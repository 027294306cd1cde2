"""Phrase collocations by prefix-free parsing.

Texts are parsed into chunks: a chunk starts where a piece starts or where the checksum of OVERLAP words
triggers, and ends OVERLAP words into the next one, so that each phrase of up to OVERLAP + 1 words lies whole in
the chunk that owns its first word, and only there. Equal chunks become one entry of a dictionary
with the number of times the parse holds it.
Phrases are counted inside distinct chunks, weighted by that number, length by length: those of a length are weighed
by their hash, the dictionary is narrowed to the stretches where they may be frequent, and there they
are counted. As the parts of a frequent phrase are frequent, the next length needs no more than these stretches. Which
phrases may be frequent is a bit map of fixed size; bits and hashes that several phrases share let more be
counted, and lose none.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize, text_slices

#: Bytes that end a piece all become commas (fixed by the definition), and a tab a space.
_TABLE = bytes(44 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
LONGEST = 5
OVERLAP = LONGEST - 1
#: One in so many word sequences starts a chunk; a chunk that finds none is cut after so many words.
TRIGGER, CUT = 16, 4096
#: Bits of the map of frequent phrases of one length: 8 MB for the driver and each worker.
SIEVE = 1 << 26
_BUCKET = 1 << 15


#: Entries that a worker keeps of what it knows of words.
_KNOWN = 1_000_000
_GATHER = 4 << 20


class _Checksums(dict):
    """Word -> checksum, never 0; the mark between pieces has 0."""

    def __init__(self):
        self[b","] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
            self[b","] = 0
        self[word] = h = zlib.crc32(word) or 1
        return h


class _Hashes(dict):
    """Word -> hash as Spark has it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
        self[word] = h = xxh64_intdigest(word, 42)
        return h


class _Numbers(dict):
    """Word -> running number; the mark has 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def fold(key, h):
    """The key of a word sequence one word longer; the language is its first word."""
    return (key << np.uint64(5)) ^ (key >> np.uint64(2)) ^ h


def held(sieve: np.ndarray, key):
    bit = key & np.uint64(SIEVE - 1)
    return (sieve[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 != 0


def phrase_key(lang: str = "lang", phrase: str = "phrase"):
    """fold() over the language and the words of a phrase."""
    return F.aggregate(
        F.transform(F.concat(F.array(lang), F.split(phrase, " ")), lambda w: F.xxhash64(w)),
        F.lit(0).cast("long"),
        lambda k, h: F.shiftleft(k, 5).bitwiseXOR(F.shiftrightunsigned(k, 2)).bitwiseXOR(h),
    )


def sieve_of(keys: DataFrame) -> np.ndarray:
    """Bit map of a table's keys; at most SIEVE bits reach the driver, whatever the table's size."""
    bit = keys.select(F.pmod("key", F.lit(SIEVE)).alias("h"))
    rows = bit.groupBy(F.expr(f"h div {_BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.expr(f"h % {_BUCKET}")).alias("bits")).collect()
    out = np.zeros(SIEVE // 8, np.uint8)
    for r in rows:
        out[r.bucket * _BUCKET // 8 : (r.bucket + 1) * _BUCKET // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _gathered(batches, column: str):
    """Arrow batches of small rows put together, of large ones cut, to a few MB each."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.column(column).nbytes
        if size >= _GATHER:
            yield from text_slices(pa.Table.from_batches(kept).combine_chunks().to_batches()[0], column)
            kept, size = [], 0
    if size:
        yield from text_slices(pa.Table.from_batches(kept).combine_chunks().to_batches()[0], column)


def _by_lang(batch: pa.RecordBatch):
    """(lang, rows) of each language of an Arrow batch whose first column is the language."""
    for lang in pc.unique(batch.column(0)).to_pylist():
        yield lang, batch.filter(pc.equal(batch.column(0), lang))


def _pieces(rows: pa.RecordBatch) -> bytes:
    """The texts in lower case (A-Z), their pieces parted by commas."""
    return b",".join(rows.column(1).cast(pa.binary()).to_pylist()).lower().translate(_TABLE)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _column(lang: str, n: int) -> pa.Array:
    return pa.array([lang] * n, pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """documents -> lang, phrase, a of all single words."""
    def rows_of(lang, seen):
        return pa.RecordBatch.from_arrays([_column(lang, len(seen)), pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "phrase", "a"])

    def run(batches):
        counts: dict[str, Counter] = {}
        for part in _gathered(batches, "text"):
            for lang, rows in _by_lang(part):
                counts.setdefault(lang, Counter()).update(_pieces(rows).replace(b",", b" ").split())
            if sum(map(len, counts.values())) > _KNOWN // 2:
                yield from (rows_of(*x) for x in counts.items())
                counts = {}
        yield from (rows_of(*x) for x in counts.items())

    return _texts(docs).mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def parse(data: bytes, checksums: dict) -> tuple[Counter, Counter]:
    """Chunks of comma-parted text with their counts: those that end their piece, and those with an overlap behind them. Single words are no chunks."""
    words = data.replace(b",", b" , ").split()
    n = len(words)
    h = np.fromiter(map(checksums.__getitem__, words), np.uint64, n)
    place = np.arange(n)
    mark = h == 0
    before = np.maximum.accumulate(np.where(mark, place, -1))
    until = np.minimum.accumulate(np.where(mark, place, n)[::-1])[::-1]
    mixed = np.zeros(n, np.uint64)
    for k in range(OVERLAP):
        mixed[: max(0, n - k)] = (mixed[: max(0, n - k)] + h[k:]) * np.uint64(0x9E3779B97F4A7C15)
    inner = (mixed >> np.uint64(40)) % np.uint64(TRIGGER) == 0
    begins = (place == np.append(-1, before)[:n] + 1) | ((inner | ((place - before - 1) % CUT == 0)) & (place + OVERLAP <= until))
    a = np.flatnonzero(begins & ~mark)
    end = until[a]
    own = np.minimum(np.append(a[1:], n), end)
    whole = own == end
    longer = whole & (end - a > 1)
    cut = lambda x, y: Counter(b" ".join(words[i:j]) for i, j in zip(x.tolist(), y.tolist()))
    return cut(a[longer], own[longer]), cut(a[~whole], own[~whole] + OVERLAP)


def _entries(df: DataFrame, run) -> DataFrame:
    """The dictionary that run gives parts of: lang, chunk, own, n; phrases that start in the first `own` words of a chunk are the chunk's."""
    return df.mapInArrow(run, "lang string, chunk string, own int, n long").groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


def _entry_rows(lang: str, chunks: list[bytes], own, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(lang, len(chunks)), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(own, pa.int32()), pa.array(n, pa.int64())], names=["lang", "chunk", "own", "n"])


def chunks(docs: DataFrame) -> DataFrame:
    """documents -> the dictionary of distinct chunks a language."""
    def run(batches):
        checksums = _Checksums()
        for part in _gathered(batches, "text"):
            for lang, rows in _by_lang(part):
                for found, behind in zip(parse(_pieces(rows), checksums), (0, OVERLAP)):
                    yield _entry_rows(lang, list(found), [t.count(b" ") + 1 - behind for t in found], list(found.values()))

    return _entries(_texts(docs), run)


def _chunk_words(rows: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of all chunks with a comma between two, where they are commas, each word's chunk, and its place in it."""
    words = b" , ".join(rows.column(1).cast(pa.binary()).to_pylist()).split(b" ")
    sizes = np.fromiter((t.count(b" ") for t in rows.column(1).cast(pa.binary()).to_pylist()), np.int64, rows.num_rows) + 2
    chunk = np.repeat(np.arange(len(sizes)), sizes)[:-1]
    starts = np.append(0, np.cumsum(sizes)[:-1])
    return words, starts[1:] - 1, chunk, np.arange(len(words)) - starts[chunk]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and where each key begins in it."""
    order = np.argsort(key)
    sorted_ = key[order]
    return order, np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(key) else np.zeros(0, np.int64)


def count_inside(rows: pa.RecordBatch, length: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct phrases of `length` words that the chunks of one language own, and their weighted counts."""
    words, marks, chunk, offset = _chunk_words(rows)
    number = np.fromiter(map(_Numbers({b",": 0}).__getitem__, words), np.int64, len(words))
    at = np.flatnonzero((number != 0) & (offset < rows.column(2).to_numpy()[chunk]))
    left = np.append(marks, len(words))[chunk[at]] - at  # words from here to the chunk's end
    at = at[left >= length]
    gram = number[at]
    for k in range(1, length):
        if k > 1:  # shorter phrases are numbered anew, so that two numbers fit one key
            order, first = _groups(gram)
            gram[order] = np.cumsum(np.bincount(first, minlength=len(order))) if len(order) else 0
        gram = gram * (number.max(initial=0) + 1) + number[at + k]
    order, first = _groups(gram)
    if not len(order):
        return [], np.zeros(0, np.int64)
    total = np.add.reduceat(rows.column(3).to_numpy()[chunk[at[order]]], first)
    return [b" ".join(words[p : p + length]) for p in at[order[first]].tolist()], total


def counts(dictionary: DataFrame, length: int) -> DataFrame:
    """The dictionary -> lang, phrase, a of phrases of one length, a being its count in all texts."""
    def run(batches):
        for part in _gathered(batches, "chunk"):
            for lang, rows in _by_lang(part):
                found, total = count_inside(rows, length)
                yield pa.RecordBatch.from_arrays([_column(lang, len(found)), pa.array(found, pa.binary()).cast(pa.string()), pa.array(total, pa.int64())], names=["lang", "phrase", "a"])

    return dictionary.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _keys(lang: str, words: list[bytes], marks: np.ndarray, length: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The key of the `length` words from each place on, and where they lie in one chunk."""
    n = len(words)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    key = fold(np.zeros(n, np.uint64), np.uint64(xxh64_intdigest(lang.encode(), 42)))
    for k in range(length):
        key = fold(key[: max(0, n - k)], h[k:])
    inside = np.ones(len(key), bool)
    for k in range(length):
        at = marks[marks >= k] - k
        inside[at[at < len(key)]] = False
    return key, inside


def weighed(dictionary: DataFrame, length: int, sieve=None) -> DataFrame:
    """The dictionary -> key, a: the occurrences of all phrases of `length` words that share a key. sieve: broadcast bit map of words; phrases with others are left out."""
    def run(batches):
        hashes = _Hashes()
        for part in _gathered(batches, "chunk"):
            for lang, rows in _by_lang(part):
                words, marks, chunk, offset = _chunk_words(rows)
                n = max(0, len(words) - length + 1)
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                key = word = fold(fold(np.uint64(0), np.uint64(xxh64_intdigest(lang.encode(), 42))), h)
                often = held(sieve.value, word) if sieve else np.ones(len(words), bool)
                often[marks] = False
                mine = often[:n] & (offset < rows.column(2).to_numpy()[chunk])[:n]
                for k in range(1, length):
                    key = fold(key[:-1], h[k:])
                    mine &= often[k : n + k]
                at = np.flatnonzero(mine)
                order, first = _groups(key[at])
                total = np.add.reduceat(rows.column(3).to_numpy()[chunk[at[order]]], first) if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[at[order[first]]].view(np.int64)), pa.array(total, pa.int64())], names=["key", "a"])

    return dictionary.mapInArrow(run, "key long, a long").groupBy("key").agg(F.sum("a").alias("a"))


def narrow(dictionary: DataFrame, length: int, sieve) -> DataFrame:
    """The dictionary of the longest stretches of which all phrases of `length` words may be frequent."""
    def run(batches):
        hashes = _Hashes()
        for part in _gathered(batches, "chunk"):
            for lang, rows in _by_lang(part):
                words, marks, chunk, offset = _chunk_words(rows)
                key, inside = _keys(lang, words, marks, length, hashes)
                alive = np.zeros(len(key) + 2, bool)
                alive[1:-1] = inside & held(sieve.value, key)
                turns = np.flatnonzero(alive[1:] != alive[:-1])
                a, b = turns[::2], turns[1::2] + length - 1
                own = np.minimum(rows.column(2).to_numpy()[chunk[a]] - offset[a], b - a) if len(a) else a
                a, b, own = a[own > 0], b[own > 0], own[own > 0]
                yield _entry_rows(lang, [b" ".join(words[i:j]) for i, j in zip(a.tolist(), b.tolist())], own, rows.column(3).to_numpy()[chunk[a]] if len(a) else a)

    return _entries(dictionary, run)


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Word totals as (lang, n), and tables of phrases of 1, 2, ... LONGEST words that occur `least` times, as (lang, phrase, a)."""
    share = lambda keys: docs.sparkSession.sparkContext.broadcast(sieve_of(keys))
    often = F.col("a") >= least
    every = materialize(word_counts(docs), "words")
    tables = [every.filter(often)]
    dictionary = materialize(chunks(docs), "chunks")
    words = share(tables[0].select(phrase_key().alias("key")))
    for length in range(2, LONGEST + 1):
        keys = weighed(dictionary, length, words if length == 2 else None).filter(often)
        dictionary = materialize(narrow(dictionary, length, share(keys)), f"chunks-{length}")
        tables.append(materialize(counts(dictionary, length).filter(often), f"phrases-{length}"))
    return every.groupBy("lang").agg(F.sum("a").alias("n")), tables


def collocations(docs: DataFrame, least: int = 100) -> DataFrame:
    """documents -> lang, phrase, a, l, r, n, score: phrases of 2 to LONGEST words that occur `least` times and lie in no longer one as frequent.

    Texts are lower-cased (A-Z) and cut into pieces at . , ; : ! ? and line ends, pieces into words at
    spaces and tabs; a phrase lies in one piece. n counts the words of the language, a the phrase's occurrences,
    overlaps included; l and r those of its two parts at the cut of the lowest score
    floor(1000 a n / (l r)), of equal ones the first. Null texts are empty, a null language is `und`, texts
    without words give nothing, repeated rows count each time, other columns are ignored; no
    phrase so frequent or no rows: no rows out.
    """
    total, tables = frequent_phrases(docs, least)
    known = tables[0]
    for t in tables[1:-1]:
        known = known.unionByName(t)
    found = tables[1]
    for t in tables[2:]:
        found = found.unionByName(t)
    found = found.withColumn("w", F.split("phrase", " "))
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    cuts = cuts.join(known.selectExpr("lang", "phrase as first", "a as l"), ["lang", "first"]).join(known.selectExpr("lang", "phrase as rest", "a as r"), ["lang", "rest"]).join(total, "lang")
    # Decimals of 38 digits: exact far beyond 64 bits, and an error rather than a wrong figure beyond that.
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("top", (big("a") * big("n") * F.lit(1000)).cast("decimal(38,0)")).withColumn("below", (big("l") * big("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("top div below"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    inside = found.filter("size(w) > 2").select("lang", "a", "w", F.explode(F.expr("sequence(2, size(w) - 1)")).alias("m"))
    inside = inside.select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, size(w) - m + 1)")).alias("i"))
    inside = inside.groupBy("lang", F.expr("array_join(slice(w, i, m), ' ')").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < b.a")
    return kept.select("lang", "phrase", *[F.col(f"b.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def top_phrases(docs: DataFrame, first: int = 2000, least: int = 100) -> DataFrame:
    """The `first` rows of collocations() a language by score, a (both descending) and phrase (ascending bytes), with their rank from 1.

    Nulls, repeats, empty tables and other columns as in collocations(). A language's rows are cut to
    `first` in many parts before they meet in one.
    """
    rows = collocations(docs, least).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
