"""Edit-aware token counts.

A document's pre-tokens (what the tokenizer's pattern cuts before byte pairs are merged) are the
leaves of a segment tree whose nodes hold characters and tokens. Leaves are packed into runs; an edit
finds its place by descending the character sums, re-encodes only the pre-tokens it touches plus the
context on either side that the pattern may read, and updates the sums above. Encoding goes on to the
right of an edit until a new boundary meets an old one: what follows depends on the rest of the text
alone, so it stands. To the left it starts at an old boundary that the edit cannot reach: at least
`CONTEXT` characters before it, with something other than white space in between.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 16
LEAF = 64
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's public pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Tokens of a pre-token; counts of short ones are kept."""

    def __init__(self, vocabulary: str = VOCABULARY):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.pattern = regex.compile(PATTERN)

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 32:
                if len(self.known) >= 500_000:
                    self.known.clear()
                self.known[piece] = n
        return n

    def pieces(self, text: str, start: int = 0):
        """(end, tokens) of each pre-token from start."""
        for m in self.pattern.finditer(text, start):
            yield m.end(), self.tokens(m[0])

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


class TokenTree:
    """Segment tree over runs of at most LEAF pre-tokens, with sums of characters and tokens."""

    def __init__(self, text: str, count: Counter):
        self.text, self.count, self.encoded = text, count, 0
        self._build(self._cut(self._measure(0, len(text))))

    def _measure(self, start: int, stop: int) -> list[tuple[int, int]]:
        """(characters, tokens) of the pre-tokens of text from start to stop, a boundary."""
        out, at = [], start
        for end, n in self.count.pieces(self.text, start):
            out.append((end - at, n))
            at = end
            if end >= stop:
                break
        return out

    @staticmethod
    def _cut(pieces: list) -> list[list]:
        return [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]

    def _build(self, leaves: list[list]) -> None:
        self.leaves = leaves
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(leaves):
            self.chars[self.size + i] = sum(c for c, _ in leaf)
            self.sums[self.size + i] = sum(n for _, n in leaf)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def _leaf_at(self, pos: int) -> tuple[int, int]:
        """Leaf that holds character pos (the last one at the end), and where it starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if pos >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _set(self, leaf: int, pieces: list) -> None:
        self.leaves[leaf] = pieces
        i = self.size + leaf
        self.chars[i], self.sums[i] = sum(c for c, _ in pieces), sum(n for _, n in pieces)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def _restart(self, pos: int) -> int:
        """An old boundary whose left side an edit at pos cannot change."""
        leaf, start = self._leaf_at(max(0, pos - CONTEXT))
        while True:
            ends = [start]
            for c, _ in self.leaves[leaf]:
                ends.append(ends[-1] + c)
            for at in reversed(ends[:-1]):
                if at <= pos - CONTEXT and not self.text[at:pos].isspace():
                    return at
            if leaf == 0:
                return 0
            leaf -= 1
            start -= self.chars[self.size + leaf]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace text[start:stop] by new; re-encode what it touches."""
        start = min(max(0, start), len(self.text))
        stop = min(max(start, stop), len(self.text))
        old_size, begin = len(self.text), self._restart(start)
        shift = len(new) - (stop - start)
        first, first_at = self._leaf_at(begin)
        before, at = [], first_at
        for piece in self.leaves[first]:
            if at >= begin:
                break
            before.append(piece)
            at += piece[0]
        self.text = self.text[:start] + new + self.text[stop:]
        # Old boundaries at or after the edit's end, from the leaf of `stop` on.
        last, last_at = self._leaf_at(min(stop, max(0, old_size - 1)))
        made, at, done = [], begin, False
        ahead, old_at, k = self.leaves[last], last_at, 0
        for end, n in self.count.pieces(self.text, begin):
            made.append((end - at, n))
            self.encoded += 1
            at = end
            want = end - shift
            if want < stop:
                continue
            while old_at < want:
                if k == len(ahead):
                    if last + 1 >= len(self.leaves):
                        break
                    last, k = last + 1, 0
                    ahead = self.leaves[last]
                    continue
                old_at += ahead[k][0]
                k += 1
            if old_at == want:
                done = True
                break
        after = ahead[k:] if done else []
        if not done:
            last = len(self.leaves) - 1
        pieces = before + made + after
        span = last - first + 1
        if len(pieces) <= 4 * LEAF * span:
            each = -(-len(pieces) // span) or 1
            for j in range(span):
                self._set(first + j, pieces[j * each : (j + 1) * each])
        else:
            self._build(self.leaves[:first] + self._cut(pieces) + self.leaves[last + 1 :])


def recount(docs: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents (doc_id, text) and edits (doc_id, seq, start, stop, new) ->
    doc_id, n_chars, n_pretokens, n_tokens, n_edits, n_chars_after, n_tokens_after, n_encoded.

    Edits apply in order of seq to the text as it then stands; positions are in code points and are
    cut to the text. n_encoded is the pre-tokens encoded again for the edits. A null text is empty; a
    null `new` deletes; null positions are 0. A document without edits keeps its count. A doc_id that
    repeats gets the edits in each of its rows; null doc_ids get none. Other columns are ignored.
    """
    todo = edits.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("e_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("start").cast("long"), F.lit(0)).alias("start"), F.coalesce(F.col("stop").cast("long"), F.lit(0)).alias("stop"), F.coalesce(F.col("new"), F.lit("")).alias("new")))).alias("edits"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(todo, F.col("doc_id") == F.col("e_id"), "left")
    return recount_rows(rows, vocabulary)


def recount_rows(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """recount() of documents that carry their own `edits`, an array of (seq, start, stop, new) in order:
    no row is moved. A null array is no edits."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "edits").mapInArrow(_recounter(vocabulary), _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, n_pretokens long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, n_encoded long"


def _recounter(vocabulary: str):
    def run(batches):
        count = counter(vocabulary)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                doc, text = b.column(0)[i].as_py(), b.column(1)[i].as_py() or ""
                todo = [(e["start"], e["stop"], e["new"]) for e in b.column(2)[i].as_py() or ()]
                tree = TokenTree(text, count)
                was = (len(text), sum(map(len, tree.leaves)), tree.total)
                for e in todo:
                    tree.edit(*e)
                out.append((doc, *was, len(todo), len(tree.text), tree.total, tree.encoded))
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in out], schema=_ARROW)

    return run


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_ARROW = pa.schema([(n, pa.int64()) for n in _NAMES])


def planned_edits(docs: DataFrame, per_document: int = 3) -> DataFrame:
    """(doc_id, text, edits): documents with edits made from themselves, in place.

    Every row with a doc_id gets `per_document` edits at hashed places: a replacement by a passage of
    its own text, a deletion, an insertion, in turn. Rows that repeat a doc_id get their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("long")

    def edit(seq: int):
        place = lambda salt, n: F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seq), F.lit(salt)), n)
        start = place("start", size)
        new = F.lit("") if seq % 3 == 1 else F.substring(text, (place("from", size) + 1).cast("int"), place("take", F.lit(60)).cast("int") + 1)
        stop = start if seq % 3 == 2 else start + place("cut", F.lit(80))
        return F.struct(F.lit(seq).cast("long").alias("seq"), start.alias("start"), stop.alias("stop"), new.alias("new"))

    edits = F.array(*[edit(i) for i in range(per_document)])
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.when(F.col("doc_id").isNotNull(), edits).alias("edits"))
