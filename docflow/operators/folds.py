"""Operators whose next step depends on all that came before in a document: chunking, merging, packing.

Rows are dealt by document, sorted inside their partition and read as a stream of Arrow batches; an ordered fold runs
over each document's rows (a document is the bound): no task per document, one shuffle on doc_id. Of a batch only a few
rows are Python objects at a time, and what folds give leaves in batches of a few megabytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Token limits of chunks and sections, similarities, overlap, growth of packs, headings never merged into.
CHUNK_MAX, CHUNK_MIN, CHUNK_SIMILARITY, OVERLAP = 1500, 500, 0.15, 40
SECTION_TARGET, SECTION_MIN, SECTION_MAX, SECTION_SIMILARITY = 800, 450, 1200, 0.28
PACK_GROWTH, PACK_ROUNDS, TINY_SIMILARITY = 1.75, 8, 0.1
HARD_HEADING = re.compile(r"^(?:appendix|references|bibliography|glossary|index|acknowledg|chapter\s+\d|part\s+[ivxlcdm\d]|article\s+\d)", re.I)
_WORD = re.compile("[a-zA-Z]{3,}")
GAP = "\n\n"
#: Rows of an Arrow batch that are Python objects at a time, and characters of text after which results are sent on.
ROWS, HELD = 64, 1 << 20
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4)


def similarity(a: str, b: str) -> float:
    x, y = set(_WORD.findall(a.lower())), set(_WORD.findall(b.lower()))
    return len(x & y) / len(x | y) if x and y else 0.0


def streamed(batches: Iterable[pa.RecordBatch], work: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """What work gives for the rows of all batches, as batches of about HELD characters; columns that come in keep their type."""
    known = {name: _ARROW.get(kind) for name, kind in (c.split(" ", 1) for c in schema.split(", "))}
    names = list(known)

    def rows():
        for b in batches:
            known.update({f.name: f.type for f in b.schema if known.get(f.name, f.type) is None})
            for at in range(0, b.num_rows, ROWS):
                yield from b.slice(at, ROWS).to_pylist()

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, known[n]) for c, n in zip(zip(*held), names)], names=names)

    held, size = [], 0
    for t in work(rows()):
        held.append(t)
        size += 64 + sum(len(v) for v in t if isinstance(v, str))
        if size >= HELD:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def fold_documents(rows: DataFrame, order: str, fields: list[str], fold: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run fold over each document's rows in order; its tuples follow doc_id in the result."""
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {schema}"

    def folded(stream):
        return ((doc, *t) for doc, items in groupby(stream, itemgetter("doc_id")) for t in fold(list(items)))

    dealt = rows.select("doc_id", order, *fields).repartition("doc_id").sortWithinPartitions("doc_id", order, *fields)
    return dealt.mapInArrow(lambda batches: streamed(batches, folded, schema), schema)


CHUNK = "chunk_index int, kind string, parent int, title string, content string, tokens int, reason string"


@dataclass
class _Chunker:
    most: int
    least: int
    near: float
    overlap: int
    out: list = field(default_factory=list)
    held: list = field(default_factory=list)
    parent: int = -1
    title: str = ""

    def emit(self, kind: str, text: str, reason: str) -> None:
        if text.strip():
            self.out.append((len(self.out), kind, self.parent, self.title, text, tokens_of(text), reason))

    def close(self, reason: str) -> str:
        """Emit what is held; gives its text back for the overlap."""
        text = GAP.join(c for _, c in self.held)
        if self.held:
            self.emit("List" if all(k == "List" for k, _ in self.held) else "Text", text, reason)
        self.held = []
        return text

    def open(self, title: str) -> None:
        self.parent += 1
        self.title = title[:200]

    def take(self, kind: str, text: str) -> None:
        if kind == "Title":
            self.close("new_heading")
            self.open(text)
            self.held = [("Text", text)]
            return
        if self.parent < 0:
            if kind == "Table":
                self.close("table_boundary")
            self.open("Document")
        if kind == "Table":
            self.close("table_boundary")
            self.emit("Table", text, "table_boundary")
            return
        if self.held:
            joined = GAP.join(c for _, c in self.held)
            why = None
            if tokens_of(joined + GAP + text) > self.most:
                why = "max_token_threshold"
            elif tokens_of(joined) >= self.least and similarity(self.held[-1][1], text) < self.near:
                why = "semantic_similarity_drop"
            if why:
                self.close(why)
                if self.overlap and len(joined) > 4 * self.overlap:
                    self.held = [("Text", joined[-4 * self.overlap :])]
        self.held.append((kind, text))


def adaptive_chunks(elements: DataFrame, most: int = CHUNK_MAX, least: int = CHUNK_MIN, near: float = CHUNK_SIMILARITY, overlap: int = OVERLAP) -> DataFrame:
    """CHK1: (doc_id, pos, type, content) -> chunks: titles open parents, tables stay whole, texts fill up to `most`
    tokens and part earlier where, `least` reached, neighbours have little in common; splits repeat an overlap."""
    def fold(items):
        c = _Chunker(most, least, near, overlap)
        for x in items:
            text = (x["content"] or "").strip()
            if text:
                c.take(x["type"], text)
        c.close("end_of_document")
        return iter(c.out)

    return fold_documents(elements, "pos", ["type", "content"], fold, CHUNK)


def _packed(items: list[dict], limit: int) -> list[dict]:
    """Neighbours of one parent joined up to limit tokens; tables alone."""
    out: list[dict] = []
    for x in items:
        last = out[-1] if out else None
        joins = last and "Table" not in (x["kind"], last["kind"]) and last["parent"] == x["parent"]
        if joins and tokens_of(last["content"] + GAP + x["content"]) <= limit:
            out[-1] = last | {"content": last["content"] + GAP + x["content"], "kind": "Text", "merged": last["merged"] + x["merged"]}
        else:
            out.append(dict(x))
    return out


def consolidate(chunks: DataFrame, cap: int = 60, most: int = CHUNK_MAX, least: int = CHUNK_MIN) -> DataFrame:
    """CHK2: documents of more than cap chunks, or of over eight tiny ones, are packed, with growing packs until under the cap."""
    def fold(items):
        items = [{"kind": x["kind"], "parent": x["parent"], "content": x["content"] or "", "merged": 1} for x in items]
        mean = sum(tokens_of(x["content"]) for x in items) / max(1, len(items))
        if len(items) > cap or (mean < max(80, least // 4) and len(items) > 8):
            limit = max(64, most)
            for _ in range(PACK_ROUNDS):
                items = _packed(items, limit)
                if len(items) <= cap:
                    break
                limit = max(limit + 1, int(limit * PACK_GROWTH))
        return ((i, x["kind"], x["parent"], x["content"], tokens_of(x["content"]), x["merged"]) for i, x in enumerate(items))

    return fold_documents(chunks, "chunk_index", ["kind", "parent", "content"], fold, "chunk_index int, kind string, parent int, content string, tokens int, merged int")


def merge_sections(sections: DataFrame, target: int = SECTION_TARGET, most: int = SECTION_MAX, near: float = SECTION_SIMILARITY) -> DataFrame:
    """STR6: (doc_id, section, heading, level, body) -> neighbours merged while it is safe, pass after pass.

    Two neighbours merge if one is under target, both together fit, the right one opens no hard boundary,
    and they are alike: levels one apart at most and similarity `near`, or both tiny and nearly that.
    """
    def joins(a, b) -> bool:
        n, m = tokens_of(a["body"]), tokens_of(b["body"])
        if n + m > most or (n >= target and m >= target) or (b["level"] <= 1 and HARD_HEADING.match(b["heading"].strip())):
            return False
        s = similarity(a["body"][:2000], b["body"][:2000])
        return (abs(a["level"] - b["level"]) <= 1 and s >= near) or (n < 200 and m < 200 and s >= max(0.15, near - TINY_SIMILARITY))

    def join(a, b):
        top = b if b["level"] < a["level"] else a
        inner = [b["heading"]] if b["heading"] not in ("", "Preamble") else []
        return {"section": a["section"], "heading": top["heading"], "level": top["level"], "body": GAP.join([a["body"], *inner, b["body"]]), "parts": a["parts"] + b["parts"]}

    def fold(items):
        now = [{"section": x["section"], "heading": x["heading"] or "", "level": x["level"], "body": x["body"] or "", "parts": 1} for x in items]
        while True:
            out, i = [], 0
            while i < len(now):
                if i + 1 < len(now) and joins(now[i], now[i + 1]):
                    out.append(join(now[i], now[i + 1]))
                    i += 2
                else:
                    out.append(now[i])
                    i += 1
            if len(out) == len(now):
                return ((i, x["section"], x["heading"], x["level"], x["body"], tokens_of(x["body"]), x["parts"]) for i, x in enumerate(out))
            now = out

    return fold_documents(sections, "section", ["heading", "level", "body"], fold, "place int, section long, heading string, level int, body string, tokens int, parts int")


def split_oversized(body: str, most: int) -> list[str]:
    """STR8: a section cut at paragraphs into pieces of at most `most` tokens where paragraphs allow."""
    parts: list[str] = []
    for p in (x for x in body.split(GAP if GAP in body else "\n") if x.strip()):
        if parts and tokens_of(parts[-1] + GAP + p) <= most:
            parts[-1] += GAP + p
        else:
            parts.append(p)
    return parts


def split_sections(sections: DataFrame, most: int = SECTION_MAX) -> DataFrame:
    """STR8: sections of over `most` tokens as numbered parts cut at paragraphs; the others as one part."""
    def cut(stream):
        for x in stream:
            body = x["body"] or ""
            for i, p in enumerate([body] if tokens_of(body) <= most else split_oversized(body, most)):
                yield x["doc_id"], x["section"], x["heading"], i, p, tokens_of(p)

    types = dict(sections.dtypes)
    schema = f"doc_id {types['doc_id']}, section {types['section']}, heading string, part int, body string, tokens int"
    return sections.select("doc_id", "section", "heading", "body").mapInArrow(lambda batches: streamed(batches, cut, schema), schema)


def pack_sections(sections: DataFrame, target: int = SECTION_TARGET, least: int = SECTION_MIN, most: int = SECTION_MAX) -> DataFrame:
    """STR7: sections packed into chunks: whole ones up to target, major headings and the limit close a pack,
    oversized sections split at paragraphs, a small last chunk joins the one before where both fit."""
    def fold(items):
        out: list[list] = []  # heading, text, sections, reason
        held: list[dict] = []

        def size() -> int:
            return sum(tokens_of(x["body"]) for x in held)

        def close(reason: str) -> None:
            if held:
                out.append([held[0]["heading"] or "Section", GAP.join(x["body"] for x in held), len(held), reason])
                held.clear()

        for x in items:
            n = tokens_of(x["body"])
            if n > most:
                close("before_oversized_section")
                out += [[x["heading"] or "Section", p, 1, "section_paragraph_split"] for p in split_oversized(x["body"], most)]
                continue
            if held and x["level"] <= 1 and size() >= max(least // 2, 200) and size() + n > target:
                close("major_heading_boundary")
            if size() + n > most:
                close("max_token_boundary")
            held.append(x)
            if size() >= max(target, least):
                close("target_pack")
        close("end_of_document")
        if len(out) > 1 and tokens_of(out[-1][1]) < least and tokens_of(out[-2][1] + GAP + out[-1][1]) <= most:
            last = out.pop()
            out[-1][1] += GAP + last[1]
            out[-1][2] += last[2]
        return ((i, h, t, tokens_of(t), n, r) for i, (h, t, n, r) in enumerate(out))

    return fold_documents(sections, "section", ["heading", "level", "body"], fold, "chunk_index int, heading string, content string, tokens int, sections int, reason string")


def regional_groups(summaries: DataFrame, budget: int = 3000, near: float = 0.12, most: int = 12) -> DataFrame:
    """HIE2: (doc_id, chunk_index, section, summary) -> runs of summaries that belong together.

    A run ends at its token budget or member cap, or, once it holds the square root of the document's
    summaries, where the section changes and the text has little in common with what came before.
    """
    def fold(items):
        want = max(2, round(len(items) ** 0.5))
        group, size, n, before, section = 0, 0, 0, "", None
        for x in items:
            text = x["summary"] or ""
            t = tokens_of(text)
            turn = x["section"] != section and similarity(before, text) < near
            if n and (size + t > budget or n >= most or (n >= want and turn)):
                group, size, n = group + 1, 0, 0
            yield x["chunk_index"], group, t
            size, n, before, section = size + t, n + 1, text, x["section"]

    return fold_documents(summaries, "chunk_index", ["section", "summary"], fold, "chunk_index int, region int, tokens int")
