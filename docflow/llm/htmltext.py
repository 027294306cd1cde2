"""Main text of web pages: page structure first, then a suffix index of each host.

A page becomes a list of blocks. Blocks inside an article (or main) element are article text; blocks
in menus, headers, footers, sidebars, notices, adverts, forms and comments are not; the others are
undecided. The token streams of all pages of a host, article text apart, are concatenated block by
block, and their suffixes ordered by (host, first `run` tokens): neighbours in that order that agree
over `run` tokens (or over a whole shorter block) and come from distinct pages are long repeated
substrings, so the tokens they cover are boilerplate.
Copies of a page (equal text apart from what is barred) count once, and a run counts only if enough
pages of different text hold it, so copies and quoted passages stay. Ordered to that depth a group of
equal suffixes needs only its count, summed map-side: a footer on a third of all pages is one row per task.
Undecided blocks lose their covered tokens and keep their unique runs.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import materialize, text_slices

RUN = 8
LEAST_PAGES = 3
LEAST_SHARE = 0.1
_ITEM = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title|math|canvas|object)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<(?P<odd>[a-zA-Z][^\s/>\"']*)[^>]*(?:>|\Z)",
    re.S | re.I,
)
# Element names.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav header footer aside form menu button dialog head fieldset search".split())
_MAIN = frozenset("article main".split())
_KEPT = _MAIN | {"html", "body"}
_SHUTS_P = _BLOCK - {"body", "html", "head"}
# Words of class, id and role attributes that mark what is not the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar sidebars aside widget widgets related recommended share sharing social subscribe subscription newsletter signup login "
    "cookie cookies consent gdpr notice notices notification popup modal overlay alert comment comments commentlist disqus respond reply replies form search "
    "pagination pager toolbar copyright legal disclaimer complementary contentinfo paywall".split()
)
# Words of class, id and role attributes of what holds the article.
_HOLDS = frozenset("article body content entry main post story text".split())
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_SPACE = re.compile(r"\s+")


def _marked(attributes: str) -> bool:
    """Hidden, or an attribute names what is not the article, and none of its names what holds the article alone."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    if _HIDDEN.search(attributes):
        return True
    for x in _NAMED.finditer(attributes):
        names = [set(re.split(r"[^a-z]+", n)) for n in (x[2] or x[3] or x[4] or "").lower().split()]
        marked = [not _MARKS.isdisjoint(n) for n in names]
        if any(marked) and not any(not m and not _HOLDS.isdisjoint(n) for m, n in zip(marked, names)):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block in page order: kind 2 in an article, 1 undecided, 0 not the article.

    Class words never bar html, body, main or article. Where every article lies in a form or in what
    class words bar, these do not bar it either.
    """
    out = _blocks(page, False)
    return out if any(kind == 2 for _, kind in out) else _blocks(page, True)


def _blocks(page: str | None, lift: bool) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    open_: list[tuple[str, int, int, int]] = []  # name, barred, main and soft counts outside it
    where: dict[str, list[int]] = defaultdict(list)  # places of each name among the open ones
    blocks_at: list[int] = []
    held: list[str] = []
    barred = main = soft = 0  # soft: bars by class words or form, which an article lifts
    at = 0
    page = page or ""

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip() if held else ""
        held.clear()
        if text:
            out.append((text, 0 if barred else 2 if main else 1))

    def close_to(i: int):
        nonlocal barred, main, soft
        _, barred, main, soft = open_[i]
        for name, *_ in open_[i:]:
            where[name].pop()
        del open_[i:]
        while blocks_at and blocks_at[-1] >= i:
            blocks_at.pop()

    for m in _ITEM.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m["odd"] or "").lower()
        if not name:
            continue
        attributes = m[4] or ""
        if m[2]:
            i = where[name][-1] if where[name] else None
            if name in _BLOCK:
                flush()
            if i is not None and (name in _BLOCK or not blocks_at or blocks_at[-1] <= i):
                close_to(i)
            continue
        if name == "br":
            flush()
            continue
        if name in _BLOCK:
            flush()
        if name in _SHUTS_P and blocks_at:
            i = blocks_at[-1]
            if open_[i][0] == "p" or name == open_[i][0] and name in ("li", "dd", "dt", "tr", "td", "th", "option"):
                close_to(i)
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            continue
        where[name].append(len(open_))
        if name in _BLOCK:
            blocks_at.append(len(open_))
        open_.append((name, barred, main, soft))
        if lift and name in _MAIN and barred == soft:
            barred = soft = 0
        inside_main = main and name in ("header", "footer")
        if name in _MAIN and not barred:
            main += 1
        if name in _OUT and not (inside_main and name == "header"):
            barred += 1
            soft += name == "form" and not _HIDDEN.search(attributes)
        elif _marked(attributes) and (name not in _KEPT or _HIDDEN.search(attributes)):
            barred += 1
            soft += not _HIDDEN.search(attributes)
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def _suffixes(text: str, run: int) -> tuple[list[str], list[int]]:
    """Tokens of a block, and the key of each of its suffixes of `run` tokens (of a shorter block, the whole)."""
    tokens = text.split(" ")
    keys = []
    for i in range(max(1, len(tokens) - run + 1)):
        h = xxh3_64_intdigest(" ".join(tokens[i : i + run]))
        keys.append(h - (1 << 64) if h >= 1 << 63 else h)
    return tokens, keys


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def extract(pages: DataFrame, run: int = RUN, structure: bool = True) -> DataFrame:
    """pages -> page_id, url, text, n_chars: the article's blocks in page order, joined by newlines.

    Character references are decoded; white space inside a block becomes one space; `br` parts blocks.
    Null html is empty and gives an empty text. A page without an article keeps its undecided blocks
    but for tokens covered by runs of `run` or more tokens that LEAST_PAGES pages of its host and
    LEAST_SHARE of them hold, copies counted once. With structure=False no element
    bars or settles a block, and the index alone decides about all of them. Urls without a host lose nothing. Repeated rows are the same
    page if page_id and url agree. Other columns are ignored. Empty in, empty out.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").alias("text"))

    def parse(batches):
        for b in batches:
            for part in text_slices(b, "text"):
                ids, urls, sure, rest, copy = part.column(0), part.column(1), [], [], []
                for t in part.column(2):
                    found = blocks(t.as_py())
                    found = found if structure else [(text, 1) for text, _ in found]
                    settled = not any(kind == 1 for _, kind in found)
                    sure.append("\n".join(text for text, kind in found if kind == 2) if settled else None)
                    h = xxh3_64_intdigest("\n".join(text for text, kind in found if kind))
                    copy.append(h - (1 << 64) if h >= 1 << 63 else h)
                    rest.append([{"text": text, "kind": kind} for text, kind in found if not settled or kind < 2])
                kinds = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32())]))
                hosts = pa.array([_host(u.as_py()) for u in urls], pa.string())
                yield pa.RecordBatch.from_arrays([ids, urls, hosts, pa.array(sure, pa.string()), pa.array(rest, kinds), pa.array(copy, pa.int64())], names=["page_id", "url", "host", "sure", "blocks", "copy"])

    parsed = rows.mapInArrow(parse, "page_id long, url string, host string, sure string, blocks array<struct<text:string,kind:int>>, copy long")
    parsed = materialize(parsed.withColumn("page", F.xxhash64("page_id", "url")), "page-blocks")

    def index(batches):
        for b in batches:
            host, page, keys = [], [], []
            for h, p, found in zip(b.column(0), b.column(1), b.column(2)):
                own = {k for x in found.as_py() if x["kind"] < 2 for k in _suffixes(x["text"], run)[1]}
                host += [h.as_py()] * len(own)
                page += [p.as_py()] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(keys, pa.int64())], names=["host", "page", "key"])

    once = parsed.filter("host <> ''").groupBy("host", "copy").agg(F.min(F.struct("page", "blocks")).alias("x"))
    suffixes = once.select("host", "x.page", "x.blocks").mapInArrow(index, "host string, page long, key long")
    sizes = parsed.groupBy("host").agg(F.countDistinct("copy").alias("pages"))
    repeated = suffixes.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    repeated = repeated.join(sizes, "host").filter(F.col("n") >= LEAST_SHARE * F.col("pages")).select("host", "key")
    undecided = parsed.filter("sure is null")
    theirs = undecided.select("host", "page", "blocks").mapInArrow(index, "host string, page long, key long")
    covered = theirs.join(repeated, ["host", "key"], "left_semi").groupBy("page").agg(F.collect_set("key").alias("keys"))

    def trim(batches):
        for b in batches:
            out = []
            for found, keys in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                known, kept = set(keys or ()), []
                for x in found:
                    if x["kind"] == 2:
                        kept.append(x["text"])
                    elif x["kind"] == 1:
                        tokens, own = _suffixes(x["text"], run)
                        gone = [False] * len(tokens)
                        for i, k in enumerate(own):
                            if k in known:
                                gone[i : i + run] = [True] * len(gone[i : i + run])
                        left = " ".join(t for t, g in zip(tokens, gone) if not g)
                        if left:
                            kept.append(left)
                out.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    late = undecided.join(covered, "page", "left").select("page_id", "url", "blocks", "keys").mapInArrow(trim, "page_id long, url string, text string")
    done = parsed.filter("sure is not null").select("page_id", "url", F.col("sure").alias("text"))
    return done.union(late).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
