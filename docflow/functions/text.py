"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns by kind; all but eval run over lower-cased text.
TOKEN_PATTERNS = {
    "bm25": "[a-zA-Z0-9_]{2,}",
    "alpha": "[a-zA-Z]{3,}",
    "word": "[a-zA-Z0-9_]{3,}",
    "alnum": "[a-z0-9]{3,}",
    "eval": "[a-z0-9]+(?:'[a-z]+)?",
}


def text_of(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def est_tokens(c) -> Column:
    """Tokens of a chunk: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text_of(c)) / 4).cast("int"))


def est_tokens0(c) -> Column:
    """Tokens for energy accounting: a quarter of the characters."""
    return F.floor(F.length(text_of(c)) / 4).cast("int")


def tokens(c, kind: str = "bm25") -> Column:
    """All tokens of a kind, in order, repeats included."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(TOKEN_PATTERNS[kind]), F.lit(0))


def token_set(c, kind: str) -> Column:
    return F.array_distinct(tokens(c, kind))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two sets; 0 where either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def jaccard(a, b, kind: str = "alpha") -> Column:
    """Jaccard of token sets; for kind 'word' equal short strings count as 1."""
    out = overlap(token_set(a, kind), token_set(b, kind))
    if kind != "word":
        return out
    empty = (F.size(tokens(a, kind)) == 0) | (F.size(tokens(b, kind)) == 0)
    same = strip(F.lower(text_of(a))) == strip(F.lower(text_of(b)))
    return F.when(empty & same & (strip(text_of(a)) != ""), F.lit(1.0)).otherwise(out)


def dot(a, b) -> Column:
    x = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def cosine(a, b) -> Column:
    """Cosine; 0 for a length mismatch or a norm of nearly nothing."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (na <= 1e-9) | (nb <= 1e-9), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def clamp(c: Column, lo=0.0, hi=1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def total_length(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))


def reading_level(c) -> Column:
    """Difficulty from 0 to 1: half from mean word length, half from mean sentence length."""
    w = F.regexp_extract_all(text_of(c), F.lit("[A-Za-z]{2,}"), F.lit(0))
    n = F.size(w)
    sentences = F.greatest(F.lit(1), F.length(F.regexp_replace(text_of(c), "[^.!?]", "")))
    score = clamp((total_length(w) / n - 4.0) / 4.0) * 0.5 + clamp((n / sentences - 12.0) / 16.0) * 0.5
    return F.when(n == 0, F.lit(0.4)).otherwise(score)


def density(c) -> Column:
    """Distinct tokens for each 40 characters, 1.5 at most; 0.5 without tokens."""
    n = F.size(token_set(c, "alnum"))
    return F.when(n == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.5), n / (F.greatest(F.lit(1), F.length(text_of(c))) / 40.0)))


def entities(c) -> Column:
    """Distinct capitalised runs of two words or more, and acronyms."""
    plain = F.regexp_replace(text_of(c), r"[^\x00-\x7F]", "0")  # a letter outside ASCII is part of a word
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z]{2,})\b"), F.lit(1)))


def content_hash(c) -> Column:
    return F.sha2(text_of(c), 256)


def embed_key(model, kind, c) -> Column:
    return F.sha2(F.concat_ws("\n", model, kind, text_of(c)), 256)


def redact_email(c) -> Column:
    e = strip(F.lower(text_of(c)))
    local, domain = F.substring_index(e, "@", 1), F.regexp_extract(e, r"^[^@]*@([\s\S]*)$", 1)
    masked = F.when(F.length(local) <= 2, F.repeat(F.lit("*"), F.length(local))).otherwise(F.concat(F.substring(local, 1, 1), F.lit("***"), F.right(local, F.lit(1))))
    return F.when(e == "", F.lit("-")).when(~F.contains(e, F.lit("@")), F.lit("***")).otherwise(F.concat(masked, F.lit("@"), domain))


def safe_filename(c, longest: int = 180) -> Column:
    base = F.substring_index(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("upload.bin")), "/", -1)
    clean = F.regexp_replace(strip(F.regexp_replace(base, r"[^\p{L}\p{N}._\- ]", "_")), r"^\.+", "")
    return F.substring(F.when(clean == "", F.lit("upload.bin")).otherwise(clean), 1, longest)


# Fixed value: the note above an extract that stands in for a summary.
EXTRACT_NOTE = (
    "## Extractive fallback\n\n"
    "_Model map/escalate did not return a usable summary; using source excerpt so compile can still proceed._\n\n"
)


def extractive_summary(c, longest: int = 1400) -> Column:
    """White space collapsed, cut to `longest`, back to the last separator in its second half."""
    body = strip(F.regexp_replace(text_of(c), r"\s+", " "))
    cut = F.substring(body, 1, longest)

    def last(sep: str) -> Column:  # 0-based place of the last separator, -1 if none
        at = F.locate(sep[::-1], F.reverse(cut))
        return F.when(at == 0, F.lit(-1)).otherwise(F.length(cut) - at - len(sep) + 1)

    half, short = longest // 2, cut
    for sep in (" ", ", ", "; ", ". "):  # the last rule that holds wins
        short = F.when(last(sep) >= half, F.substring(cut, F.lit(1), last(sep) + (1 if sep == ". " else 0))).otherwise(short)
    out = F.when(F.length(body) > longest, F.concat(F.rtrim(short), F.lit("…"))).otherwise(body)
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(EXTRACT_NOTE), out))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often `use` names it (a plain expression would be copied each time)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repair_json(c) -> Column:
    """The outermost object in a model's answer, fences and trailing commas removed; null if not JSON."""
    unfenced = lambda s: F.when(s.rlike(r"(?i)```(?:json)?\s*[\s\S]*?```"), strip(F.regexp_extract(s, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1))).otherwise(s)
    blob = F.regexp_extract(bound(strip(text_of(c)), unfenced), r"(\{[\s\S]*\})", 1)
    mended = lambda x: F.regexp_replace(F.regexp_replace(x, r",\s*\}", "}"), r",\s*\]", "]")
    ok = lambda x: F.json_object_keys(x).isNotNull()
    return bound(blob, lambda x: F.when(x == "", F.lit(None)).when(ok(x), x).otherwise(bound(mended(x), lambda y: F.when(ok(y), y))))


def norm_label(c) -> Column:
    s = F.regexp_replace(strip(F.lower(text_of(c))), r"[^a-z0-9_./\\+\-]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# Query classes in order of precedence, their patterns, token budgets, concise flags.
RESPONSE_RULES = (
    ("timeline", r"\b(timeline|chronolog|sequence of events|milestones|history of)\b", 400, False),
    ("summary", r"\b(summarize|summary|overview|tldr|tl;dr|sum up|brief|key (findings|points)|in (one|1|five|5) (paragraph|bullet|bullets))\b", 250, True),
    ("comparison", r"\b(compare|comparison|versus|vs\.?|difference between|baseline versus|pros and cons)\b", 350, False),
    ("explanation", r"\b(explain|elaborate|walk me through|how does|how do|deep dive|like i('m| am) a beginner|in detail|detailed)\b", 800, False),
    ("analytical", r"\b(analyze|analysis|evaluate|assessment|implications|trade-?offs|limitations|risks|why did|root cause)\b", 500, False),
    ("definition", r"\b(define|definition|what does .+ mean|meaning of)\b", 200, True),
    ("fact", r"\b(what is the|who is|when was|when did|how many|how much|which|where is|list (the )?(top|all|primary)|name the|yes or no)\b", 150, True),
)
DEFAULT_RESPONSE = ("default", 350, True)


def response_plan(c) -> tuple[Column, Column, Column]:
    """(query_type, max_tokens, concise): first rule that holds; eight words or fewer are a fact question."""
    q = text_of(c)
    short = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) <= 8
    rules = [(q.rlike("(?i)" + p) | (short if name == "fact" else F.lit(False)), name, n, brief) for name, p, n, brief in RESPONSE_RULES]

    def pick(i):
        return reduce(lambda out, r: F.when(r[0], F.lit(r[i])).otherwise(out), reversed(rules), F.lit(DEFAULT_RESPONSE[i - 1]))

    return pick(1), pick(2), pick(3)


def classify_intent(c, default: str = "qa") -> Column:
    q = text_of(c)
    return (
        F.when(q.rlike(r"(?i)\b(summarize|summary|overview|tldr|tl;dr|sum up|brief me)\b"), F.lit("summarize_excerpt"))
        .when(q.rlike(r"(?i)\b(timeline|chronolog|sequence of events|when did|history of events)\b"), F.lit("timeline"))
        .otherwise(F.lit(default))
    )


def lookup(c: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(table, c), c)


# Canonical routing preferences and their aliases; job statuses likewise.
PREFERENCES = ("automatic", "fastest", "lowest_cost", "lowest_carbon", "highest_quality", "eco", "balanced", "performance", "quality")
PREFERENCE_ALIASES = {
    "auto": "automatic", "smart": "automatic", "smart_routing": "automatic",
    "max quality": "highest_quality", "max_quality": "highest_quality",
    "prefer_fastest": "fastest", "prefer_lowest_cost": "lowest_cost",
    "prefer_lowest_carbon": "lowest_carbon", "prefer_highest_quality": "highest_quality",
}
STATUS_ALIASES = {
    "completed": "complete", "done": "complete", "success": "complete", "ok": "complete",
    "failed": "error", "failure": "error", "canceled": "cancelled",
}
TERMINAL = ("complete", "error", "cancelled")


def norm_preference(c) -> Column:
    key = lookup(F.regexp_replace(strip(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("automatic")))), "-", "_"), PREFERENCE_ALIASES)
    return F.when(key.isin(*PREFERENCES), key).otherwise(F.lit("automatic"))


def norm_status(c) -> Column:
    s = strip(F.lower(text_of(c)))
    return F.when(s == "", F.lit("pending")).otherwise(lookup(s, STATUS_ALIASES))


# Words of a progress message that name its stage, then the stages by progress.
STAGE_WORDS = (
    ("search_ready", ("search ready", "search available")), ("summary_ready", ("summary ready",)),
    ("background", ("background", "embedding", "search index", "indexing")), ("validation", ("validat",)),
    ("regional", ("regional",)), ("chapter", ("chapter",)), ("executive", ("executive",)),
    ("chunk_summaries", ("chunk summar", "summarizing")), ("planning", ("planning", "freeze")),
)
STAGE_PROGRESS = ((98, "search_ready"), (91, "summary_ready"), (90, "background"), (82, "compile"))
STAGE_PROGRESS_LATE = ((65, "validation"), (35, "chunk_summaries"), (24, "planning"), (20, "features"), (12, "triage"))


def progress_stage(progress: Column, message: Column) -> Column:
    m, p = F.lower(text_of(message)), F.coalesce(progress.cast("double"), F.lit(0.0))
    rules = [(reduce(lambda a, b: a | b, [F.contains(m, F.lit(w)) for w in ws]), s) for s, ws in STAGE_WORDS]
    rules += [(p >= at, s) for at, s in STAGE_PROGRESS]
    rules += [(F.contains(m, F.lit("escalat")), "escalate")]
    rules += [(p >= at, s) for at, s in STAGE_PROGRESS_LATE]
    return reduce(lambda out, r: F.when(r[0], F.lit(r[1])).otherwise(out), reversed(rules), F.lit("queued"))


def progress_counts(message: Column) -> tuple[Column, Column]:
    at = lambda i: F.nullif(F.regexp_extract(text_of(message), r"\((\d+)\s*/\s*(\d+)\)", i), F.lit("")).cast("int")
    return at(1), at(2)


# Words of headings, table rows and lines that carry metrics, not content.
METRIC_HEADINGS = r"carbon|emissions|co2|co₂|model comparison|frontier comparison|grid intensity|energy (?:→|->) pue|job report|baseline vs|reduction %"
METRIC_ROW = r"gco2|co₂|co2e|reduction|baseline|optimized|grid intensity|kwh|pue|estimated\s+g"
METRIC_LINE = r"chatgpt-class|chunk count\s*×|4\.32\s*g|energy\s*→\s*pue\s*→\s*grid|^co₂e\s*\(g\)\s*=|^co2e\s*\(g\)\s*="


def strip_metrics(c) -> Column:
    """Markdown without metric sections, tables and lines.

    Sections are cut apart at their headings, so that whole ones can go; within a section a table goes
    if its first row names a metric.
    """
    t = F.replace(text_of(c), F.lit("\r\n"), F.lit("\n"))
    sections = F.split(F.regexp_replace(t, r"(?m)^([ \t]*#{1,6}\s)", "\x00$1"), "\x00")
    kept = F.filter(sections, lambda s: ~F.lower(F.substring_index(s, "\n", 1)).rlike(r"^\s*#{1,6}\s.*(?:" + METRIC_HEADINGS + ")"))
    # A metric table: a row of bars that names a metric, and the rows of bars right below it.
    tables = F.transform(kept, lambda s: F.regexp_replace(s, r"(?im)^[ \t]*\|[^\n]*(?:" + METRIC_ROW + r")[^\n]*(?:\n|\z)(?:[ \t]*\|[^\n]*(?:\n|\z))*", ""))
    lines = F.filter(F.split(F.array_join(tables, ""), "\n"), lambda x: ~F.lower(F.trim(x)).rlike(METRIC_LINE))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
