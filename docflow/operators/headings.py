"""Heading scores of line blocks: patterns, case, position, rejections, class, level.

Columns all the way: neighbours by lag and lead, the line's place on its page by a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import clamp, strip, text_of

THRESHOLD = 0.55
# Words that head sections by themselves.
LEXICON = (
    "abstract acknowledgement acknowledgment acknowledgements acknowledgments appendix background bibliography conclusion conclusions contents discussion evaluation "
    "experiment experiments findings glossary implementation index introduction method methodology methods motivation objective objectives overview preface references results "
    "scope summary toc architecture assumptions carbon chunking design limitations pipeline routing security validation article clause notes schedule section"
).split()
PHRASES = (
    "executive summary", "future work", "literature review", "problem statement", "related work", "system architecture", "system design", "table of contents", "works cited",
    "threat model", "balance sheet", "cash flow", "financial statements", "income statement", "risk factors",
)
# Patterns of headings and of what only looks like one.
LEAD = r"(?:chapter|section|part|appendix|article|clause)\s+[ivxlcdm\d]+[.:)\-]?\s+"
NUMBERED = rf"(?i)^(?:{LEAD}|\d+(?:\.\d+){{0,4}}\.?\s+|[IVXLCDM]+\.\s+|[A-Z]\.\s+)"
MARKDOWN = r"^#{1,6}\s+\S+"
MONTHS = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE = rf"(?i)^(?:(?:date\s*[:\-]\s*)?{MONTHS}\s+\d{{4}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|date\s*[:\-].*)$"
ADDRESS = r"(?i)\b[\w.+-]+@[\w.-]+\.\w+\b|https?://|www\."
CAPTION = r"(?i)^(?:figure|fig\.|table|eq\.|equation|algorithm)\s*[\d.:]|^(?:figure|fig\.|table|caption)\b"
PAGE, STATUS = r"(?i)^(?:page\s+)?\d{1,4}$", r"(?i)^(?:status|version|rev(?:ision)?|draft)\s*[:\-]"
TEAM = r"(?i)^(?:team(?:\s+members?)?|author(?:s)?|prepared by|submitted by|supervisor|advisor|mentor|affiliation|department|university|institute|organization|email|phone|address|contact)\s*:?\s*$"
PERSON = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$"
NO_PERSON = ("project manager", "team members", "frontend choices", "backend choices", "users table", "documents table", "chunks table", "key outcomes", "future work", "related work", "problem statement", "system design", "model design", "data flow", "tech stack")
NO_PERSON_WORDS = r"(?i)\b(table|choices|manager|diagram|schema|flow)\b"
AFFILIATION = r"(?i)\b(university|institute|college|department|ltd|inc|corp|gmbh|pvt)\b"
VERBS = r"(?i)\b(is|are|was|were|be|been|being|have|has|had|do|does|did|will|would|should|could|can|may|might|must|shall)\b"
CODE_COMMENT = r"^[a-z]|\b(API|JSON|SQL|HTTP|GET|POST|BaseModel|Collection)\b|^(User|Document|RAG|ChromaDB|Query)\b"


def upper_share(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / letters)


def title_share(words: Column) -> Column:
    alpha = F.filter(words, lambda w: F.substring(w, 1, 1).rlike(r"\p{L}"))
    return F.when(F.size(alpha) == 0, 0.0).otherwise(F.size(F.filter(alpha, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}"))) / F.size(alpha))


def in_lexicon(c: Column) -> Column:
    t = F.regexp_replace(strip(c), "(?i)^(?:" + LEAD + ")", "")
    t = F.lower(strip(F.regexp_replace(t, r"^[\d.\s\-#:]+", "")))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s\-]", ""), r"\s+", " "))
    words = F.split(F.replace(t, F.lit("-"), F.lit(" ")), " ")
    known = F.array(*[F.lit(w) for w in LEXICON])
    phrase = reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) & (F.length(t) <= len(p) + 24) for p in PHRASES])
    return (t != "") & (((F.size(words) <= 2) & F.arrays_overlap(words, known)) | phrase)


def score_headings(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """STR2: (doc_id, index, text, block_type, page) -> candidates with score, class, level, accepted, reasons.

    Candidates are titles, lines of 14 words or fewer, and numbered or marked lines.
    """
    doc = Window.partitionBy("doc_id").orderBy("index")
    page = Window.partitionBy("doc_id", "page").orderBy("index")
    b = blocks.withColumn("text", strip(text_of("text"))).filter("text <> ''")
    b = b.withColumns({"prev_blank": F.lag("text").over(doc).isNull(), "next_blank": F.lead("text").over(doc).isNull(), "page_line": F.row_number().over(page) - 1})
    b = b.withColumn("words", F.split("text", r"\s+"))
    t, w, n = F.col("text"), F.col("words"), F.size("words")
    numbered, marked, titled = t.rlike(NUMBERED), t.rlike(MARKDOWN), F.col("block_type") == "Title"
    b = b.filter((titled | (n <= 14) | numbered | marked) & ((n <= 20) | numbered | marked))
    low = F.lower(t)
    b = b.withColumns({"numbered": numbered, "marked": marked, "titled": titled, "upper": upper_share(t), "titles": title_share(w), "lex": in_lexicon(t)})
    num, mark, lex = F.col("numbered"), F.col("marked"), F.col("lex")
    left = F.size(F.split(strip(F.substring_index(t, ":", 1)), r"\s+"))
    person = t.rlike(PERSON) & ~lex & ~num & ~low.isin(*NO_PERSON) & ~t.rlike(NO_PERSON_WORDS)
    rest_md = strip(F.regexp_replace(t, r"^#{1,6}\s+", ""))
    dated = t.rlike(DATE) | ((n <= 6) & t.rlike(r"\b20\d{2}\b") & ~F.contains(low, F.lit("chapter")) & low.startswith("date"))
    label = t.rlike(TEAM) | (t.endswith(":") & (n <= 5)) | (F.contains(t, F.lit(":")) & ~num & ~mark & (left <= 4))
    code = mark & rest_md.rlike(CODE_COMMENT)
    rejects = {
        "email_or_url": t.rlike(ADDRESS), "date": dated, "page_number": t.rlike(PAGE), "label_or_colon_metadata": label, "status_metadata": t.rlike(STATUS), "person_name": person,
        "affiliation": t.rlike(AFFILIATION) & (n <= 10) & ~num, "sentence_punctuation": t.rlike(r"[.,;?]$") & ~num, "too_long": (n > 16) & ~mark, "verb_phrase_sentence": t.rlike(VERBS) & (n >= 6) & ~lex,
        "inside_table": F.lower("block_type") == "table",
    }
    b = b.withColumn("prior", F.when(dated, "date").when(person, "person_name").when(label, "label").when(rejects["status_metadata"] | rejects["affiliation"], "metadata").when(t.rlike(CAPTION), "caption"))
    free = F.col("prior").isNull()
    rejects["markdown_code_comment"] = free & code
    b = b.withColumn("reject_reasons", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rejects.items()])))

    rest = strip(F.regexp_replace(t, NUMBERED, ""))
    multi = num & t.rlike(r"^\d+\.\d+")
    major = num & ~multi & ((upper_share(rest) >= 0.72) | in_lexicon(rest) | lex | t.rlike(r"(?i)\b(chapter|section|appendix|part|article|clause)\b"))
    rest_words = F.size(F.split(rest, r"\s+"))
    toc = num & ~multi & ~major & (title_share(F.split(rest, r"\s+")) >= 0.85) & rest_words.between(2, 8)
    listish = num & ~multi & ~major & ~toc
    md = mark & ~code
    caps, cased = (F.col("upper") >= 0.85) & n.between(2, 10), (F.col("titles") >= 0.85) & n.between(2, 10) & ~t.endswith(":")
    give = lambda cond, v: F.when(cond, v).otherwise(0.0)
    score = (
        give(code, 0.05) + give(md, 0.55) + give(multi | major, 0.55) + give(toc, 0.38) + give(listish, 0.10) + give(lex, 0.55) + give(F.col("prev_blank"), 0.08) + give(F.col("next_blank"), 0.05)
        + give(caps, 0.28) + give(cased, 0.18) + give((F.col("page_line") <= 2) & (n <= 8), 0.05) + give(F.col("titled"), 0.10) - give(cased & ~lex & ~caps & ~md, 0.12)
    )
    hashes = F.least(F.lit(3), F.length(F.regexp_replace(t, "[^#]", "")))
    dots = F.length(F.regexp_replace(F.get(w, F.lit(0)), "[^.]", ""))
    minor_two = F.when(dots == 1, F.lit("minor_heading")).otherwise("subsection")
    kind = (
        F.when(multi, minor_two).when(major, "major_heading").when(toc, "minor_heading").when(md, F.when(hashes <= 1, "major_heading").when(hashes == 2, "minor_heading").otherwise("subsection"))
        .when(listish, "ignore").when(lex, "major_heading").when(caps | cased, "minor_heading").otherwise("body")
    )
    level = F.when(multi, F.when(dots == 1, 2).otherwise(3)).when(major | toc, 1).when(md, hashes).when(lex, 1).when(caps | cased, 2).otherwise(0)
    b = b.withColumns({"raw": F.when(free, score).otherwise(give(F.col("prior") == "caption", 0.25)), "kind": F.coalesce("prior", kind), "lv": F.when(free, level).otherwise(0), "hard": F.size("reject_reasons")})
    b = b.withColumn("score", clamp(F.when(F.col("hard") > 0, F.least("raw", F.lit(0.25)) - 0.15 * F.col("hard")).otherwise(F.col("raw"))))
    opens = F.col("kind").isin("major_heading", "minor_heading", "subsection")
    ok = opens & (F.col("score") >= threshold) & (F.col("hard") == 0)
    cls = F.when(ok, F.col("kind")).when(opens & (F.col("score") < threshold), "ignore").when(F.col("kind") == "body", "ignore").otherwise(F.col("kind"))
    return b.select("doc_id", "index", "text", "score", cls.alias("classification"), F.when(ok, F.col("lv")).otherwise(0).cast("int").alias("level"), ok.alias("accepted"), "reject_reasons")
