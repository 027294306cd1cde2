"""Features of chunks and documents: densities, novelty, reasoning, coherence, types.

Chunks have doc_id, chunk_index, content, kind (Text, Title, Table, List) and section_path.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.text import clamp, cosine, entities, est_tokens, overlap, text_of, token_set

# Patterns of equations, figures, tables, technical and legal terms, code, discourse marks.
EQUATION = r"(?i)(\$[^$]+\$|\\\(|\\\[|\\begin\{equation\}|\\frac\{|∑|∫|=|≈|≤|≥)"
EQUATION_START = r"[$\\∑∫=≈≤≥]"  # every equation starts with one of these
FIGURE = r"(?i)\b(figure|fig\.|image|diagram|chart)\b"
TABLE = r"(?i)\b(table|tabular)\b|\|.*\|"
TECHNICAL = r"(?i)\b(algorithm|theorem|lemma|hypothesis|methodology|variance|gradient|latency|throughput|protocol|api|sql|json|embedding|neural|transformer|regression|covariance|optimizer)\b"
LEGAL = r"(?i)\b(pursuant|hereinafter|shall|clause|section\s+\d+|§|plaintiff|defendant)\b"
IMAGE_MARK, CHART_MARK = r"(?i)\[image|figure\s+\d|chart\s+\d", r"(?i)\b(chart|graph|plot)\b"
EQUATION_MARK, CODE_MARK = r"(\$\$|\\begin\{equation\}|∑|∫|=.*\+.*)", r"```|def |class |function |#include"
DISCOURSE = {
    "abstractive": r"\b(therefore|thus|implies|suggests|overall|in conclusion|we argue|hypothesis)\b",
    "contradiction": r"\b(however|whereas|although|contradict|in contrast|on the other hand|despite)\b",
    "inference": r"\b(because|due to|leads to|results in|causal|implies that)\b",
    "cross_section": r"\b(see section|as discussed|chapter \d|refer to|supra|infra|appendix)\b",
    "multi_doc": r"\b(according to|cited|et al|reference|bibliography)\b",
}
CROSS_REFERENCE = r"(?i)\b(see (section|chapter|fig|table|above|below)|as (noted|mentioned)|refer to)\b"
SAMPLE_REASONING, SAMPLE_COHERENCE = 5000, 6000


def hits(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def sample_text(n: int) -> Column:
    """The first n characters of a document's chunks in order, a line each (as an aggregate)."""
    return F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", text_of("content").alias("t")))), lambda x: x["t"]), "\n"), 1, n)


def structural_profile(chunks: DataFrame, ocr: float = 0.85) -> DataFrame:
    """FEA1: table, list and title counts, densities, layout and the structural score of a document."""
    t = text_of("content")
    share = lambda p: F.avg(t.rlike(p).cast("int"))
    g = chunks.groupBy("doc_id").agg(
        F.avg((F.col("kind") == "Table").cast("int")).alias("table_density"), F.count_if(F.col("kind") == "Table").alias("table_count"), F.count_if(F.col("kind") == "List").alias("list_count"), F.count_if(F.col("kind") == "Title").alias("title_count"),
        share(IMAGE_MARK).alias("image_density"), share(CHART_MARK).alias("chart_density"), share(EQUATION_MARK).alias("equation_density"), share(CODE_MARK).alias("code_density"),
    )
    g = g.withColumn("layout_complexity", F.when(F.col("table_density") > 0.15, 0.5).otherwise(0.0))
    most = lambda c, k: F.least(F.lit(1.0), F.col(c) * k)
    s = 0.25 * (1.0 - ocr) + 0.20 * most("table_density", 3) + 0.10 * most("image_density", 4) + 0.10 * most("chart_density", 4) + 0.15 * F.col("layout_complexity") + 0.05 * most("equation_density", 3) + 0.05 * most("code_density", 3)
    return g.withColumn("structural_score", clamp(s))


def reasoning_profile(chunks: DataFrame) -> DataFrame:
    """FEA2: discourse marks in the first 5000 characters and the reasoning score."""
    g = chunks.groupBy("doc_id").agg(F.lower(sample_text(SAMPLE_REASONING)).alias("s"), F.count("*").alias("n"), F.avg((F.col("kind") == "Table").cast("int")).alias("tables"))
    g = g.withColumns({k: hits(F.col("s"), p) for k, p in DISCOURSE.items()})
    bias = F.least(F.lit(1.0), F.col("tables") * 1.5 + F.when(F.col("n") < 5, 0.3).otherwise(0.0))
    part = lambda c, k: F.least(F.lit(1.0), F.col(c) / k)
    r = 0.20 * part("abstractive", 8) + 0.15 * (1.0 - F.col("extractive_bias")) + 0.15 * part("cross_section", 5) + 0.15 * part("contradiction", 5) + 0.15 * part("inference", 6) + 0.10 * part("multi_doc", 6) + 0.10 * part("n", 40)
    g = g.withColumn("extractive_bias", bias).withColumn("reasoning_score", clamp(r, 0.05, 1.0))
    return g.select("doc_id", *DISCOURSE, "extractive_bias", "reasoning_score")


def coherence_profile(chunks: DataFrame) -> DataFrame:
    """FEA3: cross references, agreement of the vocabularies of both halves, and the coherence demanded."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    half = chunks.withColumn("left", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) <= F.greatest(F.lit(1), F.floor(n / 2)))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of("content")), F.lit("[a-zA-Z]{4,}"), F.lit(0)))
    tok = half.select("doc_id", "left", F.explode(words).alias("w")).groupBy("doc_id", "w").agg(F.max(F.col("left").cast("int")).alias("l"), F.max((~F.col("left")).cast("int")).alias("r"))
    j = tok.groupBy("doc_id").agg(F.sum(F.col("l") * F.col("r")).alias("both"), F.count("*").alias("either"), F.sum("l").alias("nl"), F.sum("r").alias("nr"))
    g = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), hits(sample_text(SAMPLE_COHERENCE), CROSS_REFERENCE).alias("cross_references"))
    g = g.join(j, "doc_id", "left").withColumn("consistency", F.when((F.coalesce("nl", F.lit(0)) > 0) & (F.coalesce("nr", F.lit(0)) > 0), F.col("both") / F.col("either")).otherwise(0.7))
    far = F.least(F.lit(1.0), F.col("chunk_count") / 30 + F.col("cross_references") / 10)
    x = 0.35 * F.least(F.lit(1.0), F.col("chunk_count") / 25) + 0.25 * far + 0.25 * (1.0 - F.col("consistency")) + 0.15 * F.least(F.lit(1.0), F.col("cross_references") / 8)
    return g.select("doc_id", "chunk_count", "cross_references", "consistency", clamp(x).alias("coherence_score"))


# Document types in order, with the evidence each gets; then domain and risk by type.
TYPE_RULES = (
    ("research_paper", 0.6, r"\babstract|references\b", "multi_doc > 3"), ("invoice", 0.5, r"\b(total|amount|balance|invoice)\b", "table_density > 0.2"),
    ("financial_statement", 0.4, r"\b(total|amount|balance|invoice)\b", "table_density > 0.2"), ("financial_statement", 0.6, r"\brevenue|ebitda|balance sheet|10-k|fiscal\b", "true"),
    ("meeting_minutes", 0.5, r"\bagenda|minutes|attendees\b", "title_count >= 3"), ("resume", 0.4, r"\bexperience|education|skills\b", "length(sample) < 8000"),
    ("legal_contract", 0.7, r"\bwhereas|hereinafter|party|agreement|indemnif", "true"), ("medical_report", 0.7, r"\bpatient|diagnosis|clinical|dosage|mg/dl\b", "true"),
    ("regulatory_document", 0.6, r"\bsec\.|regulation|compliance|cfr\b", "true"), ("technical_documentation", 0.4, r"\bapi|endpoint|configuration|install\b", "true"),
)
TYPE_ORDER = ("research_paper", "invoice", "financial_statement", "legal_contract", "medical_report", "regulatory_document", "technical_documentation", "meeting_minutes", "resume")
TYPE_DOMAIN = {"legal_contract": ("legal", "high"), "medical_report": ("medical", "high"), "financial_statement": ("financial", "high"), "invoice": ("financial", "high"), "regulatory_document": ("regulatory", "high"), "technical_documentation": ("technical", "medium"), "research_paper": ("technical", "medium")}


def classify_documents(df: DataFrame) -> DataFrame:
    """FEA4: (doc_id, sample, table_density, title_count, multi_doc) -> type, domain, risk, confidence; general under 0.35."""
    low = F.lower(text_of("sample"))
    score = {t: reduce(lambda a, b: a + b, [F.when(low.rlike(p) & F.expr(cond), w).otherwise(0.0) for name, w, p, cond in TYPE_RULES if name == t]) for t in TYPE_ORDER}
    best = F.greatest(*score.values())
    kind = reduce(lambda out, t: F.when(score[t] == best, F.lit(t)).otherwise(out), reversed(TYPE_ORDER), F.lit(TYPE_ORDER[0]))
    kind = F.when(best < 0.35, F.lit("general_text")).otherwise(kind)
    pick = lambda i, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for t, v in TYPE_DOMAIN.items() for x in (t, v[i])]), kind), F.lit(other))
    return df.select("doc_id", kind.alias("document_type"), pick(0, "general").alias("domain"), pick(1, "low").alias("risk"), F.least(F.lit(0.85), 0.4 + best).alias("confidence"))


def retrieval_probe(vectors: DataFrame, first: int = 8) -> DataFrame:
    """FEA5: mean cosine of all pairs among a document's first eight chunk vectors (at most 28 pairs)."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    v = vectors.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= first)
    o = v.select("doc_id", F.col("i").alias("j"), F.col("vector").alias("other"))
    return v.join(o, "doc_id").filter("i < j").groupBy("doc_id").agg(F.avg(cosine(F.col("vector"), F.col("other"))).alias("mean_cosine"), F.count("*").alias("pairs"))


def document_features(chunks: DataFrame) -> DataFrame:
    """FEA6: structural, reasoning and coherence profiles side by side."""
    return structural_profile(chunks).join(reasoning_profile(chunks), "doc_id").join(coherence_profile(chunks), "doc_id")


def section_type(content: Column, equations: Column) -> Column:
    path = F.lower(text_of("section_path"))
    return (
        F.when((F.col("kind") == "Table") | F.substring(content, 1, 400).rlike(TABLE), "table").when(F.col("kind") == "List", "list").when(F.col("kind") == "Title", "heading")
        .when(equations > 0, "equation_heavy").when(content.rlike(LEGAL), "legal")
        .when(path.rlike("appendix|reference|bibliography"), "appendix").when(path.rlike("method|result|discussion|abstract"), "technical").otherwise("narrative")
    )


def with_novelty(chunks: DataFrame) -> DataFrame:
    """chunks, whose `words` are distinct ones with a space between, with `novelty`, the share of the words that no earlier chunk of the document has, and `n_chunks`.

    One shuffle by document, of each chunk's own words; a pass in order keeps the words of one document.
    """
    kept = chunks.drop("words").schema
    columns = kept.names
    schema = T.StructType([*kept.fields, T.StructField("n_chunks", T.LongType()), T.StructField("novelty", T.DoubleType())])
    rows = chunks.repartition("doc_id").withColumn("n_chunks", F.count("*").over(Window.partitionBy("doc_id"))).sortWithinPartitions("doc_id", "chunk_index")

    def run(batches):
        now, seen = object(), set()
        for b in batches:
            shares = []
            for doc, line in zip(b.column("doc_id").to_pylist(), b.column("words").to_pylist()):
                if doc != now:
                    now, seen = doc, set()
                own, before = line.split(), len(seen)
                seen.update(own)
                shares.append((len(seen) - before) / len(own) if own else 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*columns, "n_chunks")), pa.array(shares, pa.float64())], names=[*columns, "n_chunks", "novelty"])

    return rows.mapInArrow(run, schema)


def novelty(chunks: DataFrame) -> DataFrame:
    """FEA8: share of a chunk's tokens that no earlier chunk of its document has."""
    c = chunks.select("doc_id", "chunk_index", F.array_join(token_set("content", "alpha"), " ").alias("words"))
    return with_novelty(c).select("doc_id", "chunk_index", "novelty")


def chunk_features(chunks: DataFrame) -> DataFrame:
    """FEA7: counts, densities, complexity, importance, confidence of each chunk. Texts are read once, before the shuffle, which they do not enter."""
    c = text_of("content")
    col = F.col
    df = chunks.withColumns({
        "word_count": F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")), "token_count": est_tokens("content"), "equation_count": F.when(c.rlike(EQUATION_START), hits(c, EQUATION)).otherwise(0), "figure_count": hits(c, FIGURE),
        "table_count": F.when((col("kind") == "Table") | F.substring(c, 1, 500).rlike(TABLE), 1).otherwise(0), "tech_hits": hits(c, TECHNICAL),
        "entity_count": F.size(F.regexp_extract_all(F.regexp_replace(c, r"[^\x00-\x7F]", "0"), F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z]{2,})\b"), F.lit(1))),
        "words": F.array_join(token_set("content", "alpha"), " "),
    })
    df = with_novelty(df.withColumn("section_type", section_type(c, col("equation_count"))).drop("content"))
    one = F.lit(1.0)
    df = df.withColumns({"entity_density": F.least(one, col("entity_count") / F.greatest(F.lit(40.0), col("word_count") / 5.0)), "technical_density": F.least(one, col("tech_hits") / F.greatest(F.lit(8.0), col("word_count") / 80.0))})
    hard = col("section_type").isin("legal", "equation_heavy")
    complexity = clamp(0.35 * F.least(one, col("token_count") / 1200.0) + 0.30 * col("technical_density") + 0.20 * F.least(one, col("equation_count") / 5.0) + 0.15 * F.when(hard, 1.0).otherwise(0.0))
    key = F.when(col("section_type").isin("technical", "legal", "equation_heavy"), 1.0).otherwise(0.4)
    importance = clamp(0.30 * col("entity_density") + 0.25 * col("novelty") + 0.20 * key + 0.15 * (1.0 - col("chunk_index") / F.greatest(F.lit(1), col("n_chunks"))) + 0.10 * F.least(one, col("table_count") + col("figure_count")))
    df = df.withColumn("complexity", complexity).withColumn("importance", importance)
    df = df.withColumn("compression_difficulty", clamp(0.5 * col("complexity") + 0.3 * col("technical_density") + 0.2 * col("entity_density")))
    df = df.withColumn("confidence", clamp(0.7 + F.when(col("word_count") > 40, 0.2).otherwise(0.0) - F.when(col("word_count") < 15, 0.15).otherwise(0.0), 0.35, 1.0))
    return df.drop("entity_count", "tech_hits", "n_chunks")




# Scales by tokens, pages and chunks; marks of code blocks.
SCALES = (("tiny", 2_500, 15, 8), ("small", 12_000, 50, 25), ("medium", 60_000, 200, 80), ("large", 200_000, 500, 200))
CODE_BLOCK = r"```|^\s{4}\S|\bdef |\bclass |\bfunction "


def capability_profile(chunks: DataFrame) -> DataFrame:
    """FEA9: size, densities, scale and complexity class of a document; `risk` may come as a column."""
    c, risk = text_of("content"), F.lower(F.coalesce(F.max("risk"), F.lit(""))) if "risk" in chunks.columns else F.lit("")
    depth = F.when(text_of("section_path") == "", 1).otherwise(1 + F.length(F.regexp_replace(text_of("section_path"), "[^/]", "")))
    g = chunks.groupBy("doc_id").agg(
        F.sum(est_tokens("content")).alias("tokens"), F.count("*").alias("chunks"), F.avg(est_tokens("content")).alias("mean_tokens"), F.max(est_tokens("content")).alias("largest"),
        F.count_if(F.substring(c, 1, 500).rlike(TABLE) | F.contains(c, F.lit("--- TABLE"))).alias("tables"), F.count_if(F.substring(c, 1, 400).rlike(FIGURE)).alias("figures"), F.count_if(c.rlike(CODE_BLOCK)).alias("code_blocks"),
        F.sum(hits(c, EQUATION)).alias("equations"), F.max(depth).alias("heading_depth"), risk.alias("risk"),
    )
    n = F.greatest(F.lit(1), F.col("chunks"))
    g = g.withColumns({"pages": F.greatest(F.lit(1), F.ceil(F.col("tokens") / 500.0)), "technical": F.least(F.lit(1.0), (F.col("equations") + F.col("code_blocks")) / (n * 2))})
    g = g.withColumn("layout", F.least(F.lit(1.0), 0.15 * F.col("tables") / n + 0.15 * F.col("figures") / n + 0.2 * F.least(F.lit(1.0), n / 40.0)))
    scale = reduce(lambda out, s: F.when((F.col("tokens") < s[1]) & (F.col("pages") <= s[2]) & (F.col("chunks") <= s[3]), s[0]).otherwise(out), reversed(SCALES), F.lit("xlarge"))
    clinical = F.col("risk").isin("medical", "clinical")
    kind = F.when(clinical, "critical").when((F.col("risk") == "legal") | (F.col("technical") >= 0.75), "complex").when((F.col("technical") >= 0.45) | (F.col("layout") >= 0.5), "moderate").otherwise("simple")
    return g.withColumn("table_density", F.col("tables") / n).withColumn("document_scale", scale).withColumn("complexity_class", kind)
