"""Sources, sinks and checks of incoming rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.text import safe_filename, strip, text_of

# Most characters read and kept, allowed uploads, patterns of headings, controls and scripts.
MOST_BYTES, BLOCK_CHARS, PATH_CHARS, QUERY_CHARS = 2_000_000, 20_000, 500, 8_000
UPLOADS = (".pdf", ".docx", ".txt", ".csv")
STORED_TYPES = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".txt": "text/plain", ".csv": "text/csv"}
UPLOAD_TYPES = (*STORED_TYPES.values(), "application/msword", "application/csv", "application/octet-stream")
HEADING_NUMBERED, HEADING_MARKDOWN = r"(?i)^(?:(?:chapter|section|part)\s+)?\d+(?:\.\d+)*\.?\s+\S+", r"^#{1,3}\s+\S+"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SCRIPT = r"(?is)<\s*script\b|javascript\s*:|on\w+\s*=|<\s*iframe\b|<\s*object\b|<\s*embed\b"


def text_blocks(docs: DataFrame) -> DataFrame:
    """SRC1: paragraphs of whole documents: split at blank lines, trimmed, empties skipped, each cut to its cap.

    Documents with a NUL in the first kilobyte are binary and give none.
    """
    t = F.substring(text_of("text"), 1, MOST_BYTES)
    parts = F.filter(F.transform(F.split(t, "\n\n"), strip), lambda x: x != "")
    d = docs.filter(~F.contains(F.substring(text_of("text"), 1, 1024), F.lit("\0")))
    return d.select("doc_id", F.posexplode(parts).alias("block", "content")).withColumn("content", F.substring("content", 1, BLOCK_CHARS))


def html_elements(pages: DataFrame) -> DataFrame:
    """SRC2: titles, list items, tables and paragraphs of markup in order, tags stripped, empties skipped."""
    pat = r"(?is)<(h[1-6]|title|li|table|p)\b[^>]*>(.*?)</\1\s*>"
    tag, body = F.regexp_extract_all(text_of("html"), F.lit(pat), F.lit(1)), F.regexp_extract_all(text_of("html"), F.lit(pat), F.lit(2))
    e = pages.select("page_id", F.posexplode(F.arrays_zip(tag.alias("tag"), body.alias("body"))).alias("pos", "x"))
    text = strip(F.regexp_replace(F.regexp_replace(F.col("x.body"), "<[^>]*>", " "), r"\s+", " "))
    low = F.lower("x.tag")
    kind = F.when(low.rlike("^(h[1-6]|title)$"), "Title").when(low == "li", "List").when(low == "table", "Table").otherwise("Text")
    out = e.select("page_id", "pos", kind.alias("type"), text.alias("content")).filter("content <> ''")
    return out.withColumn("content", F.when(F.col("type") == "Table", F.concat(F.lit("--- TABLE START ---\n\nTEXT:\n"), "content", F.lit("\n\n--- TABLE END ---"))).otherwise(F.col("content")))


def looks_like_heading(c) -> Column:
    """SRC3: 4 to 100 characters, numbered or marked, mostly capitals, or a short title-case line."""
    s = strip(text_of(c))
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    letters, capitals = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    title = F.forall(words, lambda w: ~F.substring(w, 1, 1).rlike(r"\p{L}") | F.substring(w, 1, 1).rlike(r"\p{Lu}"))
    return (
        F.when((F.length(s) < 4) | (F.length(s) > 100) | s.rlike("[.,;]$"), F.lit(False))
        .when(s.rlike(HEADING_MARKDOWN) | s.rlike(HEADING_NUMBERED), F.lit(True))
        .when((F.size(words) > 14) | (letters == 0), F.lit(False))
        .when((capitals / letters >= 0.78) & (F.length(s) <= 80), F.lit(True))
        .otherwise((F.size(words) <= 10) & title)
    )


def validate_uploads(files: DataFrame) -> DataFrame:
    """SRC4: (file_id, name, content) -> accepted or the reason it is not: ending, magic, NUL, markup in text."""
    ext = F.lower(F.regexp_extract(safe_filename("name"), r"(\.[^.]*)$", 1))
    body = text_of("content")
    head = F.lower(F.substring(body, 1, 4096))
    reason = (
        F.when(body == "", "empty").when(~ext.isin(*UPLOADS), "unsupported_type").when((ext == ".pdf") & ~body.startswith("%PDF"), "not_a_pdf").when((ext == ".docx") & ~body.startswith("PK"), "not_a_docx")
        .when(ext.isin(".txt", ".csv") & F.contains(F.substring(body, 1, 8192), F.lit("\0")), "binary_text").when(ext.isin(".txt", ".csv") & (head.rlike(SCRIPT) | F.contains(head, F.lit("<html"))), "markup_in_text")
    )
    return files.select("file_id", ext.alias("extension"), reason.isNull().alias("accepted"), reason.alias("reason"))


@F.pandas_udf(T.BooleanType())
def _is_docx(content: pd.Series) -> pd.Series:
    """Zip files that hold a content list and something under word/."""
    def fits(data) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
        except Exception:  # whatever a damaged file makes the reader say, it is no document
            return False
        return "[Content_Types].xml" in names and any(n.startswith("word/") for n in names)

    return content.map(fits)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder as (name, content_type null, content bytes); Spark's reader leaves files of no bytes out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.lit(None).cast("string").alias("content_type"), "content")


def validate_upload_bytes(files: DataFrame) -> DataFrame:
    """SRC4 on bytes: files with (name, content_type, content binary) -> also extension, accepted, reason and the type to store.

    Beginnings are compared as bytes; a word document must be a zip file with its parts; texts have no NUL in
    their first 8192 bytes and no script or page in their first 4096, bytes beyond ASCII being no part of either. Null content is empty, a
    null type is any.
    """
    ext = F.lower(F.regexp_extract(safe_filename("name"), r"(\.[^.]*)$", 1))
    body = F.coalesce("content", F.lit(b""))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    head = F.lower(F.regexp_replace(F.decode(F.substring(body, 1, 4096), "ISO-8859-1"), r"[^\x00-\x7F]", "?"))
    starts = lambda b: F.substring(body, 1, len(b)) == F.lit(b)
    text = ext.isin(".txt", ".csv")
    docx = F.when((ext == ".docx") & starts(b"PK"), _is_docx(F.when((ext == ".docx") & starts(b"PK"), body).otherwise(F.lit(b"")))).otherwise(False)
    reason = (
        F.when(F.length(body) == 0, "empty").when(~ext.isin(*UPLOADS), "unsupported_type").when((kind != "") & ~kind.isin(*UPLOAD_TYPES), "unsupported_content_type")
        .when((ext == ".pdf") & ~starts(b"%PDF"), "not_a_pdf").when((ext == ".docx") & ~docx, "not_a_docx")
        .when(text & F.contains(F.substring(body, 1, 8192), F.lit(b"\0")), "binary_text").when(text & (head.rlike(SCRIPT) | F.contains(head, F.lit("<html"))), "markup_in_text")
    )
    stored = F.element_at(F.create_map(*[F.lit(x) for kv in STORED_TYPES.items() for x in kv]), ext)
    return files.withColumns({"extension": ext, "accepted": reason.isNull(), "reason": reason, "stored_type": F.when(reason.isNull(), stored)})


def sanitize_text(c, most: int = QUERY_CHARS) -> tuple[Column, Column]:
    """SRC5: text without controls, and why it is rejected (too long, script), null if it is not."""
    s = strip(F.regexp_replace(text_of(c), CONTROLS, ""))
    return s, F.when(F.length(s) > most, "too_long").when(s.rlike(SCRIPT), "script")


def upsert_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SRC6: one row a chunk_id, the highest version's; section paths cut to their cap."""
    both = existing.unionByName(new)
    rest = [c for c in both.columns if c not in ("chunk_id", "version")]
    best = both.groupBy("chunk_id").agg(F.max(F.struct("version", F.struct(*rest).alias("x"))).alias("b"))
    return best.select("chunk_id", "b.version", "b.x.*").withColumn("section_path", F.substring("section_path", 1, PATH_CHARS))


def delete_documents(df: DataFrame, ids: DataFrame) -> DataFrame:
    """SRC7: rows of other documents."""
    return df.join(ids.select("doc_id"), "doc_id", "left_anti")


def write_events(df: DataFrame, path: str) -> None:
    """SRC8: events as JSON lines."""
    df.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC8: JSON lines read with a schema; bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tail_events(df: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """SRC8: the last n rows by key, as a report."""
    return df.orderBy(F.desc(key)).limit(n)


def flatten_routing_events(df: DataFrame, event: str = "event") -> DataFrame:
    """SRC9: indexed columns of a JSON event, confidence and carbon with their fallbacks."""
    g = lambda *ps: F.coalesce(*[F.get_json_object(event, p) for p in ps])
    num = lambda *ps: g(*ps).try_cast("double")
    return df.select("event_id", g("$.job_id").alias("job_id"), g("$.event", "$.event_type").alias("event_type"), g("$.selected_model").alias("selected_model"), num("$.crs").alias("crs"), num("$.confidence", "$.validation_confidence").alias("confidence"), num("$.latency_ms").alias("latency_ms"), num("$.carbon", "$.carbon_estimate").alias("carbon"))


def recent_events(df: DataFrame, n: int = 50, at: str = "ts", key: str = "event_id") -> DataFrame:
    """SRC10: the last n events in order of time."""
    return df.orderBy(F.desc(at), F.desc(key)).limit(n).orderBy(at, key)


def campaign_runs(df: DataFrame) -> DataFrame:
    """SRC11: (campaign_id, questions array of (question, model_runs array)) -> long rows."""
    q = df.select("campaign_id", F.posexplode_outer("questions").alias("question_no", "q"))
    r = q.select("campaign_id", "question_no", "q.question", F.posexplode_outer("q.model_runs").alias("run_no", "r"))
    return r.select("campaign_id", "question_no", "question", "run_no", "r.*")


def campaign_index(df: DataFrame) -> DataFrame:
    """SRC12: campaigns with label, workload and status, newest first; no spend and not a dry run is failed."""
    label = F.regexp_extract("name", r"_v?(\d+\.\d+\.\d+)_(.+)$", 2)
    work = F.when(F.lower("name").rlike("summari[sz]ation"), "document_summarization").otherwise("interactive_rag")
    status = F.when((F.coalesce("cost_usd", F.lit(0.0)) <= 0) & ~F.col("dry_run"), "failed").otherwise("complete")
    return df.select("campaign_id", F.when(label == "", F.col("name")).otherwise(label).alias("label"), work.alias("workload"), status.alias("status"), "at").orderBy(F.desc("at"), F.desc("campaign_id"))


def join_references(runs: DataFrame, references: DataFrame) -> DataFrame:
    """SRC13: reference answers by exact trimmed question."""
    r = references.select(F.trim("question").alias("q_"), "reference").dropDuplicates(["q_"])
    return runs.join(r, F.trim("question") == F.col("q_"), "left").drop("q_")


def join_summary_refs(docs: DataFrame, references: DataFrame) -> DataFrame:
    """SRC14: a reference by document id, else by base name, else the only one there is."""
    base = lambda c: F.lower(F.substring_index(c, "/", -1))
    by_id = references.filter("ref_id is not null").select(F.col("ref_id").alias("doc_id"), F.col("reference").alias("r1")).dropDuplicates(["doc_id"])
    by_name = references.filter("ref_name is not null").select(base("ref_name").alias("b_"), F.col("reference").alias("r2")).dropDuplicates(["b_"])
    only = references.agg(F.count("*").alias("n"), F.min("reference").alias("r3")).select(F.when(F.col("n") == 1, F.col("r3")).alias("r3"))
    df = docs.withColumn("b_", base("name")).join(by_id, "doc_id", "left").join(by_name, "b_", "left").crossJoin(F.broadcast(only))
    return df.select("doc_id", "name", F.coalesce("r1", "r2", "r3").alias("reference"))


def load_graph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """SRC15: links between known nodes, weight 1 where none is given."""
    ids = nodes.select("id").distinct()
    known = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return known.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def align_document_id(df: DataFrame, canonical: DataFrame) -> DataFrame:
    """SRC16: rows stamped with the canonical id of their document, where there is one."""
    return df.join(canonical.select("doc_id", "canonical_id"), "doc_id", "left").withColumn("doc_id", F.coalesce("canonical_id", "doc_id")).drop("canonical_id")


def list_documents(df: DataFrame, owner) -> DataFrame:
    """SRC17: an owner's documents, newest first."""
    return df.filter(F.col("owner_id") == owner).orderBy(F.desc("saved_at"), F.desc("doc_id"))
