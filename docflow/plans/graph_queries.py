"""Queries of knowledge graphs (of conversations) and of a code graph (suppliers and parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import cgraph as C
from docflow.operators import kgraph as K
from docflow.operators import nodesearch as N
from docflow.operators.tablefunctions import register_table_functions

from .bindings import table
from .registry import ORACLES, register

# Knowledge: capitalised words of a conversation are its nodes, neighbours in a turn its relations.


def mentions(spark, d):
    c = table(spark, d, "conversations")
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "0")
    return c.select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.regexp_extract_all(plain, F.lit(r"\b[A-Z][a-z]{3,}\b"), F.lit(0))).alias("pos", "name"))


MENTIONS = r"""me AS (SELECT conv_id AS doc_id, turn, i - 1 AS pos, l[i] AS name FROM (SELECT conv_id, turn, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '0', 'g'), '\b[A-Z][a-z]{3,}\b') AS l FROM conversations), unnest(range(1, len(l) + 1)) t(i))"""


def node_rows(spark, d):
    m = mentions(spark, d)
    return m.select("doc_id", F.lower("name").alias("node_id"), F.lit("Entity").alias("type"), "name", F.array(F.upper("name")).alias("aliases"), F.array(F.col("turn").cast("string")).alias("chunk_ids"), (F.col("turn") * 10000 + F.col("pos")).alias("seq"))


def relation_rows(spark, d):
    m = mentions(spark, d)
    n = m.select("doc_id", "turn", (F.col("pos") - 1).alias("pos"), F.lower("name").alias("dst"))
    return m.join(n, ["doc_id", "turn", "pos"]).select("doc_id", F.lower("name").alias("src"), F.lit("NEXT").alias("rel"), "dst", ((F.col("turn") * 3 + F.col("pos")) % 10 / 10).alias("confidence"), F.array(F.col("turn").cast("string")).alias("chunk_ids"), (F.col("turn") * 10000 + F.col("pos")).alias("seq"))


GRAPH = MENTIONS + """, rel AS (SELECT a.doc_id, lower(a.name) AS src, lower(b.name) AS dst, ((a.turn * 3 + a.pos) % 10) / 10.0::DOUBLE AS confidence, CAST(a.turn AS VARCHAR) AS chunk_id, a.turn * 10000 + a.pos AS seq FROM me a JOIN me b ON a.doc_id = b.doc_id AND a.turn = b.turn AND b.pos = a.pos + 1),
nd AS (SELECT doc_id, lower(name) AS node_id, arg_min(name, turn * 10000 + pos) AS name, list_sort(list(DISTINCT CAST(turn AS VARCHAR))) AS chunk_ids FROM me GROUP BY 1, 2),
ed AS (SELECT doc_id, src, dst, arg_min(confidence, seq) AS confidence, arg_min(chunk_id, seq) AS chunk_id FROM rel GROUP BY 1, 2, 3),
up AS (SELECT doc_id, src, dst, max(confidence) AS confidence, list_sort(list(DISTINCT chunk_id)) AS chunk_ids FROM rel GROUP BY 1, 2, 3)"""


def raw_answers(spark, d):
    n = node_rows(spark, d)
    ev = F.array(F.struct(F.get("chunk_ids", F.lit(0)).alias("chunk_id"), F.col("name").alias("quote")))
    ents = n.groupBy("doc_id", F.floor(F.col("seq") / 10000).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("seq", F.struct(F.col("node_id").alias("id"), "type", "name", "aliases", ev.alias("evidence")).alias("e")))).alias("l"))
    body = F.to_json(F.struct(F.transform("l", lambda x: x["e"]).alias("entities")))
    return ents.select("doc_id", "batch", F.concat(F.lit("```json\n"), F.regexp_replace(body, r"\}$", ", }"), F.lit("\n```")).alias("raw"))


@register(f"WITH {MENTIONS} SELECT doc_id, turn AS batch, lower(name) AS node_id, name, CAST(turn AS VARCHAR) AS chunk_id FROM me")
def kg1_knowledge_tables(spark, d):
    items, _ = K.knowledge_tables(raw_answers(spark, d))
    return items.select("doc_id", "batch", "node_id", "name", F.get("evidence", F.lit(0))["chunk_id"].alias("chunk_id"))


@register(f"WITH {MENTIONS} SELECT doc_id, lower(name) AS node_id, min(turn) AS batch FROM me GROUP BY 1, 2")
def kg2_merge_knowledge(spark, d):
    items, _ = K.knowledge_tables(raw_answers(spark, d))
    return K.merge_knowledge(items).select("doc_id", "node_id", "batch")


@register(f"""WITH {GRAPH}, ok AS (SELECT doc_id, node_id FROM nd WHERE length(node_id) % 3 <> 0), k AS (SELECT * FROM ed WHERE EXISTS (SELECT 1 FROM ok WHERE ok.doc_id = ed.doc_id AND node_id = src) AND EXISTS (SELECT 1 FROM ok WHERE ok.doc_id = ed.doc_id AND node_id = dst))
  SELECT doc_id, 'node' AS kind, count_if(length(node_id) % 3 <> 0) AS kept, count_if(length(node_id) % 3 = 0) AS dropped FROM nd GROUP BY 1 UNION ALL
  SELECT ed.doc_id, 'relation', count(k.src), count(*) - count(k.src) FROM ed LEFT JOIN k ON k.doc_id = ed.doc_id AND k.src = ed.src AND k.dst = ed.dst GROUP BY 1""")
def kg3_ground_knowledge(spark, d):
    n, e = K.graph_from_knowledge(node_rows(spark, d), relation_rows(spark, d))
    quote = F.when(F.length("node_id") % 3 == 0, F.lit("zzzz qqqq")).otherwise(F.col("name"))
    ev = n.select("doc_id", F.col("node_id").alias("item_id"), F.explode("chunk_ids").alias("chunk_id"), quote.alias("quote"))
    texts = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("chunk_id"), "text")
    return K.ground_knowledge(n, e, ev, texts)[2]


@register(f"WITH {GRAPH} SELECT doc_id, node_id, name, array_to_string(chunk_ids, ',') AS chunk_ids FROM nd")
def kg4_graph_nodes(spark, d):
    return K.graph_from_knowledge(node_rows(spark, d), relation_rows(spark, d))[0].select("doc_id", "node_id", "name", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@register(f"WITH {GRAPH} SELECT doc_id, src, dst, round(confidence, 6) AS confidence, chunk_id FROM ed")
def kg4_graph_edges(spark, d):
    return K.graph_from_knowledge(node_rows(spark, d), relation_rows(spark, d))[1].select("doc_id", "src", "dst", F.round("confidence", 6).alias("confidence"), F.array_join("chunk_ids", ",").alias("chunk_id"))


@register(f"WITH {GRAPH} SELECT doc_id, src, dst, round(confidence, 6) AS confidence, array_to_string(chunk_ids, ',') AS chunk_ids FROM up")
def kg5_upsert_edges(spark, d):
    r = relation_rows(spark, d)
    out = K.upsert_edges(r.filter("seq % 2 = 0"), r.filter("seq % 2 = 1"))
    return out.select("doc_id", "src", "dst", F.round("confidence", 6).alias("confidence"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


def asked(spark, d):
    c = table(spark, d, "conversations").filter("turn = 0")
    return c.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("doc_id"), F.col("text").alias("query"))


_ASKED = "q AS (SELECT conv_id AS doc_id, lower(text) AS query FROM conversations WHERE turn = 0), ma AS (SELECT nd.doc_id, node_id FROM q JOIN nd ON nd.doc_id = q.doc_id AND contains(query, node_id))"


@register(f"WITH {GRAPH}, {_ASKED} SELECT doc_id AS query_id, node_id FROM ma")
def kg6_match_entities(spark, d):
    n, _ = K.graph_from_knowledge(node_rows(spark, d), relation_rows(spark, d))
    return K.match_entities(asked(spark, d), n).select("query_id", "node_id")


@register(f"""WITH {GRAPH}, {_ASKED}, e AS (SELECT doc_id, src AS a, dst AS b, chunk_ids FROM up WHERE confidence >= 0.4 UNION ALL SELECT doc_id, dst, src, chunk_ids FROM up WHERE confidence >= 0.4),
  se AS (SELECT doc_id, node_id, min(hop) AS hop FROM (SELECT doc_id, node_id, 0 AS hop FROM ma UNION ALL SELECT ma.doc_id, b, 1 FROM ma JOIN e ON e.doc_id = ma.doc_id AND e.a = ma.node_id) GROUP BY 1, 2),
  c AS (SELECT se.doc_id, hop, unnest(chunk_ids) AS chunk_id FROM se JOIN nd ON nd.doc_id = se.doc_id AND nd.node_id = se.node_id UNION ALL SELECT se.doc_id, 2, unnest(chunk_ids) FROM se JOIN e ON e.doc_id = se.doc_id AND e.a = se.node_id),
  g AS (SELECT doc_id, chunk_id, min(hop) AS hop FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hop, chunk_id) AS place FROM g)
  SELECT doc_id AS query_id, chunk_id, CAST(hop AS INTEGER) AS hop, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8""")
def kg7_neighbor_chunks(spark, d):
    r = relation_rows(spark, d)
    n, _ = K.graph_from_knowledge(node_rows(spark, d), r)
    return K.neighbor_chunks(asked(spark, d), n, K.upsert_edges(r, r.limit(0)))


@register(f"WITH {GRAPH} SELECT doc_id, src, dst, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE round(confidence, 6) END AS confidence FROM up WHERE doc_id % 2 = 1 OR src < dst")
def kg8_replace_graph(spark, d):
    r = relation_rows(spark, d)
    e = K.upsert_edges(r, r.limit(0))
    new = e.filter("doc_id % 2 = 0 and src < dst").withColumn("confidence", F.lit(1.0))
    evens = e.filter("doc_id % 2 = 0").select("doc_id").distinct()
    return K.replace_graph(e.join(evens.join(new.select("doc_id").distinct(), "doc_id", "left_anti"), "doc_id", "left_anti"), new).select("doc_id", "src", "dst", F.round("confidence", 6).alias("confidence"))


@register(f"WITH {GRAPH} SELECT doc_id, node_id, doc_id % 2 = 1 AS built FROM nd")
def kg9_export_graph(spark, d):
    n, _ = K.graph_from_knowledge(node_rows(spark, d), relation_rows(spark, d))
    docs = n.select("doc_id").distinct()
    return K.export_graph(docs, n.filter("doc_id % 2 = 0"), n).select("doc_id", "node_id", "built")


# Code graph: suppliers and parts are vertices; a line's flag gives the relation and the way.


def vertices(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_partkey").alias("k"), F.lit("p").alias("t"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("k"), F.lit("s").alias("t"))
    v, k = p.union(s), F.col("k")
    label = F.when(k % 5 == 0, F.concat(F.lit("make_part_"), k, F.lit("()"))).when(k % 5 == 1, F.concat(F.lit("Part"), k)).when(k % 5 == 2, F.concat(F.lit("file"), k, F.lit(".py"))).when(k % 5 == 3, F.lit("store")).otherwise(F.concat(F.lit("readme note "), k))
    src = F.concat(F.when(F.col("t") == "p", "backend/store/m").otherwise("frontend/lib/m"), k % 20, F.lit(".py"))
    v = v.select("id", label.alias("label"), F.when(k % 7 == 0, "concept").otherwise("code").alias("file_type"), src.alias("source_file"), (k % 10).alias("community"))
    return C.classify_kind(v)


def edges(spark, d):
    l = table(spark, d, "lineitem")
    p, s = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    a = F.col("l_returnflag") == "A"
    rel = F.when(a & (F.col("l_linenumber") % 2 == 0), "imports").when(a, "calls").when(F.col("l_returnflag") == "R", "contains").when(F.col("l_linenumber") % 2 == 0, "uses").otherwise("inherits")
    return l.select(F.when(a, s).otherwise(p).alias("src"), F.when(a, p).otherwise(s).alias("dst"), rel.alias("relation"))


CODE = """v0 AS (SELECT 'p' || p_partkey AS id, p_partkey AS k, 'p' AS t FROM part UNION ALL SELECT 's' || s_suppkey, s_suppkey, 's' FROM supplier),
v1 AS (SELECT id, k, CASE k % 5 WHEN 0 THEN 'make_part_' || k || '()' WHEN 1 THEN 'Part' || k WHEN 2 THEN 'file' || k || '.py' WHEN 3 THEN 'store' ELSE 'readme note ' || k END AS label, CASE WHEN k % 7 = 0 THEN 'concept' ELSE 'code' END AS file_type, CASE t WHEN 'p' THEN 'backend/store/m' ELSE 'frontend/lib/m' END || (k % 20) || '.py' AS source_file, k % 10 AS community FROM v0),
v AS (SELECT *, CASE WHEN k % 5 = 4 THEN 'readme' WHEN file_type = 'concept' THEN 'concept' WHEN k % 5 = 2 THEN 'file' WHEN k % 5 = 0 THEN 'function' WHEN k % 5 = 1 THEN 'class' WHEN k % 5 = 3 AND source_file LIKE 'backend%' THEN 'module' ELSE 'code' END AS kind FROM v1),
e AS (SELECT CASE WHEN l_returnflag = 'A' THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS src, CASE WHEN l_returnflag = 'A' THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS dst,
  CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'imports' WHEN l_returnflag = 'A' THEN 'calls' WHEN l_returnflag = 'R' THEN 'contains' WHEN l_linenumber % 2 = 0 THEN 'uses' ELSE 'inherits' END AS relation FROM lineitem),
un AS (SELECT DISTINCT src AS a, dst AS b FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"""
DEGREES = """, dg AS (SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree FROM v LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY 1) USING (id))"""


@register(f"WITH {CODE} SELECT id, kind FROM v")
def cg1_classify_kind(spark, d):
    return vertices(spark, d).select("id", "kind")


@register(f"WITH {CODE}{DEGREES} SELECT id, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(degree AS BIGINT) AS degree FROM dg")
def cg2_degrees(spark, d):
    return C.degrees(vertices(spark, d), edges(spark, d))


_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_./\\+\-]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _searched(spark, d):
    """Vertices with degree, edges, and a query for each part whose number is divisible by 50."""
    v, e, k = vertices(spark, d), edges(spark, d), F.col("p_partkey")
    text = F.when(k / 50 % 3 == 0, F.concat(F.lit("make part "), k)).when(k / 50 % 3 == 1, F.concat(F.lit("Part"), k + 1, F.lit(" store"))).otherwise(F.concat(F.lit("readme note "), k + 4))
    return v.join(C.degrees(v, e), "id"), e, table(spark, d, "part").filter(k % 50 == 0).select(k.alias("query_id"), text.alias("query"))


#: All matches of the node search, numbered from the best.
_SCORES = rf"""WITH {CODE}{DEGREES}, q AS (SELECT p_partkey AS query_id, CASE p_partkey // 50 % 3 WHEN 0 THEN 'make part ' || p_partkey WHEN 1 THEN 'Part' || (p_partkey + 1) || ' store' ELSE 'readme note ' || (p_partkey + 4) END AS query FROM part WHERE p_partkey % 50 = 0),
  qn AS (SELECT *, {_NORM.format('query')} AS qn, list_filter(string_split({_NORM.format('query')}, ' '), lambda t: length(t) > 1) AS ts FROM q),
  nv AS (SELECT v.*, degree, {_NORM.format('label')} AS nl FROM v JOIN dg USING (id)),
  h AS (SELECT query_id, qn, query, nv.*, len(list_filter(ts, lambda t: contains(nl, t) OR contains(lower(id), t))) AS hits, len(list_filter(ts, lambda t: contains(nl, t) OR contains(lower(id), t) OR contains(lower(source_file), t))) AS met FROM qn, nv),
  s AS (SELECT query_id, id, source_file, round(CASE WHEN qn = nl OR lower(query) = lower(label) THEN 100.0 WHEN lower(id) = lower(query) THEN 99.0 ELSE 100.0 * (1 - levenshtein(qn, nl) / greatest(length(qn), length(nl), 1)) + least(10.0, 0.3 * degree) + 5.0 * hits - CASE WHEN length(label) > 80 THEN 15 WHEN length(label) > 40 THEN 5 ELSE 0 END + CASE WHEN kind IN ('class', 'function', 'module', 'file', 'code') THEN 8 WHEN kind IN ('document', 'paper', 'image', 'concept') THEN -3 ELSE 0 END END, 6) AS score FROM h WHERE met > 0 OR qn = nl OR lower(query) = lower(label) OR query = id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s)"""


@register(_SCORES + " SELECT query_id, id, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20")
def cg3_search_nodes(spark, d):
    v, _, q = _searched(spark, d)
    return N.search_nodes(v, q)


@register(_SCORES.replace("WHERE met > 0 OR qn = nl OR lower(query) = lower(label) OR query = id", "WHERE (met > 0 OR qn = nl OR lower(query) = lower(label) OR query = id) AND (kind IN ('file', 'code', 'readme') OR file_type IN ('file', 'code', 'readme')) AND contains(source_file, 'm1')") + " SELECT query_id, id, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20")
def cg3_search_filtered(spark, d):
    """Kinds by name and a part of the path."""
    v, _, q = _searched(spark, d)
    return N.search_nodes(v, q, kinds=("file", "readme"), file_contains="M1", fuzzy=None)


@register()
def cg3_search_misspelt(spark, d):
    """Queries that no vertex contains: labels that resemble them."""
    v, _, q = _searched(spark, d)
    odd = F.when(F.col("query_id") / 50 % 2 == 0, F.concat(F.lit("mkae_prat_"), "query_id", F.lit("()"))).otherwise(F.concat(F.lit("raedme-nte"), F.col("query_id") + 4))
    return N.search_nodes(v, q.withColumn("query", odd))


def _asked(spark, d):
    """Vertices whose number is divisible by 50."""
    return vertices(spark, d).filter("cast(substr(id, 2) as int) % 50 = 0").select("id")


@register(f"WITH {CODE} SELECT DISTINCT src AS id, dst AS other, relation, 'out' AS direction FROM e WHERE CAST(substr(src, 2) AS INT) % 50 = 0 UNION SELECT DISTINCT dst, src, relation, 'in' FROM e WHERE CAST(substr(dst, 2) AS INT) % 50 = 0")
def cg4_neighbors(spark, d):
    return C.neighbors(edges(spark, d), _asked(spark, d))


def _pairs(spark, d):
    """Each supplier whose number is divisible by 50, and the first ones, with a part."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").filter((k % 50 == 0) | (k < 5)).select(F.concat(F.lit("s"), k).alias("src"), F.concat(F.lit("p"), k * 7 + 1).alias("dst"))


@register(f"""WITH RECURSIVE {CODE}, pr AS (SELECT 's' || s_suppkey AS src, 'p' || (s_suppkey * 7 + 1) AS dst FROM supplier WHERE s_suppkey % 50 = 0 OR s_suppkey < 5),
  w(root, id, n) AS (SELECT src, src, 0 FROM pr UNION SELECT root, b, n + 1 FROM w JOIN un ON a = id WHERE n < 8) SELECT src, dst, CAST(min(n) AS INTEGER) AS hops FROM pr LEFT JOIN w ON root = src AND id = dst GROUP BY 1, 2""")
def cg5_shortest_paths(spark, d):
    return C.shortest_paths(edges(spark, d), _pairs(spark, d)).select("src", "dst", "hops")


_BLOCKS = """x AS (SELECT l_partkey // 6 AS g, 'p' || l_partkey AS a, 'p' || (l_partkey - l_partkey % 6 + l_suppkey % 6) AS b FROM lineitem WHERE l_linenumber < 3),
  ends AS (SELECT g, min(v) AS src, max(v) AS dst FROM (SELECT g, a AS v FROM x UNION ALL SELECT g, b FROM x) GROUP BY 1), st AS (SELECT DISTINCT g, a, b FROM (SELECT g, a, b FROM x UNION ALL SELECT g, b, a FROM x) WHERE a <> b)"""


@register(f"""WITH RECURSIVE {_BLOCKS}, w(g, src, id, n) AS (SELECT g, src, src, 0 FROM ends UNION SELECT w.g, src, b, n + 1 FROM w JOIN st ON st.g = w.g AND a = id WHERE n < 6)
  SELECT CAST(ends.g AS VARCHAR) AS graph_id, ends.src, dst, CAST(min(n) AS INTEGER) AS hops FROM ends LEFT JOIN w ON w.g = ends.g AND id = dst GROUP BY 1, 2, 3""")
def cg5_paths_in_modules(spark, d):
    """From the first to the last part of each block of six, by the table function."""
    register_table_functions(spark)
    p = F.col("l_partkey")
    e = table(spark, d, "lineitem").filter("l_linenumber < 3").select(F.floor(p / 6).cast("string").alias("graph_id"), F.lit("edge").alias("kind"), F.concat(F.lit("p"), p).alias("src"), F.concat(F.lit("p"), p - p % 6 + F.col("l_suppkey") % 6).alias("dst"))
    ends = e.select("graph_id", F.explode(F.array("src", "dst")).alias("v")).groupBy("graph_id").agg(F.lit("pair").alias("kind"), F.min("v").alias("src"), F.max("v").alias("dst"))
    e.union(ends.select("graph_id", "kind", "src", "dst")).createOrReplaceTempView("module_links")
    return spark.sql("SELECT graph_id, src, dst, hops FROM shortest_paths(TABLE(module_links) PARTITION BY graph_id)")


@register(f"WITH {CODE} SELECT DISTINCT src AS id, dst AS other, CASE relation WHEN 'imports' THEN 'imports' WHEN 'calls' THEN 'calls' WHEN 'uses' THEN 'calls' WHEN 'inherits' THEN 'inherits' ELSE 'documents' END AS family FROM e WHERE src IN (SELECT id FROM v WHERE community = 3)")
def cg6_dependencies(spark, d):
    return C.dependencies(edges(spark, d), vertices(spark, d).filter("community = 3").select("id"))


@register(f"WITH {CODE} SELECT DISTINCT dst AS id, src AS other, relation FROM e WHERE dst IN (SELECT id FROM v WHERE community = 3)")
def cg6_dependents(spark, d):
    return C.dependents(edges(spark, d), vertices(spark, d).filter("community = 3").select("id"))


_IMPACT = "st AS (SELECT DISTINCT * FROM (SELECT dst AS a, src AS b FROM e UNION ALL SELECT src, dst FROM e WHERE relation IN ('contains', 'defines', 'method')))"


@register(f"""WITH RECURSIVE {CODE}, {_IMPACT}, w(root, id, n) AS (SELECT id, id, 0 FROM v WHERE CAST(substr(id, 2) AS INT) % 50 = 0 UNION SELECT root, b, n + 1 FROM w JOIN st ON a = id WHERE n < 2), m AS (SELECT root, id, min(n) AS distance FROM w GROUP BY 1, 2)
  SELECT root, source_file, CAST(min(distance) AS INTEGER) AS distance FROM m JOIN v USING (id) WHERE distance > 0 GROUP BY 1, 2""")
def cg7_impact(spark, d):
    return C.impact_files(edges(spark, d), _asked(spark, d), vertices(spark, d), 2)


@register(_SCORES + """, top AS (SELECT query_id, id, score, place FROM r WHERE place <= 5),
  fe AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, relation) AS nth FROM (SELECT DISTINCT src, dst, relation FROM e WHERE src IN (SELECT id FROM top))),
  fs AS (SELECT query_id, source_file, id, score, 'hit' AS role, place AS turn, 0 AS nth FROM r WHERE place <= 25
    UNION ALL SELECT query_id, v.source_file, v.id, score, 'neighbour', 25 + place, nth FROM top JOIN fe ON src = top.id AND nth <= 20 JOIN v ON v.id = dst WHERE kind IN ('readme', 'document', 'paper') OR file_type IN ('document', 'image')),
  one AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY turn, nth, id) AS n FROM fs),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, nth, id) AS spot FROM one WHERE n = 1)
  SELECT query_id, source_file, id, score, role, CAST(spot AS INTEGER) AS place FROM o WHERE spot <= 25""")
def cg8_locate(spark, d):
    v, e, q = _searched(spark, d)
    return N.locate(v, e, q)


_LISTS = ("files", "classes", "functions", "dependencies", "users")


@register(_SCORES + """, fit AS (SELECT r.query_id, r.id, place, contains(lower(source_file), replace(qn, ' ', '/')) OR contains(r.id, replace(qn, ' ', '_')) AS fits FROM r JOIN qn USING (query_id) WHERE place <= 15),
  seed AS (SELECT f.query_id, v.id AS seed, v.source_file, v.community, regexp_replace(v.source_file, '/[^/]*$', '') AS folder FROM (SELECT query_id, arg_min(id, (CASE WHEN fits THEN 0 ELSE 100 END) + place) AS id FROM fit GROUP BY 1) f JOIN v USING (id)),
  peers AS (SELECT community, id FROM v QUALIFY row_number() OVER (PARTITION BY community ORDER BY id) <= 80),
  rel AS (SELECT query_id, seed AS id FROM seed UNION SELECT query_id, v.id FROM seed JOIN v ON lower(v.source_file) = lower(seed.source_file) UNION SELECT query_id, v.id FROM seed JOIN v ON starts_with(v.source_file, folder || '/') UNION SELECT query_id, id FROM seed JOIN peers USING (community)),
  names AS (SELECT query_id, 'files' AS what, source_file AS name FROM rel JOIN v USING (id) UNION SELECT query_id, CASE kind WHEN 'class' THEN 'classes' ELSE 'functions' END, label FROM rel JOIN v USING (id) WHERE kind IN ('class', 'function')
    UNION SELECT query_id, 'dependencies', label FROM rel JOIN (SELECT DISTINCT src, dst FROM e WHERE relation IN ('imports', 'imports_from', 'calls', 'uses')) x ON x.src = rel.id JOIN v ON v.id = dst
    UNION SELECT query_id, 'users', label FROM rel JOIN (SELECT DISTINCT src, dst FROM e WHERE relation IN ('imports', 'imports_from', 'calls', 'uses', 'references')) x ON x.dst = rel.id JOIN v ON v.id = src),
  cut AS (SELECT *, row_number() OVER (PARTITION BY query_id, what ORDER BY name) AS n FROM names),
  ls AS (SELECT query_id, what, string_agg(name, ',' ORDER BY name) AS names FROM cut WHERE n <= CASE what WHEN 'files' THEN 25 WHEN 'classes' THEN 20 ELSE 30 END GROUP BY 1, 2)
  SELECT query_id, seed, (SELECT count(*) FROM rel WHERE rel.query_id = seed.query_id) AS members, """ + ", ".join(f"coalesce((SELECT names FROM ls WHERE ls.query_id = seed.query_id AND what = '{c}'), '') AS {c}" for c in _LISTS) + " FROM seed")
def cg9_module_summary(spark, d):
    v, e, q = _searched(spark, d)
    return N.module_summary(v, e, q).select("query_id", "seed", "members", *[F.array_join(c, ",").alias(c) for c in _LISTS])


@register(f"WITH {CODE}{DEGREES} SELECT id, CAST(degree AS BIGINT) AS degree FROM dg ORDER BY degree DESC, id LIMIT 25")
def cg12_hotspots(spark, d):
    return C.hotspots(vertices(spark, d), edges(spark, d))[0]


@register(f"WITH {CODE}{DEGREES} SELECT community, count(*) AS size, arg_min(id, (-degree, id)) AS representative, array_to_string(list_sort(list(DISTINCT source_file))[1:12], ',') AS files FROM (SELECT v.*, degree FROM v JOIN dg USING (id)) GROUP BY 1".replace("(-degree, id))", "row(-degree, id))"))
def cg12_communities(spark, d):
    return C.hotspots(vertices(spark, d), edges(spark, d))[1].select("community", "size", "representative", F.array_join("files", ",").alias("files"))


@register()
def cg13_betweenness(spark, d):
    return C.betweenness(edges(spark, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


@register(f"WITH {CODE} SELECT community, 'kind' AS what, kind AS name, count(*) AS vertices FROM v GROUP BY 1, 3 UNION ALL SELECT community, 'module', split_part(source_file, '/', 1) || '/' || split_part(source_file, '/', 2), count(*) FROM v GROUP BY 1, 3 UNION ALL SELECT community, 'file', source_file, count(*) FROM v GROUP BY 1, 3")
def cg14_community(spark, d):
    return C.community(vertices(spark, d))


@register(f"WITH {CODE}, n AS (SELECT id FROM v WHERE CAST(substr(id, 2) AS INT) % 50 = 0 UNION SELECT b FROM un WHERE CAST(substr(a, 2) AS INT) % 50 = 0) SELECT DISTINCT src, dst, relation FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def cg15_neighborhood(spark, d):
    return C.neighborhood(edges(spark, d), _asked(spark, d))


@register(f"""WITH {CODE}{DEGREES}, hub AS (SELECT id, degree FROM dg ORDER BY degree DESC, id LIMIT 20),
  fe AS (SELECT src, dst, relation, degree, row_number() OVER (PARTITION BY src ORDER BY dst, relation) AS nth FROM (SELECT DISTINCT src, dst, relation FROM e) JOIN hub ON hub.id = src QUALIFY nth <= 5),
  new AS (SELECT dst, min(row(-degree, src, nth)) AS at FROM fe WHERE dst NOT IN (SELECT id FROM hub) GROUP BY 1 ORDER BY 2 LIMIT 20)
  SELECT src, dst, relation FROM fe WHERE dst IN (SELECT dst FROM new UNION ALL SELECT id FROM hub)""")
def cg15_skeleton(spark, d):
    v, e = vertices(spark, d), edges(spark, d)
    return N.skeleton(v.join(C.degrees(v, e), "id"), e)


def imports(spark, d):
    """Imports among parts of a block of six, and a ring of many suppliers: small cycles and one that is too large."""
    l = table(spark, d, "lineitem").filter("l_linenumber < 3")
    p, s, flag = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")
    rel = F.when(flag == "A", "imports").when(flag == "R", "calls").otherwise("contains")
    blocks = l.select(F.concat(F.lit("p"), p).alias("src"), F.concat(F.lit("p"), p - p % 6 + s % 6).alias("dst"), rel.alias("relation"))
    ring = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).select(F.concat(F.lit("s"), "k").alias("src"), F.explode(F.array(F.col("k") + 1, F.when(F.col("k") > 1, F.col("k") - 1).otherwise(F.lit(2)))).alias("o"))
    return blocks.union(ring.select("src", F.concat(F.lit("s"), "o"), F.lit("uses")))


@register("""WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 'p' || (l_partkey - l_partkey % 6 + l_suppkey % 6) AS dst FROM lineitem WHERE l_linenumber < 3 AND l_returnflag IN ('A', 'R') UNION SELECT 's' || s_suppkey, 's' || unnest([s_suppkey + 1, CASE WHEN s_suppkey > 1 THEN s_suppkey - 1 ELSE 2 END]) FROM supplier),
  w(a, b) AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT a, dst FROM w JOIN e ON src = b), m AS (SELECT x.a AS id, min(least(x.a, x.b)) AS component FROM w x JOIN w y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1),
  z AS (SELECT component, count(*) AS size FROM m GROUP BY 1) SELECT id, component, size FROM m JOIN z USING (component) WHERE size BETWEEN 2 AND 12""")
def cg16_cycles(spark, d):
    return C.cycles(imports(spark, d))


@register(f"WITH {CODE}{DEGREES} SELECT v.id, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(degree AS BIGINT) AS degree FROM v JOIN dg USING (id) WHERE (file_type = 'code' OR kind IN ('function', 'class', 'module', 'file')) AND in_degree = 0 AND out_degree <= 1")
def cg17_dead_nodes(spark, d):
    return C.dead_nodes(vertices(spark, d), edges(spark, d))


@register(f"WITH {CODE} SELECT dst AS id, count(*) AS inbound_refs FROM e WHERE relation IN ('imports', 'imports_from', 'calls', 'uses', 'references') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def cg18_most_reused(spark, d):
    return C.most_reused(edges(spark, d))


@register(f"WITH {CODE} SELECT src, dst, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM e GROUP BY 1, 2 HAVING count(DISTINCT relation) >= 2")
def cg19_hidden_coupling(spark, d):
    return C.hidden_coupling(edges(spark, d), 2).withColumn("relations", F.array_join("relations", ","))


@register(f"WITH {CODE} SELECT src, dst, relation, a.source_file AS from_file, b.source_file AS to_file FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE relation IN ('imports', 'imports_from', 'calls') AND (a.source_file LIKE 'frontend/%' AND '/' || b.source_file LIKE '%/backend/%' OR a.source_file LIKE 'backend/%' AND b.source_file LIKE 'frontend/%')")
def cg20_layer_violations(spark, d):
    return C.layer_violations(vertices(spark, d), edges(spark, d))


@register(f"WITH {CODE} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(DISTINCT community) FROM v) AS communities, (SELECT count(DISTINCT source_file) FROM v) AS files, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT relation) FROM e) AS relations")
def cg21_graph_stats(spark, d):
    return C.graph_stats(vertices(spark, d), edges(spark, d))


@register()
def cg10_explain_flow(spark, d):
    return C.explain_flow(edges(spark, d), vertices(spark, d), _pairs(spark, d))


@register()
def cg11_graph_qa(spark, d):
    v, e, q = _searched(spark, d)
    return N.graph_qa(v, e, q.withColumn("query", F.concat(F.lit("How does the "), "query", F.lit(" work with Part1 code"))))


@register(ORACLES["kg7_neighbor_chunks"].replace("SELECT doc_id AS query_id, chunk_id, CAST(hop AS INTEGER) AS hop, CAST(place AS INTEGER) AS place FROM r", "SELECT r.doc_id AS query_id, chunk_id, CAST(place AS INTEGER) AS place, length(text) AS n_chars FROM r JOIN conversations c ON c.conv_id = r.doc_id AND CAST(c.turn AS VARCHAR) = chunk_id"))
def ret5_graph_seeds(spark, d):
    """Seed chunks of each query with their text; chunks without text go."""
    seeds = kg7_neighbor_chunks(spark, d)
    texts = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("chunk_id"), F.length("text").cast("long").alias("n_chars")).filter("n_chars > 0")
    return seeds.join(texts, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "place", "n_chars")
