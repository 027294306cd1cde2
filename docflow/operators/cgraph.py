"""Analytics of a code graph of any size: vertices (id, label, file_type, source_file, community), edges (src, dst, relation).

Iterations run on the driver until nothing changes; each round's frontier is checkpointed or written in
spark.checkpoint.dir, so lost executors cost no more than a round.
"""

from __future__ import annotations

import functools
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.session import shared_folder

# Relation families, relations a change passes through, endings of images and files.
FAMILIES = {
    "imports": "imports", "imports_from": "imports", "re_exports": "imports", "calls": "calls", "indirect_call": "calls", "method": "calls", "uses": "calls",
    "inherits": "inherits", "extends": "inherits", "rationale_for": "documents", "contains": "documents",
}
CHILD_RELATIONS = ("contains", "defines", "method")
CYCLE_RELATIONS = ("imports", "imports_from", "calls", "uses")
REUSE_RELATIONS = (*CYCLE_RELATIONS, "references")
IMAGES = r"\.(png|jpg|jpeg|svg|webp|gif)$"
FILES = r"(?i)\.(py|ts|tsx|js|jsx|md|pdf|png|jpg|jpeg|svg|yml|yaml|toml|json|sh|ps1)$"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and the optimizer knows its size."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def classify_kind(v: DataFrame) -> DataFrame:
    """CG1: a coarse kind from type, label and file."""
    ft, label, src = F.lower(F.coalesce("file_type", F.lit(""))), F.coalesce("label", F.lit("")), F.lower(F.coalesce("source_file", F.lit("")))
    low, name = F.lower(label), F.substring_index("source_file", "/", -1)
    paper = F.contains(low, F.lit("paper")) | F.contains(src, F.lit("paper")) | src.endswith(".pdf")
    upper = F.substring(label, 1, 1).rlike(r"\p{Lu}") & ~F.contains(label, F.lit(" "))
    folder = F.lower(F.element_at(F.split(src, "/"), F.lit(-2)))
    stem = F.regexp_replace(F.substring_index(src, "/", -1), r"\.[^.]*$", "")
    kind = (
        F.when((ft == "image") | src.rlike(IMAGES), "image")
        .when(((ft == "document") | src.rlike(r"\.(pdf|docx)$")) & paper, "paper")
        .when((ft == "document") | src.rlike(r"\.(pdf|docx)$"), "document")
        .when(F.contains(low, F.lit("readme")) | F.contains(src, F.lit("readme")), "readme")
        .when(ft.isin("concept", "rationale"), ft)
        .when(label.rlike(FILES) | ((src != "") & (label == name)), "file")
        .when(label.endswith("()"), "function")
        .when(upper & ~F.contains(label, F.lit(".")), "class")
        .when(F.contains(src, F.lit("/")) & ((low == folder) | (low == stem)), "module")
        .when((ft == "code") & upper, "class")
        .when(ft == "code", "code")
        .otherwise(F.coalesce(F.nullif(ft, F.lit("")), F.lit("unknown")))
    )
    return v.withColumn("kind", kind)


def degrees(v: DataFrame, e: DataFrame) -> DataFrame:
    """CG2: edges in, out and at each vertex."""
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return v.select("id").join(d, "id", "left").select("id", zero("in_degree"), zero("out_degree"), (F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))).alias("degree"))


def neighbors(e: DataFrame, ids: DataFrame, relations: tuple[str, ...] | None = None) -> DataFrame:
    """CG4: distinct neighbours of the ids with direction and relation."""
    e = e.filter(F.col("relation").isin(*relations)) if relations else e
    out = e.join(ids.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), F.col("dst").alias("other"), "relation", F.lit("out").alias("direction"))
    into = e.join(ids.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), "relation", F.lit("in").alias("direction"))
    return out.union(into).distinct()


def undirected(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def bfs(e: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """(root, id, distance, parent) within depth steps (None: any) of each root along (src, dst) rows; the least parent on ties."""
    seen = cut(seeds.select("root", F.col("root").alias("id"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")))
    front = seen
    for step in itertools.count(1) if depth is None else range(1, depth + 1):
        nxt = front.select("root", F.col("id").alias("src")).join(e, "src").groupBy("root", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = cut(nxt.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(step).alias("distance"), "parent"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def components(e: DataFrame) -> DataFrame:
    """(id, component) of all vertices with an edge to another one, edges taken either way; components are numbers.

    Vertices are numbered at random; each round joins every vertex to its least neighbour of a smaller number, follows these links to
    their roots, and keeps the edges between different roots. Rounds grow with the logarithm of the longest chain.
    """
    e = e.select("src", "dst").filter("src <> dst")
    v = written(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("number", F.monotonically_increasing_id()))
    number = lambda end, name: v.select(F.col("id").alias(end), F.col("number").alias(name))
    upward = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    now, out = written(upward(e.join(number("src", "x"), "src").join(number("dst", "y"), "dst"))), v.select("id", F.col("number").alias("component"))
    while not now.isEmpty():
        up, moved = written(now.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("to"))), True
        while moved:
            further = up.select(F.col("v").alias("to"), F.col("to").alias("next"))
            up = written(up.join(further, "to", "left").select("v", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            moved, up = not up.filter("moved").isEmpty(), up.select("v", "to")
        root = lambda df, c: df.join(up.select(F.col("v").alias(c), F.col("to").alias(f"up_{c}")), c, "left").withColumn(c, F.coalesce(f"up_{c}", c)).drop(f"up_{c}")  # noqa: B023, E731
        now = written(upward(root(root(now, "a"), "b").select(F.col("a").alias("x"), F.col("b").alias("y"))).filter("a < b").distinct())
        out = root(out, "component")
    return written(out)


def both_ways(e: DataFrame) -> DataFrame:
    """(src, dst) of every edge and its reverse, repeats included."""
    return e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst")


def _connected(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of one component, and those of a vertex with itself: no ball has to fill a component to learn that there is no path."""
    c, pairs = components(e), pairs.select("src", "dst").distinct()
    of = lambda end: c.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    return written(pairs.join(of("src"), "src", "left").join(of("dst"), "dst", "left").filter("src = dst or c_src = c_dst").select("src", "dst"))


def _meetings(links: DataFrame, pairs: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(src, dst, hops) of connected pairs, and the balls (root, id, distance, parent) that grew around their ends.

    Of each pair the end with fewer vertices at its ball's rim grows by a step, until the balls meet or one is a whole component. Edges go
    both ways, so what a rim reaches lies in the last two rims or is new.
    """
    ends = pairs.select("src", "dst").filter("src is not null and dst is not null").distinct()
    found, open_ = [ends.filter("src = dst").withColumn("hops", F.lit(0))], written(ends.filter("src <> dst"))
    rim = written(ends.select(F.col("src").alias("root")).union(ends.select("dst")).distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")))
    balls, inner = rim, rim.limit(0)
    while True:
        size = written(rim.groupBy("root").agg(F.count("*").alias("n"), F.max("distance").alias("radius")))
        of = lambda end: size.select(F.col("root").alias(end), F.col("n").alias(f"n_{end}"), F.col("radius").alias(f"radius_{end}"))
        live = open_.join(of("src"), "src").join(of("dst"), "dst")
        live = written(live.filter(F.col("radius_src") + F.col("radius_dst") < most) if most is not None else live)
        if live.isEmpty():
            break
        grow = live.select(F.when(F.col("n_src") <= F.col("n_dst"), F.col("src")).otherwise(F.col("dst")).alias("root")).distinct()
        nxt = rim.join(grow, "root", "left_semi").select("root", F.col("id").alias("src"), "distance").join(links, "src").groupBy("root", F.col("dst").alias("id")).agg((F.max("distance") + 1).alias("distance"), F.min("src").alias("parent"))
        new = written(nxt.join(rim.select("root", "id").union(inner.select("root", "id")), ["root", "id"], "left_anti"))
        balls = balls.union(new)
        still = lambda df: df.join(grow, "root", "left_anti")
        rim, inner = new.union(still(rim)), rim.join(grow, "root", "left_semi").union(still(inner))
        near = rim.union(inner)
        met = None
        for a, b in (("src", "dst"), ("dst", "src")):
            hits = live.select("src", "dst").join(new.select(F.col("root").alias(a), "id", F.col("distance").alias("way")), a).join(near.select(F.col("root").alias(b), "id", "distance"), [b, "id"])
            hits = hits.select("src", "dst", (F.col("way") + F.col("distance")).alias("hops"))
            met = hits if met is None else met.union(hits)
        met = written(met.groupBy("src", "dst").agg(F.min("hops").alias("hops")))
        found.append(met if most is None else met.filter(F.col("hops") <= most))
        open_ = written(live.select("src", "dst").join(met, ["src", "dst"], "left_anti"))
        wanted = open_.select(F.col("src").alias("root")).union(open_.select("dst")).distinct()
        rim, inner = (written(df.join(wanted, "root", "left_semi")) for df in (rim, inner))
    return functools.reduce(DataFrame.union, found), balls


def shortest_paths(e: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """CG5: (src, dst) pairs -> hops and the path, edges taken either way; null where there is none (within `most` hops, if given).

    Of equally short paths the one over the least vertices, seen from its end.
    """
    links = both_ways(e)
    found, balls = _meetings(links, _connected(e, pairs), most)
    radius = balls.groupBy(F.col("root").alias("src")).agg(F.max("distance").alias("radius"))
    split = written(found.join(radius, "src").withColumn("way", F.least("hops", "radius")))
    # Vertices where the balls meet, then those towards the end, each with the least way back to a meeting.
    ball = lambda end, *names: balls.select(F.col("root").alias(end), *names)
    meet = split.select("src", "dst", F.col("way").alias("distance"), (F.col("hops") - F.col("way")).alias("rest")).join(ball("src", "id", "distance"), ["src", "distance"])
    meet = written(meet.select("src", "dst", "id", F.col("rest").alias("distance")).join(ball("dst", "id", "distance"), ["dst", "id", "distance"]).select("src", "dst", "id", "distance", F.array("id").alias("path")))
    line = meet.filter("distance = 0")
    steps = meet.agg(F.max("distance")).first()[0] or 0
    far = meet.filter(F.col("distance") == steps)
    for step in range(steps, 0, -1):
        up = far.select("src", "dst", F.col("id").alias("via"), "path").join(links.withColumnsRenamed({"src": "via", "dst": "id"}), "via").join(ball("dst", "id", "distance").filter(F.col("distance") == step - 1), ["dst", "id"])
        far = written(up.groupBy("src", "dst", "id").agg(F.min(F.struct("via", "path"))["path"].alias("path")).select("src", "dst", "id", F.lit(step - 1).alias("distance"), F.concat("path", F.array("id")).alias("path")).union(meet.filter(F.col("distance") == step - 1)))
    line = (far if steps else line).join(split, ["src", "dst"]).select("src", "dst", "hops", "way", "path", F.get("path", F.lit(0)).alias("id"))
    for _ in range(split.agg(F.max("way")).first()[0] or 0):
        line = written(line.join(ball("src", "id", "parent"), ["src", "id"], "left").select("src", "dst", "hops", "way", F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"), F.coalesce("parent", "id").alias("id")))
    return pairs.join(line.select("src", "dst", "hops", "path"), ["src", "dst"], "left").select("src", "dst", "hops", F.array_join("path", " > ").alias("path"))


def family(relation: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(relation)), F.lit("references"))


def dependencies(e: DataFrame, ids: DataFrame) -> DataFrame:
    """CG6: what each id depends on, by family of relation."""
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"), family(F.col("relation")).alias("family")).distinct()


def dependents(e: DataFrame, ids: DataFrame) -> DataFrame:
    """CG6: what depends on each id."""
    return e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("other"), "relation").distinct()


def impact(e: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """CG7: what a change of a seed may touch: users, and contained children, within depth steps."""
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    down = e.filter(F.col("relation").isin(*CHILD_RELATIONS)).select("src", "dst")
    out = bfs(back.union(down).distinct(), seeds.select(F.col("id").alias("root")), depth)
    return out.filter("distance > 0").select("root", "id", "distance")


def affected_files(touched: DataFrame, v: DataFrame) -> DataFrame:
    """CG7: files of touched vertices with the least distance."""
    return touched.join(v.select("id", "source_file"), "id").filter("source_file is not null").groupBy("root", "source_file").agg(F.min("distance").alias("distance"))


def impact_files(e: DataFrame, seeds: DataFrame, v: DataFrame, depth: int = 2) -> DataFrame:
    """CG7: affected_files(impact(e, seeds, depth), v), without a row for each vertex that the last step reaches.

    Of the last step only files matter: each vertex names the files of those it leads to, once. A step back to the seed itself does not
    count, so the least and the greatest vertex of a file are kept; those that earlier steps reached have a smaller distance by them.
    """
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = back.union(e.filter(F.col("relation").isin(*CHILD_RELATIONS)).select("src", "dst"))
    files = v.select("id", "source_file").filter("source_file is not null")
    near = bfs(steps, seeds.select(F.col("id").alias("root")), depth - 1)
    led = steps.join(files.withColumnRenamed("id", "dst"), "dst").groupBy("src", "source_file").agg(F.min("dst").alias("least"), F.max("dst").alias("most"))
    last = near.filter(F.col("distance") == depth - 1).select("root", F.col("id").alias("src")).join(led, "src")
    last = last.filter((F.col("least") != F.col("root")) | (F.col("most") != F.col("root"))).select("root", "source_file", F.lit(depth).alias("distance"))
    before = near.filter("distance > 0").join(files, "id").select("root", "source_file", "distance")
    return before.union(last).groupBy("root", "source_file").agg(F.min("distance").alias("distance"))


def hotspots(v: DataFrame, e: DataFrame, top: int = 25) -> tuple[DataFrame, DataFrame]:
    """CG12: vertices of most edges; communities by size, with their busiest member and first files."""
    d = degrees(v, e)
    busy = d.orderBy(F.desc("degree"), "id").limit(top).select("id", "degree")
    c = v.join(d, "id").groupBy("community").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("degree")).alias("k"), "id"))["id"].alias("representative"), F.slice(F.array_sort(F.collect_set("source_file")), 1, 12).alias("files"))
    return busy, c.orderBy(F.desc("size"), "community").limit(top)


#: Vertices of a block of betweenness(), sources walked at a time at most and at least, and bytes that a round of them may move.
BLOCK, MOST_SOURCES, LEAST_SOURCES, MOVED = 1024, 256, 16, 16 * 2**30
_ROUND = "block int, n int, at int, roots binary, values binary, share binary"


def _arrive(width: int, level: int, back: bool):
    """Messages of a round arrive at the blocks of vertices: what they leave there, and rows of those that send in the next round.

    Rows come sorted by block, its state first (n is set): a matrix of distances and one of path counts, a column a source, in `roots` and
    `values`, and the shares. A message brings one vertex's values for some sources to its neighbours `to` in the block.
    """
    def leave(block, n, dist, paths, share, sums):
        if back:
            here = dist == level
            share[here] = paths[here] * sums[here]
            send = np.divide(1.0 + share, paths, out=np.zeros_like(share), where=here)
        else:
            here = (sums > 0) & (dist < 0)
            dist[here], paths[here] = level, sums[here]
            send = paths
        at = np.flatnonzero(here.any(axis=1))
        roots = [np.flatnonzero(here[i]).astype(np.int16) for i in at]
        rows = [(block, n, None, dist.tobytes(), paths.tobytes(), share.tobytes() if back else None)]
        rows += [(block, None, int(i), r.tobytes(), send[i, r].tobytes(), None) for i, r in zip(at, roots)]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = ["block", "n", "at", "roots", "values", "share"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        now = None
        for b in batches:
            to = b["to"]
            ends, flat = to.offsets.to_numpy(), to.values.to_numpy(zero_copy_only=False)
            for i, (block, n, roots, values, share) in enumerate(zip(*(b[c] for c in ("block", "n", "roots", "values", "share")))):
                n = n.as_py()
                if n is None:
                    now[-1][np.ix_(flat[ends[i] : ends[i + 1]], np.frombuffer(roots.as_buffer(), np.int16))] += np.frombuffer(values.as_buffer())
                    continue
                if now:
                    yield leave(*now)
                matrix = lambda x, t, none: np.frombuffer(x.as_buffer(), t).reshape(n, width).copy() if x.is_valid else np.full((n, width), none, t)  # noqa: B023, E731
                now = block.as_py(), n, matrix(roots, np.int32, -1), matrix(values, np.float64, 0), matrix(share, np.float64, 0), np.zeros((n, width))
        if now:
            yield leave(*now)

    return run


def _shares(batches):
    """Sums over the sources of the shares of vertices that a source other than themselves reaches."""
    for b in batches:
        for block, n, roots, share in zip(*(b[c].to_pylist() for c in ("block", "n", "roots", "share"))):
            far = np.frombuffer(roots, np.int32).reshape(n, -1) > 0
            at = np.flatnonzero(far.any(axis=1))
            total = (np.frombuffer(share).reshape(n, -1) * far).sum(axis=1)[at]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(total)], names=["block", "at", "share"])


def betweenness(e: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """CG13: betweenness from k sources drawn by hash: shortest-path counts forward, shares backward.

    Without k, a tenth of the vertices, 10 at least and 200 at most. Paths may have any length. Vertices are dealt to blocks; in a round each
    that was reached last sends its values of all sources at once to every block that holds neighbours, where they are added to
    the matrix of the block. A task holds one block.
    """
    spark, u = e.sparkSession, written(undirected(e))
    ids = written(u.select(F.col("src").alias("id")).distinct())
    size, n_edges = ids.count(), u.count()
    k = min(200, max(10, size // 10)) if k is None else k
    n_blocks = max(1, -(-size // BLOCK))
    v = written(ids.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1))
    end = lambda name: v.select(F.col("id").alias(name), F.struct("block", "at").alias(f"v_{name}"))
    links = u.join(end("src"), "src").join(end("dst"), "dst").groupBy(F.col("v_src.block").alias("block"), F.col("v_src.at").alias("at"), F.col("v_dst.block").alias("near"))
    links = written(links.agg(F.collect_list("v_dst.at").alias("to")))
    sources = v.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).select("block", "at").collect()
    width = min(MOST_SOURCES, max(LEAST_SOURCES, MOVED // (8 * max(1, n_edges))))
    total = None
    for first in range(0, len(sources), width):
        some = sources[first : first + width]
        null = lambda t, c: F.lit(None).cast(t).alias(c)
        state = v.groupBy("block").agg(F.count("*").cast("int").alias("n")).select("block", "n", *[null("binary", c) for c in ("roots", "values", "share")])
        sent = spark.createDataFrame([(r.block, [r.at], np.int16(i).tobytes(), np.float64(1).tobytes()) for i, r in enumerate(some)], "block int, to array<int>, roots binary, values binary")

        def arrive(level, back):
            rows = state.select("block", "n", null("array<int>", "to"), "roots", "values", "share")  # noqa: B023
            rows = rows.union(sent.select("block", null("int", "n"), "to", "roots", "values", null("binary", "share")))  # noqa: B023
            rows = rows.repartition(min(2 * n_blocks, 1000), "block").sortWithinPartitions("block", F.col("n").isNull())
            out = written(rows.mapInArrow(_arrive(len(some), level, back), _ROUND))  # noqa: B023
            reached = out.filter("at is not null")
            return out.filter("n is not null"), reached.select("block", "at", "roots", "values").join(links, ["block", "at"]).select(F.col("near").alias("block"), "to", "roots", "values"), reached

        for level in itertools.count():
            state, sent, reached = arrive(level, False)
            if reached.isEmpty():
                break
        for back in range(level - 1, 0, -1):
            state, sent, _ = arrive(back, True)
        part = state.filter("share is not null").mapInArrow(_shares, "block int, at int, share double")
        total = part if total is None else total.union(part)
    if total is None:
        return v.limit(0).select("id", F.lit(0.0).alias("betweenness"))
    return v.join(total.groupBy("block", "at").agg(F.sum("share").alias("betweenness")), ["block", "at"]).select("id", "betweenness")


def community(v: DataFrame) -> DataFrame:
    """CG14: vertices of each community by kind, by the first two parts of their path, and by file."""
    module = F.concat_ws("/", F.slice(F.split("source_file", "/"), 1, 2))
    by = lambda what, c: v.groupBy("community", F.lit(what).alias("what"), F.coalesce(c, F.lit("unknown")).alias("name")).agg(F.count("*").alias("vertices"))
    files = by("file", F.col("source_file")).filter("name <> 'unknown'")
    return by("kind", F.col("kind")).union(by("module", module)).union(files)


def neighborhood(e: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """CG15: edges between vertices within depth steps of the seeds."""
    near = bfs(undirected(e), seeds.select(F.col("id").alias("root")), depth).select("id").distinct()
    return e.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").distinct()


def cycles(e: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """CG16: (id, component, size) of strongly connected components of `least` to `most` vertices on import and call edges."""
    c = scc(e.filter(F.col("relation").isin(*CYCLE_RELATIONS)))
    sizes = c.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size").between(least, most))
    return c.join(sizes, "component").select("id", "component", "size")


def scc(e: DataFrame) -> DataFrame:
    """(id, component) of strongly connected components of two vertices or more, named by their least id.

    Vertices with edges both ways are one: they are merged, as often as new ones come up, so that chains and rings of them cost rounds
    by the logarithm of their length. What is left goes through _scc_rounds.
    """
    edges, merged = written(e.select("src", "dst").filter("src <> dst").distinct()), []
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("component", F.col("id"))
    named = lambda df, up, c: df.join(up.withColumnsRenamed({"id": c, "name": f"new_{c}"}), c, "left").withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
    while True:
        both = written(edges.filter("src < dst").join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").select("src", "dst"))
        if both.isEmpty():
            break
        c = components(both)
        up = written(c.join(c.groupBy("component").agg(F.min("id").alias("name")), "component").select("id", "name"))
        merged.append(up)
        edges = written(named(named(edges, up, "src"), up, "dst").select("src", "dst").filter("src <> dst").distinct())
    for up in merged:
        vertices = named(vertices, up, "component")
    rest = _scc_rounds(edges)
    if rest is not None:
        vertices = named(vertices, rest.select("id", F.col("component").alias("name")), "component")
    vertices = written(vertices.select("id", "component"))
    big = vertices.groupBy("component").count().filter("count > 1").select("component")
    return vertices.join(big, "component", "left_semi").select("id", "component")


def _scc_rounds(e: DataFrame) -> DataFrame | None:
    """(id, component) of strongly connected components, single vertices among them or left out.

    Each round trims vertices without a way in or out, colours the rest by the least id that reaches
    them, and takes from each colour what reaches its root back. Every loop runs until nothing changes:
    as many steps as the longest chain or cycle has vertices.
    """
    edges = e
    done, size = None, edges.count()
    while size:
        while True:
            trimmed = cut(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
            before, edges, size = size, trimmed, trimmed.count()
            if size == before:
                break
        if not size:
            break
        colour = cut(edges.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            got = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
            new = cut(colour.join(got, "id", "left").select("id", F.least("c", "n").alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("moved")))
            colour = new.select("id", "c")
            if not new.filter("moved").limit(1).count():
                break
        own = edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b")
        back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reach = cut(colour.filter("id = c"))
        while True:
            nxt = cut(reach.withColumnRenamed("id", "src").join(back, "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cc")), "dst").filter("c = cc").select(F.col("dst").alias("id"), "c").distinct().join(reach, ["id", "c"], "left_anti"))
            if nxt.isEmpty():
                break
            reach = cut(reach.union(nxt))
        part = reach.select("id", F.col("c").alias("component"))
        done = part if done is None else done.union(part)
        edges = cut(edges.join(reach.select(F.col("id").alias("src")), "src", "left_anti").join(reach.select(F.col("id").alias("dst")), "dst", "left_anti"))
        size = edges.count()
    return done


def dead_nodes(v: DataFrame, e: DataFrame) -> DataFrame:
    """CG17: code that nothing uses: no way in, one way out at most."""
    code = (F.col("file_type") == "code") | F.col("kind").isin("function", "class", "module", "file")
    return v.filter(code).select("id").join(degrees(v, e), "id").filter("in_degree = 0 and out_degree <= 1")


def most_reused(e: DataFrame, top: int = 25) -> DataFrame:
    """CG18: vertices that most imports, calls, uses and references point to."""
    return e.filter(F.col("relation").isin(*REUSE_RELATIONS)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound_refs")).orderBy(F.desc("inbound_refs"), "id").limit(top)


def hidden_coupling(e: DataFrame, least: int = 3) -> DataFrame:
    """CG19: pairs joined by `least` kinds of relation or more."""
    g = e.groupBy("src", "dst").agg(F.array_sort(F.collect_set(F.coalesce("relation", F.lit("related")))).alias("relations"))
    return g.filter(F.size("relations") >= least)


def layer_violations(v: DataFrame, e: DataFrame) -> DataFrame:
    """CG20: imports and calls between the front and the back layer."""
    f = v.select("id", F.lower(F.coalesce("source_file", F.lit(""))).alias("f"))
    x = e.filter(F.col("relation").isin("imports", "imports_from", "calls")).join(f.select(F.col("id").alias("src"), F.col("f").alias("from_file")), "src").join(f.select(F.col("id").alias("dst"), F.col("f").alias("to_file")), "dst")
    front, back = F.col("from_file").startswith("frontend/"), F.col("from_file").startswith("backend/")
    return x.filter((front & F.contains(F.concat(F.lit("/"), "to_file"), F.lit("/backend/"))) | (back & F.col("to_file").startswith("frontend/"))).select("src", "dst", "relation", "from_file", "to_file")


def graph_stats(v: DataFrame, e: DataFrame) -> DataFrame:
    """CG21: vertices, edges, communities, files; one row."""
    return v.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"), F.countDistinct("source_file").alias("files")).crossJoin(e.agg(F.count("*").alias("edges"), F.countDistinct("relation").alias("relations")))


def explain_flow(e: DataFrame, v: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """CG10: the path between two vertices told by labels."""
    p = shortest_paths(e, pairs, most).filter("path is not null")
    steps = p.select("src", "dst", F.posexplode(F.split("path", " > ")).alias("step", "id")).join(v.select("id", "label"), "id")
    return steps.groupBy("src", "dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "label"))), lambda x: x["label"]), " -> ").alias("story"))
