"""Python table functions that SQL can call with a partitioned TABLE argument."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class ShortestPaths:
    """CG5 in SQL: rows (graph_id, kind, src, dst) of one partition, kind 'edge' or 'pair' -> hops and path of each pair.

    Edges are walked either way; of equally short paths the one over the least vertex names from the end comes back.
    A partition is a graph that fits one task (a module, a document); graphs of any size go to cgraph.shortest_paths.
    Pairs without a path have null hops. Null ends do not count.
    """

    def __init__(self):
        self.graph, self.step, self.pairs = None, {}, []

    def eval(self, row):
        self.graph = row["graph_id"]
        src, dst = row["src"], row["dst"]
        if src is None or dst is None:
            return
        if row["kind"] == "pair":
            self.pairs.append((src, dst))
        elif src != dst:
            self.step.setdefault(src, set()).add(dst)
            self.step.setdefault(dst, set()).add(src)

    def terminate(self):
        for src in sorted({a for a, _ in self.pairs}):
            parent, level, todo = {src: None}, {src: 0}, deque([src])
            while todo:
                x = todo.popleft()
                for y in sorted(self.step.get(x, ())):
                    if y not in level:
                        level[y], parent[y] = level[x] + 1, x
                        todo.append(y)
                    elif level[y] == level[x] + 1 and x < parent[y]:
                        parent[y] = x
            for dst in sorted({b for a, b in self.pairs if a == src}):
                path, at = [], dst if dst in level else None
                while at is not None:
                    path.append(at)
                    at = parent[at]
                yield self.graph, src, dst, level.get(dst), " > ".join(reversed(path)) if path else None


def register_table_functions(spark: SparkSession) -> None:
    """shortest_paths(TABLE(...) PARTITION BY graph_id) for this session."""
    spark.udtf.register("shortest_paths", udtf(ShortestPaths, returnType="graph_id string, src string, dst string, hops int, path string"))
