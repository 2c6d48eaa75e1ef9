"""Hubs by degree and bridges by betweenness."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import keep
from .scope import KEY, first_of, scope, scoped

HUB_EXCLUDED = ["file", "folder", "package", "repository"]
#: Sources of one repository whose paths one task follows.
CHUNK = 64
#: Edges of a repository up to which its paths are followed within tasks; above that by levels, as joins.
TASK_EDGES = 200_000


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with in_degree, out_degree and degree over all edges of their repository, parallel ones counted each."""
    keys = scope(nodes)
    ends = edges.select(*keys, F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(*keys, "target", F.lit(0), F.lit(1)))
    d = ends.groupBy(*keys, "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("in_degree", "out_degree")}
    return nodes.join(d, [*keys, "id"], "left").withColumns(zero).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def hubs(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of each repository with most edges, containers left out; ties in node order."""
    return first_of(degrees(nodes.where(~F.col("kind").isin(HUB_EXCLUDED)), edges).where("degree > 0"), k, F.desc("degree"), "ord")


def ranked(best: DataFrame, value: str) -> DataFrame:
    """hubs() or bridges() with their place among those of their repository, by value, as ord."""
    return best.withColumn("ord", F.row_number().over(Window.partitionBy(*(scope(best) or [F.lit(0)])).orderBy(F.desc(value), "ord")))


def _dependencies(adjacency: dict[str, list[str]], sources: list[str]) -> dict[str, float]:
    """Brandes' dependencies of the sources on every node, summed."""
    total: dict[str, float] = {}
    for s in sources:
        dist, sigma, before, order = {s: 0}, {s: 1.0}, {s: []}, []
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adjacency.get(v, ()):
                if w not in dist:
                    dist[w], sigma[w], before[w] = dist[v] + 1, 0.0, []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] = total.get(w, 0.0) + delta[w]
    return total


def _within_tasks(starts: DataFrame, inner: DataFrame) -> DataFrame:
    """repo_id, id, part: dependencies of starts (repo_id, id), CHUNK of them with their repository's edges in a task."""
    keys = [KEY]
    # chunks by hash: as many as the repository's sources need
    sizes = starts.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    rows = starts.join(sizes, keys).select(*keys, F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"))
    graph = inner.join(sizes, keys).select(*keys, F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"), "source", "target")
    schema = ", ".join([f"`{k}` {starts.schema[k].dataType.simpleString()}" for k in keys] + ["id string", "part double"])

    def part(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        is_edge = g["target"].notna()
        adjacency = g[is_edge].groupby("source")["target"].apply(list).to_dict()
        total = _dependencies(adjacency, g["source"][~is_edge].tolist())
        # types of their own: an empty frame's columns are taken for numbers
        out = pd.DataFrame({"id": pd.Series(list(total), dtype=object), "part": pd.Series(list(total.values()), dtype=float)})
        for k, v in zip(keys, key):
            out.insert(0, k, v)
        return out

    return rows.unionByName(graph).groupBy(*keys, "chunk").applyInPandas(part, schema)


def _by_levels(starts: DataFrame, inner: DataFrame) -> DataFrame:
    """As _within_tasks(), but as joins: forward, each level's nodes with the number of shortest paths from each start; backward, from the
    last level to the first, what hangs on each node. A row is a start and a node it reaches, and no task holds a graph.
    """
    keys = [KEY]
    edges = keep(inner.groupBy(*keys, "source", "target").agg(F.count("*").cast("double").alias("times")))
    levels = [keep(starts.select(*keys, F.col("id").alias("start"), F.col("id").alias("node"), F.lit(1.0).alias("paths")))]
    seen = levels[0].select(*keys, "start", "node")
    while not levels[-1].isEmpty():
        step = levels[-1].join(edges.withColumnRenamed("source", "node"), [*keys, "node"]).groupBy(*keys, "start", F.col("target").alias("node")).agg(F.sum(F.col("paths") * F.col("times")).alias("paths"))
        levels.append(keep(step.join(seen, [*keys, "start", "node"], "left_anti")))
        seen = seen.union(levels[-1].select(*keys, "start", "node"))
    levels.pop()
    total, hung = None, None
    for k in range(len(levels) - 1, 0, -1):
        d = levels[k]
        d = d.withColumn("part", F.lit(0.0)) if hung is None else d.join(hung, [*keys, "start", "node"], "left").withColumn("part", F.coalesce(F.col("paths") * F.col("share"), F.lit(0.0))).drop("share")
        d = keep(d)
        out = d.select(*keys, F.col("node").alias("id"), "part")
        total = out if total is None else total.union(out)
        up = d.join(edges.withColumnRenamed("target", "node"), [*keys, "node"]).select(*keys, "start", F.col("source").alias("node"), (F.col("times") * (1 + F.col("part")) / F.col("paths")).alias("share"))
        hung = up.groupBy(*keys, "start", "node").agg(F.sum("share").alias("share"))
    return total if total is not None else starts.select(*keys, "id", F.lit(0.0).alias("part")).limit(0)


def betweenness(ids: DataFrame, edges: DataFrame, sources: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(repo_id,) id, score: Brandes' betweenness over directed edges between the ids of a repository, parallel edges
    multiplying paths, divided by (n - 1)(n - 2); with two nodes or fewer the score is 0.

    Sources are independent. Repositories of up to `task_edges` edges meet CHUNK of their sources at a time in one task; in larger ones all
    sources advance together, level by level, as joins. Both give the same scores, and nothing comes to the driver;
    `sources` takes a sample of them.
    """
    if not scope(ids):
        return betweenness(scoped(ids), scoped(edges), scoped(sources), task_edges).drop(KEY)
    keys = [KEY]
    own = ids.select(*keys, "id").distinct()
    end = lambda c: own.withColumnRenamed("id", c)
    inner = keep(edges.select(*keys, "source", "target").join(end("source"), [*keys, "source"], "left_semi").join(end("target"), [*keys, "target"], "left_semi"))
    starts = own if sources is None else own.join(sources.select(*keys, "id"), [*keys, "id"], "left_semi")
    large = keep(inner.groupBy(*keys).agg(F.count("*").alias("n_edges")).where(F.col("n_edges") > task_edges).select(*keys))
    part = lambda d, how: d.join(large, keys, how)
    parts = _within_tasks(part(starts, "left_anti"), part(inner, "left_anti"))
    if not large.isEmpty():
        parts = parts.unionByName(_by_levels(part(starts, "left_semi"), part(inner, "left_semi")))
    sums = parts.groupBy(*keys, "id").agg(F.sum("part").alias("total"))
    n = own.groupBy(*keys).agg(F.count("*").alias("n"))
    d = own.join(sums, [*keys, "id"], "left").join(n, keys)
    score = F.when(F.col("n") > 2, F.coalesce("total", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(F.lit(0.0))
    return d.select(*keys, "id", score.alias("score"))


def bridges(nodes: DataFrame, edges: DataFrame, k: int = 10, exact_up_to: int = 3000, sampled: int = 500) -> DataFrame:
    """The k nodes of each repository with most betweenness among non-containers, rounded to six digits half to even; in one of
    fewer than three such nodes none.

    Above exact_up_to candidates of a repository only `sampled` of its sources, chosen by hash, start paths; paths still
    run through all.
    """
    if not scope(nodes):
        return bridges(scoped(nodes), scoped(edges), k, exact_up_to, sampled).drop(KEY)
    c, keys = nodes.where(~F.col("kind").isin(HUB_EXCLUDED)), [KEY]
    n = c.groupBy(*keys).agg(F.count("*").alias("n"))
    sized = c.join(n, keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("id")))
    few = sized.where(F.col("n") > exact_up_to).withColumn("rank", rank).where(F.col("rank") <= sampled)
    sources = sized.where(F.col("n") <= exact_up_to).select(*keys, "id").union(few.select(*keys, "id"))
    scored = c.join(betweenness(c.select(*keys, "id"), edges, sources), [*keys, "id"]).where("score > 0")
    return first_of(scored.select(*keys, "id", "label", "ord", F.bround("score", 6).alias("betweenness")), k, F.desc("betweenness"), "ord")


def analyse(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Both lists in one frame: (repo_id,) kind (hub or bridge), rank, id, value."""
    if not scope(nodes):
        return analyse(scoped(nodes), scoped(edges), k).drop(KEY)
    keys = [KEY]
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(c), "ord"))  # noqa: E731  over k rows each
    h = hubs(nodes, edges, k).select(*keys, F.lit("hub").alias("kind"), rank("degree").alias("rank"), "id", F.col("degree").cast("double").alias("value"))
    return h.unionByName(bridges(nodes, edges, k).select(*keys, F.lit("bridge").alias("kind"), rank("betweenness").alias("rank"), "id", F.col("betweenness").alias("value")))
