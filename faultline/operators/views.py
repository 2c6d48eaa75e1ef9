"""Interactive graph and list views: id resolution, filters, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Id prefixes that are probed and the order of node kinds
PREFIXES = ["file:", "module:", "folder:", "class:", "function:", "api:", "package:"]
KIND_ORDER = ["repository", "module", "folder", "file", "class", "function", "api", "database"]


def resolve_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with ends as node ids: exact, without prefix, by label, path or file name (the last node wins), with each
    prefix; unresolved and self edges drop out, (source, target, edge_type) stays once.
    """
    name = F.element_at(F.split("path", "/"), -1)
    bare = F.regexp_replace("id", r"^\w+:", "")
    keys = [nodes.select(F.col("id").alias("k"), F.lit(0).alias("rung"), "id", F.lit(0).cast("long").alias("late"))]
    for c in (F.col("label"), F.col("path"), name, bare):
        keys.append(nodes.select(c.alias("k"), F.lit(1).alias("rung"), "id", (-F.col("ord")).alias("late")))
    keys += [nodes.where(F.col("id").startswith(p)).select(F.substring("id", F.lit(len(p) + 1), F.length("id")).alias("k"), F.lit(2 + n).alias("rung"), "id", F.lit(0).cast("long").alias("late")) for n, p in enumerate(PREFIXES)]
    table = keys[0]
    for k in keys[1:]:
        table = table.unionByName(k)
    table = table.where("k IS NOT NULL AND k <> ''").groupBy("k").agg(F.min(F.struct("rung", "late", "id")).alias("x")).select("k", F.col("x.id").alias("found"))
    ends = edges.select(F.col("source").alias("e")).union(edges.select("target")).distinct()
    tried = ends.select("e", F.posexplode(F.array(F.col("e"), F.regexp_replace("e", r"^\w+:", ""))).alias("t", "k")).join(table, "k").groupBy("e").agg(F.min_by("found", "t").alias("found"))
    s, t = tried.select(F.col("e").alias("source"), F.col("found").alias("s")), tried.select(F.col("e").alias("target"), F.col("found").alias("t"))
    d = edges.join(s, "source").join(t, "target").where("s <> t")
    return d.groupBy(F.col("s").alias("source"), F.col("t").alias("target"), "edge_type").agg(F.min("ord").alias("ord"))


def visible_nodes(nodes: DataFrame, module: str | None = None, kind: str | None = None, query: str = "") -> DataFrame:
    """Nodes of a module (or under its path), a kind, with the query in label or path; each id once, by module, path, kind."""
    d = nodes.dropDuplicates(["id"])
    if module is not None:
        d = d.where((F.col("module") == module) | F.col("path").startswith(module + "/"))
    if kind is not None:
        d = d.where(F.col("kind") == kind)
    if query:
        d = d.where(F.lower("label").contains(query.lower()) | F.lower("path").contains(query.lower()))
    weight = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    return d.orderBy(F.coalesce("module", F.lit("")), F.coalesce("path", F.lit("")), F.when(weight == 0, 99).otherwise(weight), "id")


def search_any(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query in any of the columns, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False))
    return df.where(hit)


def of_type(statements: DataFrame, kind: str) -> DataFrame:
    """Statements of a type, or ALL."""
    return statements if kind == "ALL" else statements.where(F.col("statement_type") == kind)
