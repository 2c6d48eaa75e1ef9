"""Blast radius: one level-synchronous reverse search with presets, call flows and folder reach.

nodes: id, label, kind, path, ord; edges: source, target, relationship, edge_type, ord (a multigraph). Where frames have a
repo_id too, ids need to be unique within a repository only, and every search, join and limit is one repository's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.durable import keep
from .scope import first_of, scope

# Edge and directory filters of the presets
IMPACT_RELATIONS = ["IMPORTS", "CALLS", "DEPENDS_ON", "USES", "INHERITS", "IMPLEMENTS"]
REACH_RELATIONS = ["SOURCE_IMPORT", "DYNAMIC_IMPORT", "CALLS", "DEPENDS_ON", "IMPORTS", "USES", "INHERITS", "IMPLEMENTS"]
REACH_EXCLUDED_TYPES = ["PACKAGE_DEPENDENCY", "CONFIG_REFERENCE", "BUILD_DEPENDENCY", "TEST_REFERENCE", "SELF_IMPORT"]
IGNORED_DIRS = ["node_modules/", ".git/", ".next/", "dist/", "build/", "coverage/", "venv/", ".venv/", "__pycache__/", "target/"]
EXPORT_IGNORED_DIRS = [*IGNORED_DIRS, ".idea/", ".gradle/", "gradle/"]
CONTAINER_KINDS = ["package", "repository", "folder"]


def impact_edges(e: DataFrame) -> DataFrame:
    return e.where(F.col("relationship").isin(IMPACT_RELATIONS) & ~F.col("edge_type").isin(["CONFIG_REFERENCE", "BUILD_DEPENDENCY"]))


def reach_edges(e: DataFrame) -> DataFrame:
    return e.where(~F.col("edge_type").isin(REACH_EXCLUDED_TYPES) & (F.col("relationship").isin(REACH_RELATIONS) | F.col("edge_type").isin(REACH_RELATIONS)))


def view_edges(e: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("edge_type"), F.lit("")), "relationship")
    return e.where(~kind.isin(["CONFIG_REFERENCE", "BUILD_DEPENDENCY", "PACKAGE_DEPENDENCY"]))


def in_dirs(path: Column, dirs: list[str]) -> Column:
    return F.coalesce(P.contains_any(P.slashed(path), dirs), F.lit(False))


@dataclass(frozen=True)
class Preset:
    """Edge filter, depth, and which nodes are marked visited but neither emitted nor expanded."""

    edges: object
    depth: int | None
    blocked: object = None


PRESETS = {
    "impact": Preset(impact_edges, 3, lambda: F.col("kind").isin(CONTAINER_KINDS)),
    "reach_count": Preset(impact_edges, 3),
    "fallback": Preset(reach_edges, 4, lambda: in_dirs(F.col("path"), IGNORED_DIRS)),
    "all": Preset(lambda e: e, 5),
    "export": Preset(reach_edges, 3, lambda: in_dirs(F.coalesce(F.nullif(F.col("path"), F.lit("")), "label", "id"), EXPORT_IGNORED_DIRS)),
    "view": Preset(view_edges, 3),
    "folder": Preset(lambda e: e, None),
}


def search(edges: DataFrame, seeds: DataFrame, depth: int | None, nodes: DataFrame | None = None, blocked: Column | None = None) -> DataFrame:
    """key, node, depth, parent, trail (nodes from the seed to the node) of all that reaches a seed (key, node, ord)
    over edges backwards, each once per key at its least depth and with the parent a queue would have found first.

    Order within a level is the lexicographic order of the edges' ord along the trail, so no window over a key is
    needed. Every level is one join with the edges and one with what has been seen, written to the shared folder.
    """
    keys = scope(edges)
    back = edges.select(*keys, F.col("target").alias("at"), F.col("source").alias("next"), F.col("ord").alias("e_ord"))
    marks = None
    if blocked is not None:
        marks = nodes.where(blocked).select(*keys, F.col("id").alias("node"), F.lit(True).alias("blocked")).distinct()

    def marked(df: DataFrame) -> DataFrame:
        if marks is None:
            return df.withColumn("blocked", F.lit(False))
        return df.join(marks, [*keys, "node"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))

    first = seeds.groupBy(*keys, "key", "node").agg(F.min("ord").alias("o"))
    now = first.select(*keys, "key", "node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.array("node").alias("trail"), F.array(F.col("o").cast("long")).alias("rank"))
    levels, n = [keep(marked(now))], 0
    seen = levels[0].select(*keys, "key", "node")
    while depth is None or n < depth:
        n += 1
        open_ = levels[-1].where("NOT blocked").select(*keys, "key", F.col("node").alias("at"), "trail", "rank")
        step = open_.join(back, [*keys, "at"]).select(*keys, "key", F.col("next").alias("node"), F.struct(F.concat("rank", F.array(F.col("e_ord").cast("long"))).alias("rank"), F.col("at").alias("parent"), "trail").alias("x"))
        step = step.join(seen, [*keys, "key", "node"], "left_anti")
        best = step.groupBy(*keys, "key", "node").agg(F.min("x").alias("x"))
        new = best.select(*keys, "key", "node", F.lit(n).alias("depth"), F.col("x.parent").alias("parent"), F.concat("x.trail", F.array("node")).alias("trail"), F.col("x.rank").alias("rank"))
        new = keep(marked(new))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.union(new.select(*keys, "key", "node"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.where("NOT blocked").drop("blocked", "rank")


def blast(name: str, nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """search() with a preset."""
    p = PRESETS[name]
    return search(p.edges(edges), seeds, p.depth, nodes, p.blocked() if p.blocked else None)


def seeds_of(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, ord of changed files (key, path, ord): exact id, else file:path, else the first node whose path is the
    changed one or ends with /path. Suffixes of node paths are exploded, so all three are equal joins.
    """
    keys = scope(nodes)
    ids = nodes.select(*keys, F.col("id").alias("node"), F.lit(0).alias("rung"), F.col("id").alias("k"), F.col("ord").alias("n_ord"))
    seg = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(seg)), lambda i: F.array_join(F.slice(seg, i, F.size(seg)), "/"))
    by_tail = nodes.where("path IS NOT NULL AND path <> ''").select(*keys, F.col("id").alias("node"), F.lit(2).alias("rung"), F.explode(tails).alias("k"), F.col("ord").alias("n_ord"))
    by_file = ids.where(F.col("k").startswith("file:")).select(*keys, "node", F.lit(1).alias("rung"), F.substring("k", F.lit(6), F.length("k")).alias("k"), "n_ord")
    names = ids.unionByName(by_file).unionByName(by_tail).withColumnRenamed("k", "path")
    hit = changed.join(names, [*keys, "path"]).groupBy(*keys, "key", "path", "ord").agg(F.min(F.struct("rung", "n_ord", "node")).alias("x"))
    return hit.select(*keys, "key", F.col("x.node").alias("node"), "ord")


def blast_counts(found: DataFrame) -> DataFrame:
    """key and how many nodes lie at depth 1, deeper, and in all (seeds not counted)."""
    return found.groupBy(*scope(found), "key").agg(
        F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"),
        F.count_if(F.col("depth") >= 1).alias("total"), F.max("depth").alias("deepest"),
    )


def affected(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """key and the labels of APIs and database models and the test paths among what was found, sorted."""
    keys = scope(nodes)
    d = found.join(nodes.withColumnRenamed("id", "node"), [*keys, "node"])
    some = lambda test, col: F.array_sort(F.array_compact(F.collect_set(F.when(test, F.col(col)))))
    file_like = F.col("kind").isin(["file", "module"])
    return d.groupBy(*keys, "key").agg(
        some(F.col("kind") == "api", "label").alias("apis"), some(F.col("kind") == "database", "label").alias("db_models"), some(file_like & P.is_test_path(F.col("path")), "path").alias("tests"),
    )


def in_blast(candidates: DataFrame, found: DataFrame, limit: int = 5) -> DataFrame:
    """The first `limit` candidates (id, ord), such as hubs or bridges, that lie in each key's blast set; ids is null where none does."""
    keys = scope(candidates)
    hit = found.select(*keys, "key", F.col("node").alias("id")).join(candidates.select(*keys, "id", "ord"), [*keys, "id"])
    rank = F.row_number().over(Window.partitionBy(*keys, "key").orderBy("ord", "id"))
    first = hit.withColumn("k", rank).where(F.col("k") <= limit)
    lists = first.groupBy(*keys, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("ids"))
    return found.select(*keys, "key").distinct().join(lists, [*keys, "key"], "left")


def export_paths(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """key, depth, file_or_module, relationship: changed files at depth 0 and what depends on them, by (depth, name)."""
    keys = scope(nodes)
    ids = nodes.where(F.col("kind").isin(["file", "module"]) & F.col("path").isNotNull()).groupBy(*keys, "path").agg(F.max_by("id", "ord").alias("node"))
    start = changed.join(ids, [*keys, "path"], "left").select(*keys, "key", F.coalesce("node", F.concat(F.lit("file:"), "path")).alias("node"), "ord")
    found = blast("export", nodes, edges, start).where("depth > 0")
    named = found.join(nodes.withColumnRenamed("id", "node"), [*keys, "node"], "left").select(*keys, "key", "depth", F.coalesce(F.nullif(F.col("path"), F.lit("")), "label", "node").alias("file_or_module"))
    fresh = named.join(changed.select(*keys, "key", F.col("path").alias("file_or_module")), [*keys, "key", "file_or_module"], "left_anti").groupBy(*keys, "key", "file_or_module").agg(F.min("depth").alias("depth"))
    rel = F.when(F.col("depth") == 1, "IMPORTS").otherwise("DEPENDS_ON")
    zero = changed.select(*keys, "key", F.lit(0).alias("depth"), F.col("path").alias("file_or_module"), F.lit("MODIFIED").alias("relationship"))
    return zero.unionByName(fresh.select(*keys, "key", "depth", "file_or_module", rel.alias("relationship")))


def call_flows(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 4, limit: int = 20) -> DataFrame:
    """root, labels in order of depth, distinct paths of who calls each of the first `limit` roots (id, ord) of a repository over
    CALLS. Roots are cut before those without a node drop out; flows of one step are left out.
    """
    keys = scope(nodes)
    kept = first_of(roots, limit, "ord").join(nodes.select(*keys, "id"), [*keys, "id"], "left_semi")
    found = search(edges.where("relationship = 'CALLS'"), kept.select(*keys, F.col("id").alias("key"), F.col("id").alias("node"), "ord"), depth)
    steps = found.join(nodes.select(*keys, F.col("id").alias("node"), "label", "path", F.col("ord").alias("n_ord")), [*keys, "node"])
    lists = steps.groupBy(*keys, "key").agg(F.array_sort(F.collect_list(F.struct("depth", "n_ord", "label"))).alias("x"), F.array_sort(F.array_compact(F.collect_set("path"))).alias("paths"), F.count("*").alias("n"))
    return lists.where("n > 1").select(*keys, F.col("key").alias("root"), F.transform("x", lambda s: s["label"]).alias("labels"), "paths", "n")


def function_ids(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes of functions and classes whose label is one of names (label)."""
    return nodes.where(F.col("kind").isin(["function", "class"])).join(names.select(*scope(nodes), "label").distinct(), [*scope(nodes), "label"], "left_semi")


def reach_of_folders(inside: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id,) folder, reach: how many nodes outside a folder reach one of its files (inside: id, folder) over edges at any distance.

    Folders are numbered and 64 of them are the bits of a long, so a node has a row for each 64 folders it reaches, not for each. In each
    round the bits that nodes gained are or-ed into those that point at them, until no node gains any.
    """
    keys = scope(inside)
    numbered = keep(inside.select(*keys, "folder").distinct().repartitionByRange(*keys, "folder").sortWithinPartitions(*keys, "folder").withColumn("n", F.monotonically_increasing_id()))
    word, bit = F.shiftright("n", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n").bitwiseAND(F.lit(63)).cast("int"))
    gained = keep(inside.join(numbered, [*keys, "folder"]).groupBy(*keys, F.col("id").alias("node"), word).agg(F.bit_or(bit).alias("bits")))
    known, by = gained, [*keys, "node", "word"]
    back = keep(edges.select(*keys, "source", F.col("target").alias("node")).distinct())
    while not gained.isEmpty():
        step = gained.join(back, [*keys, "node"]).groupBy(*keys, F.col("source").alias("node"), "word").agg(F.bit_or("bits").alias("more"))
        gained = keep(step.join(known, by, "left").select(*by, F.col("more").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0"))
        known = keep(known.union(gained).groupBy(*by).agg(F.bit_or("bits").alias("bits")))
    # bits are counted by word first, so what is exploded is 64 counts a word
    counts = known.groupBy(*keys, "word").agg(*[F.sum(F.getbit("bits", F.lit(k))).alias(f"c{k}") for k in range(64)])
    each = counts.select(*keys, F.posexplode(F.array(*[F.col(f"c{k}") for k in range(64)])).alias("k", "c"), "word")
    each = each.select(*keys, (F.shiftleft("word", 6) + F.col("k")).alias("n"), "c").join(numbered, [*keys, "n"])
    own = inside.groupBy(*keys, "folder").agg(F.countDistinct("id").alias("own"))
    return each.join(own, [*keys, "folder"]).select(*keys, "folder", (F.col("c") - F.col("own")).alias("reach"))


def folder_metrics(files: DataFrame, edges: DataFrame, folders: DataFrame) -> DataFrame:
    """For folders (folder): files under it, distinct files outside that import it or that it imports, edge counts and
    how many files outside reach it at any distance. files: id, path; edges: source, target.

    Prefixes of a path are exploded, so membership is an equal join.
    """
    keys = scope(files)
    seg = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(seg) - 1, F.lit(1))), lambda i: F.array_join(F.slice(seg, F.lit(1), i), "/"))
    inside = keep(files.where("path LIKE '%/%'").select(*keys, "id", F.explode(prefixes).alias("folder")).join(folders, [*[k for k in keys if k in folders.columns], "folder"]))
    s = inside.select(*keys, F.col("id").alias("source"), F.col("folder"), F.lit(True).alias("s_in"))
    t = inside.select(*keys, F.col("id").alias("target"), F.col("folder"), F.lit(True).alias("t_in"))
    out = edges.select(*keys, "source", "target").join(s, [*keys, "source"]).join(t, [*keys, "target", "folder"], "left")
    outgoing = out.groupBy(*keys, "folder").agg(F.count_if("t_in").alias("internal_edges"), F.countDistinct(F.when(F.col("t_in").isNull(), F.col("target"))).alias("external_targets"), F.count_if(F.col("t_in").isNull()).alias("n_out"))
    into = edges.select(*keys, "source", "target").join(t, [*keys, "target"]).join(s, [*keys, "source", "folder"], "left_anti")
    incoming = into.groupBy(*keys, "folder").agg(F.countDistinct("source").alias("external_importers"), F.count("*").alias("n_in"))
    reach = reach_of_folders(inside, edges)
    base = inside.groupBy(*keys, "folder").agg(F.count("*").alias("n_files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    by = [*keys, "folder"]
    d = base.join(incoming, by, "left").join(outgoing, by, "left").join(reach, by, "left")
    return d.select(*by, "n_files", zero("external_importers").alias("external_importers"), zero("external_targets").alias("external_targets"), zero("internal_edges").alias("internal_edges"), (zero("n_in") + zero("n_out")).alias("external_edges"), zero("reach").alias("reach"))


def match_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (repo_id, source, target, …) both of whose ends are nodes (id, repo_id) of the repository."""
    ids = nodes.select("repo_id", "id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), ["repo_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["repo_id", "target"], "left_semi")
