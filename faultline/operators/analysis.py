"""From working trees and change sets to scores: parse, graph, blast radius, quality gate, evidence, score, all repositories at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from ..plans.durable import keep
from ..sources import parse_cache, parsers, readers, symbols
from . import centrality, diff, graph, health, risk, snapshots, traverse


@dataclass(frozen=True)
class Analysis:
    """What analyse() finds, each part a table by repository or change set."""

    parsed: DataFrame
    nodes: DataFrame
    edges: DataFrame
    impact: DataFrame
    gate: DataFrame
    inputs: DataFrame
    evidence: DataFrame
    scores: DataFrame
    affected: DataFrame


def declared_entrypoints(sources: DataFrame) -> DataFrame:
    """repo_id, classes, packages, modules: what a repository's manifests, package.json files and Gradle settings declare."""
    name = P.basename(F.col("path"))
    # XPath reads null for what is no manifest, wherever the filter on names ends up
    whole = (name == "AndroidManifest.xml") & F.col("text").rlike(r"(?s)^\s*<.*<manifest.*</manifest>\s*$|(?s)^\s*<manifest.*</manifest>\s*$")
    m = readers.manifest(sources.select(F.struct("repo_id", "path").alias("path"), F.when(whole, F.col("text")).alias("text")))
    m = m.select("path.repo_id", F.explode("entrypoints").alias("x"), F.lit("classes").alias("kind"))
    p = sources.where(name == "package.json").select("repo_id", F.explode(readers.package_entrypoints("text")).alias("x"), F.lit("packages").alias("kind"))
    g = sources.where(name.isin("settings.gradle", "settings.gradle.kts")).select("repo_id", F.explode(readers.gradle_modules(F.col("text"))).alias("x"), F.lit("modules").alias("kind"))
    some = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("x")))).alias(kind)
    return m.union(p).union(g).groupBy("repo_id").agg(some("classes"), some("packages"), some("modules"))


def counters(sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """repo_id and how many files were found, are source, were parsed and failed."""
    kept = ~P.is_generated_or_vendor(F.col("path"))
    seen = sources.groupBy("repo_id").agg(F.count("*").alias("files_discovered"), F.count_if(kept & P.suffix(F.lower("path")).isin(V.SUPPORTED_SOURCE)).alias("supported_source_files"))
    some = (F.size("defined_classes") > 0) | (F.size("defined_functions") > 0) | (F.size("imports") > 0) | (F.col("n_chars") <= 20)
    done = parsed.groupBy("repo_id").agg(F.count_if(some).alias("files_parsed"), F.count_if(F.col("parse_status") == "FAILED").alias("files_failed"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("files_parsed", "files_failed")}
    return seen.join(done, "repo_id", "left").withColumns(zero)


def changed_files(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, ranges) of one analysis of each repository: what differs between two versions of its files (repo_id, analysis_id, path,
    text), in order of path, and the lines of the new version that do.
    """
    ids = keep(new.select("repo_id", "analysis_id").unionByName(old.select("repo_id", "analysis_id")).distinct())
    side = lambda d: d.select("repo_id", "path", "text")
    found = keep(snapshots.changes(side(old), side(new)))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("path")) - 1
    changed = found.join(ids, "repo_id").select("repo_id", "analysis_id", place.cast("long").alias("ord"), "path")
    lines = snapshots.ranges(snapshots.hunks(found.where("status <> 'deleted'"), side(old), side(new), 0))
    return keep(changed), keep(lines.join(ids, "repo_id"))


def affected_functions(sources: DataFrame, ranges: DataFrame) -> DataFrame:
    """repo_id, analysis_id, path, name, kind, start_line, end_line of the symbols of sources that the changed ranges (repo_id, analysis_id, path,
    start, end) of an analysis touch. Only files with a range are scanned.
    """
    touched = sources.join(ranges.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    found = keep(symbols.symbols(touched.select("repo_id", "path", "text")))
    # a repository can have several analyses: each has its ranges, as if it were a repository of its own
    scoped = lambda d: d.withColumn("repo_id", F.struct("repo_id", "analysis_id")).drop("analysis_id")
    each = found.join(ranges.select("repo_id", "path", "analysis_id").distinct(), ["repo_id", "path"])
    hit = diff.affected_symbols(scoped(each), scoped(ranges))
    return hit.select("repo_id.repo_id", "repo_id.analysis_id", "path", "name", "kind", "start_line", "end_line")


def analyse(sources: DataFrame, changed: DataFrame, rules: DataFrame, ranges: DataFrame | None = None, owners: DataFrame | None = None, cache: str | None = None) -> Analysis:
    """Everything about change sets (repo_id, analysis_id, ord, path) of repositories whose files are sources (repo_id, ord, path,
    text). An analysis belongs to one repository. Without usable source the gate says so and lowers the score's confidence.

    With ranges (repo_id, analysis_id, path, start, end) of changed lines the functions they touch are evidence, owners (repo_id, path,
    owner) name reviewers, and `cache` is the folder of a parse cache.
    """
    spark = sources.sparkSession
    counted = sources.withColumn("n_chars", F.length(F.btrim(F.coalesce("text", F.lit("")))))
    parsed = keep(parsers.parse(counted) if cache is None else parse_cache.parse(counted, cache))
    declared = keep(declared_entrypoints(sources))
    files = parsed.withColumnRenamed("path", "file_path")
    nodes, edges = (keep(x) for x in graph.knowledge_graph(files, declared))
    edges = keep(edges.withColumn("ord", F.xxhash64("source", "target", "relationship")))
    start = traverse.seeds_of(changed.select("repo_id", F.col("analysis_id").alias("key"), "path", "ord"), nodes)
    impact = keep(traverse.blast("fallback", nodes, edges, start))
    counts = traverse.blast_counts(impact).select("repo_id", F.col("key").alias("analysis_id"), F.col("total").cast("int").alias("dependency_count"))
    hit = lambda found, name: traverse.in_blast(found, impact).select("repo_id", F.col("key").alias("analysis_id"), F.col("ids").alias(name))
    hubs = hit(centrality.ranked(centrality.hubs(nodes, edges), "degree"), "hub_nodes")
    bridges = hit(centrality.ranked(centrality.bridges(nodes, edges), "betweenness"), "bridge_nodes")
    c = changed.join(declared.select("repo_id", "modules"), "repo_id", "left")
    c = c.withColumn("module", P.impacted_module(F.col("path"), F.coalesce("modules", F.array().cast("array<string>"))))
    by_ord = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ord", "path")))), lambda x: x["path"])
    low, by = F.lower("path"), ["repo_id", "analysis_id"]
    modules = F.array_sort(F.collect_set("module"))
    d = c.groupBy(*by).agg(
        by_ord(F.lit(True)).alias("files"), F.when(F.size(modules) > 0, modules).otherwise(F.array(F.lit("root"))).alias("impacted_modules"), (~F.bool_or(P.is_test_path(F.col("path")))).alias("missing_tests"),
        by_ord(P.contains_any(low, V.CRITICAL_WORKER)).alias("critical_modules"), F.bool_or(P.contains_any(low, V.FLAG_WORDS)).alias("flags"), F.bool_or(P.contains_any(low, V.DEPLOY_WORDS)).alias("deploy"),
    )
    none = F.array().cast("array<string>")
    no_ranges = spark.createDataFrame([], "name string").select(*[F.lit(None).cast(changed.schema[k].dataType).alias(k) for k in by], F.lit("").alias("path"), "name", F.lit("").alias("kind"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    affected = keep(no_ranges if ranges is None else affected_functions(sources, ranges))
    names = affected.where("kind = 'function'").groupBy(*by).agg(F.transform(F.array_sort(F.collect_set(F.struct("path", "start_line", "name"))), lambda x: x["name"]).alias("affected_functions"))
    reached = impact.where("depth > 0").groupBy("repo_id", F.col("key").alias("analysis_id")).agg(F.count("*").cast("int").alias("unique_components"))
    # the edges that lead from what is impacted to what is impacted
    ends = lambda c: impact.select("repo_id", F.col("key").alias("analysis_id"), F.col("node").alias(c))
    among = traverse.PRESETS["fallback"].edges(edges).select("repo_id", "source", "target").join(ends("source"), ["repo_id", "source"]).join(ends("target"), [*by, "target"], "left_semi").groupBy(*by).agg(F.count("*").cast("int").alias("edges"))
    if owners is not None:
        owned = changed.join(owners, ["repo_id", "path"]).groupBy(*by).agg(F.map_from_entries(F.collect_set(F.struct("path", "owner"))).alias("ownership"))
    d = d.join(counts, by, "left").join(hubs, by, "left").join(bridges, by, "left").join(names, by, "left").join(reached, by, "left").join(among, by, "left")
    d = d.withColumn("ownership", F.lit(None).cast("map<string,string>")) if owners is None else d.join(owned, by, "left")
    inputs = keep(d.withColumns({
        "dependency_count": F.coalesce("dependency_count", F.lit(0)), "hub_nodes": F.coalesce("hub_nodes", none), "bridge_nodes": F.coalesce("bridge_nodes", none), "affected_functions": F.coalesce("affected_functions", none),
        "edges": F.coalesce("edges", F.lit(0)), "unique_components": F.coalesce("unique_components", F.lit(0)), "ownership": F.coalesce("ownership", F.create_map().cast("map<string,string>")),
    }))
    size = nodes.groupBy("repo_id").agg(F.count("*").alias("ast_nodes"))
    gate = counters(sources, parsed).join(size, "repo_id", "left").withColumns({"ast_nodes": F.coalesce("ast_nodes", F.lit(0)), "has_git_diff": F.lit(True), "has_test_analysis": F.lit(True)})
    gate = keep(health.quality_gate(gate))
    evidence = keep(risk.evidence(changed.select("analysis_id", "ord", "path"), inputs, rules if rules is not None else risk.builtin_rules(spark)))
    scores = risk.scores(evidence, inputs)
    gated = inputs.select("repo_id", "analysis_id").join(gate.select("repo_id", "evidence_completeness", "analysis_quality"), "repo_id").drop("repo_id")
    return Analysis(parsed, nodes, edges, impact, gate, inputs, evidence, health.gated(scores, gated), affected)
