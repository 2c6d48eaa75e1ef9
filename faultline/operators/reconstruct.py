"""What can be rebuilt of an analysis from its stored columns: points, statements and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .risk import normalised, raw_points, statement
from .traverse import REACH_RELATIONS

# Signals whose evidence comes back as a fact
FACT_SIGNALS = ["dependency_upgrades", "authentication_change", "env_vars_changed", "database_schema", "public_api_changed", "critical_component_modified", "large_refactor", "migration_detected"]


def points(evidence: DataFrame) -> DataFrame:
    """analysis_id, raw_rule_score and normalized_score; the sum is of rounded points here."""
    each = F.bround(raw_points()).cast("bigint")
    sums = evidence.groupBy("analysis_id").agg(F.sum(each).cast("double").alias("raw_rule_score"))
    return sums.withColumn("normalized_score", F.bround(normalised(F.col("raw_rule_score")), 2))


def reaches_further(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """analysis_id, n_edges, has_transitive: whether an impact edge (analysis_id, target, relationship, edge_type) of the
    stored graph ends outside the changed files (analysis_id, path).
    """
    kind = F.col("relationship").isin(REACH_RELATIONS) | F.col("edge_type").isin(REACH_RELATIONS)
    inside = changed.select("analysis_id", F.col("path").alias("target"), F.lit(True).alias("inside")).distinct()
    d = edges.join(inside, ["analysis_id", "target"], "left")
    return d.groupBy("analysis_id").agg(F.count("*").alias("n_edges"), F.bool_or(kind & F.col("inside").isNull()).alias("has_transitive"))


def statements(evidence: DataFrame, inputs: DataFrame, reach: DataFrame) -> DataFrame:
    """analysis_id, id, statement_type, claim, traceability_ref, in order: facts, inferences, recommendations.

    inputs has files and impacted_modules. Downstream reach is left out where a stored graph shows that there is none.
    """
    t, lit, size = F.format_string, F.lit, lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    modules = size("impacted_modules")
    head = F.array_compact(F.array(
        statement(lit(True), "FACT", t("%d file(s) modified in this change set.", size("files")), lit("Git commit diff analysis"), lit("git_diff_stat"), F.slice("files", 1, 20)),
        statement(modules > 0, "FACT", t("Change impact intersects %d architectural module(s): %s", modules, F.array_join(F.slice("impacted_modules", 1, 5), ", ")), lit("AST module resolution"), lit("module_resolution")),
        statement(modules >= 3, "INFERENCE", t("Cross-module architectural coupling: change set spans %d distinct architectural domains.", modules), lit("Derived from module impact analysis"), lit("rule:multi_module_impact")),
    ))
    first = inputs.select("analysis_id", F.posexplode(head).alias("o", "s")).select("analysis_id", F.lit(0).alias("part"), F.col("o").alias("ord"), "s.*")
    e = evidence.join(reach, "analysis_id", "left")
    hidden = ~F.coalesce("has_transitive", F.lit(False)) & (F.coalesce("n_edges", F.lit(0)) > 0)
    sig, files = F.col("signal"), F.col("file_paths")
    near = F.array_join(F.slice("file_paths", 1, 3), ", ")
    seen = F.when(F.size("file_paths") > 0, F.concat(lit("Observed in "), near)).otherwise("Repository AST scan")
    named = F.concat("name", lit(": "), "description")
    rows = F.array_compact(F.array(
        statement(sig.isin(FACT_SIGNALS), "FACT", named, seen, sig, files),
        statement((sig == "large_blast_radius") & ~hidden, "INFERENCE", F.concat(lit("Downstream regression risk: "), "description"), lit("Derived from dependency graph traversal"), lit("rule:large_blast_radius")),
        statement(sig == "missing_tests", "INFERENCE", lit("Test coverage gap: production code changes lack accompanying unit test or test specification modifications."), lit("Diff analysis: 0 test files modified"), lit("rule:missing_tests")),
        statement(sig == "critical_component_modified", "INFERENCE", F.concat(lit("Critical business workflows may be affected due to modifications in core components: "), near), lit("Sensitive domain path keyword matching"), lit("rule:critical_component_modified"), files),
        statement(F.col("recommendation") != "", "RECOMMENDATION", F.col("recommendation"), F.concat(lit("Triggered by "), named), sig, files),
    ))
    rest = e.select("analysis_id", F.lit(1).alias("part"), "ord", F.explode(rows).alias("s")).select("analysis_id", "part", "ord", "s.*")
    d = first.unionByName(rest)
    k = F.row_number().over(Window.partitionBy("analysis_id", "statement_type").orderBy("part", "ord"))
    prefix = F.when(F.col("statement_type") == "FACT", "FACT").when(F.col("statement_type") == "INFERENCE", "INF").otherwise("REC")
    return d.withColumn("id", F.concat(prefix, lit("-"), F.lpad(k.cast("string"), 3, "0"))).drop("part", "ord")
