"""The export model as tables, and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .risk import breakdown, normalised

ARCHITECTURE = ["architecture", "infrastructure", "database", "api"]


def changed_files(changed: DataFrame, evidence: DataFrame) -> DataFrame:
    """analysis_id, ord, path with category, language, module, test status and the names of the signals that touch it.

    A signal touches a file if one of its paths holds the file's or the other way round, within one analysis.
    """
    path = P.slashed(F.col("path"))
    d = changed.withColumns({
        "category": P.file_type(F.col("path")), "language": P.language_label(F.col("path")), "module": F.when(path.contains("/"), F.get(F.split(path, "/"), F.lit(0))).otherwise("root"),
    })
    tests = F.max((F.col("category") == "TEST").cast("int")).over(Window.partitionBy("analysis_id"))
    d = d.withColumn("any_test", tests)
    is_test = F.col("category") == "TEST"
    d = d.withColumn("test_change_status", F.when(is_test, "TEST_FILE_CHANGED").when(F.col("any_test") == 1, "TEST_EXISTS").otherwise("NO_TEST_CHANGE"))
    paths = evidence.select(F.col("analysis_id").alias("e_id"), "name", F.col("ord").alias("e_ord"), F.explode("file_paths").alias("p"))
    hit = changed.select("analysis_id", "ord", path.alias("q")).join(paths, (F.col("analysis_id") == F.col("e_id")) & (F.col("q").contains(F.col("p")) | F.col("p").contains(F.col("q"))))
    hit = hit.groupBy("analysis_id", "ord", "e_ord").agg(F.first("name").alias("name"))
    signals = hit.groupBy("analysis_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("e_ord", "name"))), lambda s: s["name"]).alias("risk_signals"))
    out = d.join(signals, ["analysis_id", "ord"], "left").withColumn("risk_signals", F.coalesce("risk_signals", F.array().cast("array<string>")))
    return out.select("analysis_id", "ord", "path", F.lit("MODIFIED").alias("change_type"), "category", "language", "module", "risk_signals", "test_change_status")


def risk_factors(evidence: DataFrame, indirect: DataFrame) -> DataFrame:
    """The breakdown as numbered factors; downstream reach drops out where nothing indirect was found (analysis_id, indirect)."""
    d = evidence.join(indirect, "analysis_id", "left").where((F.col("signal") != "large_blast_radius") | (F.coalesce("indirect", F.lit(0)) > 0)).drop("indirect")
    return breakdown(d).withColumn("id", F.format_string("RF-%03d", F.col("rank")))


def scoring_trace(factors: DataFrame) -> DataFrame:
    """Factors with normalized_points: their share of the normalised sum, two digits half to even."""
    total = F.sum(F.col("raw_points").cast("decimal(12,4)")).over(Window.partitionBy("analysis_id")).cast("double")
    d = factors.withColumn("raw_sum", total)
    share = F.when(F.col("raw_sum") > 0, normalised(F.col("raw_sum")) / F.col("raw_sum")).otherwise(1.0)
    return d.withColumn("normalized_points", F.bround(F.col("raw_points") * share, 2))


def findings(evidence: DataFrame) -> DataFrame:
    """Evidence as architecture or security findings; full scores are facts."""
    kind = F.when(F.col("category").isin(ARCHITECTURE), "architecture").when(F.col("category") == "security", "security")
    return evidence.withColumn("section", kind).where("section IS NOT NULL").withColumn("classification", F.when(F.col("score") >= 1.0, "FACT").otherwise("INFERENCE"))


def consistency_errors(model: DataFrame) -> DataFrame:
    """model (analysis_id, direct, indirect, total, n_files, score, capped_score, nodes, edges, claims, reach_points) with errors."""
    c, t = F.col, F.format_string
    none = c("indirect") == 0
    claimed = F.filter("claims", lambda x: F.lower(x["claim"]).contains("downstream component") | F.lower(x["claim"]).contains("downstream regression risk"))
    said = F.transform(claimed, lambda x: F.concat(F.lit("Inference '"), x["id"], F.lit("' claims downstream dependency impact when indirect impact is 0.")))
    empty = F.array().cast("array<string>")
    first = F.array_compact(F.array(
        F.when(c("direct") != c("n_files"), t("Blast radius direct impact (%d) does not match changed files count (%d).", "direct", "n_files")),
        F.when(c("total") != c("direct") + c("indirect"), t("Blast radius total impact (%d) != direct (%d) + indirect (%d).", "total", "direct", "indirect")),
    ))
    last = F.array_compact(F.array(
        F.when(none & (c("reach_points") > 0), "Risk breakdown contains 'large_blast_radius' points when indirect impact is 0."),
        F.when(c("score") != c("capped_score"), t("Risk score (%d) does not match capped score (%d).", "score", "capped_score")),
        F.when((c("nodes") < 0) | (c("edges") < 0), "Graph health nodes or edges cannot be negative."),
    ))
    return model.withColumn("errors", F.concat(first, F.when(none, said).otherwise(empty), last))


def test_findings(inputs: DataFrame) -> DataFrame:
    """One finding an analysis: the test files changed, or the gap with the first ten relevant files."""
    tests = F.filter("files", lambda f: P.file_type(f) == "TEST")
    relevant = F.filter("files", lambda f: P.is_relevant(f))
    d = inputs.select("analysis_id", tests.alias("tests"), relevant.alias("relevant"))
    some = F.size("tests") > 0
    text = F.format_string("%d test specification file(s) modified alongside changes: %s", F.size("tests"), F.array_join(F.slice("tests", 1, 3), ", "))
    return d.select(
        "analysis_id", F.when(some, "TEST_MODIFIED").otherwise("GAP_DETECTED").alias("status"), F.when(some, "Related Test Modifications Present").otherwise("Missing Test Modifications").alias("title"),
        F.when(some, text).otherwise("No related unit test or test specification modifications were detected in this commit set.").alias("description"), F.when(some, F.col("tests")).otherwise(F.slice("relevant", 1, 10)).alias("affected_files"),
    )


def repository_metrics(model: DataFrame, columns: list[str]) -> DataFrame:
    """analysis_id, metric, value: columns as rows, in their order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for k, c in enumerate(columns, 1)])
    return model.select("analysis_id", F.explode(pairs).alias("x")).select("analysis_id", "x.*")


def joined(values: Column) -> Column:
    return F.array_join(values, "; ")


# Columns of the CSV sets and the row that stands for no factors
RISK_FACTOR_COLUMNS = ["id", "rule", "name", "category", "points", "raw_points", "evidence", "evidence_ids", "affected_files", "threshold", "recommendation", "recommendation_type"]
NO_FACTOR = ["N/A", "none", "No risk factors", "general", "0", "0.0", "No scoring rule fired", "", "", "", "", ""]
CHANGED_FILE_COLUMNS = ["index", "file_path", "change_type", "language", "module", "risk_signals", "test_status", "test_change_status"]
IMPACTED_FILE_COLUMNS = ["index", "module_or_file", "relationship", "edge_type", "reason", "depth"]
MODULE_IMPACT = ["MODULE_IMPACT", "MODULE_BOUNDARY", "Architectural module in blast radius", "1"]
DEPENDENCY_COLUMNS = ["index", "source", "target", "relationship", "edge_type", "depth", "reason"]
TEST_GAP_COLUMNS = ["index", "category", "title", "description", "recommendation", "affected_files", "status"]


def _text_columns(df: DataFrame, names: list[str], order: str, index: str | None = "index") -> DataFrame:
    """analysis_id, ord and the named columns as text, lists joined, absent and null ones empty; `index` counts from 1 by order."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    text = lambda c: joined(F.col(c)) if kinds[c] == "array" else F.col(c).cast("string")
    k = F.row_number().over(Window.partitionBy("analysis_id").orderBy(order))
    cell = lambda c: k.cast("string") if c == index else F.coalesce(text(c), F.lit("")) if c in kinds else F.lit("")
    return df.select("analysis_id", k.alias("ord"), *[cell(c).alias(c) for c in names])


def csv_sets(analyses: DataFrame, factors: DataFrame, files: DataFrame, paths: DataFrame, findings: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """The six data sets of the CSV export by name, for analyses (analysis_id, impacted_modules), each with analysis_id and ord:
    an analysis without factors has one row that says so, one without paths the modules it touches as impacted files.
    """
    f = factors.withColumnsRenamed({"signal": "rule", "description": "evidence", "file_paths": "affected_files"})
    risk = _text_columns(f, RISK_FACTOR_COLUMNS, "rank", None)
    risk = risk.withColumn("id", F.format_string("RF-%03d", "ord"))
    bare = analyses.select("analysis_id").join(factors.select("analysis_id"), "analysis_id", "left_anti")
    risk = risk.unionByName(bare.select("analysis_id", F.lit(1).alias("ord"), *[F.lit(v).alias(c) for c, v in zip(RISK_FACTOR_COLUMNS, NO_FACTOR)]))
    changed = _text_columns(files.withColumnRenamed("path", "file_path"), CHANGED_FILE_COLUMNS, "ord")
    by = paths.withColumn("by", F.struct("depth", "file_or_module"))
    impacted = _text_columns(by.withColumnRenamed("file_or_module", "module_or_file"), IMPACTED_FILE_COLUMNS, "by")
    alone = analyses.join(paths.select("analysis_id"), "analysis_id", "left_anti").select("analysis_id", F.posexplode("impacted_modules").alias("k", "module"))
    kind, edge, reason, depth = (F.lit(v) for v in MODULE_IMPACT)
    index = F.col("k") + 1
    impacted = impacted.unionByName(alone.select("analysis_id", index.alias("ord"), index.cast("string").alias("index"), F.col("module").alias("module_or_file"), kind.alias("relationship"), edge.alias("edge_type"), reason.alias("reason"), depth.alias("depth")))
    target = F.col("file_or_module") if "target" not in paths.columns else F.coalesce(F.nullif("target", F.lit("")), "file_or_module")
    dependencies = _text_columns(by.withColumn("target", target), DEPENDENCY_COLUMNS, "by")
    gaps = _text_columns(findings.withColumn("by", F.lit(0)) if "ord" not in findings.columns else findings.withColumn("by", F.col("ord")), TEST_GAP_COLUMNS, "by")
    values = _text_columns(metrics.withColumn("by", F.lit(0)) if "ord" not in metrics.columns else metrics.withColumn("by", F.col("ord")), ["metric", "value"], "by", None)
    return {"risk_factors": risk, "changed_files": changed, "impacted_files": impacted, "dependencies": dependencies, "test_gaps": gaps, "repository_metrics": values}


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV under folder/name, one folder an analysis and in it one file: a header, lists joined by '; ', quotes
    doubled, lines ended by CR LF.
    """
    for name, df in tables.items():
        flat = [joined(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema if f.name != "ord"]
        d = df.select(*flat, *(["ord"] if "ord" in df.columns else []))
        if {"analysis_id", "ord"} <= set(df.columns):
            d = d.repartition("analysis_id").sortWithinPartitions("analysis_id", "ord").drop("ord")
            writer = d.write.partitionBy("analysis_id")
        else:
            writer = d.write
        writer.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(f"{folder}/{name}")


def write_json(model: DataFrame, folder: str) -> None:
    model.withColumn("export_format", F.lit("json")).write.mode("overwrite").json(folder)


def summary(scored: DataFrame, inputs: DataFrame) -> DataFrame:
    """analysis_id and a paragraph on the change: files, modules, score, level, completeness."""
    d = scored.join(inputs.select("analysis_id", F.size("files").alias("n"), F.size("impacted_modules").alias("m")), "analysis_id")
    text = F.format_string("This change modifies %d file(s) across %d module(s). Deterministic risk score: %d/100 (%s). Evidence completeness: %.0f%%.", "n", "m", "score", "level", F.col("evidence_completeness") * 100)
    return d.select("analysis_id", text.alias("summary"))


def canonical(scored: DataFrame, factors: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """One nested row an analysis: its score, its factors by rank, its statements in order and its changed files."""
    listed = lambda df, by, columns, name: df.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct(by, *columns))).alias(name))
    d = scored.join(listed(factors, "rank", ["id", "signal", "points", "raw_points", "description"], "risk_breakdown"), "analysis_id", "left")
    d = d.join(listed(ledger, "ord", ["id", "statement_type", "claim", "traceability_ref"], "statements"), "analysis_id", "left")
    return d.join(listed(files, "ord", ["path", "category", "language", "module", "test_change_status"], "changed_files"), "analysis_id", "left")
