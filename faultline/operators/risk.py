"""Rule hits, evidence, score, level and ledger of many change sets at once.

Inputs: changed (analysis_id, ord, path) and inputs (analysis_id, impacted_modules, dependency_count, missing_tests,
critical_modules, affected_functions, hub_nodes, bridge_nodes, flags, deploy, edges, unique_components, ownership).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed_values as V
from ..functions import paths as P

RULE_FIELDS = ("signal", "name", "category", "description", "weight", "path_markers", "extensions", "file_names", "recommendation", "recommendation_type", "threshold")
RULE_SCHEMA = "signal string, name string, category string, description string, weight double, path_markers array<string>, extensions array<string>, file_names array<string>, recommendation string, recommendation_type string, threshold string, rule_no int"


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules, as literals: nothing has to be read from Python where they are used."""
    lit = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, (list, tuple)) else F.lit(v)
    names = [*RULE_FIELDS, "rule_no"]
    rows = [F.struct(*[lit(v).alias(c) for c, v in zip(names, (*r, k))]) for k, r in enumerate(V.RULES)]
    made = spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))
    return made.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(RULE_SCHEMA).fields])


def _marks(rules: DataFrame) -> DataFrame:
    """rule_no, kind, mark, inside of each name (0), suffix (1), folder (2) and word (3) that a rule looks for; inside is what the whole path must contain."""
    each = lambda c, kind: rules.select("rule_no", F.explode(c).alias("mark")).withColumn("kind", F.lit(kind) if isinstance(kind, int) else kind)
    marks = each("file_names", 0).unionByName(each("extensions", 1)).unionByName(each("path_markers", F.when(F.endswith("mark", F.lit("/")), 2).otherwise(3)))
    return marks.withColumn("inside", F.when(F.col("kind") == 2, F.concat(F.lit("/"), "mark")).otherwise(F.concat(F.lit("/"), "mark", F.lit("/"))))


def rule_hits(changed: DataFrame, rules: DataFrame) -> DataFrame:
    """analysis_id, ord, path and the columns of each built-in rule that matches. The rule table is a fixed short list, rule_no tells
    its rows apart. A path is matched once, however many change sets it is in, by plain tests of what the rules look for (as
    paths.rule_matches has it); in a stream, where that would need state, once a row.
    """
    if changed.isStreaming:
        return changed.join(F.broadcast(rules), P.rule_matches(F.col("path"), F.col("path_markers"), F.col("extensions"), F.col("file_names")))
    low = F.lower(P.slashed(F.col("path")))
    paths = changed.select("path").distinct().select("path", F.concat(F.lit("/"), low).alias("full"), P.stem(low).alias("base"), P.suffix(low).alias("suffix"), P.basename(low).alias("name"))
    paths = paths.withColumn("words", F.split("base", "[_-]"))
    c = F.col
    word = F.startswith("base", "mark") | F.endswith("base", "mark") | F.contains("full", "inside") | F.array_contains("words", c("mark"))
    match = F.when(c("kind") == 0, c("name") == c("mark")).when(c("kind") == 1, c("suffix") == c("mark")).when(c("kind") == 2, F.contains("full", "inside")).otherwise(word)
    hits = paths.join(F.broadcast(_marks(rules)), match).select("path", "rule_no").distinct()
    return changed.join(hits, "path").join(F.broadcast(rules), "rule_no").select(*changed.columns, *rules.columns)


def custom_rule_hits(changed: DataFrame, rules: DataFrame) -> DataFrame:
    """As rule_hits for a policy's rules (enabled ones): markers anywhere in the path, extensions at its end."""
    match = P.custom_rule_matches(F.col("path"), F.col("path_markers"), F.col("extensions"))
    return changed.join(rules.where("coalesce(enabled, true)").drop("enabled"), match)


def rule_evidence(hits: DataFrame, custom: bool = False, rules: DataFrame | None = None) -> DataFrame:
    """One row for each analysis and signal hit: n (repeats count), score, sorted distinct paths, first-hit order. What `rules` say of a
    signal is joined after the hits are counted; without rules it comes with the hits.
    """
    # (ord, rule_no) or (rule_no, ord) as one number, which is aggregated by hash where a struct would be sorted
    first = F.min(F.expr("CAST(rule_no AS DECIMAL(10, 0)) * 18446744073709551616 + ord" if custom else "CAST(ord AS DECIMAL(20, 0)) * 4294967296 + rule_no")).alias("first")
    fields = [c for c in RULE_FIELDS if c not in ("signal", "path_markers", "extensions", "file_names") and c in hits.columns]
    own = [F.first(c).alias(c) for c in fields] if rules is None else []
    e = hits.groupBy("analysis_id", "signal").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("path")).alias("file_paths"), first, *own)
    if rules is not None:
        said = F.broadcast(rules.select("rule_no", *fields))
        e = e.withColumn("rule_no", F.expr("CAST(pmod(first, 4294967296) AS INT)")).join(said, "rule_no")
    return e.select(
        "analysis_id", "signal", "name", "category", F.format_string("%s (%d matching file(s))", F.col("description"), F.col("n")).alias("description"), "weight",
        F.least(F.col("n") / 2.0, F.lit(1.0)).alias("score"), "file_paths", "recommendation", "recommendation_type", "threshold",
        F.array_join(F.slice("file_paths", 1, 5), ",").alias("evidence_value"), F.lit("path_match").alias("evidence_type"),
        (F.lit(0) + F.row_number().over(Window.partitionBy("analysis_id").orderBy("first"))).alias("ord"), "n",
    )


def _signal(test: Column, signal: str, name: str, category: str, description: Column, weight: float, score: Column, files: Column, recommendation: Column, kind: Column, threshold: Column, value: Column, evidence: str, ord_: int) -> tuple[Column, tuple[Column, ...]]:
    return test, (
        F.lit(signal).alias("signal"), F.lit(name).alias("name"), F.lit(category).alias("category"), description.alias("description"), F.lit(weight).alias("weight"),
        F.least(score, F.lit(1.0)).alias("score"), F.coalesce(files, F.array().cast("array<string>")).alias("file_paths"), recommendation.alias("recommendation"), kind.alias("recommendation_type"),
        threshold.alias("threshold"), value.alias("evidence_value"), F.lit(evidence).alias("evidence_type"), F.lit(ord_).alias("ord"),
    )


def downstream() -> Column:
    return F.when(F.col("unique_components") > 0, F.col("unique_components")).otherwise(F.col("dependency_count"))


def critical_text(module: Column) -> Column:
    low = F.lower(P.slashed(module))
    reasons = F.array_compact(F.array(
        F.when(P.contains_any(low, ["auth", "login", "jwt", "session", "credential"]), "authentication/security domain"),
        F.when(P.contains_any(low, ["payment", "billing", "checkout", "order"]), "payment/billing domain"),
        F.when(P.contains_any(low, ["db", "database", "schema", "alembic", "model"]), "database persistence model"),
        F.when(P.contains_any(low, ["client", "sdk", "api", "lib"]), "shared client interface"),
    ))
    return F.concat(module, F.lit(" ("), F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("critical domain component"), F.lit(")"))


def refactor_files(files: Column) -> Column:
    """The changed files a refactor counts; order kept."""
    skip = lambda f: P.ends_with_any(F.lower(f), V.REFACTOR_SKIP_ENDINGS) | P.contains_any(F.concat(F.lit("/"), F.lower(f)), ["/" + d for d in V.REFACTOR_SKIP_DIRS])
    return F.filter(files, lambda f: ~skip(f))


def dynamic_signals(inputs: DataFrame) -> DataFrame:
    """The eight signals that graph, tests and symbols raise; inputs also has files, the ordered changed paths."""
    none = F.lit(None).cast("array<string>")
    # fewer changed files than the signal needs aren't looked through
    arch = F.when(F.size("files") >= 15, refactor_files(F.col("files"))).otherwise(F.array().cast("array<string>"))
    i = inputs.withColumn("arch", arch).withColumn("down", downstream())
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    first = lambda c, n, by=", ": F.array_join(F.slice(F.col(c), 1, n), by)
    text = lambda fmt, *cols: F.format_string(fmt, *cols)
    edges = F.when(F.col("edges") > 0, text(" across %d dependency edge(s)", F.col("edges"))).otherwise("")
    total = F.size("files")
    signals = [
        _signal(F.col("down") > 0, "large_blast_radius", "Large Downstream Blast Radius", "architecture", F.concat(text("%d unique downstream component(s) impacted", F.col("down")), edges, F.lit(" by this change.")), 0.18, F.col("down") / 20.0, none, F.when(F.col("flags"), "Feature flag deployment is available and may reduce rollback risk.").otherwise("Add regression tests covering downstream consumers and validate in a staging environment."), F.when(F.col("flags"), "EVIDENCE_BACKED").otherwise("POLICY_BASED"), F.when(F.col("down") >= 10, ">= 10 unique components").otherwise("> 10 unique components"), text("%d_components", F.col("down")), "graph_metric", 1001),
        _signal(F.col("missing_tests"), "missing_tests", "Potential Test Gap", "testing", F.lit("No related unit test or test specification modifications were detected alongside source changes. Runtime coverage data is unavailable."), 0.14, F.lit(1.0), none, F.lit("Add unit tests covering modified business logic in changed components."), F.lit("EVIDENCE_BACKED"), F.lit("0 test changes"), F.lit("0_tests"), "repo_structure", 1002),
        _signal(F.size("arch") >= 15, "large_refactor", "Large Architectural Refactor", "architecture", text("%d architecturally relevant source/build files modified (out of %d total changed files).", F.size("arch"), total), 0.16, F.size("arch") / 30.0, F.slice("arch", 1, 15), F.lit("Consider breaking change set into smaller, isolated pull requests for safer review."), F.lit("GENERIC_BEST_PRACTICE"), F.lit(">= 15 architectural files"), text("%d/%d", F.size("arch"), total), "diff_metric", 1003),
        _signal(size("critical_modules") > 0, "critical_component_modified", "Critical Business Component Modified", "architecture", F.concat(F.lit("Critical business components are directly changed or impacted: "), F.array_join(F.transform(F.slice("critical_modules", 1, 3), critical_text), ", ")), 0.20, size("critical_modules") / 3.0, F.col("critical_modules"), F.lit("Run end-to-end integration tests for critical business workflows."), F.lit("POLICY_BASED"), F.lit("1 critical component"), first("critical_modules", 3, ","), "path_keyword", 1004),
        _signal(size("impacted_modules") >= 3, "multi_module_impact", "Multiple Modules Impacted", "architecture", text("Change impact spans across %d distinct architectural modules: %s", size("impacted_modules"), first("impacted_modules", 4)), 0.18, size("impacted_modules") / 4.0, none, F.lit("These components share dependency relationships and should be tested together."), F.lit("EVIDENCE_BACKED"), F.lit(">= 3 modules"), size("impacted_modules").cast("string"), "graph_metric", 1005),
        _signal(size("affected_functions") > 0, "function_level_impact", "Specific Functions Modified", "architecture", F.concat(text("%d function(s) directly modified: %s", size("affected_functions"), first("affected_functions", 5)), F.when(size("affected_functions") > 5, text(" and %d more", size("affected_functions") - 5)).otherwise("")), 0.10, size("affected_functions") / 10.0, none, F.lit("Review all call sites of the modified functions for argument and return-type compatibility."), F.lit("EVIDENCE_BACKED"), F.lit("1 function"), first("affected_functions", 5, ","), "diff_ast", 1006),
        _signal(size("hub_nodes") > 0, "hub_node_affected", "High-Degree Hub Node in Impact Set", "architecture", text("%d heavily-connected hub node(s) are directly changed or transitively impacted: %s", size("hub_nodes"), first("hub_nodes", 3)), 0.16, size("hub_nodes") / 3.0, none, F.lit("Run the full test suite — hub nodes have many consumers and failures propagate widely."), F.lit("EVIDENCE_BACKED"), F.lit("1 hub node"), first("hub_nodes", 3, ","), "graph_topology", 1007),
        _signal(size("bridge_nodes") > 0, "bridge_node_affected", "Architectural Bridge Node Modified", "architecture", text("%d architectural bridge/chokepoint node(s) are in the impact set: %s. These nodes connect otherwise separate subsystems.", size("bridge_nodes"), first("bridge_nodes", 3)), 0.18, size("bridge_nodes") / 2.0, none, F.lit("Validate integration points between all subsystems connected through these nodes."), F.lit("EVIDENCE_BACKED"), F.lit("1 bridge node"), first("bridge_nodes", 3, ","), "graph_topology", 1008),
    ]
    # which apply comes first, then a column at a time, so that texts nobody asks for are not made
    found = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, (test, _) in enumerate(signals)]))
    i = i.select("*", F.explode(found).alias("which"))

    def one(at: int, name: str) -> Column:
        out = F.when(F.col("which") == 0, signals[0][1][at])
        for k, (_, columns) in enumerate(signals[1:], 1):
            out = out.when(F.col("which") == k, columns[at])
        return out.alias(name)

    names = ("signal", "name", "category", "description", "weight", "score", "file_paths", "recommendation", "recommendation_type", "threshold", "evidence_value", "evidence_type", "ord")
    return i.select("analysis_id", *[one(at, name) for at, name in enumerate(names)])


def evidence(changed: DataFrame, inputs: DataFrame, rules: DataFrame) -> DataFrame:
    """All evidence of each analysis; ord is the order of insertion: path rules by first hit, then the dynamic signals."""
    return rule_evidence(rule_hits(changed, rules), rules=rules).drop("n").unionByName(dynamic_signals(inputs))


def raw_points() -> Column:
    return F.col("weight") * F.col("score") * 100


def normalised(raw: Column) -> Column:
    return F.when(raw > 60, 60 + (raw - 60) * 0.5).otherwise(raw)


def level(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 55, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def completeness(files: Column, modules: Column, has_evidence: Column, dependency_count: Column) -> Column:
    total = F.lit(0.60) + F.when(F.size(files) > 0, 0.15).otherwise(0.0) + F.when(F.size(modules) > 0, 0.10).otherwise(0.0)
    total = total + F.when(has_evidence, 0.10).otherwise(0.0) + F.when(dependency_count != 0, 0.05).otherwise(0.0)
    return F.bround(F.least(total, F.lit(0.98)), 3)


def scores(ev: DataFrame, inputs: DataFrame) -> DataFrame:
    """analysis_id, raw, normalized, score, level, n_evidence, evidence_completeness; analyses without evidence score 0."""
    sums = ev.groupBy("analysis_id").agg(F.sum(F.expr("CAST(weight * score * 100 AS DECIMAL(18, 9))")).cast("double").alias("raw"), F.count("*").alias("n_evidence"))
    s = inputs.join(sums, "analysis_id", "left").withColumns({"raw": F.coalesce("raw", F.lit(0.0)), "n_evidence": F.coalesce("n_evidence", F.lit(0))})
    s = s.withColumn("normalized", normalised(F.col("raw"))).withColumn("score", F.bround(F.greatest(F.least(F.col("normalized"), F.lit(100.0)), F.lit(0.0))).cast("int"))
    return s.select(
        "analysis_id", F.bround("raw", 2).alias("raw_rule_score"), F.bround("normalized", 2).alias("normalized_score"), "score", level(F.col("score")).alias("level"),
        F.col("n_evidence").cast("long").alias("n_evidence"), completeness(F.col("files"), F.col("impacted_modules"), F.col("n_evidence") > 0, F.col("dependency_count")).alias("evidence_completeness"),
    )


def audit(scored: DataFrame) -> DataFrame:
    """analysis_id and the audit map."""
    keys = ("raw_rule_score", "normalized_score", "score", "evidence_completeness")
    names = F.array(*[F.lit("capped_score" if k == "score" else k) for k in keys])
    return scored.select("analysis_id", F.map_from_arrays(names, F.array(*[F.col(k).cast("double") for k in keys])).alias("audit"))


def breakdown(ev: DataFrame) -> DataFrame:
    """Evidence ranked by points, ties in order of insertion."""
    rank = F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.desc(F.col("weight") * F.col("score")), "ord"))
    return ev.withColumn("rank", rank).withColumn("points", F.bround(raw_points()).cast("int")).withColumn("raw_points", F.bround(raw_points(), 2))


def statement(test: Column, kind: str, claim: Column, source: Column, ref: Column, files: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.when(test, F.struct(F.lit(kind).alias("statement_type"), claim.alias("claim"), source.alias("source_evidence"), ref.alias("traceability_ref"), F.coalesce(files if files is not None else none, none).alias("affected_files")))


def ledger(ev: DataFrame, inputs: DataFrame) -> DataFrame:
    """Facts, inferences and recommendations with their ids, in order."""
    i = inputs.withColumn("down", downstream())
    t, size = F.format_string, lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    yes, lit = F.lit(True), F.lit
    across = F.when(F.col("edges") > 0, t(" across %d dependency edges", F.col("edges"))).otherwise("")
    facts = F.array_compact(F.array(
        statement(yes, "FACT", t("%d file(s) modified in the active change set.", size("files")), t("Git unified diff touching %d files", size("files")), lit("diff_stat"), F.slice("files", 1, 10)),
        statement(F.col("unique_components") > 0, "FACT", t("%d unique downstream component(s) impacted across %d dependency edge(s). Total blast radius: %d.", F.col("unique_components"), F.col("edges"), size("files") + F.col("unique_components")), lit("AST Dependency Graph BFS traversal"), lit("graph_traversal")),
        statement((F.col("unique_components") <= 0) & (F.col("dependency_count") > 0), "FACT", t("%d downstream component(s) impacted by this change.", F.col("dependency_count")), lit("AST Dependency Graph traversal"), lit("graph_traversal")),
        statement(size("impacted_modules") > 0, "FACT", t("%d distinct architectural module(s) are touched or imported: %s", size("impacted_modules"), F.array_join(F.slice("impacted_modules", 1, 5), ", ")), lit("AST module resolution"), lit("ast_modules")),
        statement(size("affected_functions") > 0, "FACT", t("%d function/class symbol(s) directly modified in AST diff.", size("affected_functions")), t("Tree-Sitter AST diff on %d symbols", size("affected_functions")), lit("ast_diff_symbols")),
        statement(yes, "FACT", F.when(F.col("flags"), "Feature flag infrastructure was detected in repository evidence.").otherwise("Feature flag infrastructure was not detected in available repository evidence."), F.when(F.col("flags"), "Repository configuration / dependency scan").otherwise("Repository configuration scan"), lit("feature_flags_scan")),
        statement(yes, "FACT", F.when(F.col("deploy"), "Deployment topology configuration manifests were detected.").otherwise("Deployment topology evidence was not detected from available repository files."), F.when(F.col("deploy"), "Infrastructure as Code / container manifests").otherwise("Repository infrastructure scan"), lit("deployment_manifests")),
    ))
    inferences = F.array_compact(F.array(
        statement(F.col("down") > 10, "INFERENCE", F.concat(t("High downstream blast radius: changing these components may introduce regression risk across %d unique dependent components", F.col("down")), across, lit(".")), t("Derived from blast radius traversal (%d unique components)", F.col("down")), lit("rule:large_blast_radius")),
        statement(F.col("missing_tests"), "INFERENCE", lit("Potential test gap: production code changes lack accompanying unit test or test specification modifications in this commit set. Runtime coverage data was unavailable."), lit("Diff analysis: 0 test files modified in commit set"), lit("rule:missing_tests")),
        statement(size("critical_modules") > 0, "INFERENCE", F.concat(lit("Critical business workflows may be affected because changes intersect sensitive domains: "), F.array_join(F.slice("critical_modules", 1, 3), ", ")), lit("Sensitive domain path keyword matching"), lit("rule:critical_component_modified"), F.col("critical_modules")),
        statement(size("impacted_modules") >= 3, "INFERENCE", lit("Cross-module coupling: changes span multiple architectural boundaries rather than being localized to a single module."), t("Impact spans %d modules", size("impacted_modules")), lit("rule:multi_module_impact")),
    ))
    numbered = lambda c, prefix, base: i.select("analysis_id", F.posexplode(c).alias("k", "s")).select("analysis_id", (F.lit(base) + F.col("k")).alias("ord"), t(prefix + "-%03d", F.col("k") + 1).alias("id"), "s.*")
    k = F.row_number().over(Window.partitionBy("analysis_id").orderBy("ord"))
    recs = ev.where("recommendation <> ''").withColumn("k", k)
    recs = recs.select("analysis_id", (F.lit(2000) + F.col("k")).alias("ord"), t("REC-%03d", F.col("k")).alias("id"), lit("RECOMMENDATION").alias("statement_type"), F.col("recommendation").alias("claim"), F.concat(lit("Triggered by "), "signal", lit(": "), "description").alias("source_evidence"), F.concat(lit("rule:"), "signal").alias("traceability_ref"), F.col("file_paths").alias("affected_files"))
    return numbered(facts, "FACT", 0).unionByName(numbered(inferences, "INF", 1000)).unionByName(recs)


def scenarios(inputs: DataFrame) -> DataFrame:
    """analysis_id, k, scenario."""
    prefix = "Potential Scenario: "
    any_file = lambda test: F.coalesce(F.exists("files", test), F.lit(False))
    found = F.array_compact(F.array(
        F.when(downstream() > 0, F.format_string(prefix + "Downstream consumers may be affected because %d dependent components rely on the modified interfaces.", downstream())),
        F.when(F.col("missing_tests"), prefix + "Regressions in modified business logic may go undetected prior to deployment due to absence of accompanying automated test specifications."),
        F.when(any_file(lambda f: P.contains_any(F.lower(f), ["auth", "session"])), prefix + "Authentication or session validation logic changes could alter token verification or permission evaluation for active sessions."),
        F.when(any_file(lambda f: f.endswith(".sql") | F.lower(f).contains("migration")), prefix + "Database schema changes may cause transient runtime queries to fail if application code and database migrations are not synchronized."),
    ))
    fallback = F.array(F.lit(prefix + "Minor localized regressions possible in directly modified components if edge cases in updated logic are unhandled."))
    return inputs.select("analysis_id", F.posexplode(F.when(F.size(found) > 0, found).otherwise(fallback)).alias("k", "scenario"))


def review_areas(inputs: DataFrame) -> DataFrame:
    """The first six changed files with the reviewer the ownership map names, or a note."""
    d = inputs.select("analysis_id", "ownership", F.posexplode(F.slice("files", 1, 6)).alias("k", "review_area"))
    owner = F.when(F.coalesce(F.try_element_at("ownership", F.col("review_area")), F.lit("")) != "", F.try_element_at("ownership", F.col("review_area")))
    note = "Ownership data unavailable — CODEOWNERS/team mapping not detected (could not be determined from available repository evidence)."
    return d.select("analysis_id", "k", "review_area", owner.alias("suggested_reviewer"), F.when(owner.isNull(), note).alias("ownership_note"))


def deployment_notes(inputs: DataFrame) -> DataFrame:
    together = "These components share dependency relationships and should be tested together."
    known = ["Deployment topology configuration detected: verify container build and staging deployment manifests before production rollout.", together]
    unknown = [together, "Deployment topology evidence was not detected from repository files. Do not infer standalone deployment sequencing solely from source code imports."]
    both = lambda v: F.array(*[F.lit(x) for x in v])
    return inputs.select("analysis_id", F.posexplode(F.when(F.col("deploy"), both(known)).otherwise(both(unknown))).alias("k", "note"))


def reasons(ev: DataFrame) -> DataFrame:
    return breakdown(ev).select("analysis_id", "rank", F.concat("name", F.lit(": "), "description").alias("reason"))


def fail_closed(scored: DataFrame, health_status: str = "health_status", columns: tuple[str, ...] = ("health_score",)) -> DataFrame:
    """Scores of an analysis without usable evidence are null, not 0."""
    return scored.withColumns({c: F.when(F.col(health_status) != "UNAVAILABLE", F.col(c)) for c in columns})
