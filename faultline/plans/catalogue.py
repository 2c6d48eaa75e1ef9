"""Every operator over the test tables, with the DuckDB statement that its result must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from ..operators import analysis, centrality, diff, experiments, export, graph, health, policy, reconstruct, report, risk, snapshots, store, traverse, views
from ..sources import adapters as A
from ..sources import parsers, readers
from . import sql_views as S
from .durable import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def big(c, name: str | None = None) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint").alias(name or c)


def join_list(c, name: str | None = None) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(col, "|").alias(name or c)


# --- paths and classifiers ---------------------------------------------------------------------------------------------
PATHS = S.PATHS + ", " + S.PARTS.format(table="paths")
TYPED = f"{PATHS}, typed AS (SELECT *, {S.TYPE_CASE} AS file_type FROM p)"


@query(f"WITH {PATHS} SELECT CAST(ord AS BIGINT) AS ord, path, raw_name AS name, suffix, stem FROM p")
def q_path_parts(spark, d):
    low = F.lower(P.slashed(F.col("path")))
    return A.all_paths(spark, d).select("ord", "path", P.basename(P.slashed(F.col("path"))).alias("name"), P.suffix(low).alias("suffix"), P.stem(low).alias("stem"))


@query(f"WITH {PATHS} SELECT CAST(ord AS BIGINT) AS ord, {S.any_contains('low', V.IGNORED_PATTERNS)} AS vendor FROM p")
def q_vendor_filter(spark, d):
    return A.all_paths(spark, d).select("ord", P.is_generated_or_vendor(F.col("path")).alias("vendor"))


@query(f"WITH {PATHS} SELECT CAST(ord AS BIGINT) AS ord, name IN {S.inside(V.PARSER_CONFIG_FILENAMES)} AS config FROM p")
def q_config_filter(spark, d):
    return A.all_paths(spark, d).select("ord", P.is_config_file(F.col("path")).alias("config"))


@query(f"WITH {TYPED} SELECT CAST(ord AS BIGINT) AS ord, path, file_type FROM typed")
def q_file_type(spark, d):
    return A.all_paths(spark, d).select("ord", "path", P.file_type(F.col("path")).alias("file_type"))


@query(f"WITH {PATHS} SELECT CAST(ord AS BIGINT) AS ord, path, {S.ROLE_CASE} AS role FROM p")
def q_file_role(spark, d):
    return A.all_paths(spark, d).select("ord", "path", P.file_role(F.col("path")).alias("role"))


@query(f"WITH {TYPED} SELECT CAST(ord AS BIGINT) AS ord, path FROM typed WHERE file_type IN {S.inside(V.RELEVANT_TYPES)}")
def q_arch_relevant(spark, d):
    return A.all_paths(spark, d).where(P.is_relevant(F.col("path")))


@query(f"WITH {TYPED} SELECT CAST(ord AS BIGINT) AS ord, {S.MODULE_CASE} AS module FROM typed")
def q_impacted_modules(spark, d):
    return A.all_paths(spark, d).select("ord", P.impacted_module(F.col("path")).alias("module"))


@query(f"WITH {PATHS} SELECT CAST(ord AS BIGINT) AS ord, {S.any_contains('low', V.CRITICAL_GRAPH)} AS graph, {S.any_contains('low', V.CRITICAL_ANALYZER)} AS analyzer, {S.any_contains('low', V.CRITICAL_WORKER)} AS worker FROM p")
def q_critical_paths(spark, d):
    low = F.lower("path")
    return A.all_paths(spark, d).select("ord", *[P.contains_any(low, w).alias(n) for n, w in (("graph", V.CRITICAL_GRAPH), ("analyzer", V.CRITICAL_ANALYZER), ("worker", V.CRITICAL_WORKER))])


LANGUAGE_SQL = " ".join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in P.LANGUAGES.items())


@query(f"WITH {PATHS}, e AS (SELECT ord, CASE WHEN contains(norm, '.') THEN lower(string_split(norm, '.')[-1]) ELSE '' END AS ext FROM p) SELECT CAST(ord AS BIGINT) AS ord, CASE ext WHEN '' THEN 'Text' {LANGUAGE_SQL} ELSE upper(ext) END AS language FROM e")
def q_language_label(spark, d):
    return A.all_paths(spark, d).select("ord", P.language_label(F.col("path")).alias("language"))


@query(f"WITH {PATHS}, r AS (SELECT ord, path AS ref FROM p UNION ALL SELECT ord, path || '..x' FROM p WHERE ord < 0) SELECT CAST(ord AS BIGINT) AS ord, ref, NOT contains(ref, '..') AND regexp_full_match(ref, '[A-Za-z0-9_.~^/@{{}}\\-]+') AS safe FROM r")
def q_safe_ref(spark, d):
    paths = A.all_paths(spark, d)
    refs = paths.select("ord", F.col("path").alias("ref")).union(paths.where("ord < 0").select("ord", F.concat("path", F.lit("..x"))))
    return refs.select("ord", "ref", P.is_safe_ref(F.col("ref")).alias("safe"))


@query(f"WITH {PATHS} SELECT CAST(ord AS BIGINT) AS ord, left(regexp_replace(regexp_replace(path, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_\\-.]', '_', 'g'), 64) AS safe_name FROM paths")
def q_safe_filename(spark, d):
    return A.all_paths(spark, d).select("ord", P.safe_filename(F.col("path")).alias("safe_name"))


@query(f"WITH {S.FILES} SELECT ord, replace(path, '/', '//./') || '/..' AS path, regexp_replace(path, '/[^/]*$', '') AS normal FROM files")
def q_normalize_path(spark, d):
    return A.files(spark, d).select("ord", F.concat(F.replace("path", F.lit("/"), F.lit("//./")), F.lit("/..")).alias("path")).withColumn("normal", P.normalize_path(F.col("path")))


@query("SELECT p_partkey AS ord, 'Part ' || p_name || ' of ' || p_brand || ': ' || p_name AS body FROM part")
def q_template_render(spark, d):
    t = F.lit("Part {{ name }} of {{brand}}: {{ name }}")
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), P.render(t, {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("body"))


# --- change sets, rules, scores ----------------------------------------------------------------------------------------
SCORED, SCORED_LARGE = S.scored_views(), S.scored_views(True)


def _scored(spark, d, large=False):
    """(evidence, inputs) of all change sets, which are read and grouped once."""
    changes = keep(A.changed(spark, d, large))
    inputs = keep(A.inputs_of(changes))
    return risk.evidence(changes, inputs, risk.builtin_rules(spark)), inputs


def _evidence(spark, d, large=False):
    return _scored(spark, d, large)[0]


@query(f"WITH {SCORED} SELECT analysis_id, CAST(ord AS BIGINT) AS ord, path, signal FROM hits")
def q_rule_hits(spark, d):
    return risk.rule_hits(A.changed(spark, d), risk.builtin_rules(spark)).select("analysis_id", "ord", "path", "signal")


SPECIAL_CHANGED = f"WITH {PATHS}, c AS (SELECT 0 AS analysis_id, * FROM p), {S.HITS}"


@query(f"{SPECIAL_CHANGED} SELECT CAST(ord AS BIGINT) AS ord, path, signal FROM hits")
def q_rule_hits_special(spark, d):
    """Rules on every path of the tables and on the names that hit each rule's corner cases."""
    return risk.rule_hits(A.all_paths(spark, d).withColumn("analysis_id", F.lit(0)), risk.builtin_rules(spark)).select("ord", "path", "signal")


@query(f"WITH {SCORED} SELECT analysis_id, signal, n, score, array_to_string(file_paths, '|') AS file_paths FROM rule_ev")
def q_rule_evidence(spark, d):
    e = risk.rule_evidence(risk.rule_hits(A.changed(spark, d), risk.builtin_rules(spark)))
    return e.select("analysis_id", "signal", big("n"), "score", join_list("file_paths"))


@query(f"WITH {SCORED_LARGE} SELECT analysis_id, signal, weight, CAST(score AS DOUBLE) AS score, CAST(ord AS BIGINT) AS ord FROM dyn")
def q_dynamic_signals(spark, d):
    return risk.dynamic_signals(A.inputs(spark, d, True)).select("analysis_id", "signal", "weight", "score", big("ord"))


SCORE_COLUMNS = "analysis_id, round_even(raw, 2) AS raw_rule_score, round_even(normalized, 2) AS normalized_score, score, level, CAST(n_evidence AS BIGINT) AS n_evidence"
COMPLETE = "round_even(least(0.60 + CASE WHEN n_files > 0 THEN 0.15 ELSE 0 END + CASE WHEN len(modules) > 0 THEN 0.10 ELSE 0 END + CASE WHEN n_evidence > 0 THEN 0.10 ELSE 0 END + CASE WHEN dependency_count <> 0 THEN 0.05 ELSE 0 END, 0.98), 3)"


@query(f"WITH {SCORED} SELECT {SCORE_COLUMNS}, CAST({COMPLETE} AS DOUBLE) AS evidence_completeness FROM levels")
def q_risk_score(spark, d):
    return risk.scores(*_scored(spark, d))


@query(f"WITH {SCORED_LARGE} SELECT {SCORE_COLUMNS}, CAST({COMPLETE} AS DOUBLE) AS evidence_completeness FROM levels")
def q_risk_score_large(spark, d):
    return risk.scores(*_scored(spark, d, True))


@query(f"WITH {SCORED} SELECT level, count(*) AS n FROM levels GROUP BY level")
def q_risk_level_counts(spark, d):
    return risk.scores(*_scored(spark, d)).groupBy("level").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT analysis_id, signal, row_number() OVER (PARTITION BY analysis_id ORDER BY weight * score DESC, ord) AS rank, CAST(round_even(weight * score * 100, 0) AS BIGINT) AS points, round_even(weight * score * 100, 2) AS raw_points FROM ev")
def q_risk_breakdown(spark, d):
    return risk.breakdown(_evidence(spark, d)).select("analysis_id", "signal", big("rank"), big("points"), "raw_points")


@query(f"WITH {SCORED} SELECT analysis_id, score * 1.0 AS capped_score, round_even(raw, 2) AS raw_rule_score FROM levels")
def q_audit_map(spark, d):
    a = risk.audit(risk.scores(*_scored(spark, d)))
    return a.select("analysis_id", F.col("audit")["capped_score"].alias("capped_score"), F.col("audit")["raw_rule_score"].alias("raw_rule_score"))


def _custom(spark):
    rows = [("touches_lib", ["lib", "Utils/"], [], True), ("sql_like", [], [".SQL", ".tf"], True), ("off", ["a"], [], False)]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "signal string, path_markers array<string>, extensions array<string>, enabled boolean, rule_no int")


@query(f"WITH {S.FILES}, {S.CHANGED} SELECT analysis_id, CAST(ord AS BIGINT) AS ord, signal FROM changed, (VALUES ('touches_lib'), ('sql_like')) AS r(signal) WHERE CASE signal WHEN 'touches_lib' THEN contains(lower(path), 'lib') OR contains(lower(path), 'utils/') ELSE ends_with(lower(path), '.sql') OR ends_with(lower(path), '.tf') END")
def q_custom_rule_hits(spark, d):
    return risk.custom_rule_hits(A.changed(spark, d), _custom(spark)).select("analysis_id", "ord", "signal")


@query(f"""WITH {SCORED} SELECT analysis_id, id, statement_type, claim FROM (
 SELECT analysis_id, 'FACT-001' AS id, 'FACT' AS statement_type, n_files || ' file(s) modified in the active change set.' AS claim FROM down
 UNION ALL SELECT analysis_id, 'FACT-002', 'FACT', CASE WHEN unique_components > 0 THEN unique_components || ' unique downstream component(s) impacted across ' || edges || ' dependency edge(s). Total blast radius: ' || (n_files + unique_components) || '.' ELSE dependency_count || ' downstream component(s) impacted by this change.' END FROM down WHERE down > 0)""")
def q_ledger_facts(spark, d):
    facts = risk.ledger(*_scored(spark, d)).where("traceability_ref IN ('diff_stat', 'graph_traversal')")
    return facts.select("analysis_id", "id", "statement_type", "claim")


@query(f"""WITH {SCORED_LARGE}, i AS (SELECT analysis_id, 1 AS k, 'rule:large_blast_radius' AS ref FROM down WHERE down > 10 UNION ALL SELECT analysis_id, 2, 'rule:missing_tests' FROM down WHERE missing_tests
 UNION ALL SELECT analysis_id, 3, 'rule:critical_component_modified' FROM down WHERE len(critical_modules) > 0 UNION ALL SELECT analysis_id, 4, 'rule:multi_module_impact' FROM down WHERE len(modules) >= 3)
 SELECT analysis_id, 'INF-' || lpad(CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY k) AS VARCHAR), 3, '0') AS id, ref AS traceability_ref FROM i""")
def q_ledger_inferences(spark, d):
    return risk.ledger(*_scored(spark, d, True)).where("statement_type = 'INFERENCE'").select("analysis_id", "id", "traceability_ref")


@query(f"WITH {SCORED} SELECT analysis_id, 'REC-' || lpad(CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY ord) AS VARCHAR), 3, '0') AS id, 'rule:' || signal AS traceability_ref FROM ev")
def q_ledger_recommendations(spark, d):
    return risk.ledger(*_scored(spark, d)).where("statement_type = 'RECOMMENDATION'").select("analysis_id", "id", "traceability_ref")


@query(f"""WITH {SCORED}, s AS (SELECT analysis_id, 1 AS k FROM down WHERE down > 0 UNION ALL SELECT analysis_id, 2 FROM down WHERE missing_tests
 UNION ALL SELECT DISTINCT analysis_id, 3 FROM c WHERE contains(low, 'auth') OR contains(low, 'session') UNION ALL SELECT DISTINCT analysis_id, 4 FROM c WHERE ends_with(path, '.sql') OR contains(low, 'migration')),
 a AS (SELECT analysis_id, k FROM s UNION ALL SELECT analysis_id, 5 FROM down WHERE analysis_id NOT IN (SELECT analysis_id FROM s))
 SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY k) - 1 AS k, ['Downstream', 'Regressions', 'Authentication', 'Database', 'Minor'][k] AS topic FROM a""")
def q_scenarios(spark, d):
    return risk.scenarios(A.inputs(spark, d)).select("analysis_id", big("k"), F.regexp_extract("scenario", r"^Potential Scenario: (\w+)", 1).alias("topic"))


@query(f"WITH {SCORED} SELECT analysis_id, k - 1 AS k, files[k] AS review_area, CASE WHEN k = 1 THEN 'owner_' || analysis_id END AS suggested_reviewer FROM down, range(1, 7) AS r(k) WHERE k <= n_files")
def q_review_areas(spark, d):
    return risk.review_areas(A.inputs(spark, d)).select("analysis_id", big("k"), "review_area", "suggested_reviewer")


@query(f"WITH {SCORED} SELECT analysis_id, deploy, k FROM down, range(0, 2) AS r(k)")
def q_deployment_notes(spark, d):
    i = A.inputs(spark, d)
    return risk.deployment_notes(i).select("analysis_id", F.col("note").isNotNull().alias("x"), big("k")).join(i.select("analysis_id", "deploy"), "analysis_id").select("analysis_id", "deploy", "k")


@query(f"WITH {SCORED} SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY weight * score DESC, ord) AS rank, signal FROM ev")
def q_reasons(spark, d):
    ev = _evidence(spark, d)
    return risk.reasons(ev).join(risk.breakdown(ev).select("analysis_id", "rank", "signal"), ["analysis_id", "rank"]).select("analysis_id", big("rank"), "signal")


def report_lines(spark, d) -> DataFrame:
    """The Markdown report of every change set, a row a line."""
    changes = keep(A.changed(spark, d))
    inputs = keep(A.inputs_of(changes))
    ev = keep(risk.evidence(changes, inputs, risk.builtin_rules(spark)))
    sums = risk.scores(ev, inputs).join(inputs.select("analysis_id", F.col("dependency_count").alias("indirect"), F.size("files").alias("direct")), "analysis_id")
    text = {"title": F.concat(F.lit("order/"), "analysis_id"), "branch": F.lit("main"), "generated": F.lit(""), "completeness": F.lit(""), "calibration": F.lit("RULE_BASED")}
    none = {c: F.lit(0) for c in ("nodes", "edges", "cycles", "orphans", "unresolved", "health_score")}
    a = sums.select("analysis_id", "score", "level", "evidence_completeness", F.lit("").alias("score_description"), F.col("raw_rule_score").alias("raw_score"), F.col("normalized_score").alias("normalized"), "direct", "indirect", F.col("direct").alias("raw_files"), F.col("direct").alias("relevant_files"))
    a = keep(a.withColumns(text | none).withColumn("metadata", F.create_map(F.lit("analysis_id"), F.col("analysis_id").cast("string"))))
    b = risk.breakdown(ev).select("analysis_id", F.col("rank").alias("ord"), F.col("signal").alias("rule"), F.lit("risk").alias("category"), "points", F.lit("").alias("evidence"), F.array().cast("array<string>").alias("files"))
    files = changes.select("analysis_id", "ord", "path", P.file_type(F.col("path")).alias("category"), P.language_label(F.col("path")).alias("language"), F.lit("").alias("module"), F.array().cast("array<string>").alias("signals"), F.lit("").alias("status"))
    return report.markdown_lines(a, factors=b, files=files)


@query(f"""WITH {SCORED} SELECT CAST(analysis_id AS VARCHAR) AS analysis_id, '**Risk Rating:** `' || score || '/100 — ' || level || '`  ' AS line FROM levels
 UNION ALL SELECT CAST(analysis_id AS VARCHAR), '**Changed Files Scope:** `' || n_files || '` total changed files (`' || n_files || '` architecturally relevant source/build files)' FROM levels
 UNION ALL SELECT CAST(analysis_id AS VARCHAR), {S.text(report.NOTHING['factors'])} FROM levels WHERE n_evidence = 0 UNION ALL SELECT CAST(analysis_id AS VARCHAR), h FROM levels, (VALUES {', '.join(f"({S.text(h)})" for h in report.SECTIONS)}) AS s(h)""")
def q_report_lines(spark, d):
    lines = report_lines(spark, d)
    return lines.where(F.col("line").startswith("**Risk") | F.col("line").startswith("**Changed") | F.col("line").startswith("## ") | (F.col("line") == report.NOTHING["factors"])).select("analysis_id", "line")


# --- diffs and symbols -------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS status, 'new/' || p_partkey AS filename,
 CASE WHEN p_partkey % 4 = 3 THEN 'old/' || p_partkey END AS previous_filename FROM part""")
def q_diff_name_status(spark, d):
    k = F.col("p_partkey")
    line = F.concat(A.pick(["A", "M", "D", "R100"], k % 4), F.lit("\t"), F.when(k % 4 == 3, F.concat(F.lit("old/"), k, F.lit("\t"))).otherwise(""), F.lit("new/"), k)
    return diff.name_status(A.table(spark, d, "part").select(k.alias("key"), k.alias("ord"), line.alias("line"))).select("key", "status", "filename", "previous_filename")


def _hunk_rows(spark, d):
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")).distinct()


@query("SELECT DISTINCT l_orderkey AS key, 'f/' || l_partkey AS path, l_suppkey AS start, CASE WHEN CAST(l_quantity AS INT) % 20 > 0 THEN l_suppkey + CAST(l_quantity AS INT) % 20 - 1 ELSE l_suppkey END AS \"end\" FROM lineitem")
def q_diff_hunks(spark, d):
    r = _hunk_rows(spark, d)
    block = F.concat(F.lit("--- a/x\n+++ b/f/"), "l_partkey", F.lit("\n@@ -1,2 +"), "l_suppkey", F.when(F.col("q") % 20 == 1, "").otherwise(F.concat(F.lit(","), (F.col("q") % 20).cast("string"))), F.lit(" @@ x\n+y"))
    text = r.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_join(F.sort_array(F.collect_list(block)), "\n").alias("text"))
    return diff.hunks(text).select("key", "path", big("start"), big("end")).distinct()


@query("""WITH s AS (SELECT DISTINCT l_partkey AS f, 's' || l_linenumber AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'class' ELSE 'function' END AS kind, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INT) AS b FROM lineitem),
 r AS (SELECT DISTINCT l_partkey AS f, l_suppkey AS a, l_suppkey + CAST(l_quantity AS INT) % 20 AS b FROM lineitem),
 h AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.f = s.f AND s.a <= r.b AND s.b >= r.a)),
 o AS (SELECT *, row_number() OVER (PARTITION BY f, name ORDER BY kind <> 'function', a, b, kind) AS k FROM h)
 SELECT 'f/' || f AS path, name, kind, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line FROM o WHERE k = 1""")
def q_affected_symbols(spark, d):
    l = A.table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    path = F.concat(F.lit("f/"), "l_partkey").alias("path")
    n = F.col("l_linenumber")
    symbols = l.select(path, F.concat(F.lit("s"), n).alias("name"), F.when(n % 2 == 0, "class").otherwise("function").alias("kind"), (n * 10).alias("start_line"), (n * 10 + F.col("q")).alias("end_line")).distinct()
    ranges = l.select(path, F.col("l_suppkey").cast("int").alias("start"), (F.col("l_suppkey") + F.col("q") % 20).cast("int").alias("end")).distinct()
    return diff.affected_symbols(symbols, ranges).select("path", "name", "kind", big("start_line"), big("end_line"))


@query(f"""WITH {S.VERSIONS} SELECT 'modified' AS status, path, NULL AS previous_path FROM both_sides WHERE a <> b UNION ALL SELECT 'renamed', path, old_path FROM moved
 UNION ALL SELECT 'deleted', path, NULL FROM lost WHERE path NOT IN (SELECT old_path FROM moved) UNION ALL SELECT 'added', path, NULL FROM fresh WHERE path NOT IN (SELECT path FROM moved)""")
def q_snapshot_status(spark, d):
    return snapshots.changes(*A.versions(spark, d), least=1).select("status", "path", "previous_path")


@query(f"""WITH {S.VERSIONS}, tokens AS (SELECT side, path, line, count(*) AS n FROM (SELECT side, path, unnest(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS line
  FROM (SELECT 'old' AS side, path, text FROM lost WHERE path NOT IN (SELECT old_path FROM moved) UNION ALL SELECT 'new', path, text FROM fresh WHERE path NOT IN (SELECT path FROM moved)) WHERE text <> '') GROUP BY ALL),
 sizes AS (SELECT side, path, sum(n) AS n_lines FROM tokens GROUP BY ALL),
 met AS (SELECT a.path AS old_path, b.path AS path, sum(least(a.n, b.n)) AS common FROM tokens a JOIN tokens b ON a.line = b.line AND a.side = 'old' AND b.side = 'new' GROUP BY ALL)
 SELECT m.old_path, m.path, CAST(common AS BIGINT) AS common, CAST(a.n_lines + b.n_lines AS BIGINT) AS lines FROM met m JOIN sizes a ON a.side = 'old' AND a.path = m.old_path JOIN sizes b ON b.side = 'new' AND b.path = m.path WHERE 4 * common >= a.n_lines + b.n_lines""")
def q_snapshot_similar(spark, d):
    old, new = A.versions(spark, d)
    found = keep(snapshots.changes(old, new, least=1))
    side = lambda files, status: files.join(found.where(F.col("status") == status).select("path"), "path", "left_semi")
    pairs = snapshots.similar_files(side(old, "deleted"), side(new, "added"))
    return pairs.select("old_path", "path", "common", F.round(2 * F.col("common") / F.col("similarity")).cast("bigint").alias("lines"))


def snapshot_hunks(spark, d):
    """(changes, hunks) between the two versions of all documents."""
    old, new = A.versions(spark, d)
    found = keep(snapshots.changes(old, new))
    return found, snapshots.hunks(found, old, new)


@query()
def q_snapshot_hunks(spark, d):
    found, hunks = snapshot_hunks(spark, d)
    return hunks.join(found.select("path", "status", "previous_path"), "path")


@query()
def q_snapshot_symbols(spark, d):
    """The paragraphs (three lines) of the new version that a hunk touches."""
    hunks = keep(snapshot_hunks(spark, d)[1])
    lines = A.versions(spark, d)[1].select("path", F.size(F.split("text", "\n")).alias("n"))
    symbols = lines.select("path", "n", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(3))).alias("start_line"))
    symbols = symbols.select("path", F.concat(F.lit("p"), "start_line").alias("name"), F.lit("function").alias("kind"), "start_line", F.least(F.col("start_line") + 2, "n").alias("end_line"))
    return diff.affected_symbols(symbols, snapshots.ranges(hunks))


CODE_CHANGED = "changed AS (SELECT ord % 5 AS analysis_id, ord, path FROM files WHERE ord % 3 = 0)"
TREE_SCORED = S.scored_views().replace(S.CHANGED, CODE_CHANGED).replace("sum(ord % 7) AS dependency_count", "0 AS dependency_count").replace("FILTER (ord % 3 = 0) AS n_functions", f"FILTER (suffix = '.py' AND NOT {S.any_contains('low', V.IGNORED_PATTERNS)} AND NOT name IN {S.inside(V.PARSER_CONFIG_FILENAMES)}) AS n_functions")
TREE_SCORED = TREE_SCORED.replace("FILTER (ord % 11 = 0) AS n_hubs", "FILTER (false) AS n_hubs").replace("FILTER (ord % 13 = 0) AS n_bridges", "FILTER (false) AS n_bridges")
TREE_SCORED = TREE_SCORED.replace("sum(CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END) AS edges", "0 AS edges").replace("sum(CASE WHEN ord % 5 = 0 THEN 2 ELSE 0 END) AS unique_components", "0 AS unique_components")


@query(f"""WITH {TREE_SCORED}, n AS (SELECT ord % 5 AS analysis_id, count(*) FILTER (NOT {S.any_contains('lower(path)', V.IGNORED_PATTERNS)}) AS n_nodes FROM files GROUP BY 1)
 SELECT analysis_id, n_files, n_functions, len(modules) AS n_modules, CAST(score AS BIGINT) AS score, level, n_nodes FROM levels JOIN n USING (analysis_id)""")
def q_analysis_scores(spark, d):
    """From two versions of five repositories to their scores: diff, parse, graph, blast radius, symbols, evidence, score."""
    old, new = A.code_versions(spark, d)
    changed, ranges = analysis.changed_files(old, new)
    a = analysis.analyse(new.drop("analysis_id"), changed, None, ranges, new.select("repo_id", "path", F.concat(F.lit("owner_"), "repo_id").alias("owner")))
    sized = a.inputs.select("repo_id", "analysis_id", big(F.size("files"), "n_files"), big(F.size("affected_functions"), "n_functions"), big(F.size("impacted_modules"), "n_modules"))
    nodes = a.nodes.where("kind = 'file'").groupBy("repo_id").agg(F.count("*").alias("n_nodes"))
    return sized.join(a.scores.select("analysis_id", big("score"), "level"), "analysis_id").join(nodes, "repo_id").drop("repo_id")


# --- graphs ------------------------------------------------------------------------------------------------------------
def tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, seeds) of the property graph over parts."""
    files, k = A.files(spark, d), F.col("ord")
    nodes = files.select(F.concat(F.lit("n:"), k).alias("id"), F.concat(F.lit("label_"), k).alias("label"), A.pick(S.KINDS, (k * 7 + 3) % len(S.KINDS)).alias("kind"), "path", F.get(F.split("path", "/"), F.lit(0)).alias("module"), k)
    s, t = F.col("src"), F.col("dst")
    edges = A.imports(spark, d).select(F.concat(F.lit("n:"), s).alias("source"), F.concat(F.lit("n:"), t).alias("target"), A.pick(S.RELATIONS, (s + t) % len(S.RELATIONS)).alias("relationship"), A.pick(S.TYPES, (s * 3 + t) % len(S.TYPES)).alias("edge_type"), (s * 100000 + t).alias("ord"))
    return nodes, edges, A.last_change(spark, d).select(F.lit("all").alias("key"), F.concat(F.lit("n:"), "ord").alias("node"), "ord")


def reach_sql(edge_filter: str, depth: int | None, blocked: str = "false", tail: str = "SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM reach WHERE NOT blocked GROUP BY node") -> str:
    stop = "" if depth is None else f" AND r.depth < {depth}"
    step = "r.depth + 1" if depth is not None else "1"
    return f"""WITH RECURSIVE {S.GRAPH}, e AS (SELECT * FROM edges WHERE {edge_filter}), b AS (SELECT id, coalesce({blocked}, false) AS blocked FROM nodes),
 reach(node, depth, blocked) AS (SELECT node, 0, blocked FROM seeds JOIN b ON id = node UNION SELECT e.source, {step}, b.blocked FROM reach r JOIN e ON e.target = r.node JOIN b ON b.id = e.source WHERE NOT r.blocked{stop})
 {tail}"""


IMPACT = f"relationship IN {S.inside(traverse.IMPACT_RELATIONS)} AND edge_type NOT IN ('CONFIG_REFERENCE', 'BUILD_DEPENDENCY')"
REACH = f"edge_type NOT IN {S.inside(traverse.REACH_EXCLUDED_TYPES)} AND (relationship IN {S.inside(traverse.REACH_RELATIONS)} OR edge_type IN {S.inside(traverse.REACH_RELATIONS)})"
VIEW = "edge_type NOT IN ('CONFIG_REFERENCE', 'BUILD_DEPENDENCY', 'PACKAGE_DEPENDENCY')"


def _blast(name):
    def run(spark, d):
        nodes, edges, seeds = tables(spark, d)
        return traverse.blast(name, nodes, edges, seeds).select("node", big("depth"))

    return run


for _name, _preset, _sql in [
    ("blast_b1", "impact", reach_sql(IMPACT, 3, f"kind IN {S.inside(traverse.CONTAINER_KINDS)}")), ("blast_b2", "fallback", reach_sql(REACH, 4, S.any_contains("path", traverse.IGNORED_DIRS))),
    ("blast_b3", "all", reach_sql("true", 5)), ("blast_b4", "export", reach_sql(REACH, 3, S.any_contains("path", traverse.EXPORT_IGNORED_DIRS))), ("blast_b5", "view", reach_sql(VIEW, 3)),
    ("blast_unbounded", "folder", reach_sql("true", None, tail="SELECT DISTINCT node FROM reach")),
]:
    QUERIES[_name], ORACLES[_name] = _blast(_preset), _sql
QUERIES["blast_unbounded"] = lambda spark, d: _blast("folder")(spark, d).select("node")


@query(f"""WITH RECURSIVE {S.GRAPH}, e AS (SELECT * FROM edges WHERE {IMPACT}), reach(root, node, depth) AS (SELECT node, node, 0 FROM seeds UNION SELECT r.root, e.source, r.depth + 1 FROM reach r JOIN e ON e.target = r.node WHERE r.depth < 3),
 m AS (SELECT root, node, min(depth) AS depth FROM reach GROUP BY ALL)
 SELECT root AS key, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, count(*) FILTER (depth >= 1) AS total, CAST(max(depth) AS BIGINT) AS deepest FROM m GROUP BY root""")
def q_blast_counts(spark, d):
    nodes, edges, seeds = tables(spark, d)
    return traverse.blast_counts(traverse.blast("reach_count", nodes, edges, seeds.withColumn("key", F.col("node")))).select("key", "direct", "transitive", "total", big("deepest"))


@query(reach_sql(REACH, 4, S.any_contains("path", traverse.IGNORED_DIRS), """, m AS (SELECT DISTINCT n.* FROM reach r JOIN nodes n ON n.id = r.node WHERE NOT r.blocked)
 SELECT coalesce(string_agg(DISTINCT label, '|' ORDER BY label) FILTER (kind = 'api'), '') AS apis, coalesce(string_agg(DISTINCT label, '|' ORDER BY label) FILTER (kind = 'database'), '') AS db_models,
 coalesce(string_agg(DISTINCT path, '|' ORDER BY path) FILTER (kind IN ('file', 'module') AND (contains(lower(path), 'test') OR contains(lower(path), 'spec'))), '') AS tests FROM m"""))
def q_blast_apis_tests(spark, d):
    nodes, edges, seeds = tables(spark, d)
    return traverse.affected(traverse.blast("fallback", nodes, edges, seeds), nodes).select(join_list("apis"), join_list("db_models"), join_list("tests"))


@query(f"""WITH RECURSIVE {S.GRAPH}, folders AS (SELECT * FROM (VALUES ('src'), ('app/api'), ('docs')) AS f(folder)), walk(folder, node) AS (SELECT folder, id FROM folders JOIN nodes ON starts_with(path, folder || '/') UNION SELECT w.folder, e.source FROM walk w JOIN edges e ON e.target = w.node), m AS (SELECT folder, id FROM folders JOIN nodes ON starts_with(path, folder || '/')),
 x AS (SELECT s.folder AS sf, t.folder AS tf, e.source, e.target FROM edges e LEFT JOIN m s ON s.id = e.source LEFT JOIN m t ON t.id = e.target),
 o AS (SELECT f.folder, e.source, e.target, EXISTS (SELECT 1 FROM m WHERE m.folder = f.folder AND m.id = e.source) AS s_in, EXISTS (SELECT 1 FROM m WHERE m.folder = f.folder AND m.id = e.target) AS t_in FROM folders f, edges e)
 SELECT folder, (SELECT count(*) FROM m WHERE m.folder = o.folder) AS n_files, count(DISTINCT source) FILTER (t_in AND NOT s_in) AS external_importers, count(DISTINCT target) FILTER (s_in AND NOT t_in) AS external_targets,
 count(*) FILTER (s_in AND t_in) AS internal_edges, count(*) FILTER (s_in <> t_in) AS external_edges,
 (SELECT count(*) FROM walk w WHERE w.folder = o.folder) - (SELECT count(*) FROM m WHERE m.folder = o.folder) AS reach FROM o GROUP BY folder""")
def q_folder_metrics(spark, d):
    nodes, edges, _ = tables(spark, d)
    folders = spark.createDataFrame([("src",), ("app/api",), ("docs",)], "folder string")
    return traverse.folder_metrics(nodes.select("id", "path"), edges, folders)


@query(f"""WITH RECURSIVE {S.GRAPH}, e AS (SELECT * FROM edges WHERE relationship = 'CALLS'), roots AS (SELECT id FROM nodes ORDER BY ord LIMIT 20),
 reach(root, node, depth) AS (SELECT id, id, 0 FROM roots UNION SELECT r.root, e.source, r.depth + 1 FROM reach r JOIN e ON e.target = r.node WHERE r.depth < 4)
 SELECT root, count(DISTINCT node) AS n FROM reach GROUP BY root HAVING count(DISTINCT node) > 1""")
def q_flow_trace(spark, d):
    nodes, edges, _ = tables(spark, d)
    return traverse.call_flows(nodes, edges, nodes.select("id", "ord")).select("root", "n")


@query(f"WITH {S.GRAPH} SELECT id, label FROM nodes WHERE kind IN ('function', 'class') AND ord % 3 = 0")
def q_function_ids(spark, d):
    nodes, _, _ = tables(spark, d)
    return traverse.function_ids(nodes, nodes.where("ord % 3 = 0").select("label")).select("id", "label")


@query(f"WITH {S.GRAPH}, x AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) SELECT n.id, count(x.id) AS degree FROM nodes n LEFT JOIN x USING (id) GROUP BY n.id")
def q_degree(spark, d):
    nodes, edges, _ = tables(spark, d)
    return centrality.degrees(nodes, edges).select("id", "degree")


@query(f"WITH {S.GRAPH}, x AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) SELECT n.id, count(*) AS degree FROM nodes n JOIN x USING (id) WHERE kind NOT IN {S.inside(centrality.HUB_EXCLUDED)} GROUP BY n.id, n.ord ORDER BY degree DESC, n.ord LIMIT 10")
def q_hub_nodes(spark, d):
    nodes, edges, _ = tables(spark, d)
    return centrality.hubs(nodes, edges).select("id", "degree")


#: Trade between nations above the average of all pairs: a directed graph over whole tables.
NATIONS = """trade AS (SELECT s_nationkey AS s, c_nationkey AS t, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 WHERE s_nationkey <> c_nationkey GROUP BY ALL), e AS (SELECT s, t FROM trade WHERE q > (SELECT avg(q) FROM trade))"""


def nations(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the trade graph."""
    t = lambda n: A.table(spark, d, n)
    l = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    q = l.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    q = q.withColumn("mean", F.avg("q").over(Window.partitionBy(F.lit(0)))).where("q > mean")  # at most 600 pairs
    edges = q.select(F.col("s_nationkey").cast("string").alias("source"), F.col("c_nationkey").cast("string").alias("target"))
    return t("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"), F.lit("class").alias("kind"), F.col("n_nationkey").cast("bigint").alias("ord")), edges


BETWEENNESS = f"""WITH RECURSIVE {NATIONS}, walk(s, t, d) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT w.s, e.t, w.d + 1 FROM walk w JOIN e ON e.s = w.t WHERE w.d < 24),
 dist AS (SELECT s, t, min(d) AS d FROM walk GROUP BY ALL), paths(s, t, d, n) AS (SELECT s, t, 0, CAST(1 AS DOUBLE) FROM dist WHERE s = t UNION ALL SELECT * FROM
  (SELECT p.s, e.t, p.d + 1 AS d, sum(p.n) AS n FROM paths p JOIN e ON e.s = p.t JOIN dist q ON q.s = p.s AND q.t = e.t AND q.d = p.d + 1 GROUP BY p.s, e.t, p.d + 1)),
 b AS (SELECT v.t AS v, sum(v.n * w.n / st.n) AS score FROM paths v JOIN paths w ON w.s = v.t JOIN paths st ON st.s = v.s AND st.t = w.t AND st.d = v.d + w.d WHERE v.s <> v.t AND w.s <> w.t AND v.s <> w.t GROUP BY v.t)"""


@query(BETWEENNESS + """ SELECT CAST(n_nationkey AS VARCHAR) AS id, round_even(coalesce(score, 0) / (24 * 23), 6) AS betweenness FROM nation LEFT JOIN b ON v = n_nationkey""")
def q_betweenness(spark, d):
    nodes, edges = nations(spark, d)
    return centrality.betweenness(nodes.select("id"), edges).select("id", F.bround("score", 6).alias("betweenness"))


@query(BETWEENNESS + """ SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS label, round_even(score / (24 * 23), 6) AS betweenness FROM nation JOIN b ON v = n_nationkey WHERE score > 0 ORDER BY betweenness DESC, n_nationkey LIMIT 10""")
def q_bridge_nodes(spark, d):
    return centrality.bridges(*nations(spark, d)).select("id", "label", "betweenness")


@query(f"""WITH RECURSIVE {NATIONS}, walk(s, t) AS (SELECT s, t FROM e UNION SELECT w.s, e.t FROM walk w JOIN e ON e.s = w.t)
 SELECT CAST(a.s AS VARCHAR) AS node, min(CAST(a.t AS VARCHAR)) AS component FROM walk a JOIN walk b ON a.s = b.t AND a.t = b.s GROUP BY a.s""")
def q_cycles_scc(spark, d):
    return health.strongly_connected(nations(spark, d)[1])


@query()
def q_import_cycles(spark, d):
    nodes, edges, _ = tables(spark, d)
    return health.cycles(edges, nodes.select(F.col("id").alias("node"), "ord")).select(join_list("cycle"))


@query(f"WITH {S.GRAPH} SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type")
def q_edge_type_counts(spark, d):
    return graph.edge_type_counts(tables(spark, d)[1])


@query(f"""WITH {S.GRAPH}, e AS (SELECT '"\\u00e9' || source || '->' || target || '"' AS id FROM edges), n AS (SELECT '"\\u00e9' || id || '"' AS id FROM nodes)
 SELECT sha256('{{"edges": [' || (SELECT string_agg(id, ', ' ORDER BY id) FROM e) || '], "nodes": [' || (SELECT string_agg(id, ', ' ORDER BY id) FROM n) || ']}}') AS graph_hash""")
def q_graph_hash(spark, d):
    nodes, edges, _ = tables(spark, d)
    own = lambda df, name: df.select(F.lit("r").alias("repo_id"), F.concat(F.lit("é"), name).alias("id"))
    return graph.graph_hash(own(nodes, F.col("id")), own(edges, F.concat("source", F.lit("->"), "target"))).select("graph_hash")


@query(f"WITH {S.FILES}, {S.CHANGED} SELECT DISTINCT analysis_id, 'module:' || split_part(path, '/', 1) AS source, 'file:' || path AS target, 'owns' AS relationship FROM changed")
def q_change_set_graph(spark, d):
    return graph.change_set_graph(A.changed(spark, d))[1].select("analysis_id", "source", "target", "relationship")


def parsed(spark, d) -> DataFrame:
    """Parsed files over parts: imports by path, module name or symbol; classes and functions by key."""
    f = A.files(spark, d)
    i = A.imports(spark, d).join(f.select(F.col("ord").alias("dst"), F.col("path").alias("t")), "dst")
    src = F.when(F.col("dst") % 3 == 0, F.concat(F.lit("./"), F.element_at(F.split("t", "/"), -1))).when(F.col("dst") % 3 == 1, F.regexp_replace("t", r"\.[a-z]+$", "")).otherwise(F.concat(F.lit("missing."), F.col("dst")))
    item = F.struct(src.alias("source_module"), F.lit("x").alias("imported_name"), F.lit(None).cast("string").alias("alias"), F.lit(False).alias("is_relative"), F.lit("SOURCE_IMPORT").alias("import_type"), F.col("dst").cast("int").alias("line_number"))
    lists = i.groupBy(F.col("src").alias("ord")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("o"), item.alias("i")))).alias("x")).select("ord", F.transform("x", lambda s: s["i"]).alias("imports"))
    k, none = F.col("ord"), F.array().cast("array<string>")
    cls = F.array(F.struct(F.concat(F.lit("C"), k % 50).alias("name"), F.when(k % 4 == 0, F.array(F.concat(F.lit("C"), (k + 1) % 50))).when(k % 4 == 1, F.array(F.lit("BaseModel"))).otherwise(none).alias("base_classes"), none.alias("methods"), (k % 9 == 0).alias("is_db_model")))
    fn = F.array(F.struct(F.concat(F.lit("f"), k % 70).alias("name"), F.transform(F.sequence(F.lit(1), (k % 7 + 1).cast("int")), lambda n: F.concat(F.lit("f"), (k + n) % 90)).alias("calls")))
    return f.join(lists, "ord", "left").select(
        F.lit("r").alias("repo_id"), "ord", F.col("path").alias("file_path"), F.lit("x").alias("language"), F.lit(None).cast("string").alias("package_name"), F.coalesce("imports", F.array().cast(parsers.NO_IMPORTS)).alias("imports"), none.alias("defined_classes"),
        cls.alias("class_symbols"), fn.alias("function_symbols"), F.when(k % 10 == 0, F.array(F.concat(F.lit("/api/"), k % 40))).otherwise(none).alias("api_routes"), F.when(k % 15 == 0, F.array(F.lit("lodash"), F.concat(F.lit("pkg"), k % 5))).otherwise(none).alias("package_deps"), none.alias("framework_signals"),
    )


IMPORT_ROWS = f"""{S.FILES}, {S.IMPORTS}, f AS (SELECT ord, path FROM files WHERE NOT {S.any_contains('lower(path)', V.IGNORED_PATTERNS)}),
 i AS (SELECT a.ord AS src, a.path AS file_path, dst, CASE dst % 3 WHEN 0 THEN regexp_replace(a.path, '[^/]*$', '') || regexp_extract(b.path, '([^/]*)$', 1) WHEN 1 THEN regexp_replace(b.path, '\\.[a-z]+$', '') END AS base FROM imports JOIN f a ON a.ord = src JOIN files b ON b.ord = dst)"""


ENDINGS = " ".join(f"WHEN f.path = b.base || {S.text(e)} THEN {k}" for k, e in enumerate(graph.CANDIDATE_ENDINGS))


@query(f"""WITH {IMPORT_ROWS}, b AS (SELECT DISTINCT base, dst % 3 AS form FROM i WHERE base IS NOT NULL),
 exact AS (SELECT form, base, arg_min(path, rank) AS path FROM (SELECT b.form, b.base, f.path, CASE {ENDINGS} END AS rank FROM b JOIN f ON starts_with(f.path, b.base)) WHERE rank IS NOT NULL GROUP BY 1, 2),
 part AS (SELECT b.base, min(f.path) AS path FROM b JOIN f ON contains(f.path, replace(b.base, '.', '/')) WHERE form = 1 GROUP BY 1)
 SELECT src AS ord, i.dst, CASE WHEN i.dst % 6 = 1 THEN '~' ELSE '' END AS alias, coalesce(e.path, p.path) AS target_path
 FROM i LEFT JOIN exact e ON e.base = i.base AND e.form = i.dst % 3 LEFT JOIN part p ON p.base = i.base AND i.dst % 3 = 1""")
def q_import_resolution(spark, d):
    f = parsed(spark, d).where(~P.is_generated_or_vendor(F.col("file_path")))
    aliased = F.when(F.col("dst") % 6 == 1, "~").otherwise("")
    rows = f.select("repo_id", "ord", "file_path", F.posexplode("imports").alias("k", "i")).select("repo_id", "ord", "file_path", "k", "i.source_module", F.col("i.line_number").alias("dst"))
    rows = rows.withColumn("alias", aliased).withColumn("source_module", F.concat("alias", "source_module"))
    aliases = spark.createDataFrame([("r", 1, "~missing", "gone"), ("r", 2, "~", ""), ("r", 3, "~src", "never")], "repo_id string, ord int, prefix string, replacement string")
    return graph.resolve_imports(rows, f, aliases).select("ord", F.col("dst").cast("bigint").alias("dst"), "alias", "target_path")


@query(f"""WITH {S.FILES}, f AS (SELECT * FROM files WHERE NOT {S.any_contains('lower(path)', V.IGNORED_PATTERNS)}),
 calls AS (SELECT f.ord, (f.ord + n) % 90 AS c FROM f, range(1, 6) AS r(n) WHERE n <= f.ord % 7 + 1), bases AS (SELECT CASE ord % 4 WHEN 0 THEN 'C' || ((ord + 1) % 50) ELSE 'BaseModel' END AS b FROM f WHERE ord % 4 < 2)
 SELECT * FROM (SELECT 'module' AS kind, count(DISTINCT split_part(path, '/', 1)) AS n FROM f UNION ALL SELECT 'folder', count(DISTINCT regexp_replace(path, '/[^/]*$', '')) FROM f UNION ALL SELECT 'file', count(*) FROM f
  UNION ALL SELECT 'database', count(*) FROM f WHERE ord % 9 = 0 OR ord % 4 = 1 UNION ALL SELECT 'class', count(*) FILTER (NOT (ord % 9 = 0 OR ord % 4 = 1)) + (SELECT count(DISTINCT b) FROM bases WHERE b NOT IN (SELECT 'C' || (ord % 50) FROM f)) FROM f
  UNION ALL SELECT 'function', count(*) + (SELECT count(DISTINCT c) FROM calls WHERE c NOT IN (SELECT ord % 70 FROM f)) FROM f UNION ALL SELECT 'api', count(DISTINCT ord % 40) FROM f WHERE ord % 10 = 0
  UNION ALL SELECT 'package', 1 + count(DISTINCT ord % 5) FROM f WHERE ord % 15 = 0 UNION ALL SELECT 'repository', 1)""")
def q_graph_nodes(spark, d):
    return graph.graph_nodes(parsed(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {S.FILES}, f AS (SELECT * FROM files WHERE NOT {S.any_contains('lower(path)', V.IGNORED_PATTERNS)})
 SELECT * FROM (SELECT 'DEPENDS_ON' AS relationship, 2 * count(*) AS n FROM f UNION ALL SELECT 'DEFINES_MODEL', count(*) FROM f WHERE ord % 9 = 0 OR ord % 4 = 1 UNION ALL SELECT 'EXPORTS', count(*) + count(*) FILTER (NOT (ord % 9 = 0 OR ord % 4 = 1)) FROM f
 UNION ALL SELECT 'INHERITS', count(*) FROM f WHERE ord % 4 < 2 UNION ALL SELECT 'CALLS', sum(least(ord % 7 + 1, 5)) FROM f UNION ALL SELECT 'DEFINES_ROUTE', count(*) FROM f WHERE ord % 10 = 0)""")
def q_graph_edges(spark, d):
    return graph.graph_edges(parsed(spark, d)).where("relationship <> 'IMPORTS'").groupBy("relationship").agg(F.count("*").alias("n"))


def _direct_edges(spark, d):
    f = A.files(spark, d)
    return A.imports(spark, d).join(f.select(F.col("ord").alias("src"), F.col("path").alias("file_path")), "src").join(f.select(F.col("ord").alias("dst"), F.col("path").alias("target_path")), "dst").select(F.lit("r").alias("repo_id"), "file_path", "target_path", F.when(F.col("src") == F.col("dst"), "SELF_IMPORT").otherwise("SOURCE_IMPORT").alias("edge_type"), F.col("src").alias("ord"))


@query(f"WITH {S.FILES}, {S.IMPORTS}, e AS (SELECT * FROM imports WHERE src <> dst) SELECT path AS file_path, (SELECT count(*) FROM e WHERE dst = ord) AS fan_in, (SELECT count(*) FROM e WHERE src = ord) AS fan_out FROM files")
def q_fan_in_out(spark, d):
    f = A.files(spark, d).select(F.lit("r").alias("repo_id"), "ord", F.col("path").alias("file_path"))
    return graph.fan(f, _direct_edges(spark, d)).select("file_path", "fan_in", "fan_out")


_LIKE = lambda roots: "(" + " OR ".join(f"starts_with(module, {S.text(r)})" for r in roots) + ")"


@query(f"""WITH {IMPORT_ROWS}, b AS (SELECT DISTINCT base, dst % 3 AS form FROM i WHERE base IS NOT NULL),
 exact AS (SELECT form, base, arg_min(path, rank) AS path FROM (SELECT b.form, b.base, f.path, CASE {ENDINGS} END AS rank FROM b JOIN f ON starts_with(f.path, b.base)) WHERE rank IS NOT NULL GROUP BY 1, 2),
 part AS (SELECT b.base, min(f.path) AS path FROM b JOIN f ON contains(f.path, replace(b.base, '.', '/')) WHERE form = 1 GROUP BY 1),
 r AS (SELECT src, i.file_path, CASE i.dst % 3 WHEN 0 THEN './' || regexp_extract(t.path, '([^/]*)$', 1) WHEN 1 THEN i.base ELSE 'missing.' || i.dst END AS module, coalesce(e.path, p.path) AS target
  FROM i JOIN files t ON t.ord = i.dst LEFT JOIN exact e ON e.base = i.base AND e.form = i.dst % 3 LEFT JOIN part p ON p.base = i.base AND i.dst % 3 = 1),
 k AS (SELECT *, starts_with(module, '.') OR {_LIKE(V.INTERNAL_ROOTS)} AS internal, {_LIKE(V.EXTERNAL_ROOTS)} AS external FROM r),
 c AS (SELECT count(*) FILTER (internal) AS attempted, count(*) FILTER (internal AND target IS NOT NULL) AS resolved, count(*) FILTER (target IS NULL AND (internal OR NOT external)) AS unresolved,
  count(DISTINCT file_path) FILTER (target = file_path) AS self_edges, count(*) FILTER (target IS NOT NULL) - count(DISTINCT file_path || ' ' || target) AS duplicate_edges FROM k),
 q AS (SELECT *, round_even(resolved / attempted, 4) AS resolution_rate FROM c),
 s AS (SELECT *, CASE WHEN resolution_rate >= 0.95 AND unresolved = 0 THEN 'HEALTHY' WHEN resolution_rate >= 0.7 THEN 'DEGRADED' ELSE 'POOR' END AS status FROM q)
 SELECT 'r' AS repo_id, attempted, resolved, unresolved, self_edges, duplicate_edges, resolution_rate, status, array_to_string(list_filter([
  CASE WHEN self_edges > 0 THEN 'Detected ' || self_edges || ' self-import statement(s).' END,
  CASE WHEN status <> 'HEALTHY' THEN 'Graph quality is ' || status || ' (' || round_even(resolution_rate * 100, 1) || '% resolution rate, ' || unresolved || ' unresolved imports). Blast-radius confidence may be reduced.' END], lambda w: w IS NOT NULL), '|') AS warnings FROM s""")
def q_import_counters(spark, d):
    f = parsed(spark, d).where(~P.is_generated_or_vendor(F.col("file_path")))
    c = graph.import_counters(graph.resolve_imports(graph.import_rows(f), f), f)
    return c.withColumn("warnings", join_list(graph.health_warnings(F.col("self_edges"), F.lit(0), F.col("status"), F.col("resolution_rate"), F.col("unresolved")), "warnings"))


@query(f"WITH {S.GRAPH} SELECT module, count(*) AS n_nodes, arg_min(kind, ord) AS kind FROM nodes GROUP BY module")
def q_discovered_modules(spark, d):
    return graph.discovered_modules(tables(spark, d)[0].withColumn("fan_out", F.lit(0))).select("module", "n_nodes", "kind")


@query(f"WITH {S.GRAPH} SELECT DISTINCT source, target, edge_type FROM edges WHERE source <> target")
def q_resolve_ends(spark, d):
    nodes, edges, _ = tables(spark, d)
    mixed = edges.withColumn("target", F.when(F.col("ord") % 2 == 0, F.regexp_replace("target", "^n:", "label_")).otherwise(F.col("target")))
    return views.resolve_ends(nodes, mixed).select("source", "target", "edge_type")


@query(f"WITH {S.GRAPH} SELECT id, kind FROM nodes WHERE (module = 'src' OR starts_with(path, 'src/')) AND kind = 'file' AND (contains(lower(label), '1') OR contains(lower(path), '1'))")
def q_visible_nodes(spark, d):
    return views.visible_nodes(tables(spark, d)[0], "src", "file", "1").select("id", "kind")


# --- health and gate ---------------------------------------------------------------------------------------------------
HEALTH = f"""{PATHS}, {S.IMPORTS}, e AS (SELECT * FROM imports WHERE src <> dst), r AS (SELECT ord, path, name, {S.ROLE_CASE} AS role, (SELECT count(*) FROM e WHERE dst = ord) AS fan_in, (SELECT count(*) FROM e WHERE src = ord) AS fan_out FROM p WHERE ord >= 0),
 o AS (SELECT *, CASE WHEN role = 'SOURCE_MODULE' AND fan_in = 0 THEN 'ORPHAN_CANDIDATE' ELSE role END AS role_after FROM r)"""


def _roles(spark, d):
    f = A.files(spark, d)
    fan = graph.fan(f.select(F.lit("r").alias("repo_id"), "ord", F.col("path").alias("file_path")), _direct_edges(spark, d)).select("ord", "fan_in", "fan_out")
    return health.orphans(f.withColumn("role", P.file_role(F.col("path"))).join(fan, "ord"))


@query(f"WITH {HEALTH} SELECT CAST(ord AS BIGINT) AS ord, role, role_after FROM o")
def q_orphans(spark, d):
    return _roles(spark, d).select("ord", "role", "role_after")


@query(f"WITH {HEALTH}, s AS (SELECT ord, path, split_part(name, '.', 1) AS stem FROM o WHERE role_after IN ('SOURCE_MODULE', 'ROUTE') ORDER BY ord LIMIT 25) SELECT CAST(ord AS BIGINT) AS ord, path FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE role_after = 'TEST' AND contains(lower(o.path), s.stem))")
def q_test_gaps(spark, d):
    return health.test_gaps(_roles(spark, d)).select("ord", "path")


@query(f"WITH {HEALTH} SELECT * FROM (SELECT 'in' AS side, path, fan_in AS n FROM (SELECT * FROM o ORDER BY fan_in DESC, ord LIMIT 10) WHERE fan_in > 0 UNION ALL SELECT 'out', path, fan_out FROM (SELECT * FROM o ORDER BY fan_out DESC, ord LIMIT 10) WHERE fan_out > 0)")
def q_top_fan(spark, d):
    r = _roles(spark, d)
    side = lambda c, n: health.top_fan(r, c).select(F.lit(n).alias("side"), "path", F.col(c).alias("n"))
    return side("fan_in", "in").unionByName(side("fan_out", "out"))


@query("SELECT 'p/' || p_partkey AS path, 'C' || p_size AS name, CAST(p_size % 12 AS BIGINT) AS n_methods FROM part WHERE p_size % 12 >= 8")
def q_god_classes(spark, d):
    m = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda k: k < F.col("p_size") % 12)
    c = A.table(spark, d, "part").select(F.concat(F.lit("p/"), "p_partkey").alias("path"), F.concat(F.lit("C"), "p_size").alias("name"), F.transform(m, lambda k: k.cast("string")).alias("methods"))
    return health.god_classes(c).select("path", "name", big("n_methods"))


COUNTS = "c AS (SELECT p_partkey AS k, p_size % 5 AS cycles, p_size % 3 AS god_classes, p_size % 9 AS fan_out_files, p_partkey % 20 AS gaps, p_partkey % 31 AS orphans, p_size % 2 AS violations, p_partkey % 4 AS sec_findings FROM part)"


def _counts(spark, d):
    p = A.table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(k.alias("k"), (s % 5).alias("cycles"), (s % 3).alias("god_classes"), (s % 9).alias("fan_out_files"), (k % 20).alias("gaps"), (k % 31).alias("orphans"), (s % 2).alias("violations"), (k % 4).alias("sec_findings"), F.when(k % 6 == 0, F.create_map(F.lit("Architecture"), F.lit(55), F.lit("Security"), F.lit(77))).otherwise(F.create_map().cast("map<string,int>")).alias("persisted"))


WEIGHTED = "CAST(round_even(a * 0.25 + d * 0.20 + t * 0.20 + s * 0.20 + m * 0.15, 0) AS BIGINT)"


@query(f"WITH {COUNTS}, x AS (SELECT k, greatest(100 - 8 * cycles - 4 * god_classes, 10) AS a, greatest(100 - 3 * fan_out_files, 10) AS d, greatest(100 - least(4 * gaps, 50), 10) AS t, 100 AS s, greatest(100 - least(2 * orphans, 40), 10) AS m FROM c) SELECT k, CAST(a AS BIGINT) AS architecture, CAST(d AS BIGINT) AS dependencies, CAST(t AS BIGINT) AS testing, CAST(m AS BIGINT) AS maintainability, {WEIGHTED} AS health_score FROM x")
def q_health_score(spark, d):
    return health.health(_counts(spark, d)).select("k", big("architecture"), big("dependencies"), big("testing"), big("maintainability"), big("health_score"))


@query(f"""WITH {COUNTS}, y AS (SELECT k, k % 6 = 0 AS p, sec_findings, greatest(100 - 8 * cycles - 10 * violations, 10) AS a0, greatest(100 - 4 * fan_out_files, 10) AS d, greatest(100 - least(3 * gaps, 50), 10) AS t,
 CASE WHEN sec_findings > 0 THEN greatest(100 - least(15 * sec_findings, 40) - 12 * violations, 20) ELSE greatest(100 - 12 * violations, 10) END AS s0, greatest(100 - least(2 * orphans, 40), 10) AS m FROM c),
 x AS (SELECT *, CASE WHEN p THEN 55 ELSE a0 END AS a, CASE WHEN p AND sec_findings = 0 THEN 77 ELSE s0 END AS s FROM y) SELECT k, CAST(a AS BIGINT) AS architecture, CAST(s AS BIGINT) AS security, {WEIGHTED} AS health_score FROM x""")
def q_export_health(spark, d):
    return health.export_health(_counts(spark, d)).select("k", big("architecture"), big("security"), big("health_score"))


@query("""WITH g AS (SELECT p_partkey AS analysis_id, p_partkey % 90 AS disc, p_partkey % 40 AS sup, CAST((p_partkey % 40) * (p_size % 11) / 10 AS INT) AS parsed, CASE WHEN p_size % 4 = 0 THEN 2 ELSE 0 END AS failed, p_partkey % 17 AS ast, p_size % 3 > 0 AS diff, p_size % 5 > 0 AS tests FROM part),
 a AS (SELECT *, CASE WHEN sup = 0 THEN CASE WHEN disc > 0 THEN 'N/A' ELSE 'FAIL' END WHEN parsed / CAST(sup AS DOUBLE) >= 0.8 AND failed = 0 THEN 'PASS' WHEN parsed / CAST(sup AS DOUBLE) >= 0.3 THEN 'PARTIAL' ELSE 'FAIL' END AS parser_health FROM g),
 b AS (SELECT *, CASE WHEN parser_health IN ('PASS', 'N/A') THEN 1.0 WHEN parser_health = 'PARTIAL' THEN 0.5 ELSE 0.0 END AS s_ast FROM a),
 c AS (SELECT *, CASE WHEN sup > 0 AND (ast <= 1 OR s_ast = 0) THEN 'FAILED' WHEN sup > 0 AND failed > 0 THEN 'DEGRADED' ELSE 'VALID' END AS graph_status FROM b),
 e AS (SELECT *, CAST(CASE graph_status WHEN 'FAILED' THEN 0.0 WHEN 'DEGRADED' THEN 0.6 ELSE 1.0 END AS DOUBLE) AS s FROM c),
 f AS (SELECT *, CAST(printf('%.2f', greatest(least(0.20e0 * CAST(diff AS INT) + 0.10e0 * CAST(disc > 0 AS INT) + 0.25e0 * CAST(s_ast AS DOUBLE) + 0.20e0 * s + 0.15e0 * s + 0.10e0 * CAST(tests AS INT), 0.98e0), 0.10e0)) AS DOUBLE) AS v FROM e)
 SELECT analysis_id, parser_health, graph_status, CAST(v AS DOUBLE) AS evidence_completeness, CASE WHEN v >= 0.90 AND graph_status = 'VALID' THEN 'FULL' WHEN v >= 0.45 THEN 'DEGRADED' ELSE 'FAILED' END AS analysis_quality FROM f""")
def q_quality_gate(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    i = A.table(spark, d, "part").select(k.alias("analysis_id"), (k % 90).alias("files_discovered"), (k % 40).alias("supported_source_files"), F.bround((k % 40) * (s % 11) / 10).cast("int").alias("files_parsed"), F.when(s % 4 == 0, 2).otherwise(0).alias("files_failed"), (k % 17).alias("ast_nodes"), F.lit(0).alias("dependency_edges"), (s % 3 > 0).alias("has_git_diff"), (s % 5 > 0).alias("has_test_analysis"))
    return health.quality_gate(i).select("analysis_id", "parser_health", "graph_status", "evidence_completeness", "analysis_quality")


@query(f"WITH {SCORED} SELECT analysis_id, CASE WHEN analysis_id % 3 <> 0 THEN score END AS score FROM levels")
def q_fail_closed(spark, d):
    s = risk.scores(*_scored(spark, d)).withColumn("health_status", F.when(F.col("analysis_id") % 3 == 0, "UNAVAILABLE").otherwise("AVAILABLE"))
    return risk.fail_closed(s, columns=("score",)).select("analysis_id", "score")


# --- policies ----------------------------------------------------------------------------------------------------------
def _policy(spark, d, shift):
    k = F.col("p_partkey")
    return A.table(spark, d, "part").where(k % 7 != shift).select(F.concat(F.lit("s"), k).alias("signal"), ((k % 10 + F.when(k % 4 == shift, 1).otherwise(0)) / 20.0).alias("weight"), (k % 5 != shift).alias("enabled"))


def _policy_sql(shift):
    return f"SELECT 's' || p_partkey AS signal, (p_partkey % 10 + CASE WHEN p_partkey % 4 = {shift} THEN 1 ELSE 0 END) / 20.0 AS weight, p_partkey % 5 <> {shift} AS enabled FROM part WHERE p_partkey % 7 <> {shift}"


@query(f"""WITH a AS ({_policy_sql(0)}), b AS ({_policy_sql(1)}), j AS (SELECT coalesce(a.signal, b.signal) AS signal, a.weight AS w1, b.weight AS w2, a.enabled AS e1, b.enabled AS e2 FROM a FULL JOIN b ON a.signal = b.signal)
 SELECT signal, 'added' AS change FROM j WHERE w1 IS NULL UNION ALL SELECT signal, 'removed' FROM j WHERE w2 IS NULL UNION ALL SELECT signal, 'weight_changed' FROM j WHERE abs(w1 - w2) > 0.001 UNION ALL SELECT signal, 'status_changed' FROM j WHERE e1 <> e2""")
def q_policy_compare(spark, d):
    return policy.compare(_policy(spark, d, 0), _policy(spark, d, 1)).select("signal", "change")


POLICIES = "p AS (SELECT c_custkey AS id, c_custkey % 97 = 5 AS is_active, CAST(c_acctbal AS DOUBLE) AS created_at FROM customer)"


@query(f"WITH {POLICIES} SELECT id FROM p ORDER BY is_active DESC, created_at DESC, id LIMIT 1")
def q_policy_active(spark, d):
    p = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97 == 5).alias("is_active"), F.col("c_acctbal").alias("created_at"))
    return policy.active(p).select("id")


@query("SELECT c_custkey AS id, c_custkey = 7 AS is_active FROM customer UNION ALL SELECT -1, false")
def q_policy_switch(spark, d):
    p = A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") == 3).alias("is_active"), F.lit("1").alias("version"))
    return policy.save(policy.set_active(p, "7"), policy.clone(p, "3", "-1", "2")).select(F.col("id").cast("bigint").alias("id"), "is_active")


RULE_VALUES = "(VALUES " + ", ".join(f"({S.text(r[0])}, {S.text(' '.join((r[1], r[0], r[3])).lower())}, {S.text(r[2])}, CAST({r[4]} AS DOUBLE))" for r in V.RULES) + ") AS r(signal, body, category, weight)"


def seeded(spark, d) -> DataFrame:
    """The rules of a policy for each supplier, some of them changed: by rule number and supplier a weight or a rule that is off."""
    policies = A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    rules = policy.seed(policies, risk.builtin_rules(spark))
    k = F.length("signal") + F.col("id").cast("int")
    changes = rules.where(k % 3 == 0).select("id", "signal", F.when(k % 2 == 0, F.lit(0.5)).alias("weight"), F.when(k % 2 == 1, F.lit(False)).alias("enabled"))
    return policy.update(rules, changes)


SEEDED = f"seeded AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, signal, body, category, CASE WHEN (length(signal) + s_suppkey) % 6 = 0 THEN 0.5 ELSE weight END AS weight, (length(signal) + s_suppkey) % 6 <> 3 AS enabled FROM supplier, {RULE_VALUES})"


@query(f"WITH {SEEDED} SELECT id, signal, weight, enabled FROM seeded")
def q_policy_seed(spark, d):
    return seeded(spark, d).select("id", "signal", "weight", "enabled")


@query(f"WITH {SEEDED} SELECT id, signal FROM seeded WHERE category = 'security' AND contains(body, 'permission')")
def q_policy_filter(spark, d):
    return policy.filter_rules(seeded(spark, d), "security", "Permission").select("id", "signal")


@query(f"WITH {SEEDED} SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(count(*) AS BIGINT) AS n_rules, CAST(count(*) FILTER (enabled) AS BIGINT) AS n_enabled FROM supplier JOIN seeded ON id = CAST(s_suppkey AS VARCHAR) GROUP BY 1")
def q_policy_list(spark, d):
    policies = A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_suppkey") == 1).alias("is_active"), F.col("s_suppkey").alias("created_at"))
    return policy.listed(policies, seeded(spark, d)).select("id", "n_rules", "n_enabled")


@query("SELECT p_partkey AS ord, replace(lower(p_name), ' ', '_') AS signal, array_to_string(string_split(p_name, ' '), '|') AS words FROM part")
def q_custom_rule_builder(spark, d):
    name = F.concat(F.lit(" "), "p_name", F.lit(" "))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), policy.rule_signal(name).alias("signal"), join_list(policy.csv_list(F.replace("p_name", F.lit(" "), F.lit(" , "))), "words"))


# --- export ------------------------------------------------------------------------------------------------------------
@query(f"""WITH {SCORED}, t AS (SELECT *, {S.TYPE_CASE} AS ft FROM c), g AS (SELECT analysis_id, bool_or(ft = 'TEST') AS any_test FROM t GROUP BY 1)
 SELECT t.analysis_id, CAST(t.ord AS BIGINT) AS ord, ft AS category, split_part(path, '/', 1) AS module, CASE WHEN ft = 'TEST' THEN 'TEST_FILE_CHANGED' WHEN any_test THEN 'TEST_EXISTS' ELSE 'NO_TEST_CHANGE' END AS test_change_status,
 (SELECT count(DISTINCT r.signal) FROM rule_ev r WHERE r.analysis_id = t.analysis_id AND list_contains(r.file_paths, t.path)) AS n_signals FROM t JOIN g USING (analysis_id)""")
def q_export_changed_files(spark, d):
    c = A.changed(spark, d)
    ev = risk.rule_evidence(risk.rule_hits(c, risk.builtin_rules(spark)))
    return export.changed_files(c, ev).select("analysis_id", "ord", "category", "module", "test_change_status", big(F.size("risk_signals"), "n_signals"))


@query(f"""WITH RECURSIVE {S.GRAPH}, e AS (SELECT * FROM edges WHERE {REACH}), b AS (SELECT id, {S.any_contains('path', traverse.EXPORT_IGNORED_DIRS)} AS blocked FROM nodes),
 start AS (SELECT path, CASE WHEN kind IN ('file', 'module') THEN id ELSE 'file:' || path END AS node FROM nodes WHERE id IN (SELECT node FROM seeds)),
 reach(node, depth, blocked) AS (SELECT node, 0, coalesce(blocked, false) FROM start LEFT JOIN b ON id = node UNION SELECT e.source, r.depth + 1, b.blocked FROM reach r JOIN e ON e.target = r.node JOIN b ON b.id = e.source WHERE NOT r.blocked AND r.depth < 3),
 m AS (SELECT n.path, min(r.depth) AS depth FROM reach r JOIN nodes n ON n.id = r.node WHERE NOT r.blocked AND r.depth > 0 AND r.node NOT IN (SELECT node FROM start) GROUP BY n.path)
 SELECT CAST(depth AS BIGINT) AS depth, path AS file_or_module, CASE WHEN depth = 1 THEN 'IMPORTS' ELSE 'DEPENDS_ON' END AS relationship FROM m WHERE path NOT IN (SELECT path FROM start) UNION ALL SELECT 0, path, 'MODIFIED' FROM start""")
def q_export_paths(spark, d):
    nodes, edges, seeds = tables(spark, d)
    changed = nodes.join(seeds.select(F.col("node").alias("id")), "id", "left_semi").select(F.lit("all").alias("key"), "path", "ord")
    return traverse.export_paths(nodes, edges, changed).select(big("depth"), "file_or_module", "relationship")


RANKED = "f AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY weight * score DESC, ord) AS rank, round_even(weight * score * 100, 2) AS rp FROM ev WHERE signal <> 'large_blast_radius' OR analysis_id % 2 = 0)"


def _factors(spark, d):
    ev, i = _scored(spark, d)
    return export.risk_factors(ev, i.select("analysis_id", F.when(F.col("analysis_id") % 2 == 0, 1).otherwise(0).alias("indirect")))


@query(f"WITH {SCORED}, {RANKED} SELECT analysis_id, 'RF-' || lpad(CAST(rank AS VARCHAR), 3, '0') AS id, signal, rp AS raw_points FROM f")
def q_export_risk_factors(spark, d):
    return _factors(spark, d).select("analysis_id", "id", "signal", "raw_points")


@query(f"WITH {SCORED}, {RANKED}, s AS (SELECT *, CAST(sum(CAST(rp AS DECIMAL(12, 4))) OVER (PARTITION BY analysis_id) AS DOUBLE) AS total FROM f) SELECT analysis_id, signal, round_even(rp * CASE WHEN total > 60 THEN (60 + (total - 60) * 0.5e0) / total ELSE 1.0e0 END, 2) AS normalized_points FROM s")
def q_scoring_trace(spark, d):
    return export.scoring_trace(_factors(spark, d)).select("analysis_id", "signal", "normalized_points")


CATEGORY_SQL = "CASE signal " + " ".join(f"WHEN {S.text(r[0])} THEN {S.text(r[2])}" for r in V.RULES) + " WHEN 'missing_tests' THEN 'testing' ELSE 'architecture' END"


@query(f"WITH {SCORED}, g AS (SELECT *, {CATEGORY_SQL} AS category FROM ev) SELECT analysis_id, signal, CAST(ord AS BIGINT) AS ord, CASE WHEN category = 'security' THEN 'security' ELSE 'architecture' END AS section, CASE WHEN score >= 1 THEN 'FACT' ELSE 'INFERENCE' END AS classification FROM g WHERE category <> 'testing'")
def q_findings_split(spark, d):
    return export.findings(_evidence(spark, d)).select("analysis_id", "signal", big("ord"), "section", "classification")


@query("SELECT p_partkey AS analysis_id, CAST((CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM part")
def q_consistency_errors(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    n = (k % 9).cast("int")
    claims = F.when(s % 2 == 0, F.array(F.struct(F.lit("INF-001").alias("id"), F.lit("Downstream component at risk").alias("claim")))).otherwise(F.array().cast("array<struct<id:string,claim:string>>"))
    m = A.table(spark, d, "part").select(k.alias("analysis_id"), n.alias("direct"), F.lit(0).alias("indirect"), F.when(s % 5 == 0, n + 1).otherwise(n).alias("total"), F.when(s % 3 == 0, n + 1).otherwise(n).alias("n_files"), F.lit(50).alias("score"), F.when(s % 7 == 0, 51).otherwise(50).alias("capped_score"), F.lit(1).alias("nodes"), F.lit(1).alias("edges"), claims.alias("claims"), F.lit(0).alias("reach_points"))
    return export.consistency_errors(m).select("analysis_id", big(F.size("errors"), "n_errors"))


@query(f"WITH {SCORED}, t AS (SELECT analysis_id, count(*) FILTER (file_type = 'TEST') AS n, count(*) FILTER (file_type IN {S.inside(V.RELEVANT_TYPES)}) AS r FROM typed GROUP BY 1) SELECT analysis_id, CASE WHEN n > 0 THEN 'TEST_MODIFIED' ELSE 'GAP_DETECTED' END AS status, CASE WHEN n > 0 THEN n ELSE least(r, 10) END AS n_files FROM t")
def q_test_findings(spark, d):
    return export.test_findings(A.inputs(spark, d)).select("analysis_id", "status", big(F.size("affected_files"), "n_files"))


@query(f"WITH {SCORED} SELECT analysis_id, 'score' AS metric, CAST(score AS VARCHAR) AS value FROM levels UNION ALL SELECT analysis_id, 'level', level FROM levels")
def q_export_repo_metrics(spark, d):
    return export.repository_metrics(risk.scores(*_scored(spark, d)), ["score", "level"]).select("analysis_id", "metric", "value")


@query(f"WITH {SCORED} SELECT analysis_id, 'This change modifies ' || n_files || ' file(s) across ' || len(modules) || ' module(s). Deterministic risk score: ' || score || '/100 (' || level || ').' AS head FROM levels")
def q_summary_text(spark, d):
    ev, i = _scored(spark, d)
    return export.summary(risk.scores(ev, i), i).select("analysis_id", F.regexp_replace("summary", r" Evidence completeness.*", "").alias("head"))


@query(f"WITH {SCORED}, s AS (SELECT analysis_id, CAST(sum(round_even(weight * score * 100, 0)) AS DOUBLE) AS raw FROM ev GROUP BY 1) SELECT analysis_id, raw AS raw_rule_score, round_even(CASE WHEN raw > 60 THEN 60 + (raw - 60) * 0.5e0 ELSE raw END, 2) AS normalized_score FROM s")
def q_rebuilt_points(spark, d):
    return reconstruct.points(_evidence(spark, d))


@query(f"""WITH {SCORED}, f AS (SELECT analysis_id, 'FACT' AS t, 0 AS part, 0 AS o FROM down UNION ALL SELECT analysis_id, 'FACT', 0, 1 FROM down WHERE len(modules) > 0 UNION ALL SELECT analysis_id, 'INFERENCE', 0, 2 FROM down WHERE len(modules) >= 3
 UNION ALL SELECT analysis_id, 'FACT', 1, ord FROM ev WHERE signal IN {S.inside(reconstruct.FACT_SIGNALS)} UNION ALL SELECT analysis_id, 'INFERENCE', 1, ord FROM ev WHERE signal IN ('missing_tests', 'critical_component_modified') OR (signal = 'large_blast_radius' AND analysis_id % 2 = 0)
 UNION ALL SELECT analysis_id, 'RECOMMENDATION', 1, ord FROM ev) SELECT analysis_id, t AS statement_type, count(*) AS n FROM f GROUP BY ALL""")
def q_rebuilt_statements(spark, d):
    ev, i = _scored(spark, d)
    edges = i.select("analysis_id", F.when(F.col("analysis_id") % 2 == 0, "elsewhere").otherwise(F.get("files", F.lit(0))).alias("target"), F.lit("IMPORTS").alias("relationship"), F.lit("SOURCE_IMPORT").alias("edge_type"))
    s = reconstruct.statements(ev, i, reconstruct.reaches_further(edges, A.changed(spark, d)))
    return s.groupBy("analysis_id", "statement_type").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT analysis_id, CAST(n_evidence AS BIGINT) AS n_factors, n_files FROM levels")
def q_canonical_model(spark, d):
    ev, i = _scored(spark, d)
    factors = export.risk_factors(ev, i.select("analysis_id", F.lit(1).alias("indirect")))
    m = export.canonical(risk.scores(ev, i), factors, risk.ledger(ev, i), export.changed_files(A.changed(spark, d), ev))
    return m.select("analysis_id", big(F.coalesce(F.size("risk_breakdown"), F.lit(0)), "n_factors"), big(F.size("changed_files"), "n_files"))


@query(f"WITH {S.GRAPH} SELECT source, target FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.ord % 2 = 0 AND b.ord % 2 = 0")
def q_edge_ends(spark, d):
    nodes, edges, _ = tables(spark, d)
    half = nodes.where("ord % 2 = 0").withColumn("repo_id", F.lit("r"))
    return traverse.match_ends(half, edges.withColumn("repo_id", F.lit("r"))).select("source", "target")


@query(f"WITH {SCORED} SELECT analysis_id, CASE WHEN analysis_id % 2 = 0 THEN 0.5 ELSE CAST({COMPLETE} AS DOUBLE) END AS confidence FROM levels")
def q_gated_scores(spark, d):
    s = risk.scores(*_scored(spark, d))
    gate = s.where("analysis_id % 2 = 0").select("analysis_id", F.lit(0.5).alias("evidence_completeness"), F.lit("DEGRADED").alias("analysis_quality"))
    return health.gated(s, gate).select("analysis_id", "confidence")


HUBS_HIT = f""", x AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges),
 h AS (SELECT n.id, n.ord, count(*) AS degree FROM nodes n JOIN x USING (id) WHERE kind NOT IN {S.inside(centrality.HUB_EXCLUDED)} GROUP BY n.id, n.ord ORDER BY degree DESC, n.ord LIMIT 10),
 m AS (SELECT id, row_number() OVER (ORDER BY degree DESC, ord) AS k FROM h WHERE id IN (SELECT node FROM reach WHERE NOT blocked))
 SELECT string_agg(id, '|' ORDER BY k) AS ids FROM m WHERE k <= 5 HAVING (SELECT count(*) FROM reach WHERE NOT blocked) > 0"""


@query(reach_sql(IMPACT, 3, f"kind IN {S.inside(traverse.CONTAINER_KINDS)}", HUBS_HIT))
def q_hubs_in_blast(spark, d):
    """The first five of the ten hubs, by degree, that lie in the blast radius of the newest change."""
    nodes, edges, seeds = tables(spark, d)
    hubs = centrality.ranked(centrality.hubs(nodes, edges), "degree")
    return traverse.in_blast(hubs, traverse.blast("impact", nodes, edges, seeds)).select(join_list("ids"))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment IS NULL")
def q_repositories_of_user(spark, d):
    r = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("user_id"))
    return store.repositories(r, "BUILDING").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderdate < TIMESTAMP '1999-01-01')")
def q_purge_ephemeral(spark, d):
    a = _snapshots(spark, d).withColumn("is_ephemeral", F.col("id") % 3 == 0)
    return store.purge_ephemeral(a, "1999-01-01 00:00:00").select("id")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 15 WHEN 2 THEN 40 WHEN 3 THEN 65 WHEN 4 THEN 85 ELSE 100 END AS progress FROM events")
def q_job_progress(spark, d):
    status = A.pick(["PENDING", "CLONING", "PARSING", "BUILDING_GRAPH", "SCORING", "COMPLETED"], F.col("event_id") % 6)
    return A.table(spark, d, "events").select("event_id", store.progress(status).alias("progress"))


# --- stores, lists, experiments ----------------------------------------------------------------------------------------
@query("SELECT c_custkey AS repository_id, arg_min(o_orderkey, o_orderkey) AS id FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1 GROUP BY 1")
def q_latest_graph(spark, d):
    return store.latest(_snapshots(spark, d), ["repository_id"]).select("repository_id", "id")


def _snapshots(spark, d):
    return A.table(spark, d, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("kind"))


@query("SELECT * FROM (SELECT o_custkey AS repository_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def q_analysis_history(spark, d):
    return store.history(_snapshots(spark, d), 5).select("repository_id", "id", big("rank"))


@query("SELECT o_orderkey AS id FROM orders WHERE contains(lower(o_orderpriority), 'high') OR contains(CAST(o_orderkey AS VARCHAR), 'high') ORDER BY o_orderkey LIMIT 6")
def q_history_search(spark, d):
    a = _snapshots(spark, d).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.col("kind").alias("trigger"), F.lit("x").alias("risk_level"), F.array(F.lit("m")).alias("modules"), F.array(F.lit("f")).alias("files"))
    return store.search_history(a, "HIGH", 6).select(F.col("ord").alias("id"))


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey % 50 = 1 DESC, c_nationkey, c_custkey) AS rank FROM customer WHERE c_acctbal > 0")
def q_provider_order(spark, d):
    p = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("enabled"), (F.col("c_custkey") % 50 == 1).alias("is_default"), F.col("c_nationkey").alias("priority"))
    return store.by_priority(p).select("id", big(F.row_number().over(Window.orderBy(F.desc("is_default"), "priority", "id")), "rank"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS kind FROM orders")
def q_upsert_analyses(spark, d):
    s = _snapshots(spark, d)
    return store.upsert(s, s.where("id % 3 = 0").withColumn("kind", F.lit("new")), ["id"]).select("id", "kind")


@query("WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) SELECT o_orderkey AS id, CASE WHEN k = 1 AND o_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS kind FROM l")
def q_snapshot_overwrite(spark, d):
    s = _snapshots(spark, d).withColumn("kind", F.lit("old"))
    new = s.where("repository_id % 2 = 0").groupBy("repository_id").agg(F.lit(-1).cast("bigint").alias("id"), F.max("created_at").alias("created_at"), F.lit("new").alias("kind"))
    return store.overwrite_latest(s, new).select("id", "kind")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 4 <> 0")
def q_cascade_delete(spark, d):
    repos = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return store.cascade_delete(repos, {"analyses": _snapshots(spark, d)}, repos.where("id % 4 = 0"))["analyses"].select("id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' || event_id END AS tags FROM events")
def q_partial_merge(spark, d):
    e = A.table(spark, d, "events").select("event_id")
    full = e.withColumn("tags", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    return store.merge_partial(full, e.withColumn("tags", F.array(F.concat(F.lit("b"), "event_id"))), ["event_id"], ["tags"]).select("event_id", join_list("tags"))


@query("SELECT o_custkey AS user_id, CAST(sum(length(o_orderpriority)) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def q_storage_use(spark, d):
    return store.storage_use(A.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("payload"))).select("user_id", "bytes")


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL)")
def q_hash_cache_misses(spark, d):
    docs = A.table(spark, d, "documents")
    cache = docs.where("doc_id % 5 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), F.lit("python").alias("language"))
    return store.cache_misses(docs.select("doc_id", F.col("text").cast("binary").alias("content")), cache).select("doc_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def q_event_tail(spark, d):
    return experiments.event_tail(A.table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "user_id")


AB_STEP = "WITH RECURSIVE u AS (SELECT DISTINCT user_id, user_id || 'header_layout' AS s FROM events), h(user_id, s, i, x) AS (SELECT user_id, s, 0, CAST(2166136261 AS BIGINT) FROM u UNION ALL SELECT user_id, s, i + 1, CAST(CAST(fmod(fmod(CAST(CASE WHEN xor(x, CAST(ascii(substr(s, i + 1, 1)) AS BIGINT)) >= 2147483648 THEN xor(x, CAST(ascii(substr(s, i + 1, 1)) AS BIGINT)) - 4294967296 ELSE xor(x, CAST(ascii(substr(s, i + 1, 1)) AS BIGINT)) END AS DOUBLE) * 16777619.0::DOUBLE, 4294967296.0::DOUBLE) + 4294967296.0::DOUBLE, 4294967296.0::DOUBLE) AS HUGEINT) AS BIGINT) FROM h WHERE i < length(s))"


@query(f"{AB_STEP} SELECT user_id, x % 100 AS bucket FROM h WHERE i = length(s)")
def q_ab_bucket(spark, d):
    u = A.table(spark, d, "events").select("user_id").distinct()
    return u.select("user_id", big(experiments.bucket(F.col("user_id").cast("string"), F.lit("header_layout")), "bucket"))


@query(f"{AB_STEP} SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'B' WHEN user_id % 5 = 0 THEN 'A' WHEN x % 100 < 40 THEN 'B' ELSE 'A' END AS variant FROM h WHERE i = length(s)")
def q_ab_assign(spark, d):
    u = A.table(spark, d, "events").select("user_id").distinct()
    k = F.col("user_id")
    return u.select("user_id", experiments.assign(k.cast("string"), F.lit("header_layout"), F.lit(40), F.when(k % 7 == 0, "B"), F.when(k % 5 == 0, "A")).alias("variant"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x=9,y=2' ELSE 'x=1,y=2' END AS merged FROM events")
def q_overlay_map(spark, d):
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("x"), F.lit("9"))).otherwise(F.create_map().cast("map<string,string>"))
    m = experiments.overlay(F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), over)
    return A.table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))


@query("SELECT event_id, event_type || '|' || CASE event_type WHEN 'view' THEN 'click' ELSE 'view' END AS recent FROM events")
def q_recent_list(spark, d):
    return A.table(spark, d, "events").select("event_id", join_list(experiments.recent(F.col("event_type"), F.array(F.lit("view"), F.lit("click"), F.lit("x")), 2), "recent"))


# --- sources -----------------------------------------------------------------------------------------------------------
@query("SELECT page_id, CAST(unnest(range(0, len(l))) AS BIGINT) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages)")
def q_html_links(spark, d):
    return readers.html_links(A.table(spark, d, "pages")).select("page_id", big("pos"), "href")


@query("SELECT p_partkey AS ord, 'lib' || p_size || '|react|jest' AS deps, 'build' AS scripts FROM part")
def q_package_deps(spark, d):
    text = F.concat(F.lit('{"name": "x", "dependencies": {"lib'), "p_size", F.lit('": "1", "react": "2"}, "devDependencies": {"jest": "3"}, "scripts": {"build": "b"}}'))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), join_list(readers.package_dependencies(text), "deps"), join_list(readers.package_scripts(text), "scripts"))


@query("SELECT p_partkey AS ord, 'app|core/m' || p_size || '|feature/x' AS modules FROM part")
def q_gradle_modules(spark, d):
    text = F.concat(F.lit("rootProject.name = 'r'\ninclude(\":app\")\ninclude ':core:m"), "p_size", F.lit("'\ninclude(\":feature:x\")\ninclude(\":app\")\n"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), join_list(readers.gradle_modules(text), "modules"))


@query("SELECT p_partkey AS ord, 'com.x' AS package_name, 'com.x.App' || p_size AS application_class, 'com.x.App' || p_size || '|com.x.Main|org.y.Sync' AS components FROM part")
def q_manifest_components(spark, d):
    text = F.concat(F.lit('<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.x"><uses-permission android:name="p.A"/><application android:name=".App'), "p_size", F.lit('"><activity android:name="Main" android:exported="true"/><service android:name="org.y.Sync"/></application></manifest>'))
    parts = A.table(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    m = readers.manifest(parts.select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")))
    return m.select(F.col("path").cast("bigint").alias("ord"), "package_name", "application_class", join_list(F.transform("components", lambda c: c["name"]), "components"))


@query(f"""WITH {S.FILES}, f AS (SELECT ord, path, regexp_extract(path, '[.]([a-z]+)$', 1) AS ext FROM files WHERE NOT {S.any_contains('lower(path)', V.IGNORED_PATTERNS)})
 SELECT path, CASE WHEN ext = 'py' THEN 'python' WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext = 'kt' THEN 'kotlin' WHEN ext = 'java' THEN 'java' ELSE 'text' END AS language,
  CASE WHEN ext IN ('kt', 'java') THEN 'com.x' END AS package_name, CAST(CASE ext WHEN 'py' THEN 1 WHEN 'kt' THEN 2 WHEN 'java' THEN 2 WHEN 'ts' THEN 1 WHEN 'tsx' THEN 1 ELSE 0 END AS BIGINT) AS n_imports,
  CASE WHEN ext IN ('py', 'ts', 'tsx', 'java') THEN 'K' || ord ELSE '' END AS defined_classes, CASE WHEN ext IN ('py', 'ts', 'tsx', 'java') THEN 'run' ELSE '' END AS defined_functions FROM f""")
def q_parsed_sources(spark, d):
    """Each file's facts: every language has an import, a class, a function and, in a comment, a class that is none."""
    k, path = F.col("ord").cast("string"), F.col("path")
    python = F.concat(F.lit("import a.b\nimport c.d as e\n# class No:\nclass K"), k, F.lit(":\n    def run(self):\n        pass\n"))
    script = F.concat(F.lit("import { x } from './x'\n// import y from './y'\n/* class No { } */\nexport class K"), k, F.lit(" {\n  run(x: number) {\n    return 'class Not { }'\n  }\n}\n"))
    other = F.concat(F.lit("package com.x;\nimport a.b.C;\nimport static d.E;\npublic class K"), k, F.lit(" {\n  public void run(int x) {\n  }\n}\n"))
    body = F.when(path.endswith(".py"), python).when(path.rlike(r"\.tsx?$"), script).otherwise(other)
    return parsers.parse(A.files(spark, d).select("path", body.alias("text"))).select("path", "language", "package_name", big(F.size("imports"), "n_imports"), join_list("defined_classes"), join_list("defined_functions"))


@query(f"WITH {S.FILES}, {S.PARTS.format(table='files')}, x AS (SELECT suffix, count(*) AS n, min(ord) AS f FROM p GROUP BY 1 ORDER BY n DESC, f LIMIT 1) SELECT CASE suffix WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.py' THEN 'Python' WHEN '.java' THEN 'Java' ELSE upper(substr(suffix, 2)) END AS language FROM x")
def q_repository_language(spark, d):
    return parsers.repository_language(A.files(spark, d))


@query(f"WITH {PATHS} SELECT DISTINCT framework FROM p, (VALUES ('Next.js'), ('FastAPI'), ('Node.js'), ('Python')) AS f(framework) WHERE CASE framework WHEN 'Next.js' THEN contains(low, 'next.config') OR contains(low, '/app/') WHEN 'FastAPI' THEN contains(low, 'fastapi') OR contains(low, 'main.py') WHEN 'Node.js' THEN contains(low, 'package.json') ELSE contains(low, 'pyproject.toml') END")
def q_frameworks(spark, d):
    return parsers.frameworks(A.all_paths(spark, d))


@query("SELECT doc_id FROM documents WHERE contains(lower(lang), 'en') OR contains(lower(source), 'en')")
def q_search_any(spark, d):
    return views.search_any(A.table(spark, d, "documents"), "EN", ["lang", "source"]).select("doc_id")
