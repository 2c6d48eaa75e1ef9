"""The code-shaped views of sources.adapters as DuckDB SQL, and fragments that the oracle statements share."""

from __future__ import annotations

from ..functions import fixed_values as V
from ..sources.adapters import DIRS, EXTS, SPECIAL


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def inside(values: list[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def any_contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def any_ends(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({column}, {text(w)})" for w in words) + ")"


def has_part(column: str, words: list[str]) -> str:
    """Whether a whole segment of a '/'-separated path is one of the words."""
    return "(" + " OR ".join(f"contains('/' || {column} || '/', {text('/' + w + '/')})" for w in words) + ")"


FILES = f"files AS (SELECT p_partkey AS ord, {listed(DIRS)}[CAST(p_partkey % {len(DIRS)} AS INT) + 1] || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || {listed(EXTS)}[CAST(p_size % {len(EXTS)} AS INT) + 1] AS path FROM part)"
PATHS = FILES + ", paths AS (SELECT ord, path FROM files UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-k}, {text(p)})" for k, p in enumerate(SPECIAL, 1)) + ") AS s(ord, path))"
#: low: lower case with slashes; name, suffix, stem of it.
PARTS = """parts AS (SELECT ord, path, replace(path, '\\', '/') AS norm, lower(replace(path, '\\', '/')) AS low,
  regexp_extract(replace(path, '\\', '/'), '([^/]*)$', 1) AS raw_name, regexp_extract(lower(replace(path, '\\', '/')), '([^/]*)$', 1) AS name FROM {table}),
named AS (SELECT *, regexp_extract(name, '[^/](\\.[^./]+)$', 1) AS suffix FROM parts),
p AS (SELECT *, left(name, length(name) - length(suffix)) AS stem FROM named)"""
IMPORTS = """imports AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
CHANGED = "changed AS (SELECT DISTINCT l_orderkey AS analysis_id, l_partkey AS ord, path FROM lineitem JOIN files ON l_partkey = ord)"
CHANGED_LARGE = "changed AS (SELECT DISTINCT o_custkey AS analysis_id, l_partkey AS ord, path FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN files ON l_partkey = ord)"

TYPE_CASE = f"""CASE
 WHEN {any_ends('low', V.BACKUP_EXTENSIONS)} OR starts_with(name, '.~') THEN 'BACKUP'
 WHEN {has_part('low', V.IDE_DIRS)} OR suffix IN {inside(V.IDE_SUFFIXES)} THEN 'IDE_METADATA'
 WHEN {has_part('low', V.OUTPUT_DIRS)} THEN 'GENERATED'
 WHEN suffix IN {inside(V.ASSET_EXTENSIONS)} THEN 'ASSET'
 WHEN suffix IN {inside(V.DOC_EXTENSIONS)} OR name IN {inside(V.DOC_NAMES)} THEN 'DOCUMENTATION'
 WHEN {has_part('low', V.TEST_DIRS)} OR {any_ends('name', V.TEST_ENDINGS)} THEN 'TEST'
 WHEN name IN {inside(V.BUILD_FILENAMES)} OR (suffix IN ('.gradle', '.kts') AND contains(name, 'build')) THEN 'BUILD'
 WHEN name IN {inside(V.CONFIG_FILENAMES)} OR suffix IN {inside(V.DATA_SUFFIXES)} THEN 'CONFIGURATION'
 WHEN suffix IN {inside(V.SOURCE_EXTENSIONS)} OR contains(name, '.') THEN 'SOURCE' ELSE 'CONFIGURATION' END"""

SOURCE = f"suffix IN {inside(V.SOURCE_EXTENSIONS)}"
FOLDER = "regexp_replace(low, '[^/]*$', '')"
EXAMPLE = f"({has_part(FOLDER, V.ROLE_EXAMPLE_DIRS)} OR regexp_matches('/' || regexp_replace({FOLDER}, '(^|/)({'|'.join(V.ROLE_NAMESPACES)})/example/', '\\1\\2/', 'g'), '/example/'))"
ROLE_CASE = f"""CASE
 WHEN {any_ends('low', V.BACKUP_EXTENSIONS)} OR starts_with(name, '.~') THEN 'GENERATED'
 WHEN {has_part('low', V.ROLE_GENERATED_DIRS)} OR {any_ends('name', V.ROLE_GENERATED_ENDINGS)} OR suffix IN {inside(V.ASSET_EXTENSIONS)} THEN 'GENERATED'
 WHEN {has_part('low', V.ROLE_DOC_DIRS)} OR suffix IN {inside(V.DOC_EXTENSIONS)} OR stem IN {inside(V.ROLE_DOC_STEMS)} THEN 'DOCUMENTATION'
 WHEN {EXAMPLE} THEN 'EXAMPLE'
 WHEN {has_part('low', V.ROLE_TEST_DIRS)} OR {any_ends('name', V.ROLE_TEST_ENDINGS)} OR (starts_with(stem, 'test_') AND {SOURCE}) OR (ends_with(stem, 'test') AND suffix IN ('.kt', '.java')) THEN 'TEST'
 WHEN {has_part('low', [d for d in V.ROLE_SCRIPT_DIRS if '/' not in d])} OR name IN {inside(V.SCRIPT_FILENAMES)} OR suffix IN {inside(V.ROLE_SCRIPT_SUFFIXES)} THEN 'CLI_SCRIPT'
 WHEN name IN {inside(V.CONFIG_FILENAMES)} OR name IN {inside(V.BUILD_FILENAMES)} OR suffix IN {inside(V.ROLE_CONFIG_SUFFIXES)} OR ({has_part('low', ['alembic', 'migrations'])} AND suffix IN ('.py', '.sql')) OR name IN ('env.py', 'alembic.ini', '__init__.py') THEN 'CONFIGURATION'
 WHEN {any_ends('stem', V.ROLE_COMPONENT_STEMS)} THEN 'ENTRYPOINT'
 WHEN name IN {inside(V.ROLE_ROUTE_NAMES)} OR {has_part('low', V.ROLE_ROUTE_DIRS)} THEN 'ROUTE'
 WHEN name IN ('session.py', 'database.py') AND (contains(low, 'database') OR contains(low, 'db')) THEN 'CONFIGURATION'
 WHEN name IN {inside(V.FRAMEWORK_ENTRYPOINT_FILENAMES)} THEN 'FRAMEWORK_ENTRYPOINT'
 WHEN raw_name IN {inside(V.ENTRYPOINT_FILENAMES)} OR name IN {inside(V.ENTRYPOINT_FILENAMES)} THEN 'ENTRYPOINT'
 WHEN {has_part('low', V.ROLE_WORKER_DIRS)} AND {SOURCE} THEN 'FRAMEWORK_ENTRYPOINT'
 WHEN stem IN {inside(V.ROLE_CLIENT_STEMS)} AND {SOURCE} THEN 'ENTRYPOINT'
 WHEN {SOURCE} OR contains(raw_name, '.') THEN 'SOURCE_MODULE' ELSE 'CONFIGURATION' END"""

NESTED = "contains(norm, '/')"
TOP = "regexp_extract(norm, '^([^/]*)', 1)"
MODULE_CASE = f"""CASE WHEN file_type IN ('IDE_METADATA', 'ASSET', 'GENERATED', 'BACKUP') THEN NULL
 WHEN lower({TOP}) IN {inside(V.NESTED_MODULE_DIRS)} AND {NESTED} THEN lower({TOP}) || '/' || regexp_extract(norm, '^[^/]*/([^/]*)', 1)
 WHEN lower({TOP}) IN {inside(V.MODULE_DIRS)} THEN {TOP}
 WHEN file_type IN ('SOURCE', 'TEST') THEN CASE WHEN {NESTED} THEN {TOP} ELSE 'root' END
 WHEN file_type = 'BUILD' THEN CASE WHEN {NESTED} THEN {TOP} ELSE 'build' END END"""


def marker_test(m: str) -> str:
    if m.endswith("/"):
        return f"contains('/' || low, {text('/' + m)})"
    return f"(regexp_matches(stem, {text('(^|[_-])' + m.replace('.', chr(92) + '.') + '([_-]|$)')}) OR starts_with(stem, {text(m)}) OR ends_with(stem, {text(m)}) OR contains('/' || low, {text('/' + m + '/')}))"


def rule_test(rule: tuple) -> str:
    tests = [marker_test(m) for m in rule[5]]
    if rule[6]:
        tests.append(f"suffix IN {inside(rule[6])}")
    if rule[7]:
        tests.append(f"name IN {inside(rule[7])}")
    return " OR ".join(tests)


HITS = "hits AS (" + " UNION ALL ".join(f"SELECT analysis_id, ord, path, {k} AS rule_no, {text(r[0])} AS signal, CAST({r[4]} AS DOUBLE) AS weight FROM c WHERE {rule_test(r)}" for k, r in enumerate(V.RULES) if r[5] or r[6] or r[7]) + ")"


def scored_views(large: bool = False) -> str:
    """files, changed, c (changed with path parts), hits, rule evidence, inputs."""
    return f"""{FILES}, {CHANGED_LARGE if large else CHANGED}, {PARTS.format(table='files')},
c AS (SELECT g.analysis_id, p.* FROM changed g JOIN p USING (ord)), {HITS},
rule_ev AS (SELECT analysis_id, signal, min(weight) AS weight, least(count(*) / 2.0, 1.0) AS score, count(*) AS n, list_sort(list(DISTINCT path)) AS file_paths, min(ord * 100 + rule_no) AS first FROM hits GROUP BY ALL),
typed AS (SELECT *, {TYPE_CASE} AS file_type FROM c),
mods AS (SELECT *, {MODULE_CASE} AS module, {any_contains('low', V.CRITICAL_ANALYZER)} AS critical FROM typed),
inputs AS (SELECT analysis_id, count(*) AS n_files, list(path ORDER BY ord) AS files, coalesce(list_sort(list(DISTINCT module) FILTER (module IS NOT NULL)), []) AS modules,
  sum(ord % 7) AS dependency_count, NOT bool_or(contains(low, 'test') OR contains(low, 'spec')) AS missing_tests,
  coalesce(list_sort(list(DISTINCT path) FILTER (critical)), []) AS critical_modules, count(DISTINCT ord) FILTER (ord % 3 = 0) AS n_functions, count(DISTINCT ord) FILTER (ord % 11 = 0) AS n_hubs, count(DISTINCT ord) FILTER (ord % 13 = 0) AS n_bridges,
  bool_or({any_contains('low', V.FLAG_WORDS)}) AS flags, bool_or({any_contains('low', V.DEPLOY_WORDS)}) AS deploy,
  sum(CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END) AS edges, sum(CASE WHEN ord % 5 = 0 THEN 2 ELSE 0 END) AS unique_components,
  count(*) FILTER (NOT ({any_ends('low', V.REFACTOR_SKIP_ENDINGS)} OR {any_contains("('/' || low)", ['/' + d for d in V.REFACTOR_SKIP_DIRS])})) AS n_arch
  FROM mods GROUP BY analysis_id),
down AS (SELECT *, CASE WHEN unique_components > 0 THEN unique_components ELSE dependency_count END AS down FROM inputs),
dyn AS (SELECT analysis_id, 'large_blast_radius' AS signal, 0.18 AS weight, least(down / 20.0, 1.0) AS score, 1001 AS ord FROM down WHERE down > 0
  UNION ALL SELECT analysis_id, 'missing_tests', 0.14, 1.0, 1002 FROM down WHERE missing_tests
  UNION ALL SELECT analysis_id, 'large_refactor', 0.16, least(n_arch / 30.0, 1.0), 1003 FROM down WHERE n_arch >= 15
  UNION ALL SELECT analysis_id, 'critical_component_modified', 0.20, least(len(critical_modules) / 3.0, 1.0), 1004 FROM down WHERE len(critical_modules) > 0
  UNION ALL SELECT analysis_id, 'multi_module_impact', 0.18, least(len(modules) / 4.0, 1.0), 1005 FROM down WHERE len(modules) >= 3
  UNION ALL SELECT analysis_id, 'function_level_impact', 0.10, least(n_functions / 10.0, 1.0), 1006 FROM down WHERE n_functions > 0
  UNION ALL SELECT analysis_id, 'hub_node_affected', 0.16, least(n_hubs / 3.0, 1.0), 1007 FROM down WHERE n_hubs > 0
  UNION ALL SELECT analysis_id, 'bridge_node_affected', 0.18, least(n_bridges / 2.0, 1.0), 1008 FROM down WHERE n_bridges > 0),
ev AS (SELECT analysis_id, signal, CAST(weight AS DOUBLE) AS weight, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY analysis_id ORDER BY first) AS ord FROM rule_ev
  UNION ALL SELECT analysis_id, signal, CAST(weight AS DOUBLE), CAST(score AS DOUBLE), ord FROM dyn),
sums AS (SELECT analysis_id, CAST(sum(CAST(weight * score * 100 AS DECIMAL(18, 9))) AS DOUBLE) AS raw, count(*) AS n_evidence FROM ev GROUP BY 1),
norm AS (SELECT i.*, coalesce(raw, 0.0) AS raw, coalesce(n_evidence, 0) AS n_evidence, CASE WHEN coalesce(raw, 0.0) > 60 THEN 60 + (raw - 60) * 0.5 ELSE coalesce(raw, 0.0) END AS normalized FROM down i LEFT JOIN sums USING (analysis_id)),
scores AS (SELECT *, CAST(round_even(greatest(least(normalized, 100.0), 0.0), 0) AS INT) AS score FROM norm),
levels AS (SELECT *, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 55 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM scores)"""


#: The two versions of adapters.versions, and their lines with the number of each among its like in its file.
VERSIONS = """docs AS (SELECT doc_id, doc_id % 10 AS k, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, string_split(text, chr(10)) AS l FROM docs),
edited AS (SELECT *, array_to_string(list_filter(list_transform(range(len(l)), lambda i: CASE i % 5 WHEN 1 THEN NULL WHEN 3 THEN l[i + 1] || ' edited' ELSE l[i + 1] END), lambda x: x IS NOT NULL), chr(10)) || chr(10) || 'end of ' || doc_id AS e FROM cut),
old AS (SELECT 'd/' || doc_id || '.txt' AS path, text FROM docs WHERE k <> 3),
new AS (SELECT CASE WHEN k IN (1, 4) THEN 'moved/' ELSE 'd/' END || doc_id || '.txt' AS path, CASE WHEN k BETWEEN 4 AND 7 THEN e ELSE text END AS text FROM edited WHERE k <> 2),
both_sides AS (SELECT coalesce(o.path, n.path) AS path, o.text AS a, n.text AS b FROM old o FULL JOIN new n ON o.path = n.path),
lost AS (SELECT path, a AS text, row_number() OVER (PARTITION BY a ORDER BY path) AS nth FROM both_sides WHERE b IS NULL),
fresh AS (SELECT path, b AS text, row_number() OVER (PARTITION BY b ORDER BY path) AS nth FROM both_sides WHERE a IS NULL),
moved AS (SELECT l.path AS old_path, f.path FROM lost l JOIN fresh f ON l.text = f.text AND l.nth = f.nth)"""
#: A property graph over parts: node kinds and edge kinds by key; the same as catalogue.graph().
KINDS = ["file", "file", "file", "module", "class", "function", "api", "database", "folder", "package"]
RELATIONS = ["IMPORTS", "CALLS", "EXPORTS", "DEPENDS_ON", "INHERITS", "USES", "IMPLEMENTS"]
TYPES = ["SOURCE_IMPORT", "SOURCE_IMPORT", "SOURCE_IMPORT", "SOURCE_IMPORT", "SOURCE_IMPORT", "PACKAGE_DEPENDENCY", "CONFIG_REFERENCE", "BUILD_DEPENDENCY", "TEST_REFERENCE"]
GRAPH = f"""{FILES}, {IMPORTS},
nodes AS (SELECT 'n:' || ord AS id, 'label_' || ord AS label, {listed(KINDS)}[CAST((ord * 7 + 3) % {len(KINDS)} AS INT) + 1] AS kind, path, split_part(path, '/', 1) AS module, ord FROM files),
edges AS (SELECT 'n:' || src AS source, 'n:' || dst AS target, {listed(RELATIONS)}[CAST((src + dst) % {len(RELATIONS)} AS INT) + 1] AS relationship,
  {listed(TYPES)}[CAST((src * 3 + dst) % {len(TYPES)} AS INT) + 1] AS edge_type, src * 100000 + dst AS ord FROM imports),
seeds AS (SELECT DISTINCT 'n:' || l_partkey AS node, CAST(l_partkey AS BIGINT) AS ord FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem))"""
