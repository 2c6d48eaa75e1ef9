"""Results worked out by hand for small cases."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.functions import fixed_values as V
from faultline.functions import paths as P
from faultline.operators import analysis, centrality, diff, experiments, graph, health, policy, risk, traverse
from faultline.sources import adapters, parsers, readers

INPUT = "analysis_id long, files array<string>, impacted_modules array<string>, dependency_count int, missing_tests boolean, critical_modules array<string>, affected_functions array<string>, hub_nodes array<string>, bridge_nodes array<string>, flags boolean, deploy boolean, edges int, unique_components int, ownership map<string,string>"


def scored(spark, files, modules=(), dep=0, missing=False, critical=(), functions=(), hubs=(), bridges=()):
    changed = spark.createDataFrame([(1, k, f) for k, f in enumerate(files)], "analysis_id long, ord long, path string")
    row = (1, list(files), list(modules), dep, missing, list(critical), list(functions), list(hubs), list(bridges), False, False, 0, 0, {})
    inputs = spark.createDataFrame([row], INPUT)
    ev = risk.evidence(changed, inputs, risk.builtin_rules(spark))
    return risk.scores(ev, inputs).first(), ev, inputs


def test_score_high(spark):
    s, ev, inputs = scored(spark, ["backend/app/auth/session.py", "backend/alembic/migrations/001.sql", "frontend/app/api/users/route.ts"], ["backend", "frontend"], 8, True)
    assert (s.score, s.level, s.evidence_completeness) == (59, "HIGH", 0.98)
    signals = {r.signal for r in ev.collect()}
    assert "session_change" not in signals and {"authentication_change", "migration_detected", "api_contract_changed"} <= signals
    ids = [r.id for r in risk.ledger(ev, inputs).orderBy("ord").collect()]
    assert ids[0] == "FACT-001" and ids[-1] == f"REC-{len(signals):03d}"


def test_score_medium_and_low(spark):
    s, _, _ = scored(spark, ["src/auth.ts", "src/payment.ts"], dep=12, missing=True, critical=["src/auth.ts", "src/payment.ts"])
    assert s.level == "MEDIUM" or s.score >= 38
    low, ev, _ = scored(spark, ["docs/readme.md"])
    assert (low.score, low.level) == (0, "LOW") and ev.count() == 0


def test_large_refactor_and_functions(spark):
    _, ev, _ = scored(spark, [f"src/f{k}.py" for k in range(24)] + [".idea/x.xml"] * 3, functions=[f"f{k}" for k in range(7)], hubs=["h"], bridges=["b"])
    by = {r.signal: r for r in ev.collect()}
    assert by["large_refactor"].evidence_value == "24/27" and len(by["large_refactor"].file_paths) == 15
    assert by["function_level_impact"].description.endswith("f4 and 2 more") and by["bridge_node_affected"].score == 0.5


@pytest.mark.parametrize(("path", "kind"), [("src/a.py", "SOURCE"), ("a/build/x.js", "GENERATED"), ("x.bak", "BACKUP"), (".idea/w.xml", "IDE_METADATA"), ("r.md", "DOCUMENTATION"), ("app/FooTest.kt", "TEST"), ("build.gradle.kts", "BUILD"), ("a.json", "CONFIGURATION"), ("Makefile", "BUILD"), ("LICENSE", "DOCUMENTATION"), ("noext", "CONFIGURATION"), ("i.png", "ASSET")])
def test_file_type(spark, path, kind):
    assert spark.range(1).select(P.file_type(F.lit(path))).first()[0] == kind


@pytest.mark.parametrize(("path", "role"), [("src/lib/x.ts", "SOURCE_MODULE"), ("app/page.tsx", "ROUTE"), ("com/example/App.kt", "ENTRYPOINT"), ("examples/a.py", "EXAMPLE"), ("scripts/a.py", "CLI_SCRIPT"), ("docs/x.py", "DOCUMENTATION"), ("workers/a.py", "FRAMEWORK_ENTRYPOINT"), ("src/LoginActivity.kt", "ENTRYPOINT"), ("alembic/env.py", "CONFIGURATION"), ("", "SOURCE_MODULE"), ("tests/x.py", "TEST"), ("src/client.ts", "ENTRYPOINT")])
def test_file_role(spark, path, role):
    assert spark.range(1).select(P.file_role(F.lit(path))).first()[0] == role


@pytest.mark.parametrize(("path", "ext", "stem"), [(".env", "", ".env"), (".env.local", ".local", ".env"), ("a.b.c", ".c", "a.b"), ("Dockerfile", "", "Dockerfile"), ("x.", "", "x."), ("d.e/f", "", "f")])
def test_suffix_and_stem(spark, path, ext, stem):
    assert tuple(spark.range(1).select(P.suffix(F.lit(path)), P.stem(F.lit(path))).first()) == (ext, stem)


def test_bucket(spark):
    r = spark.range(1).select(P.bucket_hash(F.lit("abcheader_layout")), experiments.bucket(F.lit("abc"), F.lit("header_layout"))).first()
    assert tuple(r) == (678895328, 28)


def graph_of(spark, pairs, kind="class", relationship="IMPORTS"):
    names = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(n, n, kind, n, k) for k, n in enumerate(names)], "id string, label string, kind string, path string, ord long")
    edges = spark.createDataFrame([(s, t, relationship, "SOURCE_IMPORT", k) for k, (s, t) in enumerate(pairs)], "source string, target string, relationship string, edge_type string, ord long")
    return nodes, edges


def test_chain_search(spark):
    nodes, edges = graph_of(spark, [("controller", "service"), ("service", "db")], "file")
    seeds = traverse.seeds_of(spark.createDataFrame([("k", "db", 0)], "key string, path string, ord long"), nodes)
    got = {r.node: (r.depth, " -> ".join(r.trail)) for r in traverse.blast("impact", nodes, edges, seeds).collect()}
    assert got == {"db": (0, "db"), "service": (1, "db -> service"), "controller": (2, "db -> service -> controller")}
    assert traverse.search(edges.limit(0), seeds, 3).count() == 1


def test_first_parent_is_the_queue_one(spark):
    nodes, edges = graph_of(spark, [("m2", "a"), ("m1", "a"), ("top", "m1"), ("top", "m2")])
    seeds = spark.createDataFrame([("k", "a", 0)], "key string, node string, ord long")
    top = {r.node: r.parent for r in traverse.blast("impact", nodes, edges, seeds).collect()}
    assert top["top"] == "m2"


def test_betweenness_chain(spark):
    nodes, edges = graph_of(spark, [("a", "b"), ("b", "c")])
    assert [(r.id, r.betweenness) for r in centrality.bridges(nodes, edges).collect()] == [("b", 0.5)]
    assert centrality.bridges(*graph_of(spark, [("a", "b")])).count() == 0
    assert centrality.analyse(nodes, edges).count() == 4


def test_three_cycle(spark):
    nodes, edges = graph_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")])
    got = health.cycles(edges, nodes.select(F.col("id").alias("node"), "ord")).collect()
    assert [r.cycle for r in got] == [["a", "b", "c", "a"]]


def test_gate(spark):
    rows = [(72, 25, 25, 0, 35), (72, 25, 0, 25, 1), (50, 20, 10, 10, 15)]
    cols = "files_discovered int, supported_source_files int, files_parsed int, files_failed int, ast_nodes int"
    d = spark.createDataFrame(rows, cols).withColumns({"has_git_diff": F.lit(True), "has_test_analysis": F.lit(True)})
    got = {(r.evidence_completeness, r.analysis_quality) for r in health.quality_gate(d).collect()}
    assert got == {(0.98, "FULL"), (0.4, "FAILED"), (0.73, "DEGRADED")}


def test_health_of_two_orphans(spark):
    d = spark.createDataFrame([(0, 0, 0, 0, 2)], "cycles int, god_classes int, fan_out_files int, gaps int, orphans int")
    r = health.declared_never_computed(health.health(d)).first()
    assert (r.maintainability, r.health_score, r.module_coupling_ratio) == (96, 99, 0.0)


def test_hunks_follow_the_last_file(spark):
    text = "+++ b/a.py\n@@ -1 +5,3 @@\n@@ -1,2 +9 @@ def\n+++ /dev/null\n@@ -1,2 +0,0 @@\n+++ b/b.py\n@@ -3 +7,0 @@"
    got = [(r.path, r.start, r.end) for r in diff.hunks(spark.createDataFrame([(1, text)], "key long, text string")).orderBy("pos").collect()]
    assert got == [("a.py", 5, 7), ("a.py", 9, 9), ("a.py", 0, 0), ("b.py", 7, 7)]
    lines = spark.createDataFrame([(1, 0, "R100\told\tnew"), (1, 1, "C\tx\ty"), (1, 2, "D\tz")], "key long, ord long, line string")
    assert [(r.status, r.filename, r.previous_filename) for r in diff.name_status(lines).orderBy("ord").collect()] == [("renamed", "new", "old"), ("modified", "y", None), ("deleted", "z", None)]


def file_rows(spark, imports):
    item = "array<struct<source_module:string,imported_name:string,alias:string,is_relative:boolean,import_type:string,line_number:int>>"
    names = sorted(imports)
    rows = [("r", k, n, "typescript", None, [(m, m, None, m.startswith("."), "SOURCE_IMPORT", i) for i, m in enumerate(imports[n])], []) for k, n in enumerate(names)]
    d = spark.createDataFrame(rows, f"repo_id string, ord long, file_path string, language string, package_name string, imports {item}, defined_classes array<string>")
    none = F.array().cast("array<string>")
    return d.withColumns({
        "class_symbols": F.array().cast("array<struct<name:string,base_classes:array<string>,methods:array<string>,is_db_model:boolean>>"), "function_symbols": F.array().cast("array<struct<name:string,calls:array<string>>>"),
        "api_routes": none, "package_deps": none, "framework_signals": none,
    })


def test_imports(spark):
    f = file_rows(spark, {"src/a.ts": ["./b.ts", "./b", "./b.ts", "./a.ts", "@/c"], "src/b.ts": ["../next.config.js", "react"], "src/c/index.ts": ["com.x.Thing"], "next.config.js": [], "lib/Thing.kt": ["a.b"], "x/a/b.py": [".missing"]})
    edges = graph.import_edges(graph.resolve_imports(graph.import_rows(f), f))
    got = {(r.file_path, r.target_path, r.edge_type, r.times) for r in edges.collect()}
    assert got == {("src/a.ts", "src/b.ts", "SOURCE_IMPORT", 3), ("src/a.ts", "src/a.ts", "SELF_IMPORT", 1), ("src/a.ts", "src/c/index.ts", "SOURCE_IMPORT", 1), ("src/b.ts", "next.config.js", "CONFIG_REFERENCE", 1), ("src/c/index.ts", "lib/Thing.kt", "SOURCE_IMPORT", 1), ("lib/Thing.kt", "x/a/b.py", "SOURCE_IMPORT", 1)}
    fan = {r.file_path: (r.fan_in, r.fan_out) for r in graph.fan(f, edges).collect()}
    assert fan["src/b.ts"] == (1, 0) and fan["src/a.ts"] == (0, 2)
    nodes, all_edges = graph.knowledge_graph(f)
    assert nodes.where("id = 'folder:src/c'").count() == 1 and all_edges.where("relationship = 'IMPORTS'").count() == 6


def test_resolution_rate(spark):
    f = file_rows(spark, {"a/main.py": [".utils", ".gone", "app.none"], "a/utils.py": []})
    r = graph.import_counters(graph.resolve_imports(graph.import_rows(f), f), f).first()
    assert (r.resolution_rate, r.status, r.unresolved) == (0.3333, "POOR", 2)


def test_json_hash_escapes(spark):
    names = ["plain", 'q"b\\', "é😀\n\x01"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(graph.json_ascii(F.col("s"))).collect()]
    assert got == [json.dumps(n)[1:-1] for n in names]


def test_kotlin_and_java(spark):
    kt = "package com.x.ui\nimport com.x.data.Repo\nimport a.B as C\n@AndroidEntryPoint\nclass MainActivity : AppCompatActivity(), Face<T> {\n  fun onCreate(x: Int) {}\n}\n@Entity(tableName = \"users\")\ndata class User(val id: Int)\n@Composable\nfun Screen() {}\n"
    r = parsers.kotlin(spark.createDataFrame([("a.kt", kt)], "path string, text string")).first()
    assert r.package_name == "com.x.ui" and [i.source_module for i in r.imports] == ["com.x.data.Repo", "a.B"] and r.imports[1].alias == "C"
    assert r.defined_classes == ["MainActivity", "User"] and r.class_symbols[0].base_classes == ["AppCompatActivity", "Face"]
    assert r.defined_functions == ["onCreate", "Screen"] and set(r.framework_signals) == {"Activity", "Jetpack Compose", "Room Database"} and r.db_tables == ["users"]
    j = parsers.java(spark.createDataFrame([("a.java", "package a.b;\nimport static c.D;\npublic final class K {\n  public void run(int x) throws E {\n    if (x) {\n    }\n  }\n}\nenum Z {}")], "path string, text string")).first()
    assert (j.package_name, j.defined_classes, j.defined_functions) == ("a.b", ["K", "Z"], ["run"])


def test_python_and_typescript(spark):
    py = "import os, a.b\nimport x as y\nfrom m import n\nclass A:\n    def f(self): pass\nasync def g(): pass\n"
    d = spark.createDataFrame([("a.py", py), ("b.py", "def (")], "path string, text string")
    plain, more = ({r.path: r for r in parsers.python(d, e).collect()} for e in (False, True))
    assert [i.source_module for i in plain["a.py"].imports] == ["os", "a.b"] and len(more["a.py"].imports) == 4
    assert plain["a.py"].defined_classes == ["A"] and plain["a.py"].defined_functions == ["f", "g"] and plain["b.py"].parse_status == "FAILED"
    ts = "import x from './y'\nimport 'z'\nimport {\n a,\n b } from \"w\"\nexport class K { }\ninterface I {}\nexport function fn(a) {}\nclass M {\n  async go(x: number): void {\n  }\n}\n"
    t = parsers.typescript(spark.createDataFrame([("a.ts", ts)], "path string, text string")).first()
    assert [(i.source_module, i.is_relative) for i in t.imports] == [("./y", True), ("z", False), ("w", False)]
    assert t.defined_classes == ["K", "I", "M"] and {"fn", "go"} <= set(t.defined_functions)


def test_build_files(spark):
    pkg = json.dumps({"main": "./index.js", "bin": {"x": "bin/cli.js"}, "exports": {".": {"import": "./dist/client.mjs"}}, "dependencies": {"a": "1"}, "devDependencies": {"b": "1"}})
    d = spark.createDataFrame([(pkg,), ("no json",), (None,)], "t string")
    got = [r[0] for r in d.select(readers.package_entrypoints("t")).collect()]
    assert got == [["bin/cli.js", "cli.js", "client.mjs", "dist/client.mjs", "index.js"], [], []]
    assert spark.range(1).select(readers.gradle_modules(F.lit("include(':app')\ninclude(\":core:network\")\ninclude ':feature:login'"))).first()[0] == ["app", "core/network", "feature/login"]


def test_saved_answers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "One", "full_name": "o/One", "default_branch": "main", "language": None}, {"name": "two", "full_name": "o/two"}]))
    spark.dataSource.register(readers.SavedAnswers)
    got = spark.read.format("saved_answers").option("filter", "ONE").load(str(tmp_path / "r.json")).collect()
    assert [(r.name, r.default_branch) for r in got] == [("One", "main")]


def test_working_tree(spark, tmp_path):
    for name in ("src/a.py", "node_modules/x.js", "app/AndroidManifest.xml", "settings.gradle"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    tree = readers.working_tree(spark, str(tmp_path))
    r = readers.scan_counters(tree).first()
    assert (r.files_discovered, r.supported_source_files, r.manifest_path, r.settings_path) == (4, 2, "app/AndroidManifest.xml", "settings.gradle")


def test_log_and_branches(spark):
    d = spark.createDataFrame([(0, "s|x|me|now|fix a|b"), (1, "short|x")], "ord long, line string")
    assert [(r.sha, r.message) for r in readers.log_commits(d).collect()] == [("s", "fix a")]
    b = spark.createDataFrame([(0, "* main"), (1, "  dev")], "ord long, line string")
    assert [(r.name, r.is_default) for r in readers.branches(b).orderBy("ord").collect()] == [("main", True), ("dev", False)]


def test_policies(spark):
    rules = policy.seed_rules(risk.builtin_rules(spark))
    assert rules.count() == 23 and "file_names" not in rules.columns
    assert policy.compare(rules, rules).count() == 0
    assert len(V.RULES) == len({r[0] for r in V.RULES}) and adapters.inputs


def test_streaming(spark, tmp_path):
    from faultline.streaming import scoring

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "auth/login.py", None), (2, 0, "db/x.sql", None)], "analysis_id long, ord long, path string, arrived string").withColumn("arrived", F.current_timestamp()).write.parquet(src)
    q = scoring.score_stream(scoring.changed_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.signal for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"authentication_change", "database_schema_change", "migration_detected"}


def two_repositories(spark, *graphs):
    """Graphs whose ids clash, side by side under repo_id."""
    nodes = edges = None
    for repo, pairs in zip("ab", graphs):
        n, e = (x.withColumn("repo_id", F.lit(repo)) for x in graph_of(spark, pairs))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return nodes, edges


def test_repositories_stay_apart(spark):
    one, two = [("b", "a"), ("c", "b"), ("d", "c")], [("x", "a"), ("a", "b"), ("b", "x"), ("c", "a")]
    nodes, edges = two_repositories(spark, one, two)
    seeds = spark.createDataFrame([("a", "k", "a", 0), ("b", "k", "a", 0)], "repo_id string, key string, node string, ord long")
    together = traverse.blast("impact", nodes, edges, seeds)
    hubs, bridges = centrality.hubs(nodes, edges, 2), centrality.bridges(nodes, edges, 2)
    rounds = health.cycles(edges, nodes.select("repo_id", F.col("id").alias("node"), "ord"), 1)
    parts = health.strongly_connected(edges)
    files = nodes.select("repo_id", F.concat("id", F.lit("/f.py")).alias("path"), "id")
    folders = traverse.folder_metrics(files, edges, spark.createDataFrame([("a",), ("b",)], "folder string"))
    for repo, pairs in (("a", one), ("b", two)):
        n, e = graph_of(spark, pairs)
        own = lambda df, *c: sorted(tuple(r) for r in df.where(F.col("repo_id") == repo).select(*c).collect())  # noqa: B023, E731
        alone = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
        found = traverse.blast("impact", n, e, spark.createDataFrame([("k", "a", 0)], "key string, node string, ord long"))
        assert own(together, "node", "depth", "parent") == alone(found, "node", "depth", "parent")
        assert own(hubs, "id", "degree") == alone(centrality.hubs(n, e, 2), "id", "degree")
        assert own(bridges, "id", "betweenness") == alone(centrality.bridges(n, e, 2), "id", "betweenness")
        assert own(parts, "node", "component") == alone(health.strongly_connected(e), "node", "component")
        assert own(rounds, "cycle") == alone(health.cycles(e, n.select(F.col("id").alias("node"), "ord"), 1), "cycle")
        f = n.select(F.concat("id", F.lit("/f.py")).alias("path"), "id")
        names = ("folder", "n_files", "external_importers", "external_targets", "internal_edges", "external_edges", "reach")
        assert own(folders, *names) == alone(traverse.folder_metrics(f, e, spark.createDataFrame([("a",), ("b",)], "folder string")), *names)
    counts = {(r.repo_id, r.total) for r in traverse.blast_counts(together).collect()}
    assert counts == {("a", 3), ("b", 3)}


def plain_betweenness(ids, pairs):
    """By enumerating all shortest paths."""
    import itertools

    total = dict.fromkeys(ids, 0.0)
    for s, t in itertools.permutations(ids, 2):
        level, ends = [[s]], []
        while level and not ends:
            level = [[*p, y] for p in level for x, y in pairs if x == p[-1] and y not in p]
            ends = [p for p in level if p[-1] == t]
        for p in ends:
            for v in p[1:-1]:
                total[v] += 1 / len(ends)
    n = len(ids)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_against_all_paths(spark):
    import random

    r = random.Random(4)
    ids = [f"n{k}" for k in range(12)]
    pairs = sorted({(a, b) for a, b in ((r.choice(ids), r.choice(ids)) for _ in range(26)) if a != b})
    edges = spark.createDataFrame(pairs, "source string, target string")
    got = {x.id: x.score for x in centrality.betweenness(spark.createDataFrame([(i,) for i in ids], "id string"), edges).collect()}
    want = plain_betweenness(ids, pairs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and max(want.values()) > 0


def test_test_gaps_of_two_repositories(spark):
    rows = [("a", 0, "src/one.py", "SOURCE_MODULE"), ("a", 1, "tests/test_two.py", "TEST"), ("b", 0, "src/one.py", "SOURCE_MODULE"), ("b", 1, "tests/test_one.py", "TEST"), ("b", 2, "src/two.py", "ROUTE")]
    d = spark.createDataFrame(rows, "repo_id string, ord long, path string, role_after string")
    assert {(r.repo_id, r.path) for r in health.test_gaps(d).collect()} == {("a", "src/one.py"), ("b", "src/two.py")}
    assert {(r.path) for r in health.test_gaps(d.where("repo_id = 'b'").drop("repo_id")).collect()} == {"src/two.py"}


def test_from_tree_to_score(spark):
    tree = {"src/auth/login.py": "import src.auth.tokens\nclass Login:\n    def go(self): pass\n", "src/auth/tokens.py": "import src.db\n\n\n\ndef issue(): pass\n", "src/db.py": "class Store: pass\n", "web/a.ts": "import x from './b'\n", "web/b.ts": "export class B { }\n", "tests/test_db.py": "import src.db\n\n\n"}
    rows = [(repo, k, path, text if repo == "one" or path != "src/auth/tokens.py" else "x = 1\n" * 9) for repo in ("one", "two") for k, (path, text) in enumerate(tree.items())]
    rows.append(("one", 99, "package.json", json.dumps({"main": "web/b.ts", "dependencies": {"lodash": "1"}, "scripts": {"go": "x"}})))
    sources = spark.createDataFrame(rows, "repo_id string, ord long, path string, text string")
    changed = spark.createDataFrame([("one", 1, 0, "src/db.py"), ("two", 2, 0, "src/db.py")], "repo_id string, analysis_id long, ord long, path string")
    a = analysis.analyse(sources, changed, None)
    reached = {(r.repo_id, r.node): r.depth for r in a.impact.collect()}
    assert {n: k for (repo, n), k in reached.items() if repo == "one"} == {"file:src/db.py": 0, "file:src/auth/tokens.py": 1, "file:tests/test_db.py": 1, "file:src/auth/login.py": 2}
    assert {n for repo, n in reached if repo == "two"} == {"file:src/db.py", "file:tests/test_db.py"}
    by = {r.analysis_id: r for r in a.inputs.collect()}
    assert (by[1].dependency_count, by[2].dependency_count) == (3, 1) and by[1].missing_tests and by[1].impacted_modules == ["src/db.py"]
    signals = {(r.analysis_id, r.signal) for r in a.evidence.collect()}
    assert {(1, "large_blast_radius"), (2, "large_blast_radius")} <= signals and (1, "missing_tests") in signals
    scores = {r.analysis_id: r for r in a.scores.collect()}
    assert scores[1].score > scores[2].score and scores[1].analysis_quality == "FULL" and scores[1].score_description is None
    assert a.nodes.where("repo_id = 'one' AND id = 'file:web/b.ts'").first().file_classification == "ENTRYPOINT"
    assert a.nodes.where("repo_id = 'two' AND id = 'file:web/b.ts'").first().file_classification != "ENTRYPOINT"
    totals = {r.repo_id: (r.total_files, r.total_classes) for r in graph.totals(a.parsed.withColumnRenamed("path", "file_path"), a.edges).collect()}
    assert totals == {"one": (7, 3), "two": (6, 3)}
    assert a.parsed.where("path = 'package.json'").first().exports == ["go"]


def test_csv_sets(spark, tmp_path):
    from faultline.operators import export

    s, ev, inputs = scored(spark, ["src/auth/login.py", "a,b.sql"], ["src"], 3)
    inputs = inputs.unionByName(inputs.withColumn("analysis_id", F.lit(2).cast("long")))
    factors = export.risk_factors(ev, inputs.select("analysis_id", F.lit(1).alias("indirect")))
    changed = spark.createDataFrame([(1, 0, "src/auth/login.py"), (1, 1, "a,b.sql")], "analysis_id long, ord long, path string")
    files = export.changed_files(changed, ev)
    paths = spark.createDataFrame([(1, 1, "x.py", "IMPORTS")], "analysis_id long, depth int, file_or_module string, relationship string")
    metrics = spark.createDataFrame([(1, "risk_score", str(s.score)), (2, "risk_score", "0")], "analysis_id long, metric string, value string")
    sets = export.csv_sets(inputs.select("analysis_id", "impacted_modules"), factors, files, paths, export.test_findings(inputs), metrics)
    assert list(sets) == ["risk_factors", "changed_files", "impacted_files", "dependencies", "test_gaps", "repository_metrics"]
    export.write_csv(sets, str(tmp_path / "out"))
    read = lambda name, k: next((tmp_path / "out" / name / f"analysis_id={k}").glob("*.csv")).read_bytes().decode()
    lines = read("risk_factors", 2).split("\r\n")
    assert lines[0] == "id,rule,name,category,points,raw_points,evidence,evidence_ids,affected_files,threshold,recommendation,recommendation_type" and lines[1].startswith("N/A,none,No risk factors,general,0,0.0,No scoring rule fired") and lines[2:] == [""]
    assert read("risk_factors", 1).split("\r\n")[1].startswith("RF-001,") and '"a,b.sql"' in read("changed_files", 1)
    assert read("impacted_files", 2).split("\r\n")[1] == "1,src,MODULE_IMPACT,MODULE_BOUNDARY,Architectural module in blast radius,1"
    assert read("dependencies", 1).split("\r\n")[1].startswith("1,") and "\n" not in read("dependencies", 1).replace("\r\n", "")


def test_gate_says_why(spark):
    scored_ = spark.createDataFrame([(1, 30, "MEDIUM", 0.9), (2, 10, "LOW", 0.98)], "analysis_id long, score int, level string, evidence_completeness double")
    gate = spark.createDataFrame([(1, 0.5, "DEGRADED"), (2, 0.98, "FULL")], "analysis_id long, evidence_completeness double, analysis_quality string")
    got = {r.analysis_id: r.score_description for r in health.gated(scored_, gate).collect()}
    assert got[2] is None and got[1] == "Risk score: 30/100 (MEDIUM) \u00b7 Analysis Quality: DEGRADED (50% evidence completeness) \u2014 " + V.GATE_EXPLANATIONS["DEGRADED"]


def test_hits_by_window(spark, tmp_path):
    from faultline.streaming import scoring

    src = str(tmp_path / "in")
    rows = [(1, 0, "auth/login.py", "2024-01-01 10:05:00"), (2, 0, "auth/token.py", "2024-01-01 10:50:00"), (3, 0, "auth/a.py", "2024-01-01 11:10:00"), (4, 0, "docs/x.md", "2024-01-01 11:20:00")]
    spark.createDataFrame(rows, "analysis_id long, ord long, path string, arrived string").withColumn("arrived", F.to_timestamp("arrived")).write.parquet(src)
    hits = scoring.hits_by_window(scoring.changed_stream(spark, src))
    hits.writeStream.format("memory").queryName("hits_by_window").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(r.hour, r.n) for r in spark.sql("SELECT hour(window.start) AS hour, n FROM hits_by_window WHERE signal = 'authentication_change'").collect()}
    assert got == {(10, 2), (11, 1)}


def test_small_readers_and_views(spark, tmp_path):
    from faultline.operators import export, store, views

    files = spark.createDataFrame([(0, "a/b.py"), (1, "node_modules/x.js"), (2, "venv")], "ord long, path string")
    assert [(r.filename, r.status) for r in diff.as_all_added(files).collect()] == [("a/b.py", "added")]
    listing = spark.createDataFrame([(".git", True), ("Zed", True), ("alpha", False), ("dist", True)], "name string, is_dir boolean")
    assert [r.name for r in readers.browse(listing, ["dist"]).collect()] == ["alpha", "Zed"]
    folders = spark.createDataFrame([("src/Auth",), ("a/b/c/auth",), ("docs",)], "path string")
    assert [r.path for r in readers.find_directories(folders, "auth").collect()] == ["src/Auth"]
    xml = '<manifest><application><activity><intent-filter><action xmlns:android="u" android:name="go"/></intent-filter></activity></application></manifest>'
    assert spark.range(1).select(readers.manifest_filters(F.lit(xml), "activity")).first()[0] == ["go"]
    assert spark.range(1).select(P.missing_variables(F.lit("{{ a }} {{b}} {{ a }}"), ["b"])).first()[0] == ["a"]
    statements = spark.createDataFrame([("FACT", 1), ("INFERENCE", 2)], "statement_type string, n int")
    assert views.of_type(statements, "ALL").count() == 2 and [r.n for r in views.of_type(statements, "FACT").collect()] == [1]
    stored = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert sorted((r.k, r.v) for r in store.replace_partition(stored, spark.createDataFrame([("a", 9)], "k string, v int"), "k").collect()) == [("a", 9), ("b", 3)]
    s, ev, inputs = scored(spark, ["src/auth/login.py"])
    sums = risk.scores(ev, inputs)
    export.write_json(sums, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().export_format == "json"
