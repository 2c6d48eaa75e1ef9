"""What the eighth round's findings were about, on small frames."""

import duckdb

from faultline.operators import centrality, traverse

SF = "/root/testdata/sf0.001"


def test_hubs_in_blast_are_hubs_by_degree_that_the_search_reaches(spark):
    """On the tables, against a plain search and count; the hubs come by degree, not in node order."""
    from faultline.plans import catalogue

    nodes, edges, seeds = (x.collect() for x in catalogue.tables(spark, SF))
    kind, ord_, degree = {n.id: n.kind for n in nodes}, {n.id: n.ord for n in nodes}, {}
    for e in edges:
        for end in (e.source, e.target):
            degree[end] = degree.get(end, 0) + 1
    hubs = sorted((n for n in degree if n in kind and kind[n] not in centrality.HUB_EXCLUDED), key=lambda n: (-degree[n], ord_[n]))[:10]
    seen = level = {s.node for s in seeds if kind[s.node] not in traverse.CONTAINER_KINDS}
    for _ in range(3):
        level = {e.source for e in edges if e.target in level and e.relationship in traverse.IMPACT_RELATIONS and e.edge_type not in ("CONFIG_REFERENCE", "BUILD_DEPENDENCY")} - seen
        level = {n for n in level if kind[n] not in traverse.CONTAINER_KINDS}
        seen = seen | level
    want = [h for h in hubs if h in seen][:5]
    assert want and [r.ids for r in catalogue.QUERIES["hubs_in_blast"](spark, SF).collect()] == ["|".join(want)]
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert con.execute(catalogue.ORACLES["hubs_in_blast"]).fetchall() == [("|".join(want),)]


def test_hubs_are_ranked_by_degree_before_the_first_five_are_taken(spark):
    n = 8
    nodes = spark.createDataFrame([(f"h{k}", "class", k) for k in range(n)], "id string, kind string, ord long")
    edges = spark.createDataFrame([(f"h{k}", f"x{j}") for k in range(n) for j in range(k + 1)], "source string, target string")
    found = spark.createDataFrame([("a", f"h{k}") for k in range(n)], "key string, node string")
    got = traverse.in_blast(centrality.ranked(centrality.hubs(nodes, edges), "degree"), found).first().ids
    assert got == [f"h{k}" for k in range(n - 1, n - 6, -1)]


def test_nodes_resolve_no_import(spark, monkeypatch):
    """The nodes of a graph do not wait for its imports."""
    from faultline.operators import graph
    from faultline.plans import catalogue

    def fail(*_):
        raise AssertionError("resolved")

    monkeypatch.setattr(graph, "resolve_imports", fail)
    assert {r.kind for r in catalogue.QUERIES["graph_nodes"](spark, SF).collect()} >= {"file", "class", "function"}


def test_each_question_is_answered_once(spark, monkeypatch):
    """Two thousand files with the same five imports are five questions, or one a folder where the import is relative."""
    from faultline.operators import graph

    sizes, real = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: sizes.append((kept := real(df)).count()) or kept)
    files = [("r", k, f"d{k % 4}/f{k}.py", None, []) for k in range(2000)]
    sources = ["d1/f1", "d2.f2", "./f3", "f7.py", "nowhere.at.all"]
    imports = [("r", k, f"d{k % 4}/f{k}.py", n, s) for k in range(2000) for n, s in enumerate(sources)]
    f = spark.createDataFrame(files, "repo_id string, ord long, file_path string, package_name string, defined_classes array<string>")
    i = spark.createDataFrame(imports, "repo_id string, ord long, file_path string, k int, source_module string")
    found = graph.resolve_imports(i, f)
    assert found.columns == [*i.columns, "target_path"] and max(sizes) <= 8
    want = {"d1/f1": "d1/f1.py", "d2.f2": "d2/f2.py", "f7.py": None, "nowhere.at.all": None}
    for x in found.collect():
        assert x.target_path == (want[x.source_module] if x.source_module in want else "d3/f3.py" if x.ord % 4 == 3 else None)


def test_aliases_that_make_an_import_relative(spark):
    from faultline.operators import graph

    files = [("r", k, p, None, []) for k, p in enumerate(["a/x.py", "b/x.py", "b/y.py"])]
    f = spark.createDataFrame(files, "repo_id string, ord long, file_path string, package_name string, defined_classes array<string>")
    imports = [("r", 0, "a/m.py", 0, "#x"), ("r", 1, "b/m.py", 0, "#x"), ("r", 2, "b/m.py", 0, "~./y"), ("r", 3, "a/m.py", 0, "~./y"), ("r", 4, "a/m.py", 0, None)]
    i = spark.createDataFrame(imports, "repo_id string, ord long, file_path string, k int, source_module string")
    for aliases in ([("r", 1, "#", "./"), ("r", 2, "~", "")], [("r", 1, "#", " ./"), ("r", 2, "~", " ")]):
        got = graph.resolve_imports(i, f, spark.createDataFrame(aliases, "repo_id string, ord int, prefix string, replacement string")).collect()
        assert {x.ord: x.target_path for x in got} == {0: "a/x.py", 1: "b/x.py", 2: "b/y.py", 3: None, 4: None}


def test_lines_of_every_analysis_are_made_in_one_pass(spark):
    """A report reads its analyses once for all lines that each of them has, where it read them for each part."""
    from faultline.plans import catalogue

    plan = catalogue.report_lines(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") <= 15
