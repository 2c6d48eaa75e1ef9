"""What the fourth round's findings were about, on small frames."""

from faultline.operators import traverse


def test_keys_without_a_candidate_in_their_blast_set_have_a_row(spark):
    candidates = spark.createDataFrame([(f"h{k}", k % 4) for k in range(8)], "id string, ord long")
    found = spark.createDataFrame([("a", f"h{k}") for k in range(8)] + [("b", "x"), ("b", "y")], "key string, node string")
    got = {r.key: r.ids for r in traverse.in_blast(candidates, found).collect()}
    assert got == {"a": ["h0", "h4", "h1", "h5", "h2"], "b": None}


def test_rules_by_plain_tests_are_those_of_rule_matches(spark):
    """On paths for each kind of mark, and their near misses; a rule's row comes once a path however many of its marks are there."""
    from pyspark.sql import functions as F

    from faultline.functions import paths as P
    from faultline.operators import risk
    from faultline.sources.adapters import SPECIAL

    rules = risk.builtin_rules(spark)
    more = [f"x/{m}{end}" for r in rules.collect() for m in [*(r.path_markers or []), *(r.file_names or [])] for end in ("", "a.py", "/y.ts", "_z.kt")]
    paths = spark.createDataFrame([(k % 3, k, p) for k, p in enumerate([*SPECIAL, *more, None, ""])], "analysis_id long, ord long, path string")
    want = paths.join(rules, P.rule_matches(F.col("path"), F.col("path_markers"), F.col("extensions"), F.col("file_names")))
    rows = lambda df: sorted((r.ord, r.path, r.signal) for r in df.select("ord", "path", "signal").collect())
    hits = risk.rule_hits(paths, rules)
    assert rows(hits) == rows(want) and len(rows(want)) > 300
    plain, slim = ({tuple(map(str, r)) for r in risk.rule_evidence(h, rules=t).collect()} for h, t in ((want, None), (hits, rules)))
    assert plain == slim


def test_signals_make_only_what_is_asked_for(spark):
    """The plan of signal and score alone has no text of a description; the rule table is not read from Python."""
    from faultline.operators import risk
    from faultline.sources import adapters as A

    plan = risk.dynamic_signals(A.inputs(spark, "/root/testdata/sf0.001")).select("analysis_id", "signal", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "downstream component(s)" not in plan and "format_string" not in plan
    assert "LogicalRDD" not in risk.builtin_rules(spark)._jdf.queryExecution().optimizedPlan().toString()


def test_substring_search_meets_few_paths_that_lack_the_needle(spark):
    """With 20,000 numbered paths each gram of six letters is in many; what is compared stays near what is found."""
    from faultline.operators import graph

    paths = [f"src/auth/green_lace_{k}.sql" for k in range(20000)]
    needles = [p[:-4] for p in paths[::50]] + ["ce_777", "nowhere/at_all", "auth/green_lace_1999", paths[7], "e", "green", paths[9] + "x"]
    rows = lambda values, c: spark.createDataFrame([("r", v) for v in values], f"repo_id string, {c} string")
    want = {n: min(p for p in paths if n in p) for n in needles if any(n in p for p in paths)}
    assert {x.needle: x.path for x in graph.containing(rows(needles, "needle"), rows(paths, "path")).collect()} == want
    matches = sum(n in p for n in set(needles) for p in paths if len(n) > graph.GRAM)
    assert graph.looked_up(rows(needles, "needle"), rows(paths, "path"))[1].count() <= 1.2 * matches


def test_all_similar_files_are_paired_however_many_share_a_line(spark):
    """Sixty lost and sixty fresh files with the same two lines and one or two of their own, some of them copies: all pairs are found."""
    from faultline.operators import snapshots

    text = lambda k: "\n".join(["shared one", "shared two", f"own {k % 50}"] + ([f"more {k % 50}"] if k % 7 == 0 else []))
    lost, fresh = ({f"{side}/{(k * 37) % 60}": text(k + off) for k in range(60)} for side, off in (("old", 0), ("new", 25)))
    frame = lambda files: spark.createDataFrame(list(files.items()), "path string, text string")
    lines = lambda t: set(t.split("\n"))
    common = {(a, b): len(lines(x) & lines(y)) for a, x in lost.items() for b, y in fresh.items()}
    want = {(a, b, n) for (a, b), n in common.items() if 2 * n >= 0.5 * (len(lines(lost[a])) + len(lines(fresh[b])))}
    got = [(r.old_path, r.path, r.common) for r in snapshots.similar_files(frame(lost), frame(fresh)).collect()]
    assert set(got) == want and len(got) == len(want) > 3000


def test_cycles_of_a_dense_component_from_few_neighbours_each(spark, monkeypatch):
    """As a plain walk over all edges has them, with enough neighbours at first and with one that has to be asked for again."""
    import random

    from faultline.operators import health

    r = random.Random(5)
    pairs = sorted({(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(4000)} | {("x", "y"), ("y", "x"), ("z", "z")})
    out = {s: sorted(t for a, t in pairs if a == s and t != s) for s, _ in pairs}
    want, seen = [], set()

    def walk(node, path):
        seen.add(node)
        for t in out.get(node, ()):
            if t in path:
                want.append([*path[path.index(t) :], t])
            elif t not in seen:
                walk(t, [*path, t])

    nodes = [f"n{k}" for k in range(300)]
    for n in nodes:
        if n not in seen:
            walk(n, [n])
    edges = spark.createDataFrame(pairs, "source string, target string")
    order = spark.createDataFrame([(n, k) for k, n in enumerate([*nodes, "x", "y", "z"])], "node string, ord long")
    for few in (health.NEIGHBOURS, 1):
        monkeypatch.setattr(health, "NEIGHBOURS", few)
        assert [x.cycle for x in health.cycles(edges, order).collect()] == want[:15]
