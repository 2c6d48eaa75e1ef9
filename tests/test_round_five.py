"""What the fifth round's findings were about, on small frames."""

from faultline.sources import readers

ODD = [
    '<?xml version="1.0" encoding="utf-16"?><!-- <manifest/> --><manifest package="com.x" xmlns:a="u"><uses-permission a:name="p" tools:name="q" name="r" xmlns:name="s"/><application a:name=".App"><activity a:name="B" a:exported="true"/>'
    '<service a:name="org.y.S &amp; T"/><activity-alias a:name="B"/><activity a:name="B"/><receiver a:name=".R" a:exported="false"/><provider exported="true" name="P"/><x><activity a:name="Deep"/></x></application></manifest>',
    '<manifest><application><activity a:name="Main"/></application><application a:name="Two"><service a:name="é\n&#10;S"/></application><activity a:name="No"/></manifest>',
    '<manifest a:package="z"/>', "<p:manifest><p:application><p:service name='S'/></p:application></p:manifest>", "<other package='x'><manifest package='y'/></other>", "", None,
]


def test_manifests_are_parsed_once_each(spark):
    found = readers.manifest(spark.createDataFrame([(str(k), t) for k, t in enumerate(ODD)], "path string, text string"))
    assert "xpath" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.path: r for r in found.collect()}
    parts = lambda k: [(c.kind, c.name, c.exported) for c in got[k].components]
    assert (got["0"].package_name, got["0"].application_class, sorted(got["0"].permissions)) == ("com.x", "com.x.App", ["p", "q", "r"])
    one = [("activity", "com.x.B", True), ("activity", "com.x.B", True), ("service", "org.y.S & T", False), ("receiver", "com.x.R", False), ("provider", "com.x.P", True), ("activity", "com.x.B", False)]
    assert parts("0") == [("application", "com.x.App", False), *one]
    assert (got["1"].package_name, got["1"].application_class) == ("", "Two") and [x[0] for x in parts("1")] == ["application", "activity", "service"]
    assert got["2"].package_name == "z" and parts("3") == [("service", "S", False)]
    assert got["2"].components == got["4"].components == [] and got["4"].package_name == got["5"].package_name == got["6"].package_name == ""
    assert got["5"].components is got["6"].components is got["6"].permissions is None


def test_graph_ids_are_sorted_in_many_tasks(spark):
    """No task sorts a repository's ids whole: they are read in order from sorted files, also where a repository goes over several."""
    import hashlib
    import json

    from pyspark.sql import functions as F

    from faultline.operators import graph

    rows = [(q, f"{k * 7919 % 1000}\u00e9") for q, n in ((None, 40), ("a", 3), ("b", 900), ("c", 1), ("d", 2)) for k in range(n)]
    nodes = spark.createDataFrame(rows, "repo_id string, id string")
    edges = nodes.where("repo_id <> 'c'").select("repo_id", F.concat("id", F.lit("->"), "id").alias("id"))
    found = graph.graph_hash(nodes, edges)
    assert not [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Sort" in x]
    ids = lambda q: sorted(i for r, i in rows if r == q)
    said = lambda q: json.dumps({"edges": [] if q in (None, "c") else sorted(f"{i}->{i}" for i in ids(q)), "nodes": ids(q)})
    assert sorted((x.repo_id or "", x.graph_hash) for x in found.collect()) == sorted((q or "", hashlib.sha256(said(q).encode()).hexdigest()) for q in (None, "a", "b", "c", "d"))


def test_equally_alike_files_do_not_take_a_round_each(spark, monkeypatch):
    """60 lost and 60 new files, each as much alike as any other: as the greedy choice, in few written tables; also by rounds alone."""
    from faultline.operators import snapshots

    rows = [(q, f"old/{a * 7 % 60:02}", f"new/{b * 11 % 60:02}", 0.5 + (a % 3 == b % 3) / 4) for q in ("r", "s") for a in range(60) for b in range(60 if q == "r" else 2)]
    pairs = spark.createDataFrame(rows, "repo_id string, old_path string, path string, similarity double")
    old, new, want = set(), set(), set()
    for q, a, b, s in sorted(rows, key=lambda x: (x[0], -x[3], a_name(x[1]) != a_name(x[2]), x[1], x[2])):
        if (q, a) not in old and (q, b) not in new:
            old.add((q, a))
            new.add((q, b))
            want.add((q, a, b, s))
    written = []
    monkeypatch.setattr(snapshots, "keep", lambda df, keep=snapshots.keep: written.append(1) or keep(df))
    got = snapshots.one_to_one(pairs)
    assert {tuple(r) for r in got.select("repo_id", "old_path", "path", "similarity").collect()} == want and len(want) == 62 and len(written) < 6
    few = pairs.where("repo_id = 'r' AND old_path < 'old/06' AND path < 'new/06' OR repo_id = 's'")
    rows_of = lambda d: {tuple(r) for r in d.select("repo_id", "old_path", "path").collect()}
    at_once = rows_of(snapshots.one_to_one(few))
    monkeypatch.setattr(snapshots, "AT_ONCE", 20)
    assert rows_of(snapshots.one_to_one(few)) == at_once


def a_name(path):
    return path.split("/")[-1]
