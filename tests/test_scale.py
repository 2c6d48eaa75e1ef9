"""Forms for large graphs against those for small ones and plain walks."""

import random
from collections import defaultdict

import pytest

from faultline.operators import centrality, traverse


def test_betweenness_by_levels_is_that_within_tasks(spark):
    """2,000 nodes in two repositories, parallel edges among them, from 60 sources each."""
    r = random.Random(3)
    rows = [(f"r{k % 2}", f"n{r.randrange(1000)}", f"n{r.randrange(1000)}") for k in range(7000)]
    edges = spark.createDataFrame(rows + rows[:300], "repo_id string, source string, target string")
    ids = spark.createDataFrame([(f"r{k % 2}", f"n{k // 2}") for k in range(2000)], "repo_id string, id string")
    some = ids.where("cast(substr(id, 2) as int) % 17 = 0")
    score = lambda most: {(x.repo_id, x.id): x.score for x in centrality.betweenness(ids, edges, some, most).collect()}
    within, levels = score(1 << 40), score(0)
    assert within.keys() == levels.keys() and len(within) == 2000 and sum(v > 0 for v in within.values()) > 1000
    assert all(levels[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in within.items())


def test_betweenness_of_small_graphs(spark):
    edges = [("a", "b"), ("b", "c"), ("b", "d"), ("c", "e"), ("d", "e"), ("e", "b"), ("x", "x")]
    e = spark.createDataFrame(edges, "source string, target string")
    ids = spark.createDataFrame([(c,) for c in "abcdexy"], "id string")
    both = [{x.id: round(x.score, 9) for x in centrality.betweenness(ids, e, None, most).collect()} for most in (0, 100)]
    assert both[0] == both[1] and both[0]["b"] > 0 and both[0]["y"] == 0
    assert centrality.betweenness(ids, e.limit(0), None, 0).where("score <> 0").count() == 0


def test_reach_of_folders_against_walks(spark):
    """Ninety folders, so more than one word of bits, over a graph with cycles in two repositories."""
    r = random.Random(8)
    files = [(f"r{k % 2}", f"f{k}", f"top{k % 7}/d{k % 90}/f{k}.py") for k in range(400)]
    edges = [(f"r{k % 2}", f"f{r.randrange(400) // 2 * 2 + k % 2}", f"f{r.randrange(400) // 2 * 2 + k % 2}") for k in range(450)]
    inside = [(q, i, "/".join(p.split("/")[:n])) for q, i, p in files for n in (1, 2)]
    found = traverse.reach_of_folders(spark.createDataFrame(inside, "repo_id string, id string, folder string"), spark.createDataFrame(edges, "repo_id string, source string, target string"))
    back, own = defaultdict(set), defaultdict(set)
    for q, s, t in edges:
        back[q, t].add(s)
    for q, i, folder in inside:
        own[q, folder].add(i)
    want = {}
    for (q, folder), ids in own.items():
        seen, todo = set(ids), list(ids)
        while todo:
            for s in back[q, todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        want[q, folder] = len(seen) - len(ids)
    assert {(x.repo_id, x.folder): x.reach for x in found.collect()} == want and len({f for _, f in want}) > 64


def test_graph_hash_of_any_ids(spark):
    """As json.dumps has it, for two repositories, one of them without edges; ids with quotes, letters of all planes and control characters."""
    import hashlib
    import json

    from faultline.operators import graph

    ids = ["a", 'q"uote', "é", "😀", "\x01", "back\\slash", "z", "a", "ß/ü"]
    nodes = [(q, i) for q in ("one", "two") for i in ids]
    edges = [("one", f"{a}->{b}") for a in ids for b in ids]
    schema = "repo_id string, id string"
    got = {x.repo_id: x.graph_hash for x in graph.graph_hash(spark.createDataFrame(nodes, schema).repartition(3), spark.createDataFrame(edges, schema).repartition(3)).collect()}
    said = lambda q: json.dumps({"edges": sorted(e for r, e in edges if r == q), "nodes": sorted(n for r, n in nodes if r == q)})
    assert got == {q: hashlib.sha256(said(q).encode()).hexdigest() for q in ("one", "two")}
    assert graph.graph_hash(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).collect() == []
