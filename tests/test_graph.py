import numpy as np
from pyspark.sql import functions as F

from quarrylight.operators import graph


def brute(nodes, links, damping=0.85, rounds=30):
    n = len(nodes)
    rank = {v: 1 / n for v in nodes}
    out = {v: sorted({t for s, t in links if s == v and t != v}) for v in nodes}
    for _ in range(rounds):
        loose = sum(rank[v] for v in nodes if not out[v])
        new = {v: (1 - damping) / n + damping * loose / n for v in nodes}
        for v in nodes:
            for t in out[v]:
                new[t] += damping * rank[v] / len(out[v])
        rank = new
    return rank


def test_page_rank_both_ways(spark, monkeypatch):
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("d", "d"), ("a", "b")]
    nodes = ["a", "b", "c", "d"]
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(links, "source string, target string")
    want = brute(nodes, links)
    for bound in (10, 0):
        monkeypatch.setattr(graph, "ONE_TASK_NODES", bound)
        got = {r.node: r["rank"] for r in graph.page_rank(n, e).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_expand_and_impact(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5), ("x", "b", 0.1)], "source string, target string, weight double")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.distance) for r in graph.expand(e, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2), ("x", 2)}
    both = e.withColumn("graph", F.lit("g")).unionByName(e.withColumn("graph", F.lit("h")).where("source = 'b'"))
    targets = spark.createDataFrame([("g", "c"), ("h", "c")], "graph string, target string")
    found = graph.impact(both, targets)
    assert {(r.graph, r.path, r.distance) for r in found.collect()} == {("g", "c", 0), ("g", "b", 1), ("g", "a", 2), ("g", "x", 2), ("h", "c", 0), ("h", "b", 1)}
    assert [(r.path, r.position) for r in graph.affected(found).where("graph = 'g'").orderBy("position").collect()] == [("b", 1), ("a", 2), ("x", 3)]


def test_graphs_are_ranked_apart(spark, monkeypatch):
    links = [("g", "a", "b"), ("g", "b", "c"), ("h", "a", "c"), ("h", "c", "a")]
    nodes = [("g", x) for x in "abcd"] + [("h", x) for x in "ac"]
    n, e = spark.createDataFrame(nodes, "graph string, node string"), spark.createDataFrame(links, "graph string, source string, target string")
    want = {(g, k): v for g in "gh" for k, v in brute([x for h, x in nodes if h == g], [(s, t) for h, s, t in links if h == g]).items()}
    for bound in (10, 3, 0):
        monkeypatch.setattr(graph, "ONE_TASK_NODES", bound)
        got = {(r.graph, r.node): r["rank"] for r in graph.page_rank(n, e).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_related_tests(spark):
    files = spark.createDataFrame([("g", p) for p in ("src/cart.py", "tests/test_cart.py", "tests/test_cart_totals.py", "tests/test_ca.py", "tests/test_x.py", "src/y.py")] + [("h", "tests/test_cart.py")], "graph string, path string")
    edges = spark.createDataFrame([("g", "tests/test_x.py", "src/cart.py", "calls", 7, 0.7), ("g", "tests/test_cart.py", "src/cart.py", "tests", 3, 0.9), ("g", "src/y.py", "src/cart.py", "calls", 1, 0.7)], "graph string, source string, target string, relation string, line int, confidence double")
    targets = spark.createDataFrame([("g", "src/cart.py")], "graph string, target string")
    got = [(r.path, r.confidence, r.line) for r in graph.related_tests(files, edges, targets).orderBy("position").collect()]
    assert got == [("tests/test_cart.py", 1.0, 3), ("tests/test_x.py", 0.9, 7), ("tests/test_ca.py", 0.55, 1), ("tests/test_cart_totals.py", 0.55, 1)]


def test_map_choice_penalises_full_directories(spark):
    rows = [("a/1", 10.0), ("a/2", 9.9), ("b/1", 9.0), ("c", 1.0)]
    df = spark.createDataFrame(rows, "path string, score double")
    assert [r.path for r in graph.choose_map(df, 100).orderBy("position").collect()] == ["a/1", "b/1", "a/2", "c"]
    assert [r.path for r in graph.choose_map(df, 3).orderBy("position").collect()] == ["a/1", "b/1"]  # one token each, one between


def test_names_resolve_only_when_unique(spark):
    edges = spark.createDataFrame([(1, "f", "calls", "m.run", 0.5), (1, "f", "calls", "twice", 0.5)], "generation_id int, source_path string, relation string, target_name string, confidence double")
    symbols = spark.createDataFrame([(1, "s1", "run", "x.run"), (1, "s2", "twice", "a.twice"), (1, "s3", "twice", "b.twice")], "generation_id int, id string, name string, qualified_name string")
    got = {r.target_name: (r.resolved_id, r.resolved_confidence) for r in graph.resolve_names(edges, symbols).collect()}
    assert got == {"m.run": ("s1", 0.475), "twice": (None, 0.5)}
