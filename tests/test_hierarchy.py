import random

import pytest
from pyspark.sql import functions as F

from kavak.operators.hierarchy import ancestors, hierarchy, linked, named_edges

NODES, EDGES = "group long, node string", "group long, parent string, child string"


def brute(nodes, edges):
    """Fewest steps from each node to each ancestor, by walking up."""
    nodes, up = set(nodes), {}
    for g, p, c in edges:
        if (g, p) in nodes and (g, c) in nodes:
            up.setdefault((g, c), set()).add(p)
    out = {}
    for g, n in nodes:
        front, steps, seen = {n}, 0, set()
        while front:
            front = {p for x in front for p in up.get((g, x), ())} - seen
            seen |= front
            steps += 1
            for p in front:
                out[(g, p, n)] = steps
    return {(*k, v) for k, v in out.items()}


def random_forest(seed, n=60):
    rng = random.Random(seed)
    nodes, edges = [], []
    for g in range(4):
        names = [f"n{i}" for i in range(n)]
        nodes += [(g, x) for x in names]
        for i in range(1, n):
            if rng.random() < 0.9:
                edges.append((g, names[rng.randrange(i)], names[i]))
        if g % 2:
            edges = [e for e in edges if e[:1] + e[2:] != (g, "n0")] + [(g, names[rng.randrange(1, n)], "n0")]
    return nodes, edges


@pytest.mark.parametrize("whole", [50_000, 0])
def test_ancestors_are_brute_force(spark, whole):
    nodes, edges = random_forest(3)
    got = {tuple(r) for r in ancestors(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), whole).collect()}
    assert got == brute(nodes, edges)


def test_loop_with_a_tree_below(spark):
    nodes = [(1, x) for x in "abcde"]
    edges = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (1, "d", "e")]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    got = {tuple(r)[1:] for r in ancestors(n, e).collect()}
    assert ("a", "a", 3) in got and ("a", "e", 4) in got and ("c", "d", 1) in got and ("e", "a", 1) not in got
    for whole in (50_000, 0):
        rows = {r.node: r for r in hierarchy(n, e, whole).collect()}
        assert rows["a"].looped and not rows["d"].looped and rows["e"].below_loop and rows["a"].descendants == 5


def test_self_edge_and_single_node(spark):
    n, e = spark.createDataFrame([(1, "a"), (1, "b")], NODES), spark.createDataFrame([(1, "a", "a")], EDGES)
    assert [tuple(r) for r in ancestors(n, e).collect()] == [(1, "a", "a", 1)]
    rows = {r.node: r for r in hierarchy(n, e).collect()}
    assert rows["a"].looped and rows["b"].depth == 0 and rows["b"].path == ["b"]


def test_nested_sets(spark):
    nodes, edges = random_forest(5)
    rows = hierarchy(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).filter("not looped and not below_loop").collect()
    by = {(r.group, r.node): r for r in rows}
    assert all(r["last"] - r["first"] == r.descendants for r in rows)
    for r in rows:
        assert all(by[(r.group, p)]["first"] <= r["first"] <= by[(r.group, p)]["last"] for p in r.path)
        assert len(r.path) == r.depth + 1 and r.path[0] == r.root


def test_same_places_either_way(spark):
    nodes, edges = random_forest(9, 25)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    keep = ["group", "node", "path", "depth", "root", "descendants", "looped", "below_loop"]
    a = {(r.group, r.node): r for r in hierarchy(n, e).select(keep).collect()}
    b = {(r.group, r.node): r for r in hierarchy(n, e, 0).select(keep).collect()}
    for k, r in a.items():
        assert (r.looped, r.below_loop, r.descendants) == (b[k].looped, b[k].below_loop, b[k].descendants)
        if not r.looped and not r.below_loop:
            assert r == b[k]


def test_two_parents_take_the_fewest_steps(spark):
    n = spark.createDataFrame([(1, x) for x in "abcd"], NODES)
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (1, "a", "d")], EDGES)
    assert {tuple(r)[1:] for r in ancestors(n, e).collect()} >= {("a", "d", 1), ("b", "d", 2), ("c", "d", 1)}


def test_nulls_repeats_and_nothing(spark):
    n = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "x"), (1, "b")], NODES)
    e = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "a", None), (1, "zzz", "b"), (None, "a", "b")], EDGES)
    assert [tuple(r) for r in ancestors(n, e).collect()] == [(1, "a", "b", 1)]
    none_n, none_e = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    assert ancestors(none_n, none_e).count() == 0 and hierarchy(none_n, none_e).count() == 0 and linked(none_n, none_e).count() == 0


def test_names(spark):
    rows = spark.createDataFrame(
        [(1, "Hücre  Zarı", ["AYT Doku ", "TYT Su", None], None, 7), (1, "Doku", None, [" Organ"], 7), (1, "Organ", [], [], 7)],
        "plan_id long, topic string, dependencies array<string>, next_topics array<string>, node int",
    )
    nodes, edges = named_edges(rows, "plan_id", "topic", "dependencies", "next_topics")
    assert {tuple(r)[1:] for r in ancestors(nodes, edges).collect()} == {("Doku", "Hücre Zarı", 1), ("Doku", "Organ", 1)}


def test_large_group_is_split(spark):
    """A third of all nodes in one group, held by no single task."""
    wide = [(1, f"n{i}") for i in range(3000)]
    nodes = spark.createDataFrame(wide + [(2, "a"), (2, "b")], NODES)
    edges = spark.createDataFrame([(1, "n0", f"n{i}") for i in range(1, 3000)] + [(2, "a", "b")], EDGES)
    assert ancestors(nodes, edges, 1000).groupBy("group").agg(F.count("*").alias("n")).orderBy("group").collect()[0].n == 2999


def test_all_rows_and_ranges_are_the_same_either_way(spark):
    nodes, edges = random_forest(9, 25)
    nodes += [(9, x) for x in "ABC"]
    edges += [(9, "A", "B"), (9, "B", "A"), (9, "A", "C")]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    near = {(r.group, r.node): r for r in hierarchy(n, e).collect()}
    assert near == {(r.group, r.node): r for r in hierarchy(n, e, 0).collect()}
    assert near[(9, "C")].path == ["A", "C"] and near[(9, "C")].root == "A" and near[(9, "C")]["first"] is not None
