"""The set-based walk against a queue."""

import random

import pytest

from kinmatch.operators import graph as G

SCHEMA = "src string, pos bigint, name string, description string, overlap_score int, link string"


def first_paths(edges, failed, start, depth):
    """Every simple path of companies that answer, shortest and then by positions; the first to each link counts."""
    answering = [e for e in edges if e[0] not in failed and e[5]]
    paths = [((), [start])]
    found = []
    for _ in range(depth):
        paths = [((*at, e[1]), [*seen, e[5]], e) for at, seen, *_ in paths for e in answering if e[0] == seen[-1] and e[5] not in seen[1:]]
        found += paths
    best = {}
    for at, seen, e in sorted(found, key=lambda p: (len(p[0]), p[0])):
        best.setdefault(e[5], (len(at), at, e))
    visited = {link: n + 1 for link, (n, _, _) in best.items() if n < depth and link not in failed and link != start}
    if start not in failed:
        visited[start] = 1
    return visited, best


def graph(seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(12)]
    edges = []
    for n in nodes:
        for pos in range(rng.randint(0, 4)):
            link = rng.choice(nodes + [n, None, ""])
            edges.append((n, pos, f"name {link}", "d", rng.randint(0, 3), link))
    return edges, {n for n in nodes if rng.random() < 0.15}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("depth", [1, 3])
def test_walk(spark, seed, depth):
    edges, failed = graph(seed)
    rows = spark.createDataFrame(edges, SCHEMA)
    broken = spark.createDataFrame([(f,) for f in failed], "src string")
    walk = G.expand(rows, "n0", depth, broken)
    visited, best = first_paths(edges, failed, "n0", depth)
    assert {r.url: r.depth for r in walk.visited.collect()} == visited
    found = walk.superset.collect()
    assert {r.link: (r.src, r.pos, r.overlap_score, r.depth) for r in found} == {
        link: (e[0], e[1], e[4], n) for link, (n, _, e) in best.items()
    }
    ranked = [r.link for r in G.ranked_superset(walk).orderBy("rank").collect()]
    assert ranked == sorted(best, key=lambda x: (-best[x][2][4], best[x][:2]))
    total = G.summary(walk).first()
    assert (total.total_companies_analyzed, total.total_competitors_found) == (len(visited), len(best))


def test_walks_written_out(spark):
    """A loop back to the start, a link met twice in one round, a failed company, and a dead end."""
    edges = [("a", 0, "b", "", 1, "b"), ("a", 1, "c", "", 2, "c"), ("b", 0, "c", "", 3, "c"), ("b", 1, "a", "", 0, "a"),
             ("c", 0, "d", "", 1, "d"), ("b", 2, "d", "", 2, "d"), ("d", 0, "e", "", 3, "e"), ("x", 0, "e", "", 3, "e")]
    rows = spark.createDataFrame(edges, SCHEMA)
    walk = G.expand(rows, "a", 3)
    assert {(r.url, r.depth) for r in walk.visited.collect()} == {("a", 1), ("b", 2), ("c", 2), ("d", 3)}
    assert {(r.link, r.src, r.depth) for r in walk.superset.collect()} == {("b", "a", 1), ("c", "a", 1), ("a", "b", 2), ("d", "b", 2), ("e", "d", 3)}
    without_b = G.expand(rows, "a", 3, spark.createDataFrame([("b",)], "src string"))
    assert {(r.link, r.src) for r in without_b.superset.collect()} == {("b", "a"), ("c", "a"), ("d", "c"), ("e", "d")}
    assert G.expand(rows, "a", 3, spark.createDataFrame([("a",)], "src string")).superset.count() == 0


def test_hot_source_and_hot_link(spark):
    """One source names most companies, and one company is named by all of them."""
    edges = [("a", i, f"n{i}", "d", i % 4, f"l{i}") for i in range(3000)]
    edges += [(f"l{i}", 0, "hub", "d", 1, "hub") for i in range(3000)]
    walk = G.expand(spark.createDataFrame(edges, SCHEMA).repartition(4), "a", 2)
    assert walk.visited.count() == 3001
    assert walk.superset.count() == 3001
    assert walk.superset.filter("link = 'hub'").first().src == "l0"
