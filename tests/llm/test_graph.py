import random

from recoup.llm.graph import components


def brute(edges):
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    return {x: find(x) for x in of}


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (-3, 2**40)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
