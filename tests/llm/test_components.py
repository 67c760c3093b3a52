import random

from tickloom.llm import components


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def check(spark, pairs):
    got = [tuple(r) for r in components.linked_groups(spark.createDataFrame(pairs, "a string, b string")).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == brute(pairs)


def test_random_graphs(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)]
    check(spark, pairs + [(None, "n001"), ("n002", None), ("", "n003"), ("n004", "n004"), *pairs[:5], *[(b, a) for a, b in pairs[:5]]])


def test_chain_star_and_hot_vertices(spark, monkeypatch):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    star = [("z", f"s{i:03d}") for i in range(150)]
    monkeypatch.setattr(components, "HOT_FROM", 10)
    monkeypatch.setattr(components, "HOT_SHARE", 20)
    check(spark, chain + star + [("s007", "t"), ("a", "s100")])


def test_empty(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert components.linked_groups(none).count() == 0


def test_reported_links(spark):
    trace = spark.createDataFrame([(" a\t", "b ", None), ("c", "c", None), (None, "a", "a")], "candidate_id string, exact_duplicate_of string, behavior_duplicate_of string")
    flags = "left_id string, right_id string, exact_signals boolean, exact_entries boolean, highly_overlapping boolean, behaviorally_similar boolean"
    pairs = spark.createDataFrame([("\td", " e", None, None, True, None), ("f", "g", None, False, None, False)], flags)
    got = components.linked_groups(components.reported_links(trace, pairs)).collect()
    assert sorted(tuple(r) for r in got) == [("a", "a"), ("b", "a"), ("d", "d"), ("e", "d")]
