import random
from fractions import Fraction

from tickloom.llm import setjoin

SCHEMA = "id string, token bigint"


def brute(sets):
    out, ids = set(), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if common and (10 * common >= 7 * len(x | y) or (common >= 5 and 10 * common >= 9 * min(len(x), len(y)))):
                out.add((a, b))
    return out


def make(seed, n=220, hot=6, universe=400):
    """Copies, near copies, subsets and supersets, with a third of all sets holding the same tokens."""
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        kind = rng.random()
        if sets and kind < 0.45:
            base = set(sets[rng.choice(list(sets))])
            for _ in range(rng.randrange(0, 4)):
                base.discard(rng.choice(sorted(base))) if base and rng.random() < 0.5 else base.add(rng.randrange(universe))
            if rng.random() < 0.3:
                base |= {rng.randrange(universe) for _ in range(rng.randrange(0, 60))}
            elif base and rng.random() < 0.3:
                base = set(rng.sample(sorted(base), max(1, len(base) // 2)))
        else:
            base = {rng.randrange(universe) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60]))}
        if rng.random() < 0.4:
            base |= set(rng.sample(range(1000, 1000 + hot), rng.randrange(1, hot)))
        if base:
            sets[f"c{i:04d}"] = base
    return sets


def frame(spark, sets):
    return spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], SCHEMA)


def test_against_brute_force(spark):
    for seed, options in ((1, {}), (2, {"often": 2}), (3, {"often": 8, "part": 3}), (5, {"often": 0, "short": 1}), (6, {"often": 20, "short": 4, "part": 2})):
        sets = make(seed)
        got = [(r.left_id, r.right_id) for r in setjoin.similar_pairs(frame(spark, sets), **options).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(sets), options


def test_counts_without_expanding_copies(spark):
    sets = make(4)
    want = {i: 0 for i in sets}
    for a, b in brute(sets):
        want[a] += 1
        want[b] += 1
    assert {r.id: r.links for r in setjoin.similar_counts(frame(spark, sets), often=4).collect()} == want


def test_class_pairs_and_membership(spark):
    sets = make(7)
    pairs, members = setjoin.class_pairs(frame(spark, sets), often=4)
    head = dict(tuple(r) for r in members.collect())
    assert head == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == {(min(head[a], head[b]), max(head[a], head[b])) for a, b in brute(sets) if head[a] != head[b]}


def test_sets_of_hundreds_of_frequent_tokens(spark):
    rng = random.Random(8)
    sets = {f"d{i:04d}": set(rng.sample(range(400), 200)) | {1000 + 40 * i + j for j in range(40)} for i in range(600)}
    for i in range(0, 600, 60):  # a near copy each and a subset
        near = sorted(sets[f"d{i:04d}"])
        sets[f"e{i:04d}"], sets[f"f{i:04d}"] = set(near[6:]), set(near[::3])
    got = {(r.left_id, r.right_id) for r in setjoin.similar_pairs(frame(spark, sets)).collect()}
    assert got == brute(sets)


def test_odd_rows(spark):
    rows = [("a", 1), ("a", 1), ("b", 1), (None, 1), ("c", None), ("d", 2)]
    assert [tuple(r) for r in setjoin.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [("a", "b")]
    assert setjoin.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert setjoin.similar_pairs(spark.createDataFrame([("a", 1)], SCHEMA), jaccard=Fraction(3, 5)).count() == 0
    cands = spark.createDataFrame([("a", [1, None, 3], [1, 1]), ("b", None, [1]), (None, [1], [1]), ("c", [], []), ("a", [1], [-1])], "candidate_id string, entry_indices array<int>, trade_sides array<tinyint>")
    assert sorted(tuple(r) for r in setjoin.entry_tokens(cands).collect()) == [("a", 256 - 1 + 128), ("a", 256 + 1 + 128)]
