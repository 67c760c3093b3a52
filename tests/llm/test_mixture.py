import math
import random

from tickloom.llm import mixture as m


def test_exponent_meets_the_entropy():
    p = [0.6, 0.3, 0.1]
    for a in (0.3, 1.0, 2.5):
        goal = m.entropy(m._normal([x**a for x in p]))
        assert abs(m.entropy_exponent(p, goal) - a) < 1e-6


def test_plan_bisects_to_the_repetition_limit():
    sizes, targets = {"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}
    free = m.plan(sizes, targets)
    assert free.exponent == 1.0 and math.isclose(free.total, 40) and math.isclose(free.budgets["b"], 20)
    tight = m.plan(sizes, targets, total=800)
    assert 0 < tight.exponent < 1
    assert math.isclose(tight.budgets["b"], 20, rel_tol=1e-6) and math.isclose(sum(tight.budgets.values()), 800, rel_tol=1e-6)
    assert m.plan({}, targets).budgets == {} and m.plan({"a": 5}, targets).budgets == {"a": 5.0}


def test_tempered_bisects_to_entropy_or_limit():
    sizes, targets = {"a": 900, "b": 90, "c": 10}, {"a": (0.5, 3), "b": (0.3, 3), "c": (0.2, 3)}
    free = m.tempered(sizes, targets, total=100)
    goal = m.entropy([0.5, 0.3, 0.2])
    assert abs(m.entropy(m._normal(list(free.budgets.values()))) - goal) < 1e-6 and 0 < free.exponent < 1
    tight = m.tempered(sizes, targets)
    assert free.exponent < tight.exponent < 1 and tight.total == 1000
    assert math.isclose(sum(tight.budgets.values()), 1000, rel_tol=1e-9) and math.isclose(tight.budgets["c"], 30, rel_tol=1e-6)


def test_tempered_mixture_uses_the_whole_total(spark):
    docs, targets = build(spark)
    uses, plan, sized = m.mixture(docs, targets, way=m.tempered)
    got = {r.source: r for r in m.reached(uses, plan, sized, targets).collect()}
    assert sum(r.mixed_tokens for r in got.values()) > 0.97 * plan.total
    for r in got.values():
        assert r.most_uses <= r.max_repeats and abs(r.mixed_tokens - r.budget) <= 60


def build(spark, seed=1, n=400):
    rng = random.Random(seed)
    names = ["desk_chat", "Desk-Chat ", "DESK_CHAT", "wiki", "unlisted", None, "rare"]
    docs = [(i, rng.choice([None, ""]) if rng.random() < 0.05 else "word " * rng.randrange(1, 40), rng.choices(names, [30, 2, 2, 20, 5, 2, 3])[0]) for i in range(n)]
    targets = [("desk_chat", 0.5, 1), ("wiki", 0.3, 1), ("rare", 0.2, 4), ("absent", 0.1, 2), (None, 0.1, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_limits(spark):
    docs, targets = build(spark)
    uses, plan, sized = m.mixture(docs, targets)
    got = uses.collect()
    limit = {"desk_chat": 1, "wiki": 1, "rare": 4}
    assert len(got) == len({r.doc_id for r in got}) and all(1 <= r.uses <= limit[r.source] for r in got)
    report = {r.source: r for r in m.reached(uses, plan, sized, targets).collect()}
    assert set(report) == {"desk_chat", "wiki", "rare", "absent"}
    for name, share in (("desk_chat", 0.5), ("wiki", 0.3), ("rare", 0.2)):
        assert abs(report[name].reached_share - share) < 0.02
    assert report["absent"].mixed_tokens == 0
    flat = m.spread(uses).collect()
    assert len(flat) == sum(r.uses for r in got)
    again, _, _ = m.mixture(docs.repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_empty(spark):
    docs, targets = build(spark)
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        uses, plan, sized = m.mixture(d, t)
        assert uses.count() == 0
        assert m.reached(uses, plan, sized, t).count() == t.where("source is not null").count()
