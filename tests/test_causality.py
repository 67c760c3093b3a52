"""No family and no feature at a bar changes when later bars are rewritten."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tickloom.operators import features, market, signals

K, SESSIONS, LENGTH, CUT_DAY, CUT_SM = 2, 14, 150, 10, 1010


def world(seed, later, drift=0.0):
    """Bars of one instrument from 09:30; those after the cut come from the generator ``later``."""
    rows, before, after = [], np.random.default_rng(seed), np.random.default_rng(later)
    c = 1000.0
    for day in range(SESSIONS):
        usual = 1.0
        for k in range(LENGTH):
            rng = before if (day, 930 + k) <= (CUT_DAY, CUT_SM) else after
            usual = 4.0 if k % 40 in range(15, 30) else 1.0
            o, c = c, max(500.0, c + usual * rng.normal(drift * (1 if day % 2 else -1), 1) * 0.5)
            rows.append((15000 + day, (15000 + day) * 1440 + k, 930 + k, o, max(o, c) + abs(rng.normal()) * 0.3, min(o, c) - abs(rng.normal()) * 0.3, c, float(rng.integers(1, 200)), 0, False))
    return rows


NAMES = "sday int, tmin bigint, sm int, o double, h double, l double, c double, v double, seg int, rw boolean"


@pytest.fixture(scope="module")
def bars(spark):
    one = None
    for name, later in (("NQ", 1), ("XNQ", 2)):
        es = "ES" if name == "NQ" else "XES"
        for who, seed in ((name, 11), (es, 12)):
            df = spark.createDataFrame(world(seed, later + 10 * seed, 0.15), NAMES).withColumn("instrument", F.lit(who))
            one = df if one is None else one.unionByName(df)
    return one.withColumn("pos", F.col("sm") - 930).cache()


def early(df, columns, name):
    kept = df.where(F.col("instrument") == name).where(F.col("tmin") <= (15000 + CUT_DAY) * 1440 + CUT_SM - 930)
    return sorted(map(repr, kept.select("tmin", *columns).collect()))


def same(df, columns=("state",), least=1):
    a, b = early(df, columns, "NQ"), early(df, columns, "XNQ")
    assert a == b and len(a) >= least


SINGLE = {
    "e07": lambda x: signals.e07(x, 30, 0.6), "e09": lambda x: signals.e09(x, 15, 0.1), "e10": lambda x: signals.e10(x, 15, 0.5, K), "e17": lambda x: signals.e17(x, 60, 0.8), "e18": lambda x: signals.e18(x, K, 0.5),
    "e19": lambda x: signals.e19(x, K, 0.2), "e20": lambda x: signals.e20(signals.with_labels(x, F.when(F.col("c15"), F.col("direction15")).otherwise(0)), K, 0.3), "e24": lambda x: signals.e24(x, 30, 0.01, K),
    "e25": lambda x: signals.e25(x, 30, 1, K), "e26": lambda x: signals.e26(x, 30, 0.5), "e27": lambda x: signals.e27(x, 30, 1.0), "e28": lambda x: signals.e28(x, 30, 0.5, K),
    "e21": lambda x: signals.e21(x, 8, 0.4, K), "e30": lambda x: signals.e30(x, 8, 0.9, K),
}


@pytest.fixture(scope="module")
def context(bars):
    both = bars.where("instrument in ('NQ', 'XNQ')")
    return signals.context(both, market.session_numbers(both), K).cache()


@pytest.mark.parametrize("name", list(SINGLE))
def test_families(context, name):
    same(SINGLE[name](context).where("state <> 0 and c15" if name != "e30" else "state <> 0"), least=0 if name in ("e21", "e30") else 1)


def test_path_families(context):
    found = signals.path_signals(context, K, K)
    same(found, ("family", "state"), 20)
    assert {r.family for r in found.select("family").distinct().collect()} >= {"E01", "E03", "E04", "E05", "E06", "E15", "E22", "E23"}


@pytest.mark.parametrize("name", ["e12", "e13", "e14", "e29"])
def test_paired_families(bars, name):
    build = {"e12": lambda x: signals.e12(x, 15, 0.3, K, K), "e13": lambda x: signals.e13(x, K, 0.5), "e14": lambda x: signals.e14(x), "e29": lambda x: signals.e29(x, 30, 0.3, K)}[name]
    made = []
    for a, b in (("NQ", "ES"), ("XNQ", "XES")):
        made.append(build(signals.paired_context(bars, market.session_numbers(bars.where(F.col("instrument") == a)), a, b, K)).where("state <> 0").select("instrument", "tmin", "state"))
    same(made[0].unionByName(made[1]), least=0 if name == "e14" else 1)


def test_labels_wait_for_a_later_session(context):
    """A label may look ahead inside its session, so rewriting the rest of a session changes labels but no signal."""
    made = signals.with_labels(context, F.when(F.col("c15"), F.col("direction15")).otherwise(0)).where("label is not null")
    assert early(made, ("label",), "NQ") != [] and set(r.label for r in made.select("label").distinct().collect()) == {0.0, 1.0}


def test_logistic_separates():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    centre, spread, w = signals.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(np.c_[np.ones(400), (x - centre) / spread] @ w)))
    assert ((p > 0.5) == y).mean() > 0.88 and abs(w[1]) > 5 * abs(w[2]) and signals.fit_logistic(x[:20], y[:20]) is None
