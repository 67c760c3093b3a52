"""Trades, statistics and excursions of all exits, by a loop over their outcomes."""

from collections import defaultdict

import __spark_entry__ as entry
from tickloom.operators.simulate import EXITS

QUERIES = entry.queries()


def test_greedy_over_all_exits(spark, data):
    groups = defaultdict(list)
    for r in QUERIES["exit_outcomes"](spark, data).where("pnl is not null").collect():
        groups[r.instrument, r.sday, r.exit_id, r.dir].append((r.tmin, r.exit_tmin, r.pnl))
    want = set()
    for key, events in groups.items():
        free = -1
        for start, end, pnl in sorted(events):
            if start >= free:
                want.add((*key, start, end, round(pnl, 6)))
                free = end
    got = QUERIES["greedy_trades"](spark, data).collect()
    assert {(r.instrument, r.sday, r.exit_id, r.dir, r.tmin, r.exit_tmin, round(r.pnl, 6)) for r in got} == want and len(got) == len(want)
    assert {r.exit_id for r in got} == {e[0] for e in EXITS}
    stats = {(r.instrument, r.exit_id, r.dir): r.n for r in QUERIES["rule_stats"](spark, data).collect()}
    counts = defaultdict(int)
    for w in want:
        counts[w[0], w[2], w[3]] += 1
    assert stats == counts
    assert {(r.instrument, r.sday, r.tmin, r.exit_id, r.dir) for r in QUERIES["mae_mfe"](spark, data).collect()} == {(w[0], w[1], w[4], w[2], w[3]) for w in want}
