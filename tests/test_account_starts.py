import __spark_entry__ as entry


def test_every_day_of_a_stream_starts_an_account(spark, data):
    got = entry.queries()["account_starts"](spark, data).select("entity", "start").collect()
    days = {}
    for r in got:
        days.setdefault(r.entity, []).append(r.start)
    assert any(len(x) > 1 for x in days.values())
    assert all(sorted(x) == list(range(min(x), max(x) + 1)) for x in days.values())
