"""The ledger's pieces against a plain version of what was believed at any time."""

from datetime import timedelta

from test_history import SCHEMA, T0, feed, plain_periods

from evimem.operators import history as H


def believed(rows, memory, at):
    """Version and end of each start, of what was recorded by `at`."""
    best = {}
    for r in {r[0]: r for r in rows}.values():
        if r[1] == memory and r[7] <= at:
            start = r[5] or r[7]
            if start not in best or (r[7], r[0]) > (best[start][7], best[start][0]):
                best[start] = r
    starts = sorted(best)
    ends = [min([x for x in (best[s][6] if best[s][6] and best[s][6] > s else None, after) if x], default=None) for s, after in zip(starts, [*starts[1:], None][: len(starts)], strict=True)]
    return {(s, best[s][0], e) for s, e in zip(starts, ends, strict=True)}


def test_beliefs_at_any_time(spark):
    for seed, n, memories in ((1, 60, 3), (2, 300, 10), (3, 120, 1)):
        rows = feed(seed, n, memories)
        pieces = H.ledger(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        for memory in sorted({r[1] for r in rows}):
            mine = [p for p in pieces if p["memory_id"] == memory]
            for day in range(-1, 14):
                at = T0 + timedelta(days=day)
                got = [(p["valid_from"], p["version_id"], p["valid_to"]) for p in mine if p["recorded_from"] <= at and (p["recorded_to"] is None or p["recorded_to"] > at)]
                assert len(got) == len(set(got)) and set(got) == believed(rows, memory, at), (memory, at)
        assert len(pieces) <= 2 * len({r[0] for r in rows})


def test_open_pieces_are_the_periods(spark):
    rows = feed(4, 300, 10)
    by = {r[0]: r for r in rows}
    merged = {}
    for p in sorted((p for p in H.ledger(spark.createDataFrame(rows, SCHEMA)).collect() if p["recorded_to"] is None), key=lambda p: (p["memory_id"], p["valid_from"])):
        periods, mark = merged.setdefault(p["memory_id"], []), (by[p["version_id"]][2], by[p["version_id"]][4])
        if periods and periods[-1][2] == p["valid_from"] and periods[-1][3] == mark:
            periods[-1][2] = p["valid_to"]
        else:
            periods.append([p["valid_from"], p["version_id"], p["valid_to"], mark])
    found = {(m, x[1], after[1] if after and x[2] == after[0] else 0) for m, xs in merged.items() for x, after in zip(xs, [*xs[1:], None], strict=True)}
    assert found == plain_periods(rows)


def test_late_row_splits_an_earlier_one(spark):
    day = lambda n: T0 + timedelta(days=n)
    rows = [(1, "m", "a", 0.5, "x", day(0), None, day(0), None, None), (2, "m", "b", 0.5, "x", day(3), None, day(5), None, None), (2, "m", "b", 0.5, "x", day(3), None, day(5), None, None)]
    got = {tuple(r)[1:] for r in H.ledger(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, day(0), None, day(0), day(5)), (1, day(0), day(3), day(5), None), (2, day(3), None, day(5), None)}
    assert H.ledger(spark.createDataFrame([], SCHEMA)).collect() == []
