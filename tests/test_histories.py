"""Histories from logs of single changes, coverage by several sources, and calendars of what is there."""

import datetime
import random

from pyspark.sql import functions as F

from lodestar.operators import reconcile, versions

D = datetime.date


def test_state_history(spark):
    rnd = random.Random(5)
    log = [(rnd.choice([1, 2, None]), rnd.choice([D(2024, 1, k) for k in range(1, 9)] + [None]), k, rnd.choice(["a", "b", "other"]), rnd.choice(["x", "y", None])) for k in range(120)]
    df = spark.createDataFrame(log, "e int, day date, seq int, column string, value string").repartition(3)
    got = versions.state_history(df, "e", "day", ["seq"], ["a", "b"]).collect()
    want = []
    for e in (1, 2):
        state, runs = {"a": None, "b": None}, []
        for day in sorted({r[1] for r in log if r[0] == e and r[1] and r[3] in state}):
            for r in sorted(log, key=lambda r: r[2]):
                if r[0] == e and r[1] == day and r[3] in state:
                    state[r[3]] = r[4]
            if not runs or runs[-1][1:] != (state["a"], state["b"]):
                runs.append((day, state["a"], state["b"]))
        for k, (day, a, b) in enumerate(runs):
            end = str(runs[k + 1][0] - datetime.timedelta(1)) if k + 1 < len(runs) else versions.OPEN_END
            want.append((e, k + 1, day, end, k + 1 == len(runs), a, b))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert versions.state_history(df.limit(0), "e", "day", ["seq"], ["a"]).collect() == []


def test_coverage(spark):
    sources = {"a": [1, 2, 2, 3, None], "b": [2, 3, 4], "c": [3, 3, 5, 2, 6], "d": []}
    frames = {n: spark.createDataFrame([(k,) for k in ks], "k int") for n, ks in sources.items()}
    got = {r.key: (r.rows_a, r.rows_b, r.rows_c, r.rows_d, r.missing, r.verdict) for r in reconcile.coverage(frames, "k").collect()}
    assert got == {
        "1": (1, 0, 0, 0, ["b", "c", "d"], "ONLY_a"), "2": (2, 1, 1, 0, ["d"], "LACKS_d"), "3": (1, 1, 2, 0, ["d"], "LACKS_d"), "4": (0, 1, 0, 0, ["a", "c", "d"], "ONLY_b"),
        "5": (0, 0, 1, 0, ["a", "b", "d"], "ONLY_c"), "6": (0, 0, 1, 0, ["a", "b", "d"], "ONLY_c"),
    }
    two = reconcile.coverage({n: frames[n] for n in "ac"}, "k")
    assert {r.verdict: (r["keys"], r.share) for r in reconcile.coverage_summary(two).collect()} == {"COMPLETE": (2, 0.4), "ONLY_a": (1, 0.2), "ONLY_c": (2, 0.4)}
    assert reconcile.coverage({"d": frames["d"]}, "k").collect() == []


def test_calendar_of(spark):
    df = spark.createDataFrame([(D(2023, 5, 1),), (D(2024, 2, 29),), (D(2024, 2, 29),), (None,)], "d date")
    got = versions.calendar_of(df, "d")
    assert got.count() == 365 + 366 and {r.date_iso: r["rows"] for r in got.where("rows > 0").collect()} == {"2023-05-01": 1, "2024-02-29": 2}
    assert got.agg(F.min("date_iso"), F.max("date_iso")).first() == ("2023-01-01", "2024-12-31")
    assert versions.calendar_of(df.where("d IS NULL"), "d").collect() == []
