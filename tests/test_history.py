import datetime as dt
import random
from collections import defaultdict

from labelloom.operators.history import change_events, history
from labelloom.session import load
from labelloom.queries.problems import p1_found, version_states


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


SCHEMA = "k string, at timestamp, v int, extra string"


def brute(rows):
    states = defaultdict(dict)
    for k, at, v, _ in rows:
        if at is not None:
            old = states[k].get(at, "none")
            states[k][at] = v if old == "none" else min((x for x in (old, v)), key=lambda x: (x is not None, x))
    out = set()
    for k, seen in states.items():
        runs = []
        for at in sorted(seen):
            if not runs or runs[-1][1] != seen[at]:
                runs.append((at, seen[at]))
        out |= {(k, v, at, runs[i + 1][0] if i + 1 < len(runs) else None) for i, (at, v) in enumerate(runs)}
    return out


def test_random_against_brute_force(spark):
    pick = random.Random(3)
    rows = [("hot" if pick.random() < 0.4 else pick.choice(["a", "b", None]), day(pick.randrange(400)), pick.choice([1, 2, None]), "x") for _ in range(1500)]
    rows += [("a", None, 1, "x"), *rows[:50]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in history(df, ["k"], "at", ["v"]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([("a", day(0), None, "x")], SCHEMA)
    assert [tuple(r) for r in history(df, ["k"], "at", ["v"]).collect()] == [("a", None, day(0), None)]
    assert history(df.limit(0), ["k"], "at", ["v"]).count() == 0


def test_global_snapshots_tell_deletions(spark):
    rows = [("a", day(0), 1), ("b", day(0), 1), ("a", day(40), 1), ("a", day(80), 2), ("b", day(80), 1)]
    df = spark.createDataFrame(rows, "k string, at timestamp, v int")
    events = {tuple(r) for r in change_events(df, ["k"], "at", ["v"], scope="global").collect()}
    assert events == {("a", day(0), "inserted", 1), ("b", day(0), "inserted", 1), ("b", day(40), "deleted", None), ("a", day(80), "changed", 2), ("b", day(80), "inserted", 1)}
    spans = {tuple(r) for r in history(df, ["k"], "at", ["v"], scope="global").collect()}
    assert spans == {("a", 1, day(0), day(80)), ("a", 2, day(80), None), ("b", 1, day(0), day(40)), ("b", 1, day(80), None)}


def test_found_is_gapless(spark, sf):
    rows = [(r.set_id, r.retrieved_at, (r.version_no, r.effective_s), None) for r in version_states(load(spark, sf, "label_chunk")).collect()]
    text = lambda x: "9999-12-31 00:00:00" if x is None else str(x)
    assert {tuple(r) for r in p1_found(spark, sf).collect()} == {(k, v[0], text(a), text(b)) for k, v, a, b in brute(rows)}
