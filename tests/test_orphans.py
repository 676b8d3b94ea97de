import random
from datetime import datetime, timedelta

from lodestone.operators import orphans

P = "chunk string, lid string, row bigint, at timestamp_ntz, gone timestamp_ntz, extra string, scope string"
R = "id bigint, chunk string, subject string, object string, at timestamp_ntz, ref_id string"
T = datetime(2023, 1, 1)


def _frames(spark, parents, refs):
    p = orphans.parent_rows(spark.createDataFrame(parents, P), "chunk", "lid", "row", "at", "gone")
    r = orphans.reference_rows(spark.createDataFrame(refs, R), "chunk", "id", "at", ["subject", "object"])
    return p, r


def _brute(parents, refs):
    out = set()
    for i, c, s, o, at, _ in refs:
        for slot, x in (("subject", s), ("object", o)):
            if x is None or not x.strip():
                continue
            own = [p for p in parents if c is not None and p[0] == c and p[1] and p[1].strip() == x.strip()]
            live = [p for p in own if p[4] is None]
            if not own:
                out.add((i, slot, "missing"))
            elif not live:
                out.add((i, slot, "deleted"))
            elif at is not None and any(p[3] is not None for p in live) and min(p[3] for p in live if p[3] is not None) > at:
                out.add((i, slot, "late"))
    return out


def _random(n, seed):
    g = random.Random(seed)
    day = lambda: T + timedelta(days=g.randint(0, 900), seconds=g.randint(0, 9))
    ids = ["e1", " e1", "e2", "E2", "e3 ", "", None]
    parents = []
    for k in range(n):
        at = day()
        nowhen = g.random() < 0.15
        parents.append((g.choice(["a", "b", "c", None]), g.choice(ids), k, None if nowhen else at, at + timedelta(days=g.randint(1, 300)) if g.random() < 0.5 else None, "x", "y"))
    refs = [(k, g.choice(["a", "b", "c", "d", None]), g.choice(ids), g.choice(ids), day(), "z") for k in range(n)]
    return parents, refs


def test_against_brute_force_in_every_period(spark):
    parents, refs = _random(60, 3)
    for period in ("year", "quarter"):
        got = {(r.ref_id, r.slot, r.reason) for r in orphans.orphans(*_frames(spark, parents, refs), period).collect()}
        assert got == _brute(parents, refs)


def test_hot_key_and_repeated_rows(spark):
    parents = [("a", "e1", k, T + timedelta(days=2), None, "x", "y") for k in range(200)]
    refs = [(k % 150, "a", "e1", None, T, "z") for k in range(300)]
    got = orphans.orphans(*_frames(spark, parents, refs)).collect()
    assert len(got) == 150 and {r.reason for r in got} == {"late"}


def test_empty_tables(spark):
    assert orphans.orphans(*_frames(spark, [], [])).count() == 0
    got = orphans.orphans(*_frames(spark, [], [(1, "a", "e1", None, T, "z")])).collect()
    assert [(r.ref_id, r.slot, r.reason) for r in got] == [(1, "subject", "missing")]


def test_snapshots_follow_time(spark):
    parents = [("a", "e1", 1, datetime(2023, 8, 1), datetime(2024, 8, 1), "x", "y")]
    refs = [(1, "a", "e1", None, datetime(2023, 1, 5), "z")]
    got = {(r.known_until, r.reason) for r in orphans.snapshots(*_frames(spark, parents, refs), "quarter").collect()}
    assert (datetime(2023, 7, 1), "missing") in got and (datetime(2024, 7, 1), "late") in got and (None, "deleted") in got


def test_parents_of_unknown_arrival_can_be_deleted(spark):
    parents = [("a", "e1", 1, None, datetime(2022, 5, 1), "x", "y"), ("a", "e2", 2, T, None, "x", "y")]
    refs = [(1, "a", "e1", "e2", datetime(2021, 1, 5), "z"), (2, "a", "e2", None, datetime(2023, 2, 1), "z")]
    got = {(r.ref_id, r.slot, r.reason) for r in orphans.orphans(*_frames(spark, parents, refs)).collect()}
    assert got == {(1, "subject", "deleted"), (1, "object", "late")}


def test_snapshots_equal_a_new_evaluation_of_each_period(spark):
    parents, refs = _random(60, 5)
    p, r = _frames(spark, parents, refs)
    got = {(x.known_until, x.slot, x.reason): x.n for x in orphans.snapshots(p, r, "quarter").collect()}
    for hi in {k[0] for k in got}:
        then = [(*x[:4], x[4] if x[4] and (hi is None or x[4] < hi) else None, *x[5:]) for x in parents if hi is None or x[3] is None or x[3] < hi]
        made = [x for x in refs if hi is None or x[4] < hi]
        want = {}
        for _, slot, reason in _brute(then, made):
            want[slot, reason] = want.get((slot, reason), 0) + 1
        assert {k[1:]: n for k, n in got.items() if k[0] == hi and k[2] != "found"} == want


def test_a_period_writes_its_own_keys_only(spark):
    parents = [("a", f"e{k}", k, T, None, "x", "y") for k in range(500)] + [("a", "late", 900, datetime(2024, 3, 1), None, "x", "y")]
    refs = [(k, "a", f"e{k}", None, T, "z") for k in range(500)] + [(900, "a", "late", None, T, "z")]
    states = [s for _, s in orphans.replay(*_frames(spark, parents, refs), "year")]
    written = [states[-1].references.where(f"version = {v}").count() for v in (0, 1)]
    assert written == [501, 1] and states[-1].index.where("version = 1").count() == 1
