"""The cart processor on a plain handle, against a fold of the actions that came in time."""

import random

import pandas as pd
import pytest

from shopfloor.operators.carts import cart_step
from shopfloor.streaming.cart_state import _FIELDS, CartProcessor


class Cell(dict):
    """A map state (or, under the key None, a value state) in memory."""

    def exists(self):
        return len(self) > 0

    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Cell()

    getValueState = getMapState

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class Clock:
    def __init__(self, watermark=0):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def _processor(ttl=1000):
    p = CartProcessor(ttl)
    p.init(Handle())
    return p


def _run(p, actions, rng=None):
    rows = [(s, a, pid, q, True, True, 9, ts) for s, a, pid, q, ts in actions]
    if rng:
        rng.shuffle(rows)
    chunks = [pd.DataFrame(rows[i:i + 3], columns=_FIELDS) for i in range(0, len(rows), 3)]
    (out,) = p.handleInputRows(("x",), iter(chunks), Clock())
    lines = {int(r.product_id): int(r.quantity) for r in out.itertuples() if not pd.isna(r.quantity)}
    late = sorted(int(r.late_seq) for r in out.itertuples() if not pd.isna(r.late_seq))
    return lines, late


@pytest.mark.parametrize("seed", range(30))
def test_equals_fold_of_actions_in_time(seed):
    rng = random.Random(seed)
    acts = []
    for seq in range(rng.randrange(1, 40)):
        action = rng.choices(["add", "update", "remove", "clear", "view"], [5, 2, 1, 1, 1])[0]
        acts.append((seq, action, None if action == "clear" else rng.randrange(3), rng.choice([None, -1, 1, 2, 5]), seq))
    delivery = {a[0]: min(3, a[0] // 10 + (rng.random() < .3)) for a in acts}
    p, late = _processor(), []
    for n in range(4):
        again = [a for a in acts if delivery[a[0]] < n and rng.random() < .2]
        batch = [a for a in acts if delivery[a[0]] == n]
        if batch or again:
            lines, found = _run(p, batch + again, rng)
            late += found
    expect = {}
    for pid in range(3):
        mine = [a for a in acts if a[1] != "view" and a[2] in (pid, None)]
        cart = {}
        for a in mine:
            if not any(b[0] > a[0] and delivery[b[0]] < delivery[a[0]] for b in mine):
                cart_step(cart, a[1], pid, a[3], True, True, 9)
        expect.update(cart)
    assert lines == expect
    assert len(p.handle.timers) == 1 and p.handle.timers == {max(a[4] for a in acts) + 1000}


def test_odd_rows_and_expiry():
    p = _processor()
    lines, late = _run(p, [(1, "add", 1, 2, 50), (None, "add", 1, 2, 60), (2, "add", None, 1, None), (3, None, 1, 1, 55)])
    assert lines == {1: 2} and late == []
    (out,) = p.handleInputRows(("x",), iter([pd.DataFrame([(None, "add", 1, 2, True, True, 9, None)], columns=_FIELDS)]), Clock())
    assert list(out.reason.dropna()) == ["no seq"]
    assert _run(p, [(9, "add", 2, 1, 70), (9, "add", 2, 1, 70)]) == ({1: 2, 2: 1}, [9])
    assert _run(p, [(5, "clear", None, None, 65)]) == ({2: 1}, [5])          # the later line stays, and is told
    (out,) = p.handleExpiredTimer(("x",), Clock(2000), None)
    assert list(out.quantity) == [1] and out.expired.all()
    assert not p.lines.exists() and not p.clock.exists()


def test_a_trigger_on_a_large_cart_takes_few_calls_of_the_store():
    p, calls = _processor(), []
    for state in (p.lines, p.clock):
        for name in ("exists", "get", "update", "updateValue", "getValue", "containsKey", "iterator"):
            def counted(*a, _do=getattr(state, name), _name=name):
                calls.append(_name)
                return _do(*a)
            setattr(state, name, counted)
    rows = [(i, "add", i, 1, i) for i in range(300)]
    assert _run(p, rows)[0] == {i: 1 for i in range(300)} and _run(p, [(999, "remove", 7, None, 999)])[0].keys() == set(range(300)) - {7}
    assert len(calls) <= 12


def test_packed_actions_are_the_plain_ones(spark):
    from shopfloor.streaming import cart_state as CS
    rows = [(1, "add", 5, 2, True, False, 9, 1000), (None, None, None, None, False, False, None, None), (3, "view", 1, -1, True, True, 0, -5)]
    df = spark.createDataFrame(rows, "seq long, action string, product_id long, quantity int, p_exists boolean, p_active boolean, p_stock int, ts_ms long")
    got = [CS._unpacked(r[0]) for r in df.select(CS._packed()).collect()]
    assert got == [(1, "add", 5, 2, 1, 0, 9, 1000), (None, None, None, None, 0, 0, None, None), (3, None, 1, -1, 1, 1, 0, -5)]


class Due:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_a_bucket_of_carts_is_the_carts_alone_with_one_read_write_and_timer():
    from shopfloor.streaming import cart_state as CS
    rng, codes = random.Random(3), {a: str(i + 1) for i, a in enumerate(CS._ACTIONS)}
    bucket, alone, seq, calls = CS.CartBucketProcessor(1000), {}, 200, []
    bucket.init(Handle())
    for name in ("get", "update"):
        setattr(bucket.carts, name, lambda *a, _do=getattr(bucket.carts, name), _name=name: calls.append(_name) or _do(*a))
    rows_of = lambda pdf: sorted(map(str, pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)))
    for trigger in range(4):
        acts = {}
        for session in rng.sample([*range(60)], 40):
            for _ in range(rng.randrange(1, 5)):
                seq += 1
                action = rng.choice([*codes])
                acts.setdefault(f"s{session}" if session else None, []).append(
                    (2 * seq - rng.choice([0, 0, 181]), action, None if action == "clear" else rng.randrange(3), 2, True, True, 9, seq))
        expect, clock = [], Clock(seq - 300)
        for session, rows in acts.items():
            alone.setdefault(session, _processor())
            expect.append(next(alone[session].handleInputRows((session,), iter([pd.DataFrame(rows, columns=_FIELDS)]), clock)))
        packed = [(s, ",".join(codes.get(v, "" if v is None else str(int(v)) if not isinstance(v, str) else "") for v in row)) for s, rows in acts.items() for row in rows]
        rng.shuffle(packed)
        calls.clear()
        (out,) = bucket.handleInputRows((0,), iter([pd.DataFrame(packed[i::2], columns=["session_id", "fields"]) for i in range(2)]), clock)
        assert rows_of(out) == rows_of(pd.concat(expect)) and len(calls) <= 2
        assert bucket.handle.timers == {min(t for p in alone.values() for t in p.handle.timers)}
    watermark = sorted(t for p in alone.values() for t in p.handle.timers)[30]
    expect = [next(p.handleExpiredTimer((s,), Clock(watermark), None)) for s, p in alone.items() if min(p.handle.timers) <= watermark]
    fired = bucket.handle.timers.pop()
    (out,) = bucket.handleExpiredTimer((0,), Clock(watermark), Due(fired))
    assert len(expect) > 30 and rows_of(out) == rows_of(pd.concat(expect))
    assert bucket.handle.timers == {min(t for p in alone.values() for t in p.handle.timers if t > watermark)}
