"""Token buckets of keys with few and with very many waiting requests, and how often their state is looked at."""

from __future__ import annotations

import random
from datetime import timedelta

import numpy as np
import pytest

from lawframe.streaming import keyed
from tests.test_keyed import T0, looped, run


class State:
    """A key's value or map in memory, which counts the calls."""

    calls = 0

    def __init__(self):
        self.value, self.held = None, {}

    def __getattribute__(self, name):
        if name in ("get", "update", "clear", "getValue", "updateValue", "containsKey", "removeKey", "keys"):
            State.calls += 1
        return object.__getattribute__(self, name)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, k):
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v

    def containsKey(self, k):
        return k in self.held

    def removeKey(self, k):
        del self.held[k]

    def keys(self):
        return list(self.held)


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return State()

    getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.append(ms)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class Asked:
    def __init__(self, us, ident):
        self.us, self.id = us, ident


def test_a_key_is_few_calls():
    State.calls, handle = 0, Handle()
    settle = keyed.Settle(2.0, 0.01)
    settle.init(handle)
    days = [int(d * keyed.SLOT) for d in range(30)]  # a request a day
    list(settle.handleInputRows((1,), iter([Asked(us, i) for i, us in enumerate(days)]), None))
    got = list(settle.handleExpiredTimer((1,), At(days[-1] // 1000 + 10**9), None))
    assert [r.id for r in got] == list(range(30)) and State.calls <= 6 and len(handle.timers) == 1


@pytest.mark.parametrize("few", [3, 4096])
def test_small_and_large_keys_match_a_loop(spark, tmp_path, monkeypatch, few):
    rnd = random.Random(few)
    monkeypatch.setattr(keyed, "FEW", few)
    at = lambda: T0 + timedelta(seconds=rnd.randrange(5 * 86_400))
    state = keyed.Settle(2.0, 0.001)
    handle = Handle()
    state.init(handle)
    rows = [(1, at(), i) for i in range(60)]
    out, micros = [], lambda t: int(np.datetime64(t, "us").astype("int64"))
    for part in (rows[:2], rows[2:5], rows[5:]):
        list(state.handleInputRows((1,), iter([Asked(micros(t), i) for _, t, i in part]), None))
    end = micros(T0)
    for day in (1, 2, 3, 9):
        out += list(state.handleExpiredTimer((1,), At((end + day * keyed.SLOT) // 1000), None))
    want = looped(rows, 2.0, 0.001)
    assert sorted(((1, micros(t), i, w) for _, t, i, w in want), key=repr) == sorted(((r.key, r.us, r.id, r.wait) for r in out), key=repr)
    assert not state.slots.held and state.state.value is None
    assert run(spark, tmp_path, [rows, [(0, T0 + timedelta(days=20), None)]], 2.0, 0.001) == want
