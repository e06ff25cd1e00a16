"""What a stateful stream asks of its state, without Spark."""

import types

import numpy as np
import pandas as pd

from verdant.operators.statespace import Quality, crossing_of_each_prefix, crossing_so_far, quality_row, quality_step
from verdant.streaming import stateful

DAY = stateful.DAY_MS


class Handle:
    """State of one key, its timers, and the number of calls."""

    def __init__(self):
        self.timers, self.calls = set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        held = []

        def put(x=None):
            self.calls += 1
            held[:] = [] if x is None else [x]

        return types.SimpleNamespace(get=lambda: put(held[0]) or held[0] if held else None, update=put, clear=put)

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.remove(ms)

    def fired(self, p, key, now):
        """All timers before the watermark, as Spark does: each is deleted after its call."""
        out = []
        while due := sorted(t for t in self.timers if t < now):
            at = types.SimpleNamespace(getExpiryTimeInMs=lambda ms=due[0]: ms)
            out += p.handleExpiredTimer(key, types.SimpleNamespace(getCurrentWatermarkInMs=lambda: now), at)
            self.timers.discard(due[0])
        return out


def test_calls_are_by_key_and_the_row_at_the_watermark_is_due():
    h, p = Handle(), stateful.ScalarFilter(0.01, 0.05, 0.0, 1.0)
    p.init(h)
    b = pd.DataFrame({"ts": pd.to_datetime(np.arange(1000) * 60, unit="s"), "value": np.arange(1000.0)})
    list(p.handleInputRows((1,), iter([b[500:], b[:500]]), None))
    assert h.calls < 10 and len(h.timers) == 1
    got = pd.concat(h.fired(p, (1,), 500 * 60_000))
    assert len(got) == 501 and h.calls < 20 and len(h.timers) == 1
    assert len(pd.concat(h.fired(p, (1,), 1000 * 60_000))) == 499 and not h.timers


def test_versions_of_many_days_are_one_state():
    h, p = Handle(), stateful.LatestVersion()
    p.init(h)
    put = lambda *rows: pd.concat(p.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["day", "version"])]), None))
    assert len(put(*[(d, v) for d in range(300) for v in (7, 3)])) == 600
    assert h.calls < 10 and len(h.timers) == 1
    got = put((5, 9), (5, 2), (5, 9), (400, 1))
    assert got["action"].tolist() == ["stale", "superseding", "stale", "new"]
    assert got["superseded"].fillna(-1).tolist() == [-1, 7, -1, -1]
    h.fired(p, (1,), 6 * DAY + 1)
    assert put((6, 8))["action"].tolist() == ["superseding"] and put((2, 8))["action"].tolist() == ["new"]


def test_rows_in_plain_numbers():
    r, m = np.random.default_rng(1), Quality()
    for _ in range(200):
        x, p, y, u = r.normal(size=4)
        row = (x, abs(p) + 0.1, y if r.random() < 0.8 else np.nan, float(r.integers(0, 5)), u if r.random() < 0.8 else np.nan)
        assert quality_row(*row, m) == tuple(float(v[0]) for v in quality_step(*(np.array([v]) for v in row), m))
        s = r.normal(size=r.integers(1, 30))
        assert crossing_so_far(s, 0.3) == crossing_of_each_prefix(s[None], 0.3)[0, -1]
