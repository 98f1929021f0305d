"""Chains of versions: many slots cost few calls of the state, and tell what one slot at a time tells."""

import random

import pandas as pd

from factloom.streaming import state


class Kept(dict):
    """A map state that counts how often it is asked."""

    calls = 0

    def getMapState(self, *_):
        return self

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value


def versions_of(facts):
    """(slot, pkey) -> (at, version) of (slot, pkey) -> at."""
    slots = {}
    for (slot, _), at in facts.items():
        slots.setdefault(slot, []).append(at)
    return {k: (at, 1 + sum(x < at for x in slots[k[0]])) for k, at in facts.items()}


def test_many_slots_in_few_calls(monkeypatch):
    monkeypatch.setattr(state, "SPAN", 3000, raising=False)
    rnd, kept, chains, facts = random.Random(2), Kept(), state.Chains(), {}
    chains.init(kept)
    for size in (20_000, 9_000, 3, 9_000):
        rows = [(f"s{rnd.randrange(12_000)}", f"f{rnd.randrange(6)}", rnd.randrange(9)) for _ in range(size)]
        batch = pd.DataFrame(rows, columns=["slot", "pkey", "at"])
        batch["piece"] = batch["slot"].str[1:].astype(int) % 50
        before, kept.calls = versions_of(facts), 0
        out = list(chains.handleInputRows((0,), iter([batch[:100], batch[100:]]), None))
        for slot, pkey, at in rows:
            facts[slot, pkey] = max(at, facts.get((slot, pkey), at))
        after = versions_of(facts)
        told = [((r.slot, r.pkey), (r.at, r.version)) for frame in out for r in frame.itertuples()]
        assert len(told) == len(dict(told)) and dict(told) == {k: v for k, v in after.items() if before.get(k) != v}
        assert kept.calls <= 2 * min(50, size)
    assert list(chains.handleInputRows((0,), iter([batch]), None)) == []
