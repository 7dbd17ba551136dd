"""How often the streaming life cycle asks its state, and that its parts are cut again as they fill."""

import random
import re

from pyspark.sql import Row

from convlake.operators import lifecycle as L

from .test_lifecycle import brute, norm


class Kept:
    """A value or a map of state that counts the accesses to it."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def get(self, key=()):
        self.calls += 1
        return self.data.get(key)

    def put(self, *item):
        self.calls += 1
        self.data[item[0] if len(item) > 1 else ()] = item[-1]

    def has(self, key=()):
        self.calls += 1
        return key in self.data

    getValue, updateValue, update, containsKey, exists = get, put, put, has, has


class Handle:
    def __init__(self):
        self.kept = {}

    def getMapState(self, name, *schemas):
        return self.kept.setdefault(name, Kept())

    getValueState = getMapState


def by_keeper(rows, load, batches):
    """Actions, and the accesses to the state in each micro-batch."""
    keeper, handle, did, calls = L.Keeper(), Handle(), [], []
    keeper.LOAD = load
    keeper.init(handle)
    size, before = -(-len(rows) // batches), 0
    for k in range(batches):
        part = []
        for at, persona, content, _ in rows[k * size : (k + 1) * size]:
            n = norm(content)
            slot = next(((s, m[1]) for s, p in L.SLOTS if (m := re.match(p, n))), (None, None))
            part.append(Row(persona=persona, at=at, norm=n, slot=slot[0], value=slot[1]))
        did += [tuple(r) for r in keeper.handleInputRows(("p",), iter(part[::-1]), None)]
        now = sum(x.calls for x in handle.kept.values())
        calls.append(now - before)
        before = now
    return sorted(did, key=str), calls, len(handle.kept["parts"].data)


def test_the_state_is_asked_by_parts_not_by_rows():
    r = random.Random(3)
    rows = [(i, "p", r.choice(["I prefer a{}", "likes b{}", "{}"]).format(r.randrange(800)), "low") for i in range(4000)]
    want = brute(rows)[1]
    for load, batches, most in ((256, 1, 20), (256, 8, 40), (16, 8, 520), (10**6, 3, 4)):
        did, calls, parts = by_keeper(rows, load, batches)
        assert did == want and max(calls) <= most, (load, batches, calls)
        assert parts >= 2000 / load and parts & (parts - 1) == 0


def test_candidates_that_merge_write_nothing():
    assert by_keeper([(1, "p", "I prefer tea", "low"), (1, "p", "I prefer tea", "low")], 256, 2)[1] == [3, 2]
