"""Vector codes against brute force in Python's integers: ties, repeats, nulls, huge values, chunks and blocks."""

import hashlib
import math
import random

import numpy as np
import pytest

from convlake.llm import vector_codes as V

KIND = "vec_id long, embedding array<double>, label int, code string, id long, n int"


def brute(rows, parts, entries, rounds):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    kept = [(k, [math.floor(256 * int(x)) if abs(x) > 2**60 else math.floor(256 * x) for x in v], label) for k, v, label, *_ in rows if ok(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    dims = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    d = dims // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for r in kept:
                own.setdefault(near(cut(r[1], p), books[p])[1], []).append(cut(r[1], p))
            books[p] = [[sum(c) // len(c) for c in zip(*own[i])] if i in own else e for i, e in enumerate(books[p])]
    out = []
    for k, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(x for x, _ in found), label))
    total = {}
    for *_, e, label in out:
        total[label] = total.get(label, 0) + e
    big = {label for *_, e, label in out if e >= 1 << 63} | {label for label, e in total.items() if e >= 1 << 63}
    return sorted(((k, c, e if e < 1 << 63 else None, None if label in big else total[label]) for k, c, e, label in out), key=str), books


def rows(n, dims, seed, scale=1.0):
    r = random.Random(seed)
    out = [(i, [r.choice([r.gauss(0, scale), round(r.gauss(0, scale), 1)]) for _ in range(dims)], [None, 1, 2, 1][i % 4], "c", 9, 9) for i in range(n)]
    out += [out[3], out[5], (None, [0.5] * dims, 1, "c", 9, 9), (None, out[0][1], None, "c", 9, 9), (3, [0.25] * dims, 2, "c", 9, 9)]
    bad = [None, [], [None] + [0.0] * (dims - 1), [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [1e308] * dims, [0.5] * (dims - 1)]
    return out + [(1000 + i, v, 1, "c", 9, 9) for i, v in enumerate(bad)]


@pytest.mark.parametrize("dims, parts, entries, scale", [(8, 4, 7, 1.0), (6, 2, 64, 0.01), (8, 2, 5, 1e7), (4, 4, 200, 3.0)])
def test_against_brute_force(spark, dims, parts, entries, scale):
    data = rows(150, dims, 7, scale)
    data = [r if not (r[1] and r[1][0] == 1e308) else (r[0], None, *r[2:]) for r in data]
    want, books = brute(data, parts, entries, 2)
    df = spark.createDataFrame(data, KIND).repartition(3)
    for few in (500_000, 0):
        out, got = V.fit_codes(df, parts=parts, entries=entries, few=few, chunk=70 if few else 4096, width=16 if few else 64)
        assert sorted((tuple(r) for r in out.collect()), key=str) == want and got == books
    assert V.digest(books) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_huge_values_are_exact():
    """Kernels with Python's integers: squares far over 64 bits."""
    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(100, 2)) * 1e25)
    kind, data = V.packed(x)
    assert kind == 3 and np.array_equal(np.frombuffer(data, dtype="<f8").reshape(100, 2), x)
    points = V.whole(x, True)
    book = points[:9]
    size = np.array([64, 36])
    low, high = np.minimum.reduceat(points, [0, 64]), np.maximum.reduceat(points, [0, 64])
    block, entry = V.shortlists(low, high, book)
    found, dist = V.kernel(points, size, block, entry, book, np.arange(2), 64)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(book)) for p in points]
    assert list(zip(dist.tolist(), found.tolist())) == want


def test_hilbert_steps_to_neighbours():
    """The curve visits every cell of a grid once and moves one cell at a time; sorted blocks have far shorter lists."""
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    place = V.hilbert(grid * ((1 << 16) - 1) / 7)
    assert len(set(place.tolist())) == 512 and np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1).max() == 1
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(1 << 15, 4)) * 256)
    x = x[np.argsort(V.hilbert(x), kind="stable")].astype(np.int64)
    edge = np.arange(0, len(x), 16)
    listed = lambda y: len(V.shortlists(np.minimum.reduceat(y, edge), np.maximum.reduceat(y, edge), x[::512])[0])
    assert listed(x) < 0.4 * listed(r.permutation(x))


def test_empty_and_indivisible(spark):
    out, books = V.fit_codes(spark.createDataFrame([], KIND))
    assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error"] and V.digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        V.fit_codes(spark.createDataFrame([(1, [1.0] * 5, 1, "c", 1, 1)], KIND))
