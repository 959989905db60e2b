"""Hard negatives and whitening against brute force."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlens.llm import eigen, hard_negatives, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, own string, x string, score int, n string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Rows with copies, equal scores, repeated and null ids, and rows that take no part."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((330, 6)).astype(np.float32) / 2
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(base)]
    rows += [(400 + i, rows[3][1], i % 3) for i in range(12)] + [(100, rows[100][1], rows[100][2]), (100, rows[7][1], 1), (5, rows[9][1], 0), (5, rows[9][1], 0)]
    rows += [(None, rows[200][1], 1), (None, rows[0][1], 2), (500, [0.25, 0.5], 1), (501, [], 1), (600, None, 1), (601, rows[1][1], None), (700, [1.0, None, 2.0], 1), (701, [math.nan] * 6, 1), (702, [math.inf] + [0.0] * 5, 0), (703, [-math.inf] * 6, 0)]
    rows = [(*r, "o", "x", 1, "n") for r in rows]
    return spark.createDataFrame(rows, SCHEMA), rows


def usable(rows, labelled):
    for i, (k, v, label, *_) in enumerate(rows):
        if v is not None and not (labelled and label is None) and all(c is not None and math.isfinite(c) for c in v):
            yield i, k, [math.floor(256 * c) for c in np.array(v, np.float32).tolist()] + [0] * (6 - len(v)), label


def brute(rows):
    held = list(usable(rows, True))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    want = Counter()
    for i, k, x, label in held:
        if k is None or k % 100:
            continue
        scores = [(sum(a * b for a, b in zip(x, y)), m, lab) for j, m, y, lab in held if j != i]
        for ps, pid, _ in sorted((s for s in scores if s[2] == label), key=order)[:5]:
            found = sorted((s for s in scores if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:10]
            want.update((k, pid, rank, nid, ps, ns) for rank, (ns, nid, _) in enumerate(found, 1))
    return want


@pytest.mark.parametrize("sizes", [(1024, 65536, 2048, 256), (2, 40, 7, 4)])
def test_hard_negatives(vectors, spark, monkeypatch, sizes):
    frame, rows = vectors
    for name, size in zip(("SET", "GROUP", "SLICE", "PANEL"), sizes):
        monkeypatch.setattr(hard_negatives, name, size)
    got = hard_negatives.mine(frame, F.col("vec_id") % 100 == 0)
    want = brute(rows)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(frame, F.lit(False)).count() == 0 and hard_negatives.mine(frame, F.lit(None).cast("boolean")).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(100, [1e30], 1)], "vec_id bigint, embedding array<float>, label int"), F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize("size,width", [(3, 5), (300, 64), (1 << 20, 700), (1 << 28, 30)])
def test_exact_products(size, width):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (9, width)), rng.integers(-size, size + 1, (11, width))
    a[0], b[0] = size, -size
    bound = max(int((x.astype(object) ** 2).sum(axis=1).max()) for x in (a, b))
    primes = hard_negatives.primes_for(width, bound)
    got = hard_negatives.products(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
    assert (got == a.astype(object) @ b.T.astype(object)).all() and math.prod(primes) > 2 * bound


def test_best_with_ties():
    rng = np.random.default_rng(1)
    scores, wanted = rng.integers(-3, 4, (20, 90)), rng.random((20, 90)) < 0.6
    wanted[3] = False
    wanted[4, 2:] = False
    r, c = hard_negatives.best(scores, wanted, 5)
    for i in range(20):
        assert c[r == i].tolist() == sorted(np.flatnonzero(wanted[i]), key=lambda j: (-scores[i, j], j))[:5]


def checked(frame, rows, k=4):
    got = whitening.whiten(frame).collect()
    held = list(usable(rows, False))
    fit = sorted({tuple(x) for _, _, x, _ in held})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = (a[..., ::-1][..., :k] for a in np.linalg.eigh(v))
    assert len(got) == len(held) * len(values) and {r.n for r in got} == {n}
    signs = {}
    left = Counter()
    for i, key, x, _ in held:
        z = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ vectors / np.sqrt(values)
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        left.update((key, j + 1, deviation, round(abs(z[j]), 7)) for j in range(len(values)))
    assert Counter((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 7)) for r in got) == left
    for r in got:
        assert abs(r.explained * np.trace(v) / values[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    for i, key, x, _ in held[:40]:  # either sign, but one for all rows
        z = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ vectors / np.sqrt(values)
        for r in got:
            if r.vec_id == key and abs(r.whitened) > 1e-6 and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums)):
                assert signs.setdefault(r.component, np.sign(r.whitened * z[r.component - 1])) == np.sign(r.whitened * z[r.component - 1])


def test_whitening(vectors):
    checked(*vectors)


def test_whitening_of_few_rows(vectors, spark):
    kind = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(vectors[0].limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], kind)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one) == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [i / 256, 2 * i / 256, 0.0]) for i in range(5)], kind)).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 12)) for r in line} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    far = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0])], kind)).collect()
    assert {r.deviation for r in far} == {None} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in far if r.component == 1)


def test_eigenpairs():
    rng = np.random.default_rng(0)
    cases = [rng.standard_normal((d, d)) for d in (1, 2, 3, 7, 40)]
    cases = [x + x.T for x in cases] + [np.eye(6) * 3, np.diag([5.0, 5, 5, 5, 5, 1]), np.zeros((4, 4)), np.diag([4, 3, 2, 1 + 1e-9, 1, 0.5])]
    for v in cases:
        values, vectors = eigen.largest(v, 4)
        exact = np.linalg.eigvalsh(v)[::-1][:4]
        assert np.allclose(values, exact, rtol=0, atol=1e-12 * max(1, abs(exact).max()))
        assert np.allclose(v @ vectors, vectors * values, atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        for shift in rng.uniform(-6, 6, 20):
            assert eigen.above(eigen.tridiagonal(v), shift) == (np.linalg.eigvalsh(v) > shift).sum()
