"""The covariance determinant against a numpy search with many random starts, and the factors against simulation."""

import numpy as np
import pytest

from loomline.llm import quality
from loomline.llm.quality import D, FLOORS, QualityRules


def slow_mcd(z, support, starts, rng):
    """The smallest determinant that concentration reaches from many starts of six rows."""
    h = int(np.ceil(support * len(z)))
    best = None
    for _ in range(starts):
        own = z[rng.choice(len(z), 6, replace=False)]
        m, c = own.mean(axis=0), np.cov(own.T) + np.diag(np.square(FLOORS))
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)
            near = z[np.argsort(d)[:h]]
            m, c = near.mean(axis=0), np.cov(near.T, bias=True) * quality.consistency()[int(100 * h / len(z))] + np.diag(np.square(FLOORS))
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m, c
    return best


def clouds(rng, n, outliers):
    mix = rng.normal(size=(D, D)) / 3 + np.eye(D)
    clean = rng.normal(size=(n - outliers, D)) @ mix.T
    far = rng.normal(size=(outliers, D)) * 0.3 + rng.choice([-1, 1], D) * 9
    return np.concatenate([clean, far])


def test_determinants(spark):
    rng = np.random.default_rng(5)
    groups = {("=en", "=a"): clouds(rng, 400, 60), ("=en", "=b"): clouds(rng, 300, 0), ("=fr", "=a"): clouds(rng, 250, 50)}
    rows = [(lang, source, False, *map(float, z)) for (lang, source), zs in groups.items() for z in zs]
    df = spark.createDataFrame(rows, "__lang string, __source string, __base_failed boolean, " + ", ".join(f"__z{i} double" for i in range(D)))
    got = {(r["__lang"], r["__source"]): r for r in quality.estimates(df, QualityRules()).collect()}
    assert set(got) == set(groups)
    for key, z in groups.items():
        r = got[key]
        assert r["g_n"] == len(z)
        m = np.array([r[f"g_m{i}"] for i in range(D)])
        low = np.array([[r[f"g_l{i}{j}"] if j <= i else 0.0 for j in range(D)] for i in range(D)])
        det, want_m, want_c = slow_mcd(z, 0.75, 200, rng)
        assert 2 * np.log(np.diag(low)).sum() < det + 0.35  # a bucket's width and the last step
        mine = np.square(np.linalg.solve(low, (z - m).T)).sum(axis=0)
        other = np.einsum("ij,jk,ik->i", z - want_m, np.linalg.inv(want_c), z - want_m)
        assert ((mine > 36) == (other > 36)).mean() > 0.995


def test_consistency_factors():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(200_000, D))
    order = np.argsort(np.square(z).sum(axis=1))
    for share in (50, 75, 90):
        trimmed = z[order[: len(z) * share // 100]]
        assert quality.consistency()[share] * trimmed.var() == pytest.approx(1, abs=0.02)
