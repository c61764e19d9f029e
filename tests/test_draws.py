"""Counter-based draws against their distributions."""

import math

import numpy as np
import pytest

from evenhand.functions.draws import binomial, log_factorial, multinomial_counts, uniforms


def test_log_factorial():
    k = np.array([0, 1, 5, 63, 64, 100, 10_000, 10 ** 9])
    assert np.allclose(log_factorial(k), [math.lgamma(x + 1.0) for x in k], rtol=1e-13, atol=1e-11)


def test_uniforms_depend_on_every_counter():
    a = uniforms("s", np.arange(1000), 1, 0)
    assert a.shape == (1000, 2) and 0 < a.min() and a.max() < 1 and abs(a.mean() - 0.5) < 0.03
    for other in (uniforms("t", np.arange(1000), 1, 0), uniforms("s", np.arange(1000), 2, 0), uniforms("s", np.arange(1000), 1, 1)):
        assert (other != a).all()


@pytest.mark.parametrize("n,q", [(1, 0.5), (7, 0.2), (30, 0.3), (50, 0.85), (400, 0.01), (1000, 0.4), (100_000, 0.002), (10 ** 6, 0.7)])
def test_binomial_has_its_distribution(n, q):
    draws = binomial(np.full(20_000, n), q, "seed", np.arange(20_000), 1)
    spread = math.sqrt(n * q * (1 - q))
    assert draws.min() >= 0 and draws.max() <= n
    assert abs(draws.mean() - n * q) < 5 * spread / math.sqrt(20_000)
    assert abs(draws.std() / spread - 1) < 0.03
    k = np.arange(n + 1) if n <= 1000 else np.unique(np.linspace(n * q - 3 * spread, n * q + 3 * spread, 40).astype(int))
    if n <= 1000:  # the whole distribution function
        mass = [math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(q) + (n - i) * math.log(1 - q)) for i in k]
        seen = np.searchsorted(np.sort(draws), k, side="right") / len(draws)
        assert np.abs(seen - np.cumsum(mass)).max() < 0.015


def test_multinomial():
    weights = np.array([500, 3, 0, 120, 1, 376])
    counts = multinomial_counts(weights, np.arange(4000), "42|7")
    assert (counts.sum(axis=1) == 1000).all() and (counts[:, 2] == 0).all()
    expected = weights / 1000 * (1 - weights / 1000) * 1000
    assert np.allclose(counts.mean(axis=0), weights, atol=1.5)
    assert np.allclose(counts.var(axis=0), expected, rtol=0.12, atol=0.1)
    assert np.corrcoef(counts[:, 0], counts[:, 5])[0, 1] < -0.7
    again = multinomial_counts(weights, np.array([17, 3999]), "42|7")
    assert (again == counts[[17, 3999]]).all()  # a draw depends on its number alone
