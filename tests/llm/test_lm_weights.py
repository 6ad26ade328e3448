"""The mixture of op1 is a distribution in every context, seen or not."""

import collections

import numpy as np
import pytest

from veracity.llm import lm_scoring


@pytest.mark.parametrize("order", [1, 2, 3])
def test_rows_add_up_over_the_estimates_that_exist(order):
    rng = np.random.default_rng(order)
    weights = {b: rng.dirichlet(np.ones(order + 1)) for b in (0, 64 + 3, 64 + 9) if b // 64 <= order}
    table = lm_scoring.weight_table(weights, order)
    assert np.allclose(table.sum(axis=1), 1)
    for b in range(len(table)):
        assert not table[b, b // 64 + 2:].any() and table[b, 0] > 0
    if order > 1:
        assert np.allclose(table[64 + 4, :3], weights[64 + 3][:3] / weights[64 + 3][:3].sum())
        assert np.allclose(table[64 + 40, :3], weights[64 + 9][:3] / weights[64 + 9][:3].sum())


def test_probabilities_after_any_context_sum_to_one():
    """All words after one context, through the operator's own estimates and weights."""
    text = "a b a c a b d . b a a".split()
    one, two = collections.Counter(text), collections.Counter(zip(text, text[1:], strict=False))
    words = sorted(one)
    table = lm_scoring.weight_table({0: np.array([0.3, 0.6, 0.1]), 64: np.array([0.2, 0.3, 0.5])}, 2)
    floor, total = 1 / (len(words) + 1), len(text)
    for context in ("a", "d", "never"):
        # Each column is a text of two tokens: the context, then the word.
        sums = sum(two[context, w] for w in words)
        c1 = np.array([x for w in words for x in (sums, one[w])])
        c2 = np.array([x for w in words for x in (0, two[context, w])])
        first = np.arange(0, 2 * len(words) + 1, 2)
        f, bucket = lm_scoring.estimates([c1, c2], first, total, 1)
        w = table[bucket]
        p = w[:, 0] * floor + w[:, 1] * f[0] + w[:, 2] * f[1]
        unknown = w[1, 0] * floor
        assert p[1::2].sum() + unknown == pytest.approx(1.0)
