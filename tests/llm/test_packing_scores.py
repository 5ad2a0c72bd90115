"""Best fit chooses by all residuals, also where documents and attention cannot bind."""

import collections

import numpy as np
import pytest

from sparkloom.llm import packing


def item_by_item(lengths, limits, rule):
    weights = np.array([1.0, 0.1, 0.1]) / limits
    bins = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fits = [(sum(((left - need) * weights) ** 2) if rule == "norm" else -sum(left * weights * (need / limits)), k) for k, (left, _) in enumerate(bins) if (left >= need).all()]
        if fits:
            left, held = bins[min(fits)[1]]
            bins[min(fits)[1]] = (left - need, [*held, n])
        else:
            bins.append((limits - need, [n]))
    return sorted(sorted(held) for _, held in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_residuals_that_cannot_bind_still_count(rule):
    limits = np.array([1024, 1024, 1024 * 1024])
    for seed in range(5):
        lengths = np.random.default_rng(seed).choice(np.arange(1, 1025), 400, replace=False).tolist()
        runs, n = packing.best_fit(dict.fromkeys(lengths, 1), packing.Capacities(*map(int, limits)), rule)
        bins = collections.defaultdict(list)
        for r in runs:
            bins[r.bin].append(r.length)
        assert len(bins) == n and sorted(sorted(b) for b in bins.values()) == item_by_item(lengths, limits, rule)
