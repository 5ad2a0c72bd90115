"""Packing of lengths that repeat, against best fit item by item."""

import collections

import numpy as np
import pytest

from sparkloom.llm import packing

CAPS = packing.Capacities(tokens=1024, documents=1024, attention=1024 * 1024)


def item_by_item(histogram, size=1024):
    """Bins of best fit, longest first."""
    room, bins = collections.Counter(), 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            r = min((r for r, n in room.items() if n and r >= length), default=None)
            if r is None:
                bins, r = bins + 1, size
            else:
                room[r] -= 1
            room[r - length] += 1
    return bins


def checked(histogram, caps=CAPS, rule="norm"):
    """The number of bins, after looking at every item's place."""
    runs, n_bins = packing.best_fit(histogram, caps, rule)
    ranks, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in runs:
        assert r.count > 0
        for i in range(r.count):
            ranks[r.length].append(r.first + i)
            bins[r.bin + i].append((r.offset, r.length))
    assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(k)) for n, k in histogram.items()}
    assert sorted(bins) == list(range(n_bins))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= caps.tokens and len(items) <= (caps.documents or at) and sum(n * n for _, n in items) <= (caps.attention or at * at)
    return n_bins


rng = np.random.default_rng(0)
HISTOGRAMS = {
    "equal": {41: 2000},
    "hundred": {100: 1000},
    "one": {1: 5000},
    "two": {600: 300, 41: 3000},
    "three": {700: 50, 300: 500, 7: 4000},
    "short": {n: 1000 for n in range(20, 60)},
    "skewed": dict(collections.Counter(np.minimum(1024, 1 + rng.pareto(1.2, 100_000) * 40).astype(int).tolist())),
    "mixed": dict(collections.Counter(rng.integers(1, 1025, 20_000).tolist())),
    "full": {1024: 30, 1023: 5, 1: 3},
}


@pytest.mark.parametrize("name", list(HISTOGRAMS))
def test_as_few_as_item_by_item(name):
    h = HISTOGRAMS[name]
    n = checked(h)
    assert n <= 1.01 * item_by_item(h) + 1
    assert n >= -(-sum(a * b for a, b in h.items()) // 1024)


def test_figures():
    assert checked({41: 2000}) == 84 and checked({100: 1000}) == 100 and checked({30: 100_000}) == 2942


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [packing.Capacities(100, 5, None), packing.Capacities(100, None, 900), packing.Capacities(100, 7, 2000), packing.Capacities(64)])
def test_tight_capacities(rule, caps):
    h = dict(collections.Counter(np.random.default_rng(1).integers(1, 31, 3000).tolist()))
    checked(h, caps, rule)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_repeats_by_both_rules(rule):
    for h in HISTOGRAMS.values():
        checked(h, CAPS, rule)


def test_runs_stay_few():
    h = {n: 10**7 + n for n in range(1, 1025)}
    runs, _ = packing.best_fit(h, CAPS)
    assert len(runs) < 40_000
