"""The swap search against an uncapped search of all pairs of bins."""

import random

from parcelgrid.llm import packing


def uncapped(bins, capacity):
    """Of two bins, moves one or two pieces for one or none from the emptier, while that gains."""
    bins = sorted(map(list, bins), key=sum)
    changed = True
    while changed:
        changed = False
        for k, b in enumerate(bins):
            for a in reversed(bins[k + 1 :]):
                while b and sum(b) <= sum(a) < capacity:
                    room = capacity - sum(a)
                    takes = [(n,) for n in b] + [(n, m) for i, n in enumerate(b) for m in b[:i]]
                    ways = [(sum(t) - sum(g), t, g) for t in takes for g in [(), *((n,) for n in a)]]
                    gain, take, give = max((w for w in ways if 0 < w[0] <= room), default=(0, (), ()), key=lambda w: w[0])
                    if not gain:
                        break
                    changed = True
                    for n in take:
                        b.remove(n)
                    for n in give:
                        a.remove(n)
                    a.extend(take)
                    b.extend(give)
        bins = sorted((b for b in bins if b), key=sum)
    return bins


def test_medium_lengths_as_an_uncapped_search():
    for low, high, count in ((900, 1700, 900), (700, 2100, 900)):
        rng = random.Random(6)
        lengths = [rng.randint(low, high) for _ in range(count)]
        start = [[lengths[i] for i in b] for b in packing.best_fit(lengths, 4096)]
        want = len(uncapped(start, 4096))
        got = packing.swap_search(start, 4096)
        assert sorted(n for b in got for n in b) == sorted(lengths) and max(map(sum, got)) <= 4096
        assert len(got) <= want < len(start)


def test_gain_grows_with_the_group():
    """The share of bins saved is not lost among thousands of bins."""
    rng = random.Random(8)
    lengths = [rng.randint(900, 1700) for _ in range(9000)]
    least, fit = -(-sum(lengths) // 4096), len(packing.best_fit(lengths, 4096))
    assert len(packing.pack_lengths(lengths)) - least < 0.5 * (fit - least)
