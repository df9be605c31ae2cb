from math import lgamma

import numpy as np

from tidemark.llm import near


def test_the_floor_loses_hardly_a_link():
    """The exact chance, over all counts of larger and smaller registers, that a pair of equal sizes at 0.8 is not verified."""
    n, floor = near.REGISTERS, 0.8 - near.SLACK
    more, less = (one.ravel() for one in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    more, less = more[more + less <= n], less[more + less <= n]
    same = n - more - less
    up = -np.log1p(-0.1 * (near.BASE - 1) / near.BASE) / np.log(near.BASE)
    ways = np.array([lgamma(at + 1) for at in range(n + 1)])
    chance = np.exp(ways[n] - ways[more] - ways[less] - ways[same] + (more + less) * np.log(up) + same * np.log(1 - 2 * up))
    at = np.arange(n)
    left, right = (at < more[:, None]).astype(np.uint8), ((at >= more[:, None]) & (at < (more + less)[:, None])).astype(np.uint8)
    sizes = np.full(len(more), 1000.0)
    lost = (near.estimated(left, right, sizes, sizes) < floor) | (same < (floor - 0.1) * n)
    assert abs(chance.sum() - 1) < 1e-9 and chance[lost].sum() < 5e-6
