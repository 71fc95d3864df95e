"""Two linked sets share as many keys as either demands under one of their tags."""

from collections import Counter

import numpy as np
import pytest

from ferrule.llm import jaccard


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_the_keys_they_demand(percent):
    rnd = np.random.default_rng(3)
    lost = []
    for n in range(1, 61):
        for _ in range(150):
            a = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
            more = rnd.integers(0, 1 << 64, 1, dtype=np.uint64)
            for b in (np.union1d(a, more), a[1:], np.union1d(a[1:], more)):
                if not len(b) or not jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b), percent):
                    continue
                (ka, ma), (kb, mb) = jaccard.part_keys(a, percent), jaccard.part_keys(b, percent)
                shared = set(ka.tolist()) & set(kb.tolist())
                count = lambda k, m: Counter(int(y) for x, y in zip(k.tolist(), m.tolist()) if x in shared)
                ca, cb = ({y >> 32: c for y, c in count(k, m).items() if c >= y & 0xFFFFFFFF} for k, m in ((ka, ma), (kb, mb)))
                if not set(ca) & set(cb):
                    lost.append((len(a), len(b)))
    assert not lost
