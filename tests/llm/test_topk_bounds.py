import time

import numpy as np

from fluxline.llm import topk


def _best(at, x, ids, query):
    score = x[at] @ query
    order = np.lexsort((ids[at], -score))[:5]
    return list(zip(score[order].tolist(), ids[at][order].tolist()))


def test_bounds_keep_every_best_row():
    """Ties, repeated ids, own rows and bars, blocks of a few rows and of many."""
    rng = np.random.default_rng(1)
    for case in range(120):
        n, dims = int(rng.integers(1, 900 if case % 4 == 0 else 90)), int(rng.integers(1, 6))
        x, ids, queries, own = rng.integers(-3, 4, (n, dims)), rng.integers(0, 400, n), rng.integers(-3, 4, (7, dims)), rng.integers(0, 400, 7)
        bars = rng.integers(-9, 20, 7).astype(float) if case % 2 else None
        kept, share = topk.nra(queries, own, x, ids, 5, bars)
        assert ((0 <= share) & (share <= 1)).all()
        for i, at in enumerate(kept):
            want = _best(np.flatnonzero(ids != own[i]), x, ids, queries[i])
            want = [w for w in want if bars is None or w[0] >= bars[i]]
            assert _best(at, x, ids, queries[i])[: len(want)] == want


def test_bounds_cost_little_beside_sorting_the_lists():
    rng = np.random.default_rng(2)
    x, ids = rng.integers(-700, 700, (4096, 64)), np.arange(4096)
    began = time.process_time()
    np.argsort(-x, axis=0, kind="stable")
    sorting = time.process_time() - began
    began = time.process_time()
    topk.nra(x[:128], ids[:128], x, ids, 5)
    took = time.process_time() - began
    print(took / sorting)
    assert took < 120 * sorting
