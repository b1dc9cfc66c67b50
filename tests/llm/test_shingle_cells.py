import numpy as np

from fluxline.llm import shingle_join


def test_small_sets_within_the_limit_share_a_cell():
    first, groups = shingle_join.bands(300)
    rng = np.random.default_rng(11)
    for n in [1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 13, 16, 20, 24, 40, 90]:
        for m in range(n, n * 5 // 4 + 1):
            shared = -(-4 * (n + m) // 9)
            if shared <= n:
                for _ in range(400):
                    x = rng.integers(0, 1 << 64, n + m - shared, dtype=np.uint64)
                    a, b = np.sort(x[:n]), np.sort(x[n - shared :])
                    assert len(b) == m and set(shingle_join.cells(a, first, groups)) & set(shingle_join.cells(b, first, groups)), (n, m)


def test_texts_of_a_repeated_id_are_verified_each(spark):
    texts = [[f"t{k}w{i}" for i in range(60)] for k in range(4)]
    rows = [(1, " ".join(t)) for t in texts] + [(2 + k, " ".join([*t, "more"])) for k, t in enumerate(texts)]
    got = shingle_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}
