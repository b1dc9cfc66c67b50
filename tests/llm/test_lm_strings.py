import random
import time

import numpy as np

from fluxline.llm import lm


def test_own_strings_are_distinct_and_take_about_a_sort(monkeypatch):
    rng = random.Random(8)
    words = [bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 9))) for _ in range(40000)]
    streams = [b" ".join(rng.choices(words, k=400)) + b"\n" for _ in range(1200)]
    sizes = [len(s) for s in streams]
    few, sizes_of_few = streams[:7], sizes[:7]
    monkeypatch.setattr(lm, "BLOCK", 5000)
    assert lm._own(few, sizes_of_few).tolist() == sorted({int(k) for s in few for k in lm.strings([s])})
    monkeypatch.undo()

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    plain = min(seconds(lambda: np.sort(lm.strings(streams))) for _ in range(3))
    assert min(seconds(lambda: lm._own(streams, sizes)) for _ in range(3)) < 4 * plain
