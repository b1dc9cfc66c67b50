"""Spikes of readings with equal candidates and amplitudes at decimal halves: the last bits decide, so sums are taken in the order of the SQL."""

import numpy as np
import spike_oracle as O

from fluxline.operators import checks as K


def test_amplitudes_are_those_of_the_sql_to_the_last_bit():
    rng = np.random.default_rng(4)
    n_spikes = 0
    for n in (7, 8, 30, 600, 601):
        for _ in range(20):
            mag = 54000 + rng.integers(0, 2000, n) * 50.0 / 1000
            at, amplitude, z = K._of_segment(mag, 21, 1.8)
            want, want_z, _ = O.spikes_of(mag, 21, 1.8)
            assert np.array_equal(at, np.flatnonzero(~np.isnan(want)))
            assert np.array_equal(amplitude, want[at])
            assert np.allclose(z, want_z[at], rtol=1e-12)
            n_spikes += len(at)
    assert n_spikes > 100
