"""The spike detector over one segment as arrays, to test the windows against."""

import numpy as np


def running_median(v: np.ndarray, k: int) -> np.ndarray:
    n = len(v)
    if n < 3:
        return v.copy()
    k = min(k, n if n % 2 else n - 1)
    whole = np.median(np.lib.stride_tricks.sliding_window_view(v, k), axis=1)
    return np.concatenate([np.full(k // 2, whole[0]), whole, np.full(n - len(whole) - k // 2, whole[-1])])


def running_max(v: np.ndarray, k: int) -> np.ndarray:
    h = k // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(v, h, constant_values=-np.inf), 2 * h + 1).max(axis=1)


def spikes_of(v: np.ndarray, k: int, sigmas: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(amplitude, z, cleaned) of a segment; amplitude and z are NaN but at spikes.

    The fourth difference of a spike stands out against the running scale of its neighbours; of a run of candidates the largest is the spike.
    Ends are extended along their last two samples; missing samples are filled linearly and never are spikes.
    """
    v = v.astype(float)
    ok, n, none = np.isfinite(v), len(v), np.full(len(v), np.nan)
    if ok.sum() < 7:
        return none, none.copy(), v.copy()
    y = np.interp(np.arange(n), np.flatnonzero(ok), v[ok])
    e = np.concatenate([[3 * y[0] - 2 * y[1], 2 * y[0] - y[1]], y, [2 * y[-1] - y[-2], 3 * y[-1] - 2 * y[-2]]])
    d4 = e[:-4] - 4 * e[1:-3] + 6 * e[2:-2] - 4 * e[3:-1] + e[4:]
    size = np.abs(d4)
    floor = 0.5 * 1.4826 * np.median(size)
    z = d4 / np.maximum(running_max(1.4826 * running_median(size, k), k), floor if floor > 0 else np.finfo(float).eps)
    candidate = np.append(ok & (np.abs(z) > sigmas), False)
    begin = np.flatnonzero(candidate & ~np.insert(candidate[:-1], 0, False))
    end = np.flatnonzero(~candidate[1:] & candidate[:-1]) + 1
    amplitude, shown, cleaned = none.copy(), none.copy(), v.copy()
    for a, b in zip(begin, end):
        j = a + int(np.argmax(size[a:b]))
        inner = d4[j] / 6
        if j < 2:
            inner = y[j] - (2 * y[j + 1] - y[j + 2])
        elif j >= n - 2:
            inner = y[j] - (2 * y[j - 1] - y[j - 2])
        amplitude[j], shown[j], cleaned[j] = inner, z[j], v[j] - inner
    return amplitude, shown, cleaned
