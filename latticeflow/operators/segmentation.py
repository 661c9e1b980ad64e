"""Spectral segmentation of beat-synchronous features into sections."""

from __future__ import annotations

import numpy as np


def _median_filter(x: np.ndarray, size: int) -> np.ndarray:
    """Along the last axis, edges repeated."""
    half = size // 2
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half, half)], mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size, axis=-1), axis=-1)


def recurrence(f: np.ndarray, width: int = 3) -> np.ndarray:
    """Affinity of beats (rows) to their nearest neighbours at least ``width`` away, mutual and weighted."""
    n = len(f)
    d = ((f[:, None, :] - f[None, :, :]) ** 2).sum(axis=2) if n <= 512 else np.maximum((f**2).sum(1)[:, None] + (f**2).sum(1) - 2 * f @ f.T, 0)
    band = np.abs(np.subtract.outer(np.arange(n), np.arange(n))) < width
    d = np.where(band, np.inf, d)
    k = min(max(1, int(2 * np.ceil(np.sqrt(n)))), n - 1)
    near = np.zeros((n, n), dtype=bool)
    near[np.arange(n)[:, None], np.argsort(d, axis=1)[:, :k]] = True
    near &= near.T & ~band
    scale = np.median(d[near]) if near.any() else 1.0
    return np.where(near, np.exp(-np.where(near, d, 0) / max(scale, 1e-12)), 0.0)


def lag_filter(r: np.ndarray, size: int = 7) -> np.ndarray:
    """Median filter along the diagonals."""
    n = len(r)
    lagged = np.stack([np.roll(np.pad(r[:, i], (0, n)), n - i) for i in range(n)], axis=1)
    smooth = _median_filter(lagged, size)
    return np.stack([np.roll(smooth[:, i], i - n)[:n] for i in range(n)], axis=1)


def eigengap(values: np.ndarray, least: int = 2, most: int = 8) -> int:
    gaps = np.diff(values)
    high = min(most, len(gaps))
    return least if high <= least - 1 else int(np.argmax(gaps[least - 1 : high])) + least


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[int(np.argmax(d))])
    c, label = np.array(centres), np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == label).all() and _:
            break
        label = new
        c = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(k)])
    return label


def sections(features: np.ndarray, k: int | None = None) -> np.ndarray:
    """A section label for each beat: Laplacian eigenvectors of repetition blended with path similarity, clustered."""
    n = len(features)
    if n < 4:
        return np.zeros(n, dtype=int)
    f = np.asarray(features, dtype=np.float64)
    r = lag_filter(recurrence(f))
    step = ((f[1:] - f[:-1]) ** 2).sum(axis=1)
    path = np.exp(-step / max(np.median(step), 1e-12))
    p = np.diag(path, 1) + np.diag(path, -1)
    dp, dr = p.sum(axis=1), r.sum(axis=1)
    mu = dp @ (dp + dr) / max(((dp + dr) ** 2).sum(), 1e-12)
    a = mu * r + (1 - mu) * p
    d = 1 / np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
    values, vectors = np.linalg.eigh(np.eye(n) - a * np.outer(d, d))
    k = k or eigengap(values)
    v = _median_filter(vectors.T, 9).T
    norm = np.sqrt(np.cumsum(v**2, axis=1))
    return kmeans(v[:, :k] / np.maximum(norm[:, k - 1 : k], 1e-12), k)


def boundaries(labels: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1]) if len(labels) else np.zeros(0, dtype=int)


def beat_features(y: np.ndarray, sr: int, beats: np.ndarray, bands: int = 36) -> np.ndarray:
    """Median log magnitudes of ``bands`` log-spaced bands between beats: one row a beat."""
    from . import signal

    hop = max(32, signal.HOP * sr // signal.SR)
    s, f = signal.spectrogram(y, hop), np.fft.rfftfreq(signal.N_FFT, 1 / sr)
    edges = np.geomspace(32.0, max(64.0, sr / 2), bands + 1)
    place = np.clip(np.searchsorted(edges, f, "right") - 1, 0, bands - 1)
    pooled = np.log1p(np.array([s[place == b].sum(axis=0) for b in range(bands)])).T
    at = np.clip((np.append(beats, len(y) / sr) * sr / hop).astype(int), 0, len(pooled) - 1)
    return np.array([np.median(pooled[i : max(i + 1, j)], axis=0) for i, j in zip(at, at[1:], strict=False)])


def with_energy(y: np.ndarray, sr: int, spans: list[tuple[float, float, str]]) -> list[dict]:
    """Segments with the mean low-band energy of their frames; one frame at least, and none past the end."""
    from . import signal

    low = signal.band_energy(y, sr)["low"]
    sums = np.append(0.0, np.cumsum(low, dtype=np.float64))
    frame = lambda t: int(t * sr / signal.HOP)
    out = []
    for a, b, label in spans:
        i = min(max(0, frame(a)), len(low))
        j = min(max(frame(b), i + 1), len(low))
        out.append({"start": a, "end": b, "label": label, "energy": float((sums[j] - sums[i]) / (j - i)) if j > i else 0.0})
    return out


def segments_of(y: np.ndarray, sr: int, beats: np.ndarray, downs: np.ndarray, duration: float) -> list[dict]:
    """Spectral sections of a track, their bounds on the nearest downbeats; none for fewer than four beats."""
    if len(beats) < 4:
        return []
    edges = beats[boundaries(sections(beat_features(y, sr, beats)))]
    if len(downs):
        edges = np.unique([downs[np.argmin(np.abs(downs - t))] for t in edges])
    edges = np.append(edges, duration)
    return with_energy(y, sr, [(float(a), float(b), "") for a, b in zip(edges, edges[1:], strict=False) if b > a])
