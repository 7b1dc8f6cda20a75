"""Audio in numpy: spectra, landmarks and band-energy hashes of mono clips."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np

from ..errors import BadInputError

RATES = {"wang": 8000, "panako": 8000, "haitsma": 5000, "neural": 16000, "watermark": 16000}
HOP, FFT = 128, 1024
FRAMES_A_SECOND = 62.5


@dataclass(frozen=True)
class Landmarks:
    fan_out: int = 10
    zone_t: int = 63
    zone_f: int = 64
    peaks_a_second: int = 30
    floor_db: float = -50.0


WANG, PANAKO = Landmarks(), Landmarks(fan_out=5, zone_t=96, zone_f=96)


def pcm(data: bytes) -> np.ndarray:
    """Little-endian 32-bit floats."""
    if len(data) % 4:
        raise BadInputError("audio bytes aren't whole 32-bit floats")
    return np.frombuffer(data, "<f4").astype(float)


def spectrum(samples: np.ndarray, fft: int = FFT, hop: int = HOP) -> np.ndarray:
    """(frames, fft / 2 + 1) magnitudes under a Hann window; a clip shorter than a window is padded to one."""
    if len(samples) < fft:
        samples = np.pad(samples, (0, fft - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, fft)[::hop]
    window, out = np.hanning(fft), np.empty((len(frames), fft // 2 + 1))
    for i in range(0, len(frames), 64):  # the frames overlap: few are spread out at a time
        np.abs(np.fft.rfft(frames[i : i + 64] * window, axis=1), out=out[i : i + 64])
    return out


def decibel(m: np.ndarray, lowest: float = -60.0) -> np.ndarray:
    top = m.max() if m.size else 0
    return np.full(m.shape, lowest) if top <= 0 else np.clip(20 * np.log10(np.maximum(m / top, 1e-9)), lowest, 0)


def peaks(samples: np.ndarray, p: Landmarks = WANG, top: float = 0.0) -> np.ndarray:
    """(frame, bin) of the local maxima above the floor, the strongest of each second, by frame and bin. top: a magnitude heard before."""
    return peaks_in(spectrum(samples), p, top)


def peaks_in(m: np.ndarray, p: Landmarks = WANG, top: float = 0.0) -> np.ndarray:
    """The peaks of a spectrum."""
    m = m[:, : FFT // 2]
    most = max(top, m.max() if m.size else 0.0)
    if not most > 0:
        return np.empty((0, 2), int)
    padded = np.pad(m, 2, constant_values=-1)
    rows = padded[: len(m)].copy()  # the largest of five by five, first over frames, then over bins
    for i in range(1, 5):
        np.maximum(rows, padded[i : i + len(m)], out=rows)
    around = rows[:, : m.shape[1]].copy()
    for i in range(1, 5):
        np.maximum(around, rows[:, i : i + m.shape[1]], out=around)
    t, f = np.nonzero((m >= around) & (m > 0))
    loud = 20 * np.log10(np.maximum(m[t, f] / most, 1e-9)) > p.floor_db
    t, f = t[loud], f[loud]
    order = np.lexsort((f, t, -m[t, f]))
    second = (t[order] / FRAMES_A_SECOND).astype(int)
    rank = np.zeros(len(order), int)
    for s in np.unique(second):
        own = np.flatnonzero(second == s)
        rank[own] = np.arange(len(own))
    kept = order[rank < p.peaks_a_second]
    return np.stack([t[kept], f[kept]], axis=1)[np.lexsort((f[kept], t[kept]))] if len(kept) else np.empty((0, 2), int)


def pairs(found: np.ndarray, p: Landmarks = WANG) -> list[tuple[int, int, int, int]]:
    """(t1, f1, t2, f2): each anchor with the first targets after it in its zone."""
    out, times, points = [], found[:, 0], found.tolist()
    first, last = (np.searchsorted(times, times + n).tolist() for n in (1, p.zone_t + 1))
    for (t, f), lo, hi in zip(points, first, last, strict=True):
        near = 0
        for a, b in itertools.islice(points, lo, hi):
            if abs(b - f) <= p.zone_f:
                near += 1
                out.append((t, f, a, b))
                if near == p.fan_out:
                    break
    return out


def wang(samples: np.ndarray, rate: int = 8000, p: Landmarks = WANG) -> list[tuple[int, int]]:
    """(hash, time of the anchor); hash: two frequencies of nine bits, a difference in time of fourteen."""
    _rate("wang", rate)
    return [(f << 23 | g << 14 | (u - t), t) for t, f, u, g in pairs(peaks(samples, p), p)]


def landmarks_from(samples: np.ndarray, p: Landmarks, first: int, top: float) -> tuple[list[tuple[int, int]], float]:
    """What wang gives for a stretch of a clip that begins at frame `first`, and the largest magnitude so far."""
    m = spectrum(samples)[:, : FFT // 2]
    top = max(top, float(m.max()) if m.size else 0.0)
    return [(f << 23 | g << 14 | (u - t), t + first) for t, f, u, g in pairs(peaks(samples, p, top), p)], top


def panako(samples: np.ndarray, rate: int = 8000, p: Landmarks = PANAKO) -> list[tuple[int, int, int, int]]:
    """(hash, t1, t2, t3) of triplets of peaks; the hash keeps only ratios of times, so that it survives a change of speed."""
    _rate("panako", rate)
    found, out = peaks(samples, p), []
    after: dict[tuple, list] = {}
    for t, f, u, g in pairs(found, p):
        after.setdefault((t, f), []).append((u, g))
    for (t, f), own in after.items():
        for i, (u, g) in enumerate(own):
            for v, h in own[i + 1 :]:
                if v > u:
                    ratio = int(31 * (u - t) / (v - t))
                    out.append((((f >> 3) & 63) << 26 | ((g - f) & 127) << 19 | ((h - g) & 127) << 12 | int(g > f) << 11 | int(h > g) << 10 | ratio << 5, t, u, v))
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    if rate == to or not len(samples):
        return samples
    n = max(1, int(len(samples) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(samples)), samples)


def haitsma(samples: np.ndarray, rate: int, low: float = 300, high: float = 2000) -> np.ndarray:
    """A 32-bit word for each frame: the signs of the differences of band energies over bands and frames."""
    x = resample(samples, rate, RATES["haitsma"])
    m = spectrum(x, 2048, 64) ** 2
    edges = np.searchsorted(np.fft.rfftfreq(2048, 1 / RATES["haitsma"]), np.geomspace(low, high, 34))
    sums = np.concatenate([np.zeros((len(m), 1)), np.cumsum(m, axis=1)], axis=1)
    energy = sums[:, edges[1:]] - sums[:, edges[:-1]]
    step = energy[:, :-1] - energy[:, 1:]
    bits = step[1:] - step[:-1] > 0
    return (bits * (1 << np.arange(32, dtype=np.uint64))).sum(axis=1).astype(np.uint32)


def _rate(name: str, rate: int) -> None:
    if rate != RATES[name]:
        raise BadInputError(f"{name} takes {RATES[name]} Hz, not {rate}")


def bit_error_rate(a: np.ndarray, b: np.ndarray, window: int = 256) -> float:
    """The least share of different bits of a window of one sequence and one of the other, over all windows of either. A window is half of the
    shorter sequence at most. The time grows with the product of the lengths."""
    n = min(window, (min(len(a), len(b)) + 1) // 2)
    if not n:
        return 1.0
    least = 32 * n
    for shift in range(n - len(b), len(a) - n + 1):  # b begins `shift` words after a
        x, y = a[max(0, shift) :], b[max(0, -shift) :]
        m = min(len(x), len(y))
        sums = np.concatenate([[0], np.cumsum(np.bitwise_count(x[:m] ^ y[:m]), dtype=np.int64)])
        least = min(least, int((sums[n:] - sums[:-n]).min()))
    return least / (32 * n)


def frame_ms(frame, rate: int = 8000, hop: int = HOP):
    """Where a frame begins, in milliseconds; of numbers or columns."""
    return frame * (1000.0 * hop / rate)


def bin_hz(bin_, rate: int = 8000, fft: int = FFT):
    """The frequency of a bin; of numbers or columns."""
    return bin_ * (rate / fft)


def envelope(samples: np.ndarray, buckets: int = 256) -> np.ndarray:
    """The largest magnitude in each of equal parts."""
    edges = np.linspace(0, len(samples), buckets + 1).astype(int)
    out, full = np.zeros(buckets), edges[1:] > edges[:-1]
    if full.any():
        out[full] = np.maximum.reduceat(np.abs(samples), edges[:-1][full])
    return out


@functools.cache
def mel_bank(n_mels: int = 64, fft: int = FFT, rate: int = 8000) -> np.ndarray:
    """Triangular filters, even on the Slaney scale, each of one area."""
    def to_hz(m):
        return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    top = rate / 2
    most = top * 3 / 200 if top < 1000 else 15 + 27 * np.log(top / 1000) / np.log(6.4)
    points = to_hz(np.linspace(0, most, n_mels + 2))
    f = np.fft.rfftfreq(fft, 1 / rate)
    up = (f - points[:-2, None]) / np.diff(points)[:-1, None]
    down = (points[2:, None] - f) / np.diff(points)[1:, None]
    return np.clip(np.minimum(up, down), 0, None) * (2 / (points[2:] - points[:-2]))[:, None]


def inspect(samples: np.ndarray, rate: int = 8000, cap: int = 256) -> dict:
    """What the inspection page shows, and the spectrum; an algorithm that fails leaves its part empty."""
    whole = spectrum(samples)
    m = whole[::2]
    found = peaks_in(whole)
    made = pairs(found)
    hashes = len(made) if rate == RATES["wang"] else 0  # one of each pair
    mel = decibel(m @ mel_bank(rate=rate).T)
    return {"n_samples": len(samples), "seconds": len(samples) / rate, "envelope": envelope(samples).tolist(), "frames": len(m), "mel_mean": float(mel.mean()), "peaks": found[:cap].tolist(), "n_peaks": len(found), "pairs": made[:cap], "n_pairs": len(made), "n_hashes": hashes, "spectrum": whole}
