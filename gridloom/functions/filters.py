"""Band-pass filters as sums of one-pole filters, whose state is a number for each pole."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Modes(NamedTuple):
    """y[n] = direct * x[n] + 2 Re sum(weight * s[n]), s[n] = pole * s[n-1] + x[n]; of each conjugate pair one pole."""

    pole: np.ndarray
    weight: np.ndarray
    direct: float


def butterworth_band(low: float, high: float, rate: float, order: int = 4) -> Modes:
    """The Butterworth band-pass of ``order`` (its prototype's), by the bilinear transform.

    ``low`` and ``high`` are the edges in cycles per unit of time, ``rate`` the samples in
    one; 0 < low < high < rate / 2.
    """
    if not 0 < low < high < rate / 2:
        raise ValueError("a band has 0 < low < high < rate / 2")
    a, b = (2 * np.tan(np.pi * f / rate) for f in (low, high))  # a sampling rate of 1
    k = np.arange(order)
    prototype = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) * (b - a) / 2
    root = np.sqrt(prototype**2 - a * b)
    analog = np.concatenate([prototype + root, prototype - root])
    pole = (2 + analog) / (2 - analog)
    # Zeros at +1 and -1, ``order`` of each.
    gain = ((b - a) ** order * 2.0**order / np.prod(2 - analog)).real
    weight = np.array([
        gain * (1 - p**-2.0) ** order / np.prod(1 - np.delete(pole, i) / p) for i, p in enumerate(pole)
    ])
    direct = (gain * (-1) ** order / np.prod(pole)).real
    upper = pole.imag > 0
    if upper.sum() != order:
        # A very wide band of an odd order has real poles.
        raise ValueError("the band is too wide for pairs of conjugate poles; take an even order")
    return Modes(pole[upper], weight[upper], float(direct))


def run(modes: Modes, x: np.ndarray, state: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(output, state after) of a stretch that begins in ``state``.

    Blocks run side by side from rest; then their states are chained and their echo added.
    """
    n, size = len(x), min(block, max(1, len(x)))
    rows = -(-n // size)
    padded = np.zeros(rows * size)
    padded[:n] = x
    lanes = padded.reshape(rows, size)
    powers = modes.pole[:, None] ** np.arange(1, size + 1)
    at_rest = np.zeros((len(modes.pole), rows, size), dtype=complex)
    s = np.zeros((len(modes.pole), rows), dtype=complex)
    for i in range(size):
        s = modes.pole[:, None] * s + lanes[:, i]
        at_rest[:, :, i] = s
    before = np.empty((len(modes.pole), rows), dtype=complex)
    carried = state.astype(complex)
    for r in range(rows):
        before[:, r] = carried
        carried = powers[:, -1] * carried + at_rest[:, r, -1]
    full = (at_rest + before[:, :, None] * powers[:, None, :]).reshape(len(modes.pole), -1)[:, :n]
    y = modes.direct * x + 2 * np.tensordot(modes.weight, full, axes=1).real
    return y, (full[:, -1] if n else state)


def hilbert_taps(reach: int) -> np.ndarray:
    """The Hilbert transform's kernel at -reach..reach, tapered by a Hann window."""
    k = np.arange(-reach, reach + 1)
    odd = k % 2 != 0
    taps = np.zeros(2 * reach + 1)
    taps[odd] = 2 / (np.pi * k[odd])
    return taps * (0.5 + 0.5 * np.cos(np.pi * k / (reach + 1)))


def convolve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The part of a convolution that all taps reach, by fast Fourier transforms."""
    size = 1 << (len(x) + len(taps) - 2).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)
    return full[len(taps) - 1 : len(x)]
