"""Affine maps of points in any number of dimensions, and the calibration of video frames.

A map is one small matrix, so it becomes constants in column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column


class Affine:
    """A homogeneous matrix; ``a @ b`` maps by ``b`` first."""

    def __init__(self, matrix: Sequence[Sequence[float]] | np.ndarray):
        self.matrix = np.asarray(matrix, dtype=float)
        n = len(self.matrix)
        if self.matrix.shape != (n, n) or not np.allclose(self.matrix[-1], [0.0] * (n - 1) + [1.0]):
            raise ValueError("an affine map has a square matrix that ends with 0 ... 0 1")

    def __call__(self, *point: Column) -> tuple[Column, ...]:
        if len(point) != len(self.matrix) - 1:
            raise ValueError(f"this map is for points of {len(self.matrix) - 1} dimensions")
        return tuple(sum((float(m) * c for m, c in zip(row, point)), start=float(row[-1])) for row in self.matrix[:-1])

    def __matmul__(self, other: Affine) -> Affine:
        return Affine(self.matrix @ other.matrix)

    def inverse(self) -> Affine:
        return Affine(np.linalg.inv(self.matrix))


def identity(n: int = 2) -> Affine:
    return Affine(np.eye(n + 1))


def scale(*factors: float) -> Affine:
    """One factor for each dimension; a single one is for both of a plane."""
    factors = factors * 2 if len(factors) == 1 else factors
    return Affine(np.diag([*factors, 1.0]))


def translate(*by: float) -> Affine:
    m = np.eye(len(by) + 1)
    m[:-1, -1] = by
    return Affine(m)


def rotation(matrix: Sequence[Sequence[float]], shift: Sequence[float] | None = None) -> Affine:
    """From a rotation matrix of any size, and a shift after it."""
    r = np.asarray(matrix, dtype=float)
    if not np.allclose(r @ r.T, np.eye(len(r)), atol=1e-6) or np.linalg.det(r) < 0:
        raise ValueError("not a rotation: its columns have to be orthonormal and its determinant 1")
    m = np.eye(len(r) + 1)
    m[:-1, :-1] = r
    if shift is not None:
        m[:-1, -1] = shift
    return Affine(m)


def flip_y(height: float) -> Affine:
    """From rows counted downwards, as in images, to upwards."""
    return Affine([[1, 0, 0], [0, -1, height], [0, 0, 1]])


def fit(source: Sequence[Sequence[float]], target: Sequence[Sequence[float]], kind: str = "similarity") -> Affine:
    """The rigid, similarity or affine map that takes ``source`` points to ``target`` with least squares."""
    a, b = np.asarray(source, dtype=float), np.asarray(target, dtype=float)
    n = a.shape[1]
    if a.shape != b.shape or len(a) < n + (kind == "affine"):
        raise ValueError("as many target points as source points are needed, and enough of them")
    m = np.eye(n + 1)
    if kind == "affine":
        m[:-1] = np.linalg.lstsq(np.column_stack([a, np.ones(len(a))]), b, rcond=None)[0].T
        return Affine(m)
    if kind not in ("rigid", "similarity"):
        raise ValueError(f"no such kind of map: {kind}")
    ca, cb = a - a.mean(axis=0), b - b.mean(axis=0)
    u, s, vt = np.linalg.svd(cb.T @ ca)
    signs = np.ones(n)
    signs[-1] = np.sign(np.linalg.det(u @ vt))
    turn = u @ np.diag(signs) @ vt
    size = (s * signs).sum() / (ca * ca).sum() if kind == "similarity" else 1.0
    m[:-1, :-1] = size * turn
    m[:-1, -1] = b.mean(axis=0) - size * turn @ a.mean(axis=0)
    return Affine(m)


class Calibration(NamedTuple):
    """From pixels of a frame (width, height) to centimetres."""

    to_cm: Affine
    frame: tuple[int, int]

    @property
    def to_px(self) -> Affine:
        return self.to_cm.inverse()

    @property
    def cm_per_px(self) -> float:
        """The mean of both axes' scales."""
        return float(np.linalg.norm(self.to_cm.matrix[:2, :2], axis=0).mean())

    def as_dict(self) -> dict:
        return {"matrix": self.to_cm.matrix.tolist(), "frame": list(self.frame)}

    @classmethod
    def from_dict(cls, d: dict) -> Calibration:
        return cls(Affine(d["matrix"]), tuple(d["frame"]))


def by_scale_bar(a: tuple[float, float], b: tuple[float, float], length: float, frame: tuple[int, int]) -> Calibration:
    """From a bar of known length between two pixels."""
    pixels = float(np.hypot(b[0] - a[0], b[1] - a[1]))
    if length <= 0 or pixels == 0:
        raise ValueError("a scale bar has a length, in centimetres and in pixels")
    return by_scale(length / pixels, frame)


def by_scale(cm_per_px: float, frame: tuple[int, int]) -> Calibration:
    return Calibration(scale(cm_per_px) @ flip_y(frame[1]), frame)


def by_landmarks(pixels: Sequence[Sequence[float]], cm: Sequence[Sequence[float]], frame: tuple[int, int], kind: str = "similarity") -> Calibration:
    """From at least three points, not on one line, that are known in both."""
    flip = flip_y(frame[1])
    p = np.column_stack([np.asarray(pixels, dtype=float), np.ones(len(pixels))]) @ flip.matrix.T
    for points in (p[:, :2], np.asarray(cm, dtype=float)):
        spread = np.linalg.svd(points - points.mean(axis=0), compute_uv=False)
        if len(points) < 3 or spread[-1] < 1e-6 * spread[0]:
            raise ValueError("landmarks have to be three or more and not on one line")
    return Calibration(fit(p[:, :2], cm, kind) @ flip, frame)
