"""Calibration of a field-of-view camera from views of a flat grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from bitloom.operators.pose import _homography, se3_exp


@dataclass(frozen=True)
class Lens:
    """Focal lengths, centre (pixels) and the distortion w."""

    fx: float
    fy: float
    cx: float
    cy: float
    w: float

    def project(self, plane: np.ndarray) -> np.ndarray:
        r = np.linalg.norm(plane, axis=1)
        k = 2 * math.tan(self.w / 2)
        factor = np.where(r < 1e-3, 1.0, np.arctan(r * k) / np.maximum(r * self.w, 1e-12)) if abs(self.w) > 1e-9 else np.ones(len(r))
        return plane * factor[:, None] * [self.fx, self.fy] + [self.cx, self.cy]

    def unproject(self, pixels: np.ndarray) -> np.ndarray:
        plane = (pixels - [self.cx, self.cy]) / [self.fx, self.fy]
        r = np.linalg.norm(plane, axis=1)
        k = 2 * math.tan(self.w / 2)
        factor = np.where(r < 1e-3, 1.0, np.tan(r * self.w) / np.maximum(r * k, 1e-12)) if abs(self.w) > 1e-9 else np.ones(len(r))
        return plane * factor[:, None]

    def numbers(self) -> np.ndarray:
        return np.array([self.fx, self.fy, self.cx, self.cy, self.w])


def initial_pose(lens: Lens, grid: np.ndarray, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pose of a flat grid (x, y) from the homography to its unprojected pixels, with its columns made orthogonal."""
    h = _homography(grid, lens.unproject(pixels))
    h = h / np.linalg.norm(h[:, 0]) * (1 if h[2, 2] > 0 else -1)
    u, _, vt = np.linalg.svd(np.column_stack([h[:, 0], h[:, 1], np.cross(h[:, 0], h[:, 1])]))
    r = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
    return r, h[:, 2] / ((np.linalg.norm(h[:, 0]) + np.linalg.norm(h[:, 1])) / 2)


def _residual(lens: Lens, poses, views) -> np.ndarray:
    out = []
    for (r, t), (grid, pixels) in zip(poses, views):
        x = np.column_stack([grid, np.zeros(len(grid))]) @ r.T + t
        out.append((pixels - lens.project(x[:, :2] / x[:, 2:])).ravel())
    return np.concatenate(out)


def calibrate(lens: Lens, views: list[tuple[np.ndarray, np.ndarray]], steps: int = 60, damping: float = 0.1) -> tuple[Lens, float]:
    """(lens, RMS error in pixels): joint Gauss-Newton over the lens and each view's pose, steps damped until they settle.

    views: (grid corners, pixels). Derivatives are numeric, as there are 5 + 6 views unknowns only.
    """
    poses = [initial_pose(lens, g, p) for g, p in views]
    for k in range(steps):
        e = _residual(lens, poses, views)
        columns, base = [], lens.numbers()
        for i in range(5):
            d = np.zeros(5)
            d[i] = 1e-4 * max(1.0, abs(base[i])) if i < 4 else 1e-5
            columns.append((_residual(Lens(*(base + d)), poses, views) - e) / -d[i])
        for v in range(len(views)):
            for i in range(6):
                d = np.zeros(6)
                d[i] = 1e-6
                r, t = se3_exp(d)
                moved = list(poses)
                moved[v] = (r @ poses[v][0], r @ poses[v][1] + t)
                columns.append((_residual(lens, moved, views) - e) / -1e-6)
        j = np.stack(columns, 1)
        step = np.linalg.lstsq(j, e, rcond=None)[0] * (damping if k < steps // 2 else 1.0)
        lens = Lens(*(base + step[:5]))
        poses = [(se3_exp(step[5 + 6 * v : 11 + 6 * v])[0] @ r, se3_exp(step[5 + 6 * v : 11 + 6 * v])[0] @ t + se3_exp(step[5 + 6 * v : 11 + 6 * v])[1]) for v, (r, t) in enumerate(poses)]
    e = _residual(lens, poses, views)
    return lens, float(np.sqrt((e * e).mean() * 2))
