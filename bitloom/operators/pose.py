"""Dense kernels on correspondences: minimal pose models, consensus by sampling, robust refinement, bundles, planes.

Kernels are numpy on the rows of one group (a frame's correspondences, a plane's points); groups are frames of a query
and move through applyInPandas. Rotations are 3 x 3, poses map points of the world into the camera.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bitloom.functions.robust import CAUCHY, HUBER, MAD_TO_SIGMA, TUKEY, ransac_rounds

# ---------------------------------------------------------------- algebra


def cube_root(z: complex) -> complex:
    """The principal cube root."""
    return 0j if z == 0 else complex(z) ** (1 / 3)


def quartic_roots(c: np.ndarray) -> np.ndarray:
    """The four complex roots of c[0] x^4 + ... + c[4], through the resolvent cubic; fewer where c[0] is 0."""
    c = np.asarray(c, complex)
    if abs(c[0]) < 1e-14 * max(1.0, np.abs(c).max()):
        return np.roots(c)
    b, c2, d, e = c[1:] / c[0]
    p, q, r = c2 - 3 * b * b / 8, d - b * c2 / 2 + b**3 / 8, e - b * d / 4 + b * b * c2 / 16 - 3 * b**4 / 256
    if abs(q) < 1e-14:
        s = np.sqrt(p * p - 4 * r + 0j)
        y = [sign * np.sqrt((-p + t) / 2 + 0j) for t in (s, -s) for sign in (1, -1)]
    else:
        # a root m of the resolvent m^3 + p m^2 + (p^2/4 - r) m - q^2/8
        a2, a1, a0 = p, p * p / 4 - r, -q * q / 8
        k = a2 * a2 / 9 - a1 / 3
        h = a2**3 / 27 - a2 * a1 / 6 + a0 / 2
        root = np.sqrt(h * h - k**3 + 0j)
        u = cube_root(-h + root if abs(-h + root) > abs(-h - root) else -h - root)
        m = u + (k / u if u else 0) - a2 / 3
        s = np.sqrt(2 * m + 0j)
        y = [(sign * s + t * np.sqrt(-(2 * p + 2 * m + sign * 2 * q / s) + 0j)) / 2 for sign in (1, -1) for t in (1, -1)]
    return np.array(y) - b / 4


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def se3_exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, translation) of six numbers: the translation's, then the rotation's."""
    t, w = np.asarray(x[:3], float), np.asarray(x[3:], float)
    angle, k = float(np.linalg.norm(w)), skew(w)
    if angle < 1e-8:
        a, b, c = 1.0, 0.5, 1 / 6
    else:
        a, b, c = math.sin(angle) / angle, (1 - math.cos(angle)) / angle**2, (angle - math.sin(angle)) / angle**3
    kk = k @ k
    return np.eye(3) + a * k + b * kk, (np.eye(3) + b * k + c * kk) @ t


def se3_log(rotation: np.ndarray, translation: np.ndarray) -> np.ndarray:
    cosine = np.clip((np.trace(rotation) - 1) / 2, -1, 1)
    angle = math.acos(cosine)
    if angle < 1e-8:
        w = np.array([rotation[2, 1] - rotation[1, 2], rotation[0, 2] - rotation[2, 0], rotation[1, 0] - rotation[0, 1]]) / 2
    elif math.pi - angle < 1e-5:
        axis = np.sqrt(np.maximum((np.diag(rotation) + 1) / 2, 0))
        k = int(np.argmax(axis))
        axis = (rotation[k] + np.eye(3)[k]) / (2 * axis[k])
        w = angle * axis / np.linalg.norm(axis)
    else:
        w = angle / (2 * math.sin(angle)) * np.array([rotation[2, 1] - rotation[1, 2], rotation[0, 2] - rotation[2, 0], rotation[1, 0] - rotation[0, 1]])
    k, theta = skew(w), float(np.linalg.norm(w))
    if theta < 1e-8:
        inverse = np.eye(3) - k / 2
    else:
        inverse = np.eye(3) - k / 2 + (1 / theta**2 - (1 + math.cos(theta)) / (2 * theta * math.sin(theta)) if math.sin(theta) else 1 / theta**2) * (k @ k)
    return np.concatenate([inverse @ translation, w])


def rigid(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotation and translation that best move source onto target."""
    a, b = source.mean(0), target.mean(0)
    u, _, vt = np.linalg.svd((source - a).T @ (target - b))
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ d @ u.T
    return r, b - r @ a


def triangulate(rotation: np.ndarray, translation: np.ndarray, a: np.ndarray, b: np.ndarray, far: float = 1e6) -> np.ndarray:
    """The point, in B's coordinates, seen at b there and at a in the camera A that the pose leads to: midway between the
    rays where they come closest, then moved by two Gauss-Newton steps on both images' errors. Rays that are parallel meet
    `far` along B's."""
    towards = np.array([b[0], b[1], 1.0])
    other = rotation.T @ np.array([a[0], a[1], 1.0])
    origin = -rotation.T @ translation
    rays = np.column_stack([towards, -other])
    gram = rays.T @ rays
    if abs(np.linalg.det(gram)) < 1e-14 * gram[0, 0] * gram[1, 1]:
        return towards * far
    s, u = np.linalg.solve(gram, rays.T @ origin)
    x = (s * towards + origin + u * other) / 2
    for _ in range(2):
        rows, errors = [], []
        for r, t, seen in ((np.eye(3), np.zeros(3), b), (rotation, translation, a)):
            y = r @ x + t
            if abs(y[2]) < 1e-12:
                return x
            rows.append((r[:2] - np.outer(y[:2] / y[2], r[2])) / y[2])
            errors.append(seen[:2] - y[:2] / y[2])
        x = x + np.linalg.lstsq(np.vstack(rows), np.concatenate(errors), rcond=None)[0]
    return x


# ---------------------------------------------------------------- pose from points


def p3p(points: np.ndarray, rays: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Poses for three points and their unit rays: depth ratios are the real roots of a quartic, then a rigid fit."""
    a2, b2, c2 = (float(((points[i] - points[j]) ** 2).sum()) for i, j in ((1, 2), (0, 2), (0, 1)))
    if min(a2, b2, c2) < 1e-18:
        return []
    ca, cb, cg = (float(rays[i] @ rays[j]) for i, j in ((1, 2), (0, 2), (0, 1)))
    q, s = (a2 - c2) / b2, (a2 + c2) / b2
    coefficients = np.array([
        (q - 1) ** 2 - 4 * c2 / b2 * ca**2,
        4 * (q * (1 - q) * cb - (1 - s) * ca * cg + 2 * c2 / b2 * ca**2 * cb),
        2 * (q**2 - 1 + 2 * q**2 * cb**2 + 2 * (b2 - c2) / b2 * ca**2 - 4 * s * ca * cb * cg + 2 * (b2 - a2) / b2 * cg**2),
        4 * (-q * (1 + q) * cb + 2 * a2 / b2 * cg**2 * cb - (1 - s) * ca * cg),
        (1 + q) ** 2 - 4 * a2 / b2 * cg**2,
    ])
    out = []
    for v in quartic_roots(coefficients):
        if abs(v.imag) > 1e-5 * max(1.0, abs(v.real)) or v.real <= 0:
            continue
        v = v.real
        down = 2 * (cg - v * ca)
        if abs(down) < 1e-12:
            continue
        u = ((q - 1) * v * v - 2 * q * cb * v + 1 + q) / down
        depth = 1 + v * v - 2 * v * cb
        if u <= 0 or depth <= 0:
            continue
        first = math.sqrt(b2 / depth)
        out.append(rigid(points, rays * (first * np.array([1.0, u, v]))[:, None]))
    return out


def reprojected(rotation: np.ndarray, translation: np.ndarray, points: np.ndarray, focal: float, centre: tuple[float, float]) -> np.ndarray:
    moved = points @ rotation.T + translation
    z = np.where(np.abs(moved[:, 2]) < 1e-12, 1e-12, moved[:, 2])
    return np.stack([focal * moved[:, 0] / z + centre[0], focal * moved[:, 1] / z + centre[1]], 1)


@dataclass(frozen=True)
class PoseParams:
    """pixels: consensus radius. rounds: samples at most. widen: radius, as a multiple, of the refinement's inliers."""

    focal: float = 300.0
    centre: tuple[float, float] = (320.0, 240.0)
    pixels: float = 9.0
    rounds: int = 1000
    confidence: float = 0.99
    least: int = 4
    widen: float = 3.0
    steps: int = 10
    estimator: str = "tukey"
    seed: int = 1
    farthest: float | None = None


def four_point(points: np.ndarray, pixels: np.ndarray, p: PoseParams) -> tuple[np.ndarray, np.ndarray] | None:
    """The pose of three correspondences that serves the fourth best."""
    rays = np.column_stack([(pixels - p.centre) / p.focal, np.ones(len(pixels))])
    rays /= np.linalg.norm(rays, axis=1)[:, None]
    best, least = None, math.inf
    for r, t in p3p(points[:3], rays[:3]):
        error = float(((reprojected(r, t, points[3:4], p.focal, p.centre) - pixels[3:4]) ** 2).sum())
        if error < least and (points[3] @ r[2] + t[2]) > 0:
            best, least = (r, t), error
    return best


def consensus(pose, points, pixels, p: PoseParams, radius: float) -> np.ndarray:
    return ((reprojected(*pose, points, p.focal, p.centre) - pixels) ** 2).sum(1) < radius**2


def ransac(points: np.ndarray, pixels: np.ndarray, p: PoseParams, order: np.ndarray | None = None):
    """(pose, inliers) with the largest consensus, the first of equals; None with fewer than `least`.

    With order, best first, samples come from a prefix that grows with the rounds (progressive sampling), and the bound
    on rounds follows the best consensus so far.
    """
    n, rng, best, inliers, limit, k = len(points), np.random.default_rng(p.seed), None, np.zeros(len(points), bool), p.rounds, 0
    if n < 4:
        return None, inliers
    while k < limit:
        if order is None:
            picked = rng.choice(n, 4, replace=False)
        else:
            reach = min(n, 4 + k * n // max(1, p.rounds // 2))
            picked = order[np.append(rng.choice(reach - 1, 3, replace=False), reach - 1)]
        k += 1
        if len({tuple(x) for x in pixels[picked]}) < 4:
            continue
        pose = four_point(points[picked], pixels[picked], p)
        if pose is None:
            continue
        hit = consensus(pose, points, pixels, p, p.pixels)
        if hit.sum() > inliers.sum():
            best, inliers = pose, hit
            if order is not None:
                limit = min(limit, max(k, ransac_rounds(p.confidence, 1 - hit.mean(), 4, p.rounds)))
    return (best, inliers) if best is not None and inliers.sum() >= p.least else (None, np.zeros(n, bool))


def sigma_squared(error2: np.ndarray, estimator: str) -> float:
    """From the upper median of a copy, so that weights stay with their rows."""
    n = len(error2)
    if n < 4:
        return math.nan
    factor = {"tukey": TUKEY, "cauchy": CAUCHY, "huber": HUBER}[estimator]
    return (factor * MAD_TO_SIGMA * (1 + 5 / (2 * n - 6)) * math.sqrt(np.sort(error2)[n // 2])) ** 2


def robust_weights(error2: np.ndarray, sigma2: float, estimator: str) -> np.ndarray:
    sigma2 = max(sigma2, 1e-12)
    if estimator == "tukey":
        return np.where(error2 > sigma2, 0.0, (1 - error2 / sigma2) ** 2)
    if estimator == "cauchy":
        return 1 / (1 + error2 / sigma2)
    if estimator == "huber":
        return np.where(error2 < sigma2, 1.0, np.sqrt(sigma2 / np.maximum(error2, 1e-30)))
    return np.ones(len(error2))


def refine(pose, points: np.ndarray, pixels: np.ndarray, p: PoseParams, floor: float = 0.0):
    """Reweighted Gauss-Newton on the six pose numbers, with a weak prior at no motion."""
    r, t = pose
    for _ in range(p.steps):
        moved = points @ r.T + t
        z = np.where(np.abs(moved[:, 2]) < 1e-9, 1e-9, moved[:, 2])
        error = pixels - np.stack([p.focal * moved[:, 0] / z + p.centre[0], p.focal * moved[:, 1] / z + p.centre[1]], 1)
        e2 = (error**2).sum(1)
        w = robust_weights(e2, max(sigma_squared(e2, p.estimator), floor), p.estimator)
        x, y = moved[:, 0] / z, moved[:, 1] / z
        zero = np.zeros(len(z))
        ju = p.focal * np.stack([1 / z, zero, -x / z, -x * y, 1 + x * x, -y], 1)
        jv = p.focal * np.stack([zero, 1 / z, -y / z, -1 - y * y, x * y, x], 1)
        h = (ju * w[:, None]).T @ ju + (jv * w[:, None]).T @ jv + np.eye(6) * 1e-6
        g = (ju * (w * error[:, 0])[:, None]).sum(0) + (jv * (w * error[:, 1])[:, None]).sum(0)
        dr, dt = se3_exp(np.linalg.solve(h, g))
        r, t = dr @ r, dr @ t + dt
    return r, t


RELOCALISED = "frame long, found boolean, n long, inliers long, pose array<double>"


def relocalise(pairs: DataFrame, p: PoseParams = PoseParams(), progressive: bool = True, sampled: bool = True) -> DataFrame:
    """RELOCALISED per frame of pairs (frame, x, y, z, u, v, d): consensus, wider inliers, refinement, acceptance.

    pose: rotation by columns, then translation. Without sampling, refinement starts from no motion. found is false for
    too few pairs or inliers, a pose that is not a number or one that moved beyond `farthest`.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _localise(pdf, p, progressive, sampled)
        return pd.DataFrame({k: [found[k]] for k in ("frame", "found", "n", "inliers", "pose")})

    return pairs.groupBy("frame").applyInPandas(one, RELOCALISED)


def _localise(pdf: pd.DataFrame, p: PoseParams, progressive: bool, sampled: bool) -> dict:
    """One frame's RELOCALISED row, with the points of the last consensus and the seconds that preparing, pairing and all
    of it took."""
    began = time.perf_counter()
    pdf = pdf.sort_values(["d", "x", "y", "z", "u", "v"], kind="stable")
    points, pixels = pdf[["x", "y", "z"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float)
    ready = time.perf_counter()
    pose, inliers = (ransac(points, pixels, p, np.arange(len(pdf)) if progressive else None)) if sampled else ((np.eye(3), np.zeros(3)), np.ones(len(pdf), bool))
    paired = time.perf_counter()
    found, count, held = pose is not None and len(pdf) >= 4, 0, points[:0]
    if found:
        use = consensus(pose, points, pixels, p, p.pixels * p.widen) if sampled else inliers
        pose = refine(pose, points[use], pixels[use], p if sampled else PoseParams(**{**p.__dict__, "steps": 30}))
        agree = consensus(pose, points, pixels, p, p.pixels)
        count, held = int(agree.sum()), points[agree]
        ok = np.isfinite(pose[0]).all() and np.isfinite(pose[1]).all()
        found = bool(ok and count >= p.least and (p.farthest is None or np.linalg.norm(pose[0].T @ pose[1]) <= p.farthest))
    numbers = [*pose[0].T.ravel().tolist(), *pose[1].tolist()] if found else None
    return {"frame": int(pdf["frame"].iloc[0]), "found": found, "n": len(pdf), "inliers": count, "pose": numbers, "points": held, "prep": ready - began, "pair": paired - ready, "all": time.perf_counter() - began}


RECOVERED = "frame int, " + ", ".join(f"p{k} double" for k in range(12)) + ", t_reloc double, t_prep double, t_pair double, query_size int, map_size int, inliers int, points array<struct<x: double, y: double, z: double>>"


def recovered(pairs: DataFrame, p: PoseParams = PoseParams(), progressive: bool = True) -> DataFrame:
    """RECOVERED of every frame that is found again: its pose, the seconds of each stage, sizes, and its inliers' points.

    query_size is the number of pairs, map_size that of their distinct points.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _localise(pdf, p, progressive, True)
        row = {"frame": r["frame"], **{f"p{k}": x for k, x in enumerate(r["pose"] or [0.0] * 12)}, "t_reloc": r["all"], "t_prep": r["prep"], "t_pair": r["pair"], "query_size": r["n"], "map_size": len(pdf[["x", "y", "z"]].drop_duplicates()), "inliers": r["inliers"]}
        row["points"] = [{"x": x, "y": y, "z": z} for x, y, z in r["points"].tolist()]
        return pd.DataFrame([row] if r["found"] else [], columns=list(row))

    return pairs.groupBy("frame").applyInPandas(one, RECOVERED)


# ---------------------------------------------------------------- planes and homographies


def dominant_plane(points: np.ndarray, rounds: int = 100, cut: float = 0.05, seed: int = 1) -> tuple[np.ndarray, float, np.ndarray]:
    """(normal, offset, inliers) of the plane of three points with the least truncated distances, refitted to its inliers."""
    rng, best, least = np.random.default_rng(seed), None, math.inf
    for _ in range(rounds):
        a, b, c = points[rng.choice(len(points), 3, replace=False)]
        normal = np.cross(b - a, c - a)
        length = np.linalg.norm(normal)
        if length < 1e-12:
            continue
        normal /= length
        score = float(np.minimum(np.abs((points - a) @ normal), cut).sum())
        if score < least:
            best, least = (normal, float(normal @ a)), score
    if best is None:
        raise ValueError("the points are on one line")
    inliers = np.abs(points @ best[0] - best[1]) < cut
    mean = points[inliers].mean(0)
    normal = np.linalg.eigh((points[inliers] - mean).T @ (points[inliers] - mean))[1][:, 0]
    return normal, float(normal @ mean), inliers


def _homography(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    rows = []
    for (x, y), (u, v) in zip(a, b):
        rows.append([x, y, 1, 0, 0, 0, -u * x, -u * y, -u])
        rows.append([0, 0, 0, x, y, 1, -v * x, -v * y, -v])
    m = np.array(rows) * (np.repeat(w, 2)[:, None] if w is not None else 1.0)
    return np.linalg.svd(m)[2][-1].reshape(3, 3)


def _mapped(h: np.ndarray, a: np.ndarray) -> np.ndarray:
    x = np.column_stack([a, np.ones(len(a))]) @ h.T
    return x[:, :2] / np.where(np.abs(x[:, 2:]) < 1e-12, 1e-12, x[:, 2:])


def robust_homography(a: np.ndarray, b: np.ndarray, rounds: int = 300, cut: float = 0.01, refinements: int = 5, seed: int = 1) -> np.ndarray:
    """The homography of the sample with the least truncated squared error, refitted with Tukey weights."""
    rng, best, least = np.random.default_rng(seed), None, math.inf
    for _ in range(rounds):
        k = rng.choice(len(a), 4, replace=False)
        h = _homography(a[k], b[k])
        score = float(np.minimum(((_mapped(h, a) - b) ** 2).sum(1), cut**2).sum())
        if score < least:
            best, least = h, score
    for _ in range(refinements):
        e2 = ((_mapped(best, a) - b) ** 2).sum(1)
        w = robust_weights(e2, sigma_squared(e2, "tukey"), "tukey")
        if (w > 0).sum() >= 4:
            best = _homography(a[w > 0], b[w > 0], np.sqrt(w[w > 0]))
    return best / np.linalg.norm(best) * (np.sign(np.linalg.det(best)) or 1)


def decompose(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Up to four (rotation, translation over distance, normal) whose plane motion is this homography.

    By the eigenvectors of H'H: with its middle singular value at one, H keeps the lengths of two planes of vectors, those
    that the plane's translation doesn't reach. In either, two axes and their product tell how H turns it, and what H adds
    along the normal is the translation. Signs are such that both cameras are on one side of the plane.
    """
    h = np.asarray(h, float)
    h = h * (np.sign(np.linalg.det(h)) or 1.0) / np.linalg.svd(h, compute_uv=False)[1]
    power, axes = np.linalg.eigh(h.T @ h)
    small, large = power[0], power[2]
    if large - small < 1e-9:
        return [(h, np.zeros(3), np.array([0.0, 0.0, 1.0]))]
    low, kept, high = axes.T
    out = []
    for sign in (1.0, -1.0):
        along = (math.sqrt(max(0.0, 1 - small)) * high + sign * math.sqrt(max(0.0, large - 1)) * low) / math.sqrt(large - small)
        normal = np.cross(kept, along)
        frame = np.column_stack([kept, along, normal])
        turned = np.column_stack([h @ kept, h @ along, np.cross(h @ kept, h @ along)])
        rotation = turned @ frame.T
        shift = (h - rotation) @ normal
        out += [(rotation, shift, normal), (rotation, -shift, -normal)]
    return out


def plausible_motions(candidates, a: np.ndarray, b: np.ndarray, ratio: float = 0.9) -> list:
    """Candidates whose plane lies before both cameras for nearly the most points, by their Sampson error.

    Two motions explain a scene that is one plane equally well; the first is the choice, the second the doubt.
    """
    rays_a = np.column_stack([a, np.ones(len(a))])
    rays_b = np.column_stack([b, np.ones(len(b))])

    def visible(c):
        r, t, n = c
        depth = rays_a @ n
        moved = rays_a @ (r + np.outer(t, n)).T
        return int(((depth > 0) & (moved[:, 2] > 0)).sum())

    def sampson(c):
        r, t, _ = c
        e = skew(t) @ r
        x, y = rays_a @ e.T, rays_b @ e
        top = (rays_b * x).sum(1) ** 2
        return float((top / np.maximum(x[:, 0] ** 2 + x[:, 1] ** 2 + y[:, 0] ** 2 + y[:, 1] ** 2, 1e-18)).sum())

    seen = [visible(c) for c in candidates]
    kept = [c for c, v in zip(candidates, seen) if v >= ratio * max(seen)]
    return sorted(kept, key=sampson)


# ---------------------------------------------------------------- bundles


@dataclass
class Bundle:
    """Cameras (rotation, translation, fixed), points, and measurements (camera, point, image x, y on the unit plane)."""

    cameras: list[tuple[np.ndarray, np.ndarray, bool]]
    points: np.ndarray
    measured: np.ndarray

    def errors(self, cameras=None, points=None):
        cameras, points = cameras or self.cameras, self.points if points is None else points
        c, k = self.measured[:, 0].astype(int), self.measured[:, 1].astype(int)
        rot, tr = np.array([x[0] for x in cameras])[c], np.array([x[1] for x in cameras])[c]
        moved = np.einsum("nij,nj->ni", rot, points[k]) + tr
        z = np.where(np.abs(moved[:, 2]) < 1e-9, 1e-9, moved[:, 2])
        return self.measured[:, 2:4] - moved[:, :2] / z[:, None], moved

    def solve(self, estimator: str = "tukey", steps: int = 20, floor: float = 1e-8) -> tuple[int, float]:
        """Levenberg-Marquardt with the points eliminated; (steps taken, last cost). Poses and points change in place."""
        damping, grow = 1e-4, 2.0
        free = [k for k, c in enumerate(self.cameras) if not c[2]]
        slot = {k: i for i, k in enumerate(free)}
        cost = math.inf
        for step in range(steps):
            error, moved = self.errors()
            e2 = (error**2).sum(1)
            sigma2 = max(sigma_squared(e2, estimator) if len(e2) >= 4 else floor, floor)
            w = robust_weights(e2, sigma2, estimator)
            cost = _cost(e2, sigma2, estimator)
            nc, np_ = len(free), len(self.points)
            u, v, wj = np.zeros((nc, 6, 6)), np.zeros((np_, 3, 3)), {}
            ea, eb = np.zeros((nc, 6)), np.zeros((np_, 3))
            for m in range(len(self.measured)):
                c, k = int(self.measured[m, 0]), int(self.measured[m, 1])
                x, y, z = moved[m]
                z = z if abs(z) > 1e-9 else 1e-9
                j = np.array([[1 / z, 0, -x / z**2], [0, 1 / z, -y / z**2]])
                jp = j @ self.cameras[c][0]
                v[k] += w[m] * jp.T @ jp
                eb[k] += w[m] * jp.T @ error[m]
                if c in slot:
                    jc = j @ np.hstack([np.eye(3), -skew(moved[m])])
                    i = slot[c]
                    u[i] += w[m] * jc.T @ jc
                    ea[i] += w[m] * jc.T @ error[m]
                    wj[i, k] = wj.get((i, k), 0) + w[m] * jc.T @ jp
            for _ in range(10):
                vi = np.linalg.inv(v * (1 + damping * np.eye(3)) + 1e-12 * np.eye(3))
                s, g = np.zeros((6 * nc, 6 * nc)), ea.copy()
                by_point: dict[int, list[int]] = {}
                for i, k in wj:
                    by_point.setdefault(k, []).append(i)
                for i in range(nc):
                    s[6 * i : 6 * i + 6, 6 * i : 6 * i + 6] = u[i] * (1 + damping * np.eye(6)) + 1e-12 * np.eye(6)
                for k, cams in by_point.items():
                    for i in cams:
                        y = wj[i, k] @ vi[k]
                        g[i] -= y @ eb[k]
                        for j2 in cams:
                            s[6 * i : 6 * i + 6, 6 * j2 : 6 * j2 + 6] -= y @ wj[j2, k].T
                da = np.linalg.solve(s, g.ravel()).reshape(nc, 6) if nc else np.zeros((0, 6))
                back = eb.copy()
                for (i, k), block in wj.items():
                    back[k] -= block.T @ da[i]
                db = np.einsum("nij,nj->ni", vi, back)
                cameras = list(self.cameras)
                for i, k in enumerate(free):
                    dr, dt = se3_exp(da[i])
                    r, t, fixed = cameras[k]
                    cameras[k] = (dr @ r, dr @ t + dt, fixed)
                new = _cost((self.errors(cameras, self.points + db)[0] ** 2).sum(1), sigma2, estimator)
                if new < cost:
                    damping, grow = damping * 0.3, 2.0
                    self.cameras, self.points, cost = cameras, self.points + db, new
                    break
                damping, grow = damping * grow, grow * 2
            else:
                return step, cost
            if (da**2).sum() + (db**2).sum() < 1e-6**2:
                return step + 1, cost
        return steps, cost

    def outliers(self, estimator: str = "tukey", floor: float = 1e-8) -> np.ndarray:
        """Measurements beyond the estimator's scale."""
        e2 = (self.errors()[0] ** 2).sum(1)
        return e2 > max(sigma_squared(e2, estimator), floor)


def _cost(e2: np.ndarray, s2: float, estimator: str) -> float:
    if estimator == "tukey":
        return float(np.where(e2 > s2, 1.0, 1 - (1 - np.minimum(e2 / s2, 1)) ** 3).sum())
    if estimator == "cauchy":
        return float(np.log1p(e2 / s2).sum())
    if estimator == "huber":
        return float(np.where(e2 < s2, e2 / 2, math.sqrt(s2) * (np.sqrt(e2) - math.sqrt(s2) / 2)).sum())
    return float(e2.sum())


# ---------------------------------------------------------------- grouped forms


def per_group(df: DataFrame, by: str, kernel: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row a group from a numpy kernel; a group is one frame's or object's rows."""
    return df.groupBy(by).applyInPandas(lambda pdf: pd.DataFrame([{by: pdf[by].iloc[0], **kernel(pdf)}]), schema)
