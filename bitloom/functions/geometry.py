"""Distances, angles, camera models and small matrices, as expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(*components: Column) -> Column:
    total = components[0] * components[0]
    for c in components[1:]:
        total = total + c * c
    return F.sqrt(total)


def distance(a: list[Column], b: list[Column]) -> Column:
    return norm(*[x - y for x, y in zip(a, b)])


def angle_apart(a: Column, b: Column) -> Column:
    """Difference of two headings in degrees, 0 to 180."""
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


@dataclass(frozen=True)
class FieldOfViewCamera:
    """A camera whose radial distortion is an arc tangent: sizes, focal lengths and centre as shares of the image, w."""

    width: float = 640.0
    height: float = 480.0
    fx: float = 0.5
    fy: float = 0.75
    cx: float = 0.5
    cy: float = 0.5
    w: float = 0.1
    largest: float = field(default=0.0, init=False)

    def __post_init__(self) -> None:
        ends = [(u, v) for u in (0, self.width) for v in (0, self.height)]
        far = max(math.hypot((u - self.u0) / self.focal_x, (v - self.v0) / self.focal_y) for u, v in ends)
        object.__setattr__(self, "largest", self._inverse(far))

    @property
    def focal_x(self) -> float:
        return self.width * self.fx

    @property
    def focal_y(self) -> float:
        return self.height * self.fy

    @property
    def u0(self) -> float:
        return self.width * self.cx - 0.5

    @property
    def v0(self) -> float:
        return self.height * self.cy - 0.5

    @property
    def _two_tan(self) -> float:
        return 2 * math.tan(self.w / 2)

    def _inverse(self, r: float) -> float:
        return math.tan(r * self.w) / self._two_tan if self.w else r

    def project(self, x: Column, y: Column) -> tuple[Column, Column, Column]:
        """(u, v, invalid) of a point on the plane at distance 1."""
        r = norm(x, y)
        factor = F.lit(1.0) if not self.w else F.when(r < 0.001, 1.0).otherwise(F.atan(r * self._two_tan) / (r * self.w))
        return x * factor * self.focal_x + self.u0, y * factor * self.focal_y + self.v0, r > 1.5 * self.largest

    def unproject(self, u: Column, v: Column) -> tuple[Column, Column]:
        x, y = (u - self.u0) / self.focal_x, (v - self.v0) / self.focal_y
        r = norm(x, y)
        factor = F.lit(1.0) if not self.w else F.when(r < 0.01, 1.0).otherwise(F.tan(r * self.w) / (r * self._two_tan))
        return x * factor, y * factor

    def derivatives(self, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
        """du/dx, du/dy, dv/dx, dv/dy of project()."""
        r = norm(x, y)
        if self.w:
            k = self._two_tan
            factor = F.when(r < 0.001, 1.0).otherwise(F.atan(r * k) / (r * self.w))
            slope = F.when(r < 0.001, 0.0).otherwise((k / (self.w * (1 + k * k * r * r)) - factor) / (r * r))
        else:
            factor, slope = F.lit(1.0), F.lit(0.0)
        return (
            self.focal_x * (factor + slope * x * x),
            self.focal_x * slope * x * y,
            self.focal_y * slope * x * y,
            self.focal_y * (factor + slope * y * y),
        )

    def visible(self, x: Column, y: Column, z: Column) -> Column:
        """Whether a point in camera coordinates is in front, within the lens and on the image."""
        front = F.when(z >= 0.001, z)
        u, v, invalid = self.project(x / front, y / front)
        inside = (u >= 0) & (v >= 0) & (u <= self.width - 1) & (v <= self.height - 1)
        return F.coalesce((norm(x / front, y / front) <= self.largest) & ~invalid & inside, F.lit(False))


@dataclass(frozen=True)
class PinholeCamera:
    focal: float = 300.0
    cx: float = 320.0
    cy: float = 240.0

    def project(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x * self.focal + self.cx, y * self.focal + self.cy

    def unproject(self, u: Column, v: Column) -> tuple[Column, Column]:
        return (u - self.cx) / self.focal, (v - self.cy) / self.focal


def level_scale(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def to_root(position: Column, level: Column) -> Column:
    """A pyramid level's pixel position in the full image; pixel centres are half a pixel in."""
    return (position + 0.5) * level_scale(level) - 0.5


def to_level(position: Column, level: Column) -> Column:
    return (position + 0.5) / level_scale(level) - 0.5


def search_level(det: Column, levels: int = 4) -> Column:
    """The level whose scaled determinant is 3 or less, counted from the finest; null if it leaves 0.25 to 3."""
    out = F.lit(None).cast("int")
    for k in reversed(range(levels)):
        scaled = det / float(4**k)
        out = F.when(scaled <= 3, F.when(scaled >= 0.25, k)).otherwise(out)
    return out


def det2(a: Column, b: Column, c: Column, d: Column) -> Column:
    return a * d - b * c


def inverse2(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column, Column]:
    det = det2(a, b, c, d)
    return d / det, -b / det, -c / det, a / det


def det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def inverse3(m: list[list[Column]]) -> list[list[Column]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = det3(m)
    return [
        [(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det],
        [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det],
        [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det],
    ]


def gray(red: Column, green: Column, blue: Column) -> Column:
    return F.floor((red.cast("int") + green.cast("int") + blue.cast("int")) / 3).cast("int")


def squared_apart(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def zero_mean_squared_apart(a: Column, b: Column) -> Column:
    """Sum of squared differences after each array's mean is taken off."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    gap = total(a) - total(b)
    return squared_apart(a, b) - gap * gap / F.size(a)


def pixel_vectors(camera: FieldOfViewCamera, u: Column, v: Column, depth: Column, step: Column) -> tuple[list[Column], list[Column]]:
    """How a point at this depth moves, in camera coordinates, for `step` pixels to the right and down."""
    x0, y0 = camera.unproject(u, v)
    out = []
    for du, dv in ((1.0, 0.0), (0.0, 1.0)):
        x, y = camera.unproject(u + step * du, v + step * dv)
        out.append([(x - x0) * depth, (y - y0) * depth, F.lit(0.0)])
    return out[0], out[1]
