"""Cameras, frusta, projected errors and normal cones on columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.vectors import Vec

#: Scales of quantised normal cones: the axis, and the anchor offsets clamped to +-10.
AXIS_SCALE, LENGTH_SCALE, LENGTH_LIMIT = 32766.0, 3276.0, 10.0


def frustum_planes(projection: np.ndarray, view: np.ndarray) -> np.ndarray:
    """Six unit planes (a, b, c, d), inside where ax + by + cz + d >= 0: left, right, bottom, top, near, far."""
    m = projection @ view
    rows = np.array([m[3] + m[0], m[3] - m[0], m[3] + m[1], m[3] - m[1], m[3] + m[2], m[3] - m[2]])
    return rows / np.linalg.norm(rows[:, :3], axis=1, keepdims=True)


def viewpoint(view: np.ndarray) -> np.ndarray:
    return np.linalg.inv(view)[:3, 3]


def plane_distance(planes: Column, centre: Vec, radius: Column) -> Column:
    """Least signed distance of a sphere's far side to the planes; below 0 it is outside."""
    return F.array_min(F.transform(planes, lambda p: p[0] * centre.x + p[1] * centre.y + p[2] * centre.z + p[3])) + radius


def outside(planes: Column, centre: Vec, radius: Column) -> Column:
    return F.exists(planes, lambda p: p[0] * centre.x + p[1] * centre.y + p[2] * centre.z + p[3] + radius < 0)


def pixel_size(resolution: Column, distance: Column) -> Column:
    """World units of a pixel at a distance."""
    return resolution * distance


def projected_error(error: Column, resolution: Column, eye: Vec, centre: Vec, radius: Column, near: Column) -> Column:
    """Screen error of a node: its error over the pixel size at its nearest point, not nearer than the near plane."""
    return error / (resolution * F.greatest((centre - eye).norm() - radius, near))


def outside_penalty(error: Column, distance: Column) -> Column:
    """Nodes outside count less the farther out they are; distance as of plane_distance, negative outside."""
    return F.when(distance < 0, error * 0.001 / (1 + distance * distance)).otherwise(error)


def client_error(error: Column, resolution: Column, eye: Vec, centre: Vec, radius: Column, planes: Column) -> Column:
    """The streaming client's metric: a distance floor of 0.1, and a falling share outside the frustum."""
    e = error / (resolution * F.greatest((centre - eye).norm() - radius, F.lit(0.1)))
    d = plane_distance(planes, centre, F.lit(0.0))
    return F.when(d < -radius, e / 101).when(d < 0, e / (1 - d / radius * 100)).otherwise(e)


def backface(axis: Vec, threshold: Column, eye: Vec, centre: Vec, radius: Column) -> Column:
    """All normals of a cone (cosine threshold, negative: no bound) look away from the eye, the sphere taken into account."""
    to = centre - eye
    distance = to.norm()
    return F.when(threshold < 0, False).otherwise(to.dot(axis) - radius > F.sqrt(F.greatest(1 - threshold * threshold, F.lit(0.0))) * distance)


def quantise_axis(v: Column) -> Column:
    return F.round(v * AXIS_SCALE).cast("int")


def quantise_length(v: Column) -> Column:
    return F.round(F.least(F.greatest(v, F.lit(-LENGTH_LIMIT)), F.lit(LENGTH_LIMIT)) * LENGTH_SCALE).cast("int")


def _looks_past(f: Column, d: Vec) -> Column:
    """Whether a direction's share f of d reaches the whole length of d, the test of scaled cone axes."""
    return (f >= 0.001) & (f * f >= d.dot(d))


def anchored_frontface(axis: Vec, anchor: Vec, eye: Vec) -> Column:
    """All faces of a cone look to the eye: axis is the mean normal over the cosine of the cone, anchor its front anchor."""
    d = anchor - eye
    return _looks_past(-d.dot(axis), d)


def anchored_backface(axis: Vec, anchor: Vec, eye: Vec) -> Column:
    """All faces of a cone look away from the eye, by its back anchor."""
    d = anchor - eye
    return _looks_past(d.dot(axis), d)


def quantised_cone_faces(n: Vec, length: Column, eye: Vec, centre: Vec, radius: Column, strict: bool = False) -> tuple[Column, Column]:
    """(back, front) of a quantised cone on a sphere. The format's reader divides the length of the back test by the axis' scale; strict uses the length's own."""
    axis = n.times(1 / AXIS_SCALE)
    behind, before = (centre - axis.times(radius)) - eye, centre.plus(axis.times(radius)) - eye
    back = behind.dot(axis.times(length / (LENGTH_SCALE if strict else AXIS_SCALE)))
    front = -before.dot(axis.times(length / LENGTH_SCALE))
    return _looks_past(back, behind), _looks_past(front, before)
