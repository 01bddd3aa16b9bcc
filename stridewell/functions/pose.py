"""Rotations and rigid poses, vectorised over Arrow batches: conversions, relative poses, interpolation.

A pose is x, y, z and a rotation as a quaternion (x, y, z, w). These have no SQL form worth reading, so they are
pandas UDFs over array columns; a null gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

KINDS = ("axis_angle", "quaternion", "rotation_6d", "matrix", "euler_xyz", "euler_xzy", "euler_yxz", "euler_yzx", "euler_zxy", "euler_zyx")


def quaternion_to_matrix(q: np.ndarray) -> np.ndarray:
    x, y, z, w = np.moveaxis(q / np.linalg.norm(q, axis=-1, keepdims=True), -1, 0)
    m = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
    return np.stack(m, -1).reshape(*q.shape[:-1], 3, 3)


def matrix_to_quaternion(m: np.ndarray) -> np.ndarray:
    """With w >= 0. The largest of the four squares decides which form is used."""
    t = np.stack([1 + m[..., 0, 0] - m[..., 1, 1] - m[..., 2, 2], 1 - m[..., 0, 0] + m[..., 1, 1] - m[..., 2, 2], 1 - m[..., 0, 0] - m[..., 1, 1] + m[..., 2, 2], 1 + m[..., 0, 0] + m[..., 1, 1] + m[..., 2, 2]], -1)
    a, b, c = m[..., 2, 1] - m[..., 1, 2], m[..., 0, 2] - m[..., 2, 0], m[..., 1, 0] - m[..., 0, 1]
    xy, xz, yz = m[..., 0, 1] + m[..., 1, 0], m[..., 0, 2] + m[..., 2, 0], m[..., 1, 2] + m[..., 2, 1]
    forms = np.stack([np.stack([t[..., 0], xy, xz, a], -1), np.stack([xy, t[..., 1], yz, b], -1), np.stack([xz, yz, t[..., 2], c], -1), np.stack([a, b, c, t[..., 3]], -1)], -2)
    q = np.take_along_axis(forms, t.argmax(-1)[..., None, None], -2)[..., 0, :]
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    return np.where(q[..., 3:] < 0, -q, q)


def axis_angle_to_quaternion(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.concatenate([v * 0.5 * np.sinc(angle / 2 / np.pi), np.cos(angle / 2)], -1)


def quaternion_to_axis_angle(q: np.ndarray) -> np.ndarray:
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    q = np.where(q[..., 3:] < 0, -q, q)
    s = np.linalg.norm(q[..., :3], axis=-1, keepdims=True)
    angle = 2 * np.arctan2(s, q[..., 3:])
    return q[..., :3] * np.where(s > 1e-12, angle / np.where(s > 1e-12, s, 1), 2.0)


def rotation_6d_to_matrix(d: np.ndarray) -> np.ndarray:
    """From the first two rows: normalise one, take its part out of the other, and complete them."""
    a, b = d[..., :3], d[..., 3:]
    x = a / np.linalg.norm(a, axis=-1, keepdims=True)
    b = b - (x * b).sum(-1, keepdims=True) * x
    y = b / np.linalg.norm(b, axis=-1, keepdims=True)
    return np.stack([x, y, np.cross(x, y)], -2)


def _axis(name: str, angle: np.ndarray) -> np.ndarray:
    c, s, o, i = np.cos(angle), np.sin(angle), np.zeros_like(angle), np.ones_like(angle)
    m = {"x": [i, o, o, o, c, -s, o, s, c], "y": [c, o, s, o, i, o, -s, o, c], "z": [c, -s, o, s, c, o, o, o, i]}[name]
    return np.stack(m, -1).reshape(*angle.shape, 3, 3)


def euler_to_matrix(e: np.ndarray, order: str) -> np.ndarray:
    """Intrinsic: the first axis is the outermost factor."""
    return _axis(order[0], e[..., 0]) @ _axis(order[1], e[..., 1]) @ _axis(order[2], e[..., 2])


def matrix_to_euler(m: np.ndarray, order: str) -> np.ndarray:
    i, j, k = ("xyz".index(c) for c in order)
    sign = 1.0 if (j - i) % 3 == 1 else -1.0
    middle = np.arcsin(np.clip(sign * m[..., i, k], -1, 1))
    first = np.arctan2(-sign * m[..., j, k], m[..., k, k])
    last = np.arctan2(-sign * m[..., i, j], m[..., i, i])
    return np.stack([first, middle, last], -1)


def to_matrix(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "axis_angle":
        return quaternion_to_matrix(axis_angle_to_quaternion(x))
    if kind == "quaternion":
        return quaternion_to_matrix(x)
    if kind == "rotation_6d":
        return rotation_6d_to_matrix(x)
    if kind == "matrix":
        return x.reshape(*x.shape[:-1], 3, 3)
    if kind in KINDS:
        return euler_to_matrix(x, kind[-3:])
    raise ValueError(f"unknown rotation: {kind}")


def from_matrix(m: np.ndarray, kind: str) -> np.ndarray:
    if kind == "axis_angle":
        return quaternion_to_axis_angle(matrix_to_quaternion(m))
    if kind == "quaternion":
        return matrix_to_quaternion(m)
    if kind == "rotation_6d":
        return m[..., :2, :].reshape(*m.shape[:-2], 6)
    if kind == "matrix":
        return m.reshape(*m.shape[:-2], 9)
    if kind in KINDS:
        return matrix_to_euler(m, kind[-3:])
    raise ValueError(f"unknown rotation: {kind}")


def _rows(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are not null, as a matrix, and where they are."""
    ok = values.notna().to_numpy()
    return (np.stack(values[ok].to_list()).astype(float) if ok.any() else np.zeros((0, 0))), ok


def _back(rows: np.ndarray, ok: np.ndarray) -> pd.Series:
    out = np.empty(len(ok), object)
    out[:] = None
    for i, r in zip(np.flatnonzero(ok), rows, strict=True):
        out[i] = r
    return pd.Series(out)


def convert(column: Column, kind: str, to: str) -> Column:
    """A rotation in another form, by way of its matrix."""
    if kind not in KINDS or to not in KINDS:
        raise ValueError(f"unknown rotation: {kind}, {to}")

    @pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        x, ok = _rows(values)
        return _back(from_matrix(to_matrix(x, kind), to) if ok.any() else x, ok)

    return run(column)


def relative(reference: np.ndarray, pose: np.ndarray) -> np.ndarray:
    """inverse(reference) * pose."""
    r, p = quaternion_to_matrix(reference[..., 3:]), quaternion_to_matrix(pose[..., 3:])
    back = np.swapaxes(r, -1, -2)
    shift = (back @ (pose[..., :3] - reference[..., :3])[..., None])[..., 0]
    return np.concatenate([shift, matrix_to_quaternion(back @ p)], -1)


def absolute(reference: np.ndarray, pose: np.ndarray) -> np.ndarray:
    """reference * pose."""
    r, p = quaternion_to_matrix(reference[..., 3:]), quaternion_to_matrix(pose[..., 3:])
    shift = (r @ pose[..., :3, None])[..., 0] + reference[..., :3]
    return np.concatenate([shift, matrix_to_quaternion(r @ p)], -1)


def _pairs(reference: Column, pose: Column, fn) -> Column:
    @pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = (a.notna() & b.notna()).to_numpy()
        if not ok.any():
            return _back(np.zeros((0, 7)), ok)
        return _back(fn(np.stack(a[ok].to_list()).astype(float), np.stack(b[ok].to_list()).astype(float)), ok)

    return run(reference, pose)


def relative_pose(reference: Column, pose: Column) -> Column:
    return _pairs(reference, pose, relative)


def absolute_pose(reference: Column, pose: Column) -> Column:
    return _pairs(reference, pose, absolute)


def slerp(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Between unit quaternions, the short way round."""
    d = (a * b).sum(-1, keepdims=True)
    b, d = np.where(d < 0, -b, b), np.abs(d)
    angle = np.arccos(np.clip(d, -1, 1))
    s = np.sin(angle)
    near = s < 1e-8
    u, v = np.where(near, 1 - t, np.sin((1 - t) * angle) / np.where(near, 1, s)), np.where(near, t, np.sin(t * angle) / np.where(near, 1, s))
    out = u * a + v * b
    return out / np.linalg.norm(out, axis=-1, keepdims=True)


def interpolate(times: np.ndarray, values: np.ndarray, at: np.ndarray, poses: bool) -> np.ndarray:
    """Values at other times: linear, rotations of poses on the sphere. Times that do not increase are left out first;
    times outside are an error."""
    keep = np.ones(len(times), bool)
    keep[1:] = times[1:] > np.maximum.accumulate(times)[:-1]
    times, values = times[keep], values[keep]
    if len(at) and (at.min() < times[0] - 1e-9 or at.max() > times[-1] + 1e-9):
        raise ValueError("a time is out of range")
    if len(times) == 1:
        return np.repeat(values, len(at), 0)
    i = np.clip(np.searchsorted(times, at, "right") - 1, 0, len(times) - 2)
    t = np.clip((at - times[i]) / (times[i + 1] - times[i]), 0, 1)[:, None]
    out = values[i] * (1 - t) + values[i + 1] * t
    if poses:
        out[:, 3:] = slerp(values[i][:, 3:], values[i + 1][:, 3:], t)
    return out


def interpolate_chunks(df: DataFrame, key: str, time: str, value: str, grid: DataFrame, poses: bool = False) -> DataFrame:
    """key, time, value at the times that grid (key, time) names; a chunk is one group."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {time} double, {value} array<double>"

    def run(chunk: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk) or not len(wanted):
            return pd.DataFrame({key: [], time: [], value: []})
        chunk, at = chunk.sort_values(time, kind="stable"), np.sort(wanted[time].to_numpy(float))
        got = interpolate(chunk[time].to_numpy(float), np.stack(chunk[value].to_list()).astype(float), at, poses)
        return pd.DataFrame({key: [chunk[key].iloc[0]] * len(at), time: at, value: list(got)})

    return df.select(key, time, value).groupBy(key).cogroup(grid.select(key, time).groupBy(key)).applyInPandas(run, schema)


def linear(df: DataFrame, frames: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """df (by, time) with the value between the frames around each time, all in SQL: an as-of pair, carried over ranges, and a lerp."""
    from ..operators import ranges

    u = df.select(*by, time, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_side")).union(frames.select(*by, time, F.col(value).cast("double"), F.lit(0)))
    frame = F.when(F.col("_side") == 0, F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    u = ranges.carried(u, by, [F.col(time), F.col("_side"), F.col("_v")], F.struct(time, "_v"), frame, "_a", "_b").where("_side = 1")
    share = (F.col(time) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    got = F.when(F.col("_b").isNull() & (F.col("_a.t") == F.col(time)), F.col("_a.v")).when(F.col("_a.t") == F.col(time), F.col("_a.v")).otherwise(F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v")))
    return u.select(*by, time, got.alias(value))
