"""Well-known binary shapes, in batches.

Both byte orders, two to four numbers per position (the ISO codes and the high flag bits of the
older form, with or without a reference system number), points, polygons, multipolygons, and
multi-points and collections that hold one of these. Positions are read with numpy, a ring at a
time, straight from the batch's buffer. Boxes and types are made by the same expressions as for
other encodings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo

#: Fixed values of the format: kinds, and the flags of the older form.
POINT, POLYGON, MULTIPOINT, MULTIPOLYGON, COLLECTION = 1, 3, 4, 6, 7
FLAG_Z, FLAG_M, FLAG_SRID = 0x80000000, 0x40000000, 0x20000000


class Unreadable(ValueError):
    """The bytes are not a shape of a known kind."""


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self, order: str) -> int:
        (value,) = struct.unpack_from(f"{order}I", self.data, self.at)
        self.at += 4
        return value

    def positions(self, order: str, n: int, size: int) -> np.ndarray:
        if n * size * 8 > len(self.data) - self.at:
            raise Unreadable("more positions than bytes")
        values = np.frombuffer(self.data, f"{order}f8", n * size, self.at).reshape(n, size)
        self.at += n * size * 8
        if not np.isfinite(values[:, :2]).all():
            raise Unreadable("a position is no number")
        return values[:, :2].astype(float)

    def shape(self) -> tuple[str, list]:
        """('point', [position]) or ('polygon', polygons of rings of positions)."""
        if self.data[self.at] > 1:
            raise Unreadable("an unknown byte order")
        order = "<" if self.data[self.at] else ">"
        self.at += 1
        code = self.number(order)
        if code & FLAG_SRID:
            self.number(order)
        thousands, kind = divmod(code & 0x0FFFFFFF, 1000)
        if thousands > 3:
            raise Unreadable(f"an unknown kind {code}")
        size = 2 + (bool(code & FLAG_Z) + bool(code & FLAG_M) or (0, 1, 1, 2)[thousands])
        if kind == POINT:
            return "point", [self.positions(order, 1, size)[0]]
        if kind == POLYGON:
            return "polygon", [[self.positions(order, self.number(order), size) for _ in range(self.number(order))]]
        if kind in (MULTIPOINT, MULTIPOLYGON, COLLECTION):
            parts = [self.shape() for _ in range(self.number(order))]
            kinds = {k for k, _ in parts}
            if len(kinds) == 1 and ("point" not in kinds or len(parts) == 1):
                return kinds.pop(), [p for _, ps in parts for p in ps]
        raise Unreadable(f"kind {code} is neither one point nor polygons")


def decode(data: bytes) -> tuple[str, list]:
    """Kind and positions of one shape; all bytes must belong to it."""
    reader = _Reader(data)
    try:
        found = reader.shape()
    except (struct.error, IndexError) as error:
        raise Unreadable("the bytes end early") from error
    if reader.at != len(data):
        raise Unreadable("bytes are left over")
    return found


def _nested(shapes: list[tuple[str, list] | None]) -> pa.Array:
    """Arrow rings of the polygons, without a Python object per position."""
    held = [s[1] if s and s[0] == "polygon" else None for s in shapes]
    rings = [r for ps in held for p in ps or [] for r in p]
    polygons = [p for ps in held for p in ps or []]
    flat = np.concatenate([np.zeros((0, 2)), *rings])
    ends = lambda sizes: pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    vertices = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["x", "y"])
    of_rings = pa.ListArray.from_arrays(ends([len(r) for r in rings]), vertices)
    of_polygons = pa.ListArray.from_arrays(ends([len(p) for p in polygons]), of_rings)
    offsets = np.r_[0, np.cumsum([len(ps or []) for ps in held])].astype(np.int32)
    missing = pa.array(np.r_[[ps is None for ps in held], False].astype(bool))
    return pa.ListArray.from_arrays(pa.array(offsets, mask=missing.to_numpy(zero_copy_only=False)), of_polygons)


def decoded(layer: DataFrame, column: str, unreadable: str = "error") -> DataFrame:
    """The layer with ``geometry`` in place of its binary column."""
    others = [c for c in layer.columns if c != column]
    names = {n: f"wkb_{n}" for n in ("x", "y", "rings")}
    while {*names.values()} & {c.lower() for c in others}:
        names = {n: f"{v}_" for n, v in names.items()}
    added = T.StructType.fromDDL(f"`{names['x']}` double, `{names['y']}` double, `{names['rings']}` {geo.RINGS_DDL}")
    schema = T.StructType([*(layer.schema[c] for c in others), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes: list[tuple[str, list] | None] = []
            for data in batch.column(column).to_pylist():
                try:
                    shapes.append(None if data is None else decode(data))
                except Unreadable as error:
                    if unreadable == "error":
                        raise ValueError(f"a shape could not be read: {error}: {data[:20].hex()}") from error
                    shapes.append(None)
            points = [s[1][0] if s and s[0] == "point" else (None, None) for s in shapes]
            columns = [batch.column(c) for c in others]
            columns += [pa.array([p[k] for p in points], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, _nested(shapes)], [*others, *names.values()])

    held = layer.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`").cast("binary").alias(column)).mapInArrow(run, schema)
    x, y, rings = (f"`{n}`" for n in names.values())
    shape = f"CASE WHEN {rings} IS NOT NULL THEN {geo.polygon(rings)} ELSE {geo.point(x, y)} END"
    return held.withColumn("geometry", F.expr(shape)).drop(*names.values())
