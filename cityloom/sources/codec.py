"""Decoding stored geometry text and bytes once, when data comes in."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LISTS = T.ArrayType(T.ArrayType(T.DoubleType()))
_RAW = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("srid", T.IntegerType()),
    T.StructField("xs", _LISTS), T.StructField("ys", _LISTS),
    T.StructField("outer", T.ArrayType(T.BooleanType()))])
_KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString",
          6: "MultiPolygon"}
_NUMBER = re.compile(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?")
_POLYGON = re.compile(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)")


def _shape(kind: int, srid: int | None, rings: list[np.ndarray], outer: list[bool]) -> dict:
    """One decoded value. Outer rings of polygons run counter-clockwise and holes clockwise, so
    that areas add up and the parts of a multi-polygon stay apart."""
    if kind in (3, 6):
        def turned(r, out):
            x, y = r[:, 0], r[:, 1]
            area = np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) + x[-1] * y[0] - x[0] * y[-1]
            return r[::-1] if (area < 0) == out and area != 0 else r
        rings = [turned(r, out) if len(r) else r for r, out in zip(rings, outer, strict=True)]
    return {"kind": _KINDS[kind], "srid": srid, "xs": [r[:, 0] for r in rings],
            "ys": [r[:, 1] for r in rings], "outer": outer}


def _from_wkb(data: bytes) -> dict:
    pos = 0

    def shape():
        nonlocal pos
        order = "<" if data[pos] == 1 else ">"
        code = struct.unpack_from(order + "I", data, pos + 1)[0]
        pos += 5
        srid = None
        if code & 0x20000000:
            srid = struct.unpack_from(order + "i", data, pos)[0]
            pos += 4
        width = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        kind = code & 0xFF

        def count():
            nonlocal pos
            n = struct.unpack_from(order + "I", data, pos)[0]
            pos += 4
            return n

        def run(n):
            nonlocal pos
            flat = np.frombuffer(data, f"{order}f8", n * width, pos).reshape(n, width)
            pos += 8 * n * width
            return flat[:, :2]
        if kind == 1:
            return kind, srid, [run(1)], [True]
        if kind == 2:
            return kind, srid, [run(count())], [True]
        if kind == 3:
            rings = [run(count()) for _ in range(count())]
            return kind, srid, rings, [i == 0 for i in range(len(rings))]
        parts = [shape() for _ in range(count())]
        return kind, srid, [r for p in parts for r in p[2]], [o for p in parts for o in p[3]]
    return _shape(*shape())


def _from_wkt(text: str) -> dict:
    srid = None
    if text.upper().startswith("SRID="):
        head, text = text.split(";", 1)
        srid = int(head[5:])
    name = text.split("(", 1)[0].strip().split(" ")[0].upper()
    kind = next(k for k, v in _KINDS.items() if v.upper() == name)

    def ring(group: str) -> np.ndarray:
        return np.array([[float(v) for v in _NUMBER.findall(p)[:2]] for p in group.split(",")]).reshape(-1, 2)
    groups = re.findall(r"\(([^()]*)\)", text)
    outer = [True] * len(groups)
    if kind in (3, 6):
        parts = [re.findall(r"\(([^()]*)\)", p) for p in _POLYGON.findall(text)]
        groups = [g for p in parts for g in p]
        outer = [i == 0 for p in parts for i in range(len(p))]
    elif kind == 4 and len(groups) > 1:
        groups, outer = [", ".join(groups)], [True]
    return _shape(kind, srid, [ring(g) for g in groups], outer)


def _decode_one(value):
    try:
        if value is None:
            return None
        if isinstance(value, (bytes, bytearray)):
            return _from_wkb(bytes(value))
        text = value.strip()
        if re.match(r"(?i)(SRID=|POINT|LINESTRING|POLYGON|MULTI)", text):
            return _from_wkt(text)
        return _from_wkb(bytes.fromhex(text))
    except (ValueError, struct.error, StopIteration, KeyError, IndexError):
        return None


@F.pandas_udf(_RAW)
def _decode(values: pd.Series) -> pd.DataFrame:
    names = _RAW.fieldNames()
    rows = [_decode_one(v) or dict.fromkeys(names) for v in values]
    return pd.DataFrame(rows, columns=names)


def decode(column: str | Column) -> Column:
    """EWKT / WKT text, hexadecimal or binary (E)WKB to ``kind, srid, rings, outer``; what cannot
    be read has a NULL kind. ``outer`` tells for each ring whether it begins a part (else it is a
    hole of the part before)."""
    raw = _decode(F.col(column) if isinstance(column, str) else column)
    rings = F.zip_with(raw["xs"], raw["ys"], lambda xs, ys: F.zip_with(
        xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    return F.struct(raw["kind"].alias("kind"), raw["srid"].alias("srid"), rings.alias("rings"),
                    raw["outer"].alias("outer"))


def decoded(df: DataFrame, column: str) -> DataFrame:
    """Ingest step: decode, drop what is missing, unreadable or empty."""
    out = df.withColumn("_shape", decode(column)).select(
        *[c for c in df.columns if c != column], "_shape.*")
    return out.where(F.col("kind").isNotNull() & (F.size(F.flatten("rings")) > 0))
