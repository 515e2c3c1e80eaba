"""Well-known binary, in Arrow batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Geometry types of the format.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def parse_wkb(data: bytes) -> tuple[str, list[list[list[float]]]] | None:
    """(kind, parts), a part being a list of [x, y]; None if the bytes are no valid geometry."""

    def at(pos: int, top: bool) -> tuple[str, list, int]:
        order = "<" if data[pos] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, pos + 1)
        kind, pos = KINDS[code], pos + 5

        def points(n: int, pos: int) -> tuple[list[list[float]], int]:
            flat = struct.unpack_from(f"{order}{2 * n}d", data, pos)
            return [list(flat[i : i + 2]) for i in range(0, 2 * n, 2)], pos + 16 * n

        if kind == "POINT":
            part, pos = points(1, pos)
            return kind, [part], pos
        (n,) = struct.unpack_from(order + "I", data, pos)
        pos += 4
        if kind == "LINESTRING":
            part, pos = points(n, pos)
            return kind, [part], pos
        parts = []
        for _ in range(n):
            if kind == "POLYGON":
                (m,) = struct.unpack_from(order + "I", data, pos)
                part, pos = points(m, pos + 4)
                parts.append(part)
            else:
                _, inner, pos = at(pos, False)
                parts += inner
        return kind, parts, pos

    try:
        kind, parts, end = at(0, True)
        return (kind, parts) if end == len(data) else None
    except (struct.error, KeyError, IndexError):
        return None


def parsed(data: Column) -> Column:
    """struct kind, parts of binary geometries; NULLs for what can't be read."""

    @F.pandas_udf("struct<kind: string, parts: array<array<array<double>>>>")
    def parse(values: pd.Series) -> pd.DataFrame:
        found = [parse_wkb(bytes(b)) if b is not None else None for b in values]
        return pd.DataFrame({"kind": [p[0] if p else None for p in found], "parts": [p[1] if p else None for p in found]})

    return parse(data)


def point_hex(x: Column, y: Column) -> Column:
    """Little-endian points as hexadecimal text."""

    @F.pandas_udf("string")
    def write(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<BIdd", 1, 1, u, v).hex().upper() for u, v in zip(a, b)])

    return write(x, y)
