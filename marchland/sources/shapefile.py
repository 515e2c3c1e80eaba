"""ESRI shapefiles (.shp with .dbf) as DataFrames: a file is read as a whole by one task, many files in parallel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape types of the format (with their Z and M variants).
SHAPES = {0: "NULL", 1: "POINT", 3: "POLYLINE", 5: "POLYGON", 8: "MULTIPOINT", 11: "POINT", 13: "POLYLINE", 15: "POLYGON", 18: "MULTIPOINT", 21: "POINT", 23: "POLYLINE", 25: "POLYGON", 28: "MULTIPOINT"}


def parse_shp(data: bytes) -> list[tuple[int, str, list[list[list[float]]]]]:
    """(record number, kind, parts) of each record; a truncated last record is left out."""
    out, pos = [], 100
    while pos + 12 <= len(data):
        number, words = struct.unpack_from(">ii", data, pos)
        body, pos = data[pos + 8 : pos + 8 + 2 * words], pos + 8 + 2 * words
        if len(body) < 2 * words or len(body) < 4:
            break
        kind = SHAPES.get(struct.unpack_from("<i", body)[0])
        if kind is None or kind == "NULL":
            out.append((number, kind or "UNKNOWN", []))
        elif kind == "POINT":
            out.append((number, kind, [[list(struct.unpack_from("<dd", body, 4))]]))
        elif kind == "MULTIPOINT":
            (n,) = struct.unpack_from("<i", body, 36)
            flat = struct.unpack_from(f"<{2 * n}d", body, 40)
            out.append((number, kind, [[list(flat[i : i + 2])] for i in range(0, 2 * n, 2)]))
        else:
            parts, n = struct.unpack_from("<ii", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
            flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
            points = [list(flat[i : i + 2]) for i in range(0, 2 * n, 2)]
            out.append((number, kind, [points[a:b] for a, b in zip(starts, starts[1:])]))
    return out


def shp_bounds(data: bytes) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax from the header."""
    return struct.unpack_from("<4d", data, 36)


def parse_dbf(data: bytes, encoding: str = "utf-8") -> tuple[list[str], list[dict[str, str]]]:
    """(field names, rows of trimmed texts); deleted rows are NULL rows, so that rows stay beside their shapes."""
    count, header, width = struct.unpack_from("<IHH", data, 4)
    fields, pos = [], 32
    while data[pos] != 0x0D:
        name = data[pos : pos + 11].split(b"\0")[0].decode(encoding, "replace")
        fields.append((name, data[pos + 16]))
        pos += 32
    rows = []
    for i in range(count):
        record = data[header + i * width : header + (i + 1) * width]
        if len(record) < width:
            break
        row, at = {}, 1
        for name, size in fields:
            row[name] = record[at : at + size].decode(encoding, "replace").strip("\0 ") if record[:1] != b"*" else None
            at += size
        rows.append(row)
    return [n for n, _ in fields], rows


def read_shapefile(spark: SparkSession, folder: str, encoding: str = "utf-8") -> DataFrame:
    """(layer, record, kind, parts, attributes) of all shapefiles of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    stem, kind = F.regexp_extract("path", "([^/]*)\\.[^./]*$", 1), F.lower(F.regexp_extract("path", "\\.([^./]*)$", 1))
    named = files.select(F.regexp_replace("path", "\\.[^./]*$", "").alias("base"), stem.alias("layer"), kind.alias("kind"), "content").where(F.col("kind").isin("shp", "dbf"))
    both = named.groupBy("base", "layer").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for layer, shp, dbf in zip(b["layer"], b["shp"], b["dbf"]):
                shapes = parse_shp(bytes(shp)) if shp is not None else []
                rows = parse_dbf(bytes(dbf), encoding)[1] if dbf is not None else []
                yield pd.DataFrame({
                    "layer": layer, "record": [s[0] for s in shapes], "kind": [s[1] for s in shapes], "parts": [s[2] for s in shapes],
                    "attributes": [rows[i] if i < len(rows) else None for i in range(len(shapes))],
                })

    return both.select("layer", "shp", "dbf").mapInPandas(parse, "layer string, record int, kind string, parts array<array<array<double>>>, attributes map<string,string>")


def read_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the box around all layers, from their headers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.shp").load(folder)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([shp_bounds(bytes(c)) for c in b["content"]], columns=["xmin", "ymin", "xmax", "ymax"])

    boxes = files.select("content").mapInPandas(parse, "xmin double, ymin double, xmax double, ymax double")
    return boxes.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def read_fields(spark: SparkSession, folder: str) -> DataFrame:
    """(layer, field) of all attribute tables."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dbf").load(folder)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                names = parse_dbf(bytes(content))[0]
                yield pd.DataFrame({"layer": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "field": names})

    return files.select("path", "content").mapInPandas(parse, "layer string, field string")
