"""Readers of point and geometry files, and writers of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marchland.functions import geometry
from marchland.sources.wkb import parsed, point_hex

#: Delimiters by name, as regular expressions.
SEPARATORS = {
    "csv": ",", "comma": ",", "tsv": "\t", "tab": "\t", "questionmark": "\\?", "singlequote": "'", "quote": "\"", "underscore": "_",
    "dash": "-", "percent": "%", "tilde": "~", "pipe": "\\|", "semicolon": ";", "space": "\\s+",
}


def _numbered(df: DataFrame, uid: str) -> DataFrame:
    """Ids by position within the file listing; unique, not consecutive."""
    return df.withColumn(uid, F.monotonically_increasing_id())


def _label(text: Column) -> Column:
    """Whole-number labels; anything else, NaN included, is NULL."""
    return F.regexp_replace(F.trim(text), "\\.0+$", "").try_cast("int")


def read_whitespace(spark: SparkSession, path: str, dims: tuple[str, ...] = ("x", "y"), label: str | None = "label", uid: str = "id") -> DataFrame:
    """Lines of numbers separated by blanks or tabs, the label last. Lines whose coordinates are no numbers are left out."""
    parts = F.split(F.trim(F.col("value")), "\\s+")
    cols = [F.element_at(parts, i + 1).try_cast("double").alias(c) for i, c in enumerate(dims)]
    if label:
        cols.append(_label(F.when(F.size(parts) > len(dims), F.element_at(parts, len(dims) + 1))).alias(label))
    out = spark.read.text(path).where(F.size(parts) >= len(dims)).select(*cols)
    for c in dims:
        out = out.where(F.col(c).isNotNull())
    return _numbered(out, uid)


def read_delimited(spark: SparkSession, path: str, separator: str = "csv", offset: int = 0, dims: int = 2, carry: bool = True, uid: str = "id") -> DataFrame:
    """Points from ``dims`` numbers after ``offset`` fields: id, x, y (or c0, c1, ...), and the other fields as an array."""
    parts = F.split("value", SEPARATORS.get(separator, separator), -1)
    names = ["x", "y"] if dims == 2 else [f"c{i}" for i in range(dims)]
    cols = [F.trim(F.get(parts, F.lit(offset + i))).try_cast("double").alias(c) for i, c in enumerate(names)]
    if carry:
        cols.append(F.concat(F.slice(parts, 1, offset), F.slice(parts, offset + dims + 1, F.greatest(F.size(parts) - offset - dims, F.lit(0)))).alias("attributes"))
    out = spark.read.text(path).select(*cols)
    for c in names:
        out = out.where(F.col(c).isNotNull())
    return _numbered(out, uid)


def read_lat_lon(spark: SparkSession, path: str, lat: int = 0, lon: int = 1, header: bool = False, uid: str = "id") -> DataFrame:
    """A CSV of latitudes and longitudes as web-mercator points (id, lat, lon, x, y)."""
    raw = spark.read.csv(path, header=header)
    out = raw.select(F.col(raw.columns[lat]).try_cast("double").alias("lat"), F.col(raw.columns[lon]).try_cast("double").alias("lon"))
    out = out.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    x, y = geometry.to_mercator(F.col("lat"), F.col("lon"))
    return _numbered(out.withColumns({"x": x, "y": y}), uid)


def read_rectangles(spark: SparkSession, path: str, separator: str = "csv", offset: int = 0, uid: str = "id") -> DataFrame:
    """(id, xmin, ymin, xmax, ymax) from four numbers a line, corners in any order."""
    four = read_delimited(spark, path, separator, offset, 4, carry=False, uid=uid)
    return four.select(uid, F.least("c0", "c2").alias("xmin"), F.least("c1", "c3").alias("ymin"), F.greatest("c0", "c2").alias("xmax"), F.greatest("c1", "c3").alias("ymax"))


def read_wkt(spark: SparkSession, path: str, separator: str | None = None, field: int = 0, uid: str = "id", invalid: str = "skip") -> DataFrame:
    """(id, wkt, point, rings) of POINT and POLYGON texts; ``invalid``: skip, keep (as NULLs) or fail."""
    text = F.col("value") if separator is None else F.get(F.split("value", SEPARATORS.get(separator, separator), -1), F.lit(field))
    out = spark.read.text(path).select(text.alias("wkt"))
    out = out.withColumns({"point": geometry.read_wkt_point(F.col("wkt")), "rings": geometry.read_wkt_rings(F.col("wkt"))})
    return _numbered(_checked(out, F.col("point").isNotNull() | F.col("rings").isNotNull(), invalid), uid)


def read_wkb(spark: SparkSession, path: str, uid: str = "id", invalid: str = "skip") -> DataFrame:
    """(id, kind, parts) of hexadecimal well-known binary, a line each; parts: array<array<array<double>>>."""
    out = spark.read.text(path).select(parsed(F.unhex(F.trim("value"))).alias("g")).select("g.kind", "g.parts")
    return _numbered(_checked(out, F.col("kind").isNotNull(), invalid), uid)


def read_geojson(spark: SparkSession, path: str, properties: str = "", whole_file: bool = False, uid: str = "id", invalid: str = "skip") -> DataFrame:
    """(id, type, coordinates, properties) of features: one a line, or a whole FeatureCollection a file.

    ``coordinates`` stays a JSON text, as its depth depends on the type; ``properties`` is a DDL list.
    """
    props = f", properties: struct<{properties}>" if properties else ""
    feature = f"struct<type: string, geometry: struct<type: string, coordinates: string>{props}>"
    if whole_file:
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"features array<{feature}>")["features"]).alias("f"))
    else:
        raw = spark.read.text(path).select(F.from_json("value", feature).alias("f"))
    cols = [F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates")] + ([F.col("f.properties").alias("properties")] if properties else [])
    return _numbered(_checked(raw.select(*cols), F.col("type").isNotNull() & F.col("coordinates").isNotNull(), invalid), uid)


def read_mapped(spark: SparkSession, path: str, mapper: Callable, schema: str) -> DataFrame:
    """Lines through a function of your own, iterator of Arrow batches to iterator of Arrow batches."""
    return spark.read.text(path).mapInArrow(mapper, schema)


def _checked(df: DataFrame, ok: Column, invalid: str) -> DataFrame:
    if invalid == "skip":
        return df.where(ok)
    if invalid == "fail":
        return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a geometry can't be read")).isNotNull()))
    return df


def explode_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """One row for each part of a multi-part geometry."""
    return df.withColumn(parts, F.explode(parts))


def read_matrix_csv(spark: SparkSession, path: str, cell: str = "X") -> DataFrame:
    """(cell, gene, value), zeros left out, of a CSV with a cell a row and a gene a column."""
    raw = spark.read.csv(path, header=True)
    genes = [c for c in raw.columns if c != cell]
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("gene"), F.col(f"`{g}`").try_cast("double").alias("value")) for g in genes]))
    return raw.select(F.col(f"`{cell}`").alias("cell"), pairs.alias("e")).select("cell", "e.gene", "e.value").where("value <> 0")


def read_matrix_market(spark: SparkSession, matrix: str, genes: str, cells: str) -> DataFrame:
    """(cell, gene, value) of a directory's matrix, feature and barcode files; gene and cell numbers start at 1."""

    def names(path: str, key: str) -> DataFrame:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), "\\r?\\n")).alias("at", "line"))
        return lines.select((F.col("at") + 1).cast("long").alias(f"{key}_no"), F.split_part("line", F.lit("\t"), F.lit(-1 if key == "cell" else 1)).alias(key))

    parts = F.split(F.trim("value"), "\\s+")
    lines = spark.read.text(matrix).select("value", F.input_file_block_start().alias("_b"), F.monotonically_increasing_id().alias("_i")).where(~F.col("value").startswith("%"))
    # the first line after the comments holds the sizes
    first = lines.agg(F.min(F.struct("_b", "_i")).alias("m")).first()["m"]
    body = lines.where((F.col("_b") != first["_b"]) | (F.col("_i") != first["_i"])) if first else lines
    body = body.select([F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("gene_no", "cell_no", "value"))])
    g, c = names(genes, "gene"), names(cells, "cell")
    return body.join(g, "gene_no").join(c, "cell_no").select("cell", "gene", "value")


def join_barcodes(meta: DataFrame, embedding: DataFrame, barcode: str = "barcode", label: str = "class") -> DataFrame:
    """Metadata joined to an embedding whose barcodes have ``.`` for ``-``; rows without a class are left out."""
    fixed = meta.withColumn(barcode, F.regexp_replace(barcode, "-", "."))
    return embedding.join(fixed, barcode).where(F.col(label).isNotNull() & (F.trim(label) != ""))


def write_wkt(df: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    df.select(geometry.wkt_point(F.col(x), F.col(y))).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, x: str = "x", y: str = "y", properties: tuple[str, ...] = ()) -> None:
    df.select(geometry.geojson_point(F.col(x), F.col(y), **{p: F.col(p) for p in properties})).write.mode("overwrite").text(path)


def write_wkb(df: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    """Little-endian points as hexadecimal text."""
    df.select(point_hex(F.col(x), F.col(y))).write.mode("overwrite").text(path)


def write_clusters(df: DataFrame, path: str) -> None:
    """Tab-separated results, headed by their column names."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def append_scores(df: DataFrame, path: str) -> None:
    """Adds rows of metrics or timings to a folder of CSV files."""
    df.write.mode("append").csv(path, header=True)


def split_files(df: DataFrame, path: str, rows: int, header: bool = False) -> None:
    """Files of at most ``rows`` rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).csv(path, header=header)
