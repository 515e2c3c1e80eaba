"""Spatial partitions: tables of cells, and which cell each point belongs to."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.functions.geometry import axis_cell, hilbert
from marchland.operators.prep import extent
from marchland.operators.tree_knn import Tree

SAMPLE_ROWS = 1_000_000


def sample_rate(rows: int, parts: int) -> float:
    """All of up to 1,000 rows, else 1 % or two rows a partition, whichever is more; at most half as many parts as rows."""
    if rows and parts > rows / 2:
        raise ValueError("there must be two rows or more for each partition")
    return 1.0 if rows < 1000 else min(1.0, max(2 * parts, rows // 100) / rows)


def sample_points(df: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """A sample that doesn't depend on how the table is partitioned."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in ("x", "y")]).cast("double") / F.lit(2.0**64) + 0.5
    return df if rate >= 1 else df.where(h < rate)


def _sample(df: DataFrame, rows: int, parts: int) -> np.ndarray:
    """About SAMPLE_ROWS points at most, or 50 a part if that is more, spread over the whole table by hash."""
    rate = min(sample_rate(rows, parts), max(SAMPLE_ROWS, 50 * parts) / max(1, rows))
    return sample_points(df, rate).select("x", "y").toPandas().to_numpy(float)


def _box(df: DataFrame):
    return extent(df).first()


def equal_grid(df: DataFrame, parts: int) -> DataFrame:
    """Adds ``cell`` of a grid of ⌊√parts⌋ cells each way; cells are half open, but for the last ones."""
    b, n = _box(df), max(1, math.isqrt(parts))
    if not b["n"]:
        return df.withColumn("cell", F.lit(0).cast("long"))

    def axis(c: str, lo: float, hi: float):
        return F.lit(0).cast("long") if hi <= lo else F.least(F.lit(n - 1), F.floor((F.col(c) - F.lit(lo)) / (F.lit(hi) - F.lit(lo)) * n)).cast("long")

    return df.withColumn("cell", axis("x", b["xmin"], b["xmax"]) * n + axis("y", b["ymin"], b["ymax"]))


def hilbert_code(df: DataFrame, bits: int = 15) -> DataFrame:
    """Adds ``h``, the point's place along the Hilbert curve over the extent."""
    b = _box(df)
    if not b["n"]:
        return df.withColumn("h", F.lit(0).cast("long"))
    return df.withColumn("h", hilbert(axis_cell(F.col("x"), b["xmin"], b["xmax"], bits), axis_cell(F.col("y"), b["ymin"], b["ymax"], bits), bits))


def hilbert_parts(df: DataFrame, parts: int, bits: int = 15) -> DataFrame:
    """Adds ``cell``: the point's quantile along the curve. The quantiles come from an approximate aggregate of 100 × parts."""
    coded = hilbert_code(df, bits)
    cuts = coded.agg(F.percentile_approx("h", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    at = sum((F.when(F.col("h") >= c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    return coded.withColumn("cell", at.cast("long"))


def hilbert_ordered(df: DataFrame, parts: int, bits: int = 15) -> DataFrame:
    """The rows physically range-partitioned along the curve."""
    return hilbert_code(df, bits).repartitionByRange(parts, "h")


def kd_cells(df: DataFrame, parts: int) -> tuple[list[tuple[float, float, float, float]], Tree]:
    """Boxes (xmin, ymin, xmax, ymax) of median splits of a sample, on the wider side each time; they fill the plane."""
    tree = Tree(_sample(df, df.count(), parts), parts)
    return [(lo[0], lo[1], hi[0], hi[1]) for lo, hi in tree.boxes], tree


def quad_cells(df: DataFrame, parts: int, levels: int = 12) -> list[tuple[float, float, float, float]]:
    """Boxes of a quad-tree over a sample, split while one holds more than its share of the sample."""
    b = _box(df)
    n = b["n"]
    rows = _sample(df, n, parts)
    most = max(1, len(rows) // max(1, parts))
    out, stack = [], [(b["xmin"], b["ymin"], b["xmax"], b["ymax"], rows, 0)]
    while stack:
        x0, y0, x1, y1, pts, depth = stack.pop()
        if len(pts) <= most or depth >= levels:
            out.append((x0, y0, x1, y1))
            continue
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        right, up = pts[:, 0] >= mx, pts[:, 1] >= my
        stack += [(mx, my, x1, y1, pts[right & up], depth + 1), (x0, my, mx, y1, pts[~right & up], depth + 1), (mx, y0, x1, my, pts[right & ~up], depth + 1), (x0, y0, mx, my, pts[~right & ~up], depth + 1)]
    return out


def place(df: DataFrame, cells: list[tuple[float, float, float, float]]) -> DataFrame:
    """Adds ``cell``: the first box that holds the point, half open; points in none go to the overflow cell, len(cells).

    The boxes (a few for each part asked for) are looked up in Arrow batches.
    """
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    boxes = np.array(cells, float).reshape(-1, 4)
    xmax, ymax = (boxes[:, 2].max(), boxes[:, 3].max()) if len(boxes) else (0, 0)
    shared = df.sparkSession.sparkContext.broadcast(boxes)

    def run(batches):
        b = shared.value
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            cell = np.full(len(x), len(b), np.int64)
            step = max(1, (1 << 22) // max(1, len(b)))
            for s in range(0, len(x), step):
                px, py = x[s : s + step, None], y[s : s + step, None]
                hit = (px >= b[:, 0]) & ((px < b[:, 2]) | ((px == xmax) & (b[:, 2] == xmax))) & (py >= b[:, 1]) & ((py < b[:, 3]) | ((py == ymax) & (b[:, 3] == ymax)))
                any_ = hit.any(axis=1)
                cell[s : s + step][any_] = hit[any_].argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("cell", LongType())]))


def cell_table(df: DataFrame) -> DataFrame:
    """(cell, n, xmin, ymin, xmax, ymax) of placed points."""
    return df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def str_parts(df: DataFrame, parts: int) -> DataFrame:
    """Adds ``cell`` of sort-tile-recursive packing: vertical slices of equal counts, each cut into runs of equal counts.

    Cut points are quantiles from approximate aggregates, so no task sorts the table.
    """
    side = max(1, math.isqrt(parts))
    xs = sorted(set(df.agg(F.percentile_approx("x", [i / side for i in range(1, side)], 10_000)).first()[0] or [])) if side > 1 else []
    sliced = df.withColumn("_s", sum((F.when(F.col("x") >= c, 1).otherwise(0) for c in xs), F.lit(0)))
    if side == 1:
        return sliced.withColumn("cell", F.lit(0).cast("long")).drop("_s")
    cuts = sliced.groupBy("_s").agg(F.percentile_approx("y", [i / side for i in range(1, side)], 10_000).alias("_c"))
    run = F.size(F.filter("_c", lambda c: F.col("y") >= c))
    return sliced.join(cuts, "_s").withColumn("cell", (F.col("_s") * side + run).cast("long")).drop("_s", "_c")


def voronoi_parts(df: DataFrame, seeds: DataFrame, uid: str = "id") -> DataFrame:
    """Adds ``cell``, the id of the nearest seed (id, x, y)."""
    from marchland.operators.neighbors import nearest_in

    keyed = seeds.select((-F.col("id") - 1).alias("id"), "x", "y")  # a seed is itself a point and must find itself
    near = nearest_in(df.select(F.col(uid).alias("id"), "x", "y"), keyed, 1).select(F.col("id").alias(uid), (-F.col("nbr") - 1).alias("cell"))
    return df.join(near, uid)


def probability_bins(df: DataFrame, depth: int, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Adds ``bin``: recursive median splits, each bin on its column of greatest variance. One aggregate a level."""
    from marchland.session import Cut

    cut = Cut(df.sparkSession)
    out = df.withColumn("bin", F.lit(1).cast("long"))
    for level in range(depth):
        stats = out.groupBy("bin").agg(*[F.var_samp(c).alias(f"_v{i}") for i, c in enumerate(dims)], *[F.percentile_approx(c, 0.5, 10_000).alias(f"_m{i}") for i, c in enumerate(dims)])
        top = F.greatest(*[F.coalesce(F.col(f"_v{i}"), F.lit(0.0)) for i in range(len(dims))]) if len(dims) > 1 else F.coalesce("_v0", F.lit(0.0))
        goes = F.lit(0)
        for i in reversed(range(len(dims))):
            goes = F.when(F.coalesce(F.col(f"_v{i}"), F.lit(0.0)) == top, (F.col(dims[i]) > F.col(f"_m{i}")).cast("int")).otherwise(goes)
        out = cut(out.join(stats, "bin").withColumn("bin", F.col("bin") * 2 + goes).select(*df.columns, "bin"), f"bins{level}")
    return out


def bin_table(df: DataFrame, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(bin, n, weight, means)."""
    total = df.agg(F.count(F.lit(1))).first()[0] or 1
    return df.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in dims]).withColumn("weight", F.col("n") / F.lit(total))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin 1..bins, n); values outside are left out, the upper edge counts in the last bin."""
    at = F.when(F.col(col) == hi, F.lit(bins)).otherwise(F.floor((F.col(col) - F.lit(float(lo))) / ((hi - lo) / bins)) + 1)
    return df.where(F.col(col).between(lo, hi)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def uniformity(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """One row ``kl``: Kullback-Leibler divergence of the histogram from the uniform distribution."""
    h = histogram(df, col, lo, hi, bins)
    total = h.agg(F.sum("n")).first()[0] or 1
    p = F.col("n") / F.lit(float(total))
    return h.agg(F.sum(p * F.log(p * bins)).alias("kl"))


def class_moments(df: DataFrame, label: str, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(label, n, means, covariances) of each class."""
    pairs = [(a, b) for i, a in enumerate(dims) for b in dims[i:]]
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in dims], *[F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs])




def normality(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """One row ``kl``: Kullback-Leibler divergence of the histogram from the normal distribution with the values' mean and sample
    deviation, taken at the middles of the bins and scaled to sum to 1."""
    inside = df.where(F.col(col).between(lo, hi))
    m = inside.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    if m["m"] is None or not m["s"]:
        return df.sparkSession.createDataFrame([(None,)], "kl double")
    h = histogram(df, col, lo, hi, bins)
    middle = lambda b: F.lit(float(lo)) + (b - 0.5) * ((hi - lo) / bins)
    density = F.exp(-F.pow((middle(F.col("bin")) - m["m"]) / m["s"], F.lit(2.0)) / 2)
    whole = float(sum(np.exp(-(((lo + (b - 0.5) * (hi - lo) / bins) - m["m"]) / m["s"]) ** 2 / 2) for b in range(1, bins + 1)))
    total = h.agg(F.sum("n")).first()[0] or 1
    p = F.col("n") / F.lit(float(total))
    return h.agg(F.sum(p * F.log(p / (density / whole))).alias("kl"))


def bin_overlap(binned: DataFrame, subset: str, bin_: str = "bin") -> DataFrame:
    """(a, b, f_measure): for each pair a < b of subsets, the F-measure of their overlap in bins: in a bin the smaller of the two
    counts is shared."""
    n = binned.groupBy(F.col(subset).alias("s"), F.col(bin_).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("s").agg(F.sum("n").alias("size"))
    pairs = n.select(F.col("s").alias("a"), "bin", F.col("n").alias("na")).join(n.select(F.col("s").alias("b"), "bin", F.col("n").alias("nb")), "bin").where("a < b")
    shared = pairs.groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("tp"))
    both = shared.join(size.select(F.col("s").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("s").alias("b"), F.col("size").alias("sb")), "b")
    return both.select("a", "b", (2 * F.col("tp") / (F.col("sa") + F.col("sb"))).alias("f_measure"))
