"""Point tables before clustering: copies, scaling, constant columns, extents, principal components, expression matrices."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marchland.session import Cut


def dedup(df: DataFrame, uid: str = "id", dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(rep_id, *dims, n): one row per distinct place, under its lowest id. Null components form places of their own."""
    return df.groupBy(*dims).agg(F.min(uid).alias("rep_id"), F.count(F.lit(1)).alias("n")).select("rep_id", *dims, "n")


def back_fill(df: DataFrame, labelled: DataFrame, label: str, uid: str = "id", dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(id, label): each row gets the label of its place, found under the place's lowest id."""
    places = dedup(df, uid, dims)
    found = places.join(labelled.select(F.col(uid).alias("rep_id"), label), "rep_id", "left").select(*[F.col(c).alias(f"_{c}") for c in dims], label)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in dims])
    return df.select(F.col(uid), *dims).join(found, same, "left").select(uid, label)


def min_max(df: DataFrame, dims: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over all rows; constant ones stay as they are. The extremes are one aggregate of one row."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def scaled(i: int, c: str) -> Column:
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        return F.col(c) if lo is None or lo == hi else (F.col(c) - F.lit(lo)) / (F.lit(hi) - F.lit(lo))

    return df.withColumns({c: scaled(i, c) for i, c in enumerate(dims)})


def min_max_array(df: DataFrame, vec: str) -> DataFrame:
    """The same for one array column."""
    width = (df.agg(F.max(F.size(vec))).first() or [0])[0] or 0
    at = [F.element_at(vec, i + 1).cast("double") for i in range(width)]
    row = df.agg(F.array(*[F.min(c) for c in at]).alias("lo"), F.array(*[F.max(c) for c in at]).alias("hi")).first()
    parts = [c if row["lo"][i] is None or row["lo"][i] == row["hi"][i] else (c - F.lit(row["lo"][i])) / (F.lit(row["hi"][i]) - F.lit(row["lo"][i])) for i, c in enumerate(at)]
    return df.withColumn(vec, F.array(*parts)) if width else df


def varying_columns(df: DataFrame, dims: list[str]) -> list[str]:
    """The columns with more than one value."""
    row = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in dims]).first()
    return [c for c in dims if row[c]]


def drop_constant(df: DataFrame, dims: list[str]) -> DataFrame:
    keep = set(varying_columns(df, dims))
    return df.drop(*[c for c in dims if c not in keep])


def varying_components(df: DataFrame, vec: str) -> list[int]:
    """0-based positions of an array column's components with more than one value."""
    width = (df.agg(F.max(F.size(vec))).first() or [0])[0] or 0
    row = df.agg(*[(F.min(F.element_at(vec, i + 1)) != F.max(F.element_at(vec, i + 1))).alias(f"c{i}") for i in range(width)]).first() if width else {}
    return [i for i in range(width) if row[f"c{i}"]]


def drop_constant_components(df: DataFrame, vec: str) -> DataFrame:
    keep = varying_components(df, vec)
    return df.withColumn(vec, F.array(*[F.element_at(vec, i + 1) for i in keep]))


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: n, xmin, xmax, ymin, ymax."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def distinct_places(df: DataFrame, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    return df.select(*dims).distinct().agg(F.count(F.lit(1)).alias("n"))


def principal_components(df: DataFrame, vec: str, k: int | float, uid: str = "id") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, pc array), the loadings (d × k) and the explained variances.

    The covariance comes from sums over all rows in Arrow batches, d × d numbers a task; ``k`` below 1 is the share of
    variance to keep. Each component's loading of largest size is positive.
    """
    width = (df.agg(F.max(F.size(vec))).first() or [0])[0] or 0
    clean = df.where(F.col(vec).isNotNull()).select(F.col(uid).alias("id"), F.transform(F.col(vec), lambda v: v.cast("double")).alias("v"))

    def sums(batches):
        import pyarrow as pa

        n, s, ss = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
            n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], ["n", "s", "ss"])

    parts = clean.select("v").mapInArrow(sums, "n long, s array<double>, ss array<double>")
    n = parts.agg(F.sum("n")).first()[0] or 0
    if n < 2:
        raise ValueError("principal components need two rows or more")
    total = [r["t"] for r in parts.select(F.posexplode(F.concat("s", "ss")).alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("t")).orderBy("pos").select("t").collect()]
    s, ss = np.array(total[:width]), np.array(total[width:]).reshape(width, width)
    mean = s / n
    values, vectors = np.linalg.eigh((ss - n * np.outer(mean, mean)) / (n - 1))
    values, vectors = values[::-1], vectors[:, ::-1]
    if k < 1:
        k = int(np.searchsorted(np.cumsum(values) / values.sum(), k) + 1)
    vectors = vectors[:, : int(k)]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    centre = F.array(*[F.lit(float(m)) for m in mean])
    shifted = F.zip_with("v", centre, lambda a, b: a - b)
    pcs = [F.aggregate(F.zip_with(shifted, F.array(*[F.lit(float(w)) for w in vectors[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda t, z: t + z) for j in range(vectors.shape[1])]
    return clean.select("id", F.array(*pcs).alias("pc")), vectors, values[: vectors.shape[1]]


def log_normalise(long: DataFrame, cell: str = "cell", value: str = "value", scale: float = 10_000.0) -> DataFrame:
    """Counts of each cell to log(1 + share × scale)."""
    totals = long.groupBy(cell).agg(F.sum(value).alias("_total"))
    return long.join(totals, cell).withColumn(value, F.log1p(F.col(value) / F.col("_total") * F.lit(scale))).drop("_total")


def standardise(long: DataFrame, gene: str = "gene", value: str = "value", most: float = 10.0) -> DataFrame:
    """Values of each gene to zero mean and unit deviation, at most ``most``; a constant gene becomes 0."""
    stats = long.groupBy(gene).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return long.join(stats, gene).withColumn(value, F.least(F.lit(most), z)).drop("_m", "_s")


def sample_rows(df: DataFrame, n: int, uid: str = "id", seed: int = 7) -> DataFrame:
    """``n`` different rows (all, if there are fewer), those of lowest seeded hash: the same however the table is stored.

    Each partition sends its ``n`` lowest only.
    """
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(uid)), uid).limit(n)


def row_range(df: DataFrame, order: str | list[str], first: int, count: int) -> DataFrame:
    """``count`` rows from the ``first``-th (1-based) in the order of columns that together are distinct."""
    return dense_numbers(df, order, "_row").where(F.col("_row").between(first, first + count - 1)).drop("_row")


def variable_genes(long: DataFrame, n: int, gene: str = "gene", value: str = "value") -> DataFrame:
    """(gene, mean, dispersion, rank): the ``n`` genes of greatest dispersion (variance over mean), ties by gene; genes whose mean
    is 0 have none."""
    stats = long.groupBy(gene).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("_v")).where(F.col("mean") != 0)
    ranked = stats.select(gene, "mean", (F.col("_v") / F.col("mean")).alias("dispersion")).where(F.col("dispersion").isNotNull())
    return ranked.orderBy(F.desc("dispersion"), gene).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("dispersion"), gene)))


def dense_numbers(df: DataFrame, order: str | list[str], number: str) -> DataFrame:
    """Rows numbered 1, 2, ... in the order of columns of distinct values, without one task seeing all of them.

    A range sort places the rows; each partition numbers its own, and the partitions' sizes (one row each) give the offsets.
    """
    cut = Cut(df.sparkSession)
    spot = cut(df.sort(order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in spot.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = {}, 0
    for p, n in sizes:
        offsets[p] = total
        total += n
    base = F.element_at(F.create_map(*[F.lit(v) for p, o in offsets.items() for v in (p, o)]), part) if offsets else F.lit(0)
    return spot.withColumn(number, (base + inner + 1).cast("int")).drop("_at")


def rank_value(df: DataFrame, col: str, rank: int, bins: int = 4096, few: int = 50_000) -> float | None:
    """The ``rank``-th smallest value of a column (1-based), exact: histogram passes narrow the range until few values are left."""
    row = df.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    n, lo, hi = row["n"], row["lo"], row["hi"]
    if not n:
        return None
    rank = min(max(1, rank), n)
    part, inside = df.where(F.col(col).isNotNull()), n
    while inside > few and lo < hi:
        width = (hi - lo) / bins
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.lit(lo)) / F.lit(width)))
        below = 0
        for r in sorted(part.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), key=lambda r: r["b"]):
            if below + r["n"] >= rank:
                rank, inside = rank - below, r["n"]
                if (r["lo"], r["hi"]) == (lo, hi):
                    return float(part.where(F.col(col).between(lo, hi)).orderBy(col).limit(rank).agg(F.max(col)).first()[0])
                lo, hi = r["lo"], r["hi"]
                break
            below += r["n"]
        part = df.where(F.col(col).between(lo, hi))
    if lo == hi:
        return float(lo)
    return float(sorted(r[0] for r in part.select(col).collect())[rank - 1])
