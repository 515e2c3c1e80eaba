"""Filling missing values from similar records, every filled value marked with the method that gave it.

K-prototypes clusters the records on what is observed of their numeric and categorical features (missing ones add nothing
to a distance). A missing value then comes from the finest level that knows one: median or mode within the named groups,
down to the cluster, its parent levels, and at last all records; before them may come records that agree in two of four
blocks of given features, which are most likely the same case seen again. Each round of the fit is one Arrow pass that sends
partial sums only, and only the prototypes (k × features) reach the driver; the levels are plain aggregates and joins.

The number of clusters and the weight of categories are chosen by the error on hidden values of a bounded sample; seeds and
rounds go over all records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from marchland.session import Cut

#: Rows on which k and gamma are chosen, and what is tried.
TRIAL_ROWS = 10_000
CHOICES = tuple((k, gamma) for k in (6, 12, 24) for gamma in (0.5, 2.0))
#: Records that share a key of two blocks with more others than this are not taken for one case.
MOST_ALIKE = 20


@dataclass(frozen=True)
class Target:
    """A column to fill: ``observed`` gives its clean value or NULL, ``levels`` the groups to ask, finest first.

    A level is (name, grouping columns, least number of observed values); ``_cluster`` names the record's cluster. ``alike`` are
    the features by which records of one case are known, in blocks; their level comes first and is called ``alike``.
    """

    name: str
    observed: Column
    levels: tuple[tuple[str, tuple[str, ...], int], ...]
    categorical: bool = False
    alike: tuple[str, ...] = ()


@dataclass(frozen=True)
class Features:
    numeric: dict[str, Column] = field(default_factory=dict)
    categorical: dict[str, Column] = field(default_factory=dict)


@dataclass
class Prototypes:
    """k centres: scaled numbers with NaN where nothing is known, and a category each (None where none is known)."""

    x: np.ndarray
    cats: list[list[str | None]]
    gamma: float

    def distances(self, x: np.ndarray, codes: list[tuple[np.ndarray, list]]) -> np.ndarray:
        """n × k, from numbers and dictionary-coded categories (-1 is missing)."""
        known, fit = ~np.isnan(x), ~np.isnan(self.x)
        a, b = np.where(known, x, 0.0), np.where(fit, self.x, 0.0)
        d = (a**2) @ fit.T.astype(float) - 2 * (a @ b.T) + known.astype(float) @ (b**2).T
        for (at, values), mine in zip(codes, self.cats):
            differ = np.zeros((len(values) + 1, len(self.x)))
            for i, v in enumerate(mine):
                if v is not None:
                    differ[:-1, i] = [w != v for w in values]
            d += self.gamma * differ[at]
        return np.maximum(0, d)


def _coded(batch: pa.RecordBatch | pa.Table, nums: list[str], cats: list[str], scale: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, list]]]:
    """Scaled numbers (NaN: missing) and the categories by their codes (-1: missing)."""
    x = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in nums], axis=1) if nums else np.zeros((batch.num_rows, 0))
    codes = []
    for c in cats:
        column = batch.column(c)
        held = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        codes.append((held.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary.to_pylist()))
    return (x - scale[:, 0]) / scale[:, 1], codes


def _far_first(x: np.ndarray, codes: list, k: int, gamma: float) -> Prototypes:
    """Seeds among the given rows, each as far as possible from those before."""
    as_value = [np.array([*v, None], object)[at] for at, v in codes]
    picked, near = [0], None
    while True:
        i = picked[-1]
        d = Prototypes(x[i : i + 1], [[v[i]] for v in as_value], gamma).distances(x, codes)[:, 0]
        near = d if near is None else np.minimum(near, d)
        if len(picked) >= min(k, len(x)) or near.max() <= 0:
            return Prototypes(x[picked], [[v[i] for i in picked] for v in as_value], gamma)
        picked.append(int(near.argmax()))


def _sums(fit: Prototypes, x: np.ndarray, codes: list) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """Of each centre's rows: sums and counts of the numbers, and how often each category occurs."""
    mine, k = fit.distances(x, codes).argmin(axis=1), len(fit.x)
    known = ~np.isnan(x)
    total = np.stack([np.bincount(mine, np.where(known[:, j], x[:, j], 0.0), k) for j in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((k, 0))
    count = np.stack([np.bincount(mine, known[:, j], k) for j in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((k, 0))
    seen = []
    for at, values in codes:
        table = np.bincount(mine[at >= 0] * max(1, len(values)) + at[at >= 0], minlength=k * max(1, len(values))).reshape(k, -1)
        seen.append({(i, values[v]): int(table[i, v]) for i, v in zip(*np.nonzero(table))})
    return total, count, seen


def _moved(fit: Prototypes, total: np.ndarray, count: np.ndarray, seen: list[dict]) -> Prototypes:
    x = np.where(count > 0, total / np.maximum(1, count), fit.x)
    cats = []
    for old, got in zip(fit.cats, seen):
        best: dict[int, tuple[int, str]] = {}
        for (i, v), n in got.items():
            best[i] = max(best.get(i, (0, "")), (n, v))
        cats.append([best[i][1] if i in best else v for i, v in enumerate(old)])
    return Prototypes(x, cats, fit.gamma)


def _choose(sample: pa.Table, nums: list[str], cats: list[str], scale: np.ndarray, rounds: int) -> tuple[int, float]:
    """The (k, gamma) of CHOICES whose clusters tell hidden values of the sample best: every eighth value of each feature is hidden
    in turn, numbers err by their scaled distance from the cluster's mean, categories by 1."""
    x, codes = _coded(sample, nums, cats, scale)
    rng = np.random.default_rng(5)
    hidden = rng.random(x.shape) < 0.125
    hide_cat = [rng.random(len(at)) < 0.125 for at, _ in codes]
    shown = np.where(hidden, np.nan, x)
    shown_codes = [(np.where(h, -1, at), v) for h, (at, v) in zip(hide_cat, codes)]
    best = (np.inf, CHOICES[0])
    for k, gamma in CHOICES:
        fit = _far_first(shown, shown_codes, k, gamma)
        for _ in range(rounds):
            fit = _moved(fit, *_sums(fit, shown, shown_codes))
        mine = fit.distances(shown, shown_codes).argmin(axis=1)
        off = np.abs(fit.x[mine] - x)[hidden]
        wrong = [np.array([fit.cats[j][mine[i]] != v[at[i]] for i in np.flatnonzero(h & (at >= 0))]) for j, (h, (at, v)) in enumerate(zip(hide_cat, codes))]
        error = np.nansum(off) + sum(w.sum() for w in wrong)
        best = min(best, (float(error), (k, gamma)))
    return best[1]


def k_prototypes(df: DataFrame, key: str, features: Features, k: int | None = None, gamma: float | None = None, rounds: int = 8) -> DataFrame:
    """``df`` with the record's cluster as ``g__cluster``; fitted on all rows, one pass a round, until no centre moves.

    A pass sends one row per cluster and feature (and category) of a partition, so hot clusters don't matter. Seeds come from two
    passes that draw rows of the whole table by their distance from the seeds so far. ``k`` and ``gamma`` (the weight of a
    differing category against a squared standard deviation) are chosen on TRIAL_ROWS rows of lowest hash where not given.
    """
    nums, cats = list(features.numeric), list(features.categorical)
    stats = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(nums)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(nums)]).first()
    if not stats["_n"]:
        return df.withColumn("g__cluster", F.lit(0))
    scale = np.array([[stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 1.0] for i in range(len(nums))]).reshape(-1, 2)
    slim = df.select(*nums, *cats, F.xxhash64(F.col(key).cast("string")).alias("_h"))
    rate = min(1.0, TRIAL_ROWS / stats["_n"])
    trial = slim.where(F.col("_h").cast("double") / F.lit(2.0**64) + 0.5 <= rate).orderBy("_h").limit(2 * TRIAL_ROWS).toArrow()
    if k is None or gamma is None:
        k, gamma = _choose(trial, nums, cats, scale, 4) if trial.num_rows else CHOICES[0]
    drawn = trial.slice(0, 1)
    kinds = slim.schema

    def draw(now: Prototypes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = now.distances(*_coded(b, nums, cats, scale)).min(axis=1)
                u = b.column("_h").to_numpy().astype(float) / 2.0**64 + 0.5
                order = near / -np.log(np.clip(u, 1e-12, 1 - 1e-12))
                top = np.argsort(-order, kind="stable")[: 4 * k]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(top)) for c in b.columns], pa.array(order[top])], [*b.schema.names, "_w"])

        return run

    for _ in range(2 if trial.num_rows else 0):
        now = _far_first(*_coded(drawn, nums, cats, scale), drawn.num_rows, gamma)
        more = slim.mapInArrow(draw(now), StructType([*kinds.fields, StructField("_w", DoubleType())])).orderBy(F.desc("_w"), "_h").limit(4 * k).drop("_w").toArrow()
        drawn = pa.concat_tables([drawn, more.cast(drawn.schema)])
    fit = _far_first(*_coded(drawn, nums, cats, scale), k, gamma) if drawn.num_rows else Prototypes(np.zeros((1, len(nums))), [[None] for _ in cats], gamma)

    def sums(fit: Prototypes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count, seen = np.zeros(fit.x.shape), np.zeros(fit.x.shape), [{} for _ in cats]
            for batch in batches:
                t, c, s = _sums(fit, *_coded(batch, nums, cats, scale))
                total, count = total + t, count + c
                for all_, new in zip(seen, s):
                    for at, n in new.items():
                        all_[at] = all_.get(at, 0) + n
            rows = [(int(i), int(j), None, total[i, j], count[i, j]) for i, j in zip(*np.nonzero(count))]
            rows += [(int(i), len(nums) + j, v, 0.0, float(n)) for j, s in enumerate(seen) for (i, v), n in s.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()))], ["c", "f", "v", "s", "n"])

        return run

    for _ in range(rounds):
        got = slim.mapInArrow(sums(fit), "c int, f int, v string, s double, n double").groupBy("c", "f", "v").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        got = got.groupBy("c", "f").agg(F.max_by("v", F.struct("n", "v")).alias("v"), F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        x, chosen = fit.x.copy(), [list(c) for c in fit.cats]
        for r in got:
            if r["f"] < len(nums):
                x[r["c"], r["f"]] = r["s"] / r["n"]
            else:
                chosen[r["f"] - len(nums)][r["c"]] = r["v"]
        still = chosen == fit.cats and np.nanmax(np.abs(np.nan_to_num(x) - np.nan_to_num(fit.x)), initial=0.0) < 0.01
        fit = Prototypes(x, chosen, gamma)
        if still:
            break

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = fit.distances(*_coded(batch, nums, cats, scale)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine.astype(np.int32))], [*batch.schema.names, "g__cluster"])

    return df.mapInArrow(label, StructType([*df.schema.fields, StructField("g__cluster", IntegerType())]))


def _by_alike(rows: DataFrame, value: str, columns: list[str], categorical: bool) -> DataFrame:
    """(_key, va): for rows without a value that of rows with equal features in two of four blocks, each key shared by MOST_ALIKE
    rows at most; the median (or mode) over the keys of what each gives."""
    blocks = [b.tolist() for b in np.array_split(np.array(columns, object), 4)]
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col(c) for c in p + q]) for i, (p, q) in enumerate(combinations(blocks, 2))])
    pick = (lambda c: F.mode(c, deterministic=True)) if categorical else (lambda c: F.percentile_approx(c, 0.5, 10_000))
    flat = rows.where(F.col("_key").isNotNull()).select("_key", value, F.explode(keys).alias("k"))
    given = flat.where(F.col(value).isNotNull()).groupBy("k").agg(pick(value).alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") <= MOST_ALIKE)
    return flat.where(F.col(value).isNull()).join(given, "k").groupBy("_key").agg(pick("v").alias("va"))


def fill_missing(df: DataFrame, key: str, features: Features, targets: list[Target], k: int | None = None, gamma: float | None = None, rounds: int = 8) -> DataFrame:
    """One row per key: ``<key>``, and for each target ``<name>`` (observed or filled) and ``<name>_method`` (NULL where observed,
    else the level that filled it, or ``none`` where no record has a value).

    Rows repeated under one key count once; rows with a null key are kept, each for itself. Ties of modes and medians take
    the smaller value. Group columns that are NULL form no group. An empty table gives an empty result. Column names of the
    input never clash with those made here, as only the named expressions are read.
    """
    cut = Cut(df.sparkSession)
    groups = sorted({g for t in targets for _, gs, _ in t.levels for g in gs if g != "_cluster"})
    named = {f"n_{c}": e.cast("double") for c, e in features.numeric.items()} | {f"f_{c}": e.cast("string") for c, e in features.categorical.items()}
    named |= {f"g_{g}": F.col(f"`{g}`") for g in groups} | {f"t_{t.name}": t.observed for t in targets} | {f"a_{c}": F.col(f"`{c}`") for t in targets for c in t.alike}
    slim = df.select(F.col(key).alias("_key"), *[e.alias(c) for c, e in named.items()])
    known = slim.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.first(F.struct(*named)).alias("r")).select("_key", "r.*")
    slim = known.unionByName(slim.where(F.col("_key").isNull()))
    slim = cut(slim, "fill")
    prefixed = Features({f"n_{c}": e for c, e in features.numeric.items()}, {f"f_{c}": e for c, e in features.categorical.items()})
    rows = cut(k_prototypes(slim, "_key", prefixed, k, gamma, rounds), "clustered")
    cut.drop("fill")
    result = rows
    for t in targets:
        value = f"t_{t.name}"
        open_, closed = result.where(F.col(value).isNull()), result.where(F.col(value).isNotNull())
        methods, values = [], []
        if t.alike:
            open_ = open_.join(_by_alike(rows, value, [f"a_{c}" for c in t.alike], t.categorical), "_key", "left")
            methods.append(F.when(F.col("va").isNotNull(), F.lit("alike")))
            values.append(F.col("va"))
        for n, (name, by, least) in enumerate(t.levels):
            cols = [f"g_{g}" for g in by]
            agg = F.mode(value, deterministic=True) if t.categorical else F.percentile_approx(value, 0.5, 10_000)
            src = rows.where(F.col(value).isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True)))
            level = src.groupBy(*cols).agg(agg.alias(f"v{n}"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
            if cols:
                open_ = open_.join(level, cols, "left")
            else:  # the value over all records is one number
                row = level.first()
                open_ = open_.withColumn(f"v{n}", F.lit(row[f"v{n}"] if row else None).cast(slim.schema[value].dataType))
            methods.append(F.when(F.col(f"v{n}").isNotNull(), F.lit(name)))
            values.append(F.col(f"v{n}"))
        filled = open_.withColumns({value: F.coalesce(*values), f"m_{t.name}": F.coalesce(*methods, F.lit("none"))}).drop("va", *[f"v{n}" for n in range(len(t.levels))])
        result = filled.unionByName(closed.withColumn(f"m_{t.name}", F.lit(None).cast("string")))
    picked = [c for t in targets for c in (F.col(f"t_{t.name}").alias(t.name), F.col(f"m_{t.name}").alias(f"{t.name}_method"))]
    return result.select(F.col("_key").alias(key), *picked)
