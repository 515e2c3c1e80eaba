"""Agreement of two labellings, all from one contingency table of label pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLASSES = 2_000


def contingency(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(true_label, pred_label, n); rows without either label take no part."""
    both = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull())
    return both.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def pair_counts(table: DataFrame) -> DataFrame:
    """One row ss, sd, ds, dd: pairs together in both, in the true one only, in the predicted one only, in neither."""
    every = table.select(F.lit(0).alias("k"), F.col("n").alias("v"))
    every = every.unionByName(table.groupBy("true_label").agg(F.sum("n").alias("v")).select(F.lit(1).alias("k"), "v"))
    every = every.unionByName(table.groupBy("pred_label").agg(F.sum("n").alias("v")).select(F.lit(2).alias("k"), "v"))
    of = lambda k, v: F.coalesce(F.sum(F.when(F.col("k") == k, v)), F.lit(0.0))
    one = every.agg(of(0, _pairs(F.col("v"))).alias("ss"), of(1, _pairs(F.col("v"))).alias("by_true"), of(2, _pairs(F.col("v"))).alias("by_pred"), of(0, F.col("v").cast("double")).alias("total"))
    ss, sd, ds = F.col("ss"), F.col("by_true") - F.col("ss"), F.col("by_pred") - F.col("ss")
    return one.select("ss", sd.alias("sd"), ds.alias("ds"), (_pairs(F.col("total")) - ss - sd - ds).alias("dd"))


def pair_metrics(table: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: rand, ari, precision, recall, f_measure, jaccard. Shares of nothing are NULL; with identical trivial labellings
    the adjusted index is 1."""
    p = pair_counts(table)
    ss, sd, ds, dd = (F.col(c) for c in ("ss", "sd", "ds", "dd"))
    every = ss + sd + ds + dd
    ari_top = 2 * (ss * dd - ds * sd)
    ari_low = (ss + sd) * (sd + dd) + (ss + ds) * (ds + dd)
    share = lambda a, b: F.when(b > 0, a / b)
    precision, recall = share(ss, ss + ds), share(ss, ss + sd)
    b2 = beta * beta
    return p.select(
        share(ss + dd, every).alias("rand"),
        F.when(ari_low != 0, ari_top / ari_low).otherwise(F.lit(1.0)).alias("ari"),
        precision.alias("precision"),
        recall.alias("recall"),
        share((1 + b2) * precision * recall, b2 * precision + recall).alias("f_measure"),
        share(ss, ss + sd + ds).alias("jaccard"),
    )


def purity(table: DataFrame) -> DataFrame:
    """One row: purity (best true label in each predicted group) and inverse_purity (the other way round)."""
    best = lambda by, k: table.groupBy(by).agg(F.max("n").alias("m"), F.sum("n").alias("s")).select(F.lit(k).alias("k"), "m", "s")
    share = lambda k: F.sum(F.when(F.col("k") == k, F.col("m"))) / F.sum(F.when(F.col("k") == k, F.col("s")))
    return best("pred_label", 0).unionByName(best("true_label", 1)).agg(share(0).alias("purity"), share(1).alias("inverse_purity"))


def nmi(table: DataFrame) -> DataFrame:
    """One row: 2 · mutual information / (entropy + entropy); 1 if both labellings have one class only."""
    total = table.agg(F.sum("n")).first()[0] or 0
    if not total:
        return table.agg(F.lit(None).cast("double").alias("nmi"))
    n = F.lit(float(total))
    rows, cols = table.groupBy("true_label").agg(F.sum("n").alias("a")), table.groupBy("pred_label").agg(F.sum("n").alias("b"))
    p = lambda c: F.col(c) / n
    mutual = table.join(rows, "true_label").join(cols, "pred_label").select(F.lit(0).alias("k"), (p("n") * F.log(F.col("n") * n / (F.col("a") * F.col("b")))).alias("v"))
    parts = mutual.unionByName(rows.select(F.lit(1).alias("k"), (-p("a") * F.log(p("a"))).alias("v"))).unionByName(cols.select(F.lit(1).alias("k"), (-p("b") * F.log(p("b"))).alias("v")))
    of = lambda k: F.sum(F.when(F.col("k") == k, F.col("v")))
    return parts.agg(of(0).alias("mi"), of(1).alias("h")).select(F.when(F.col("h") > 0, 2 * F.col("mi") / F.col("h")).otherwise(F.lit(1.0)).alias("nmi"))


def assignment(gain: np.ndarray) -> np.ndarray:
    """The column of each row in a one-to-one assignment of greatest total gain; -1 where rows outnumber columns.

    Shortest augmenting paths with potentials.
    """
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    row_price, col_price, holder = np.zeros(n), np.zeros(m), np.full(m, -1)
    for r in range(n):
        slack, via, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, col = r, -1
        while True:
            reduced = cost[at] - row_price[at] - col_price
            better = ~seen & (reduced < slack)
            slack[better], via[better] = reduced[better], col
            nxt = int(np.where(seen, np.inf, slack).argmin())
            step = slack[nxt]
            row_price[r] += step
            for c in np.flatnonzero(seen):
                row_price[holder[c]] += step
            col_price[seen] -= step
            slack[~seen] -= step
            seen[nxt] = True
            col = nxt
            if holder[nxt] < 0:
                break
            at = holder[nxt]
        while col >= 0:
            before = via[col]
            holder[col] = r if before < 0 else holder[before]
            col = before
    out = np.full(n, -1)
    out[holder[holder >= 0]] = np.flatnonzero(holder >= 0)
    if not flip:
        return out
    back = np.full(m, -1)
    back[out] = np.arange(n)
    return back


def matched_accuracy(table: DataFrame) -> DataFrame:
    """(true_label, pred_label, n, accuracy): the one-to-one match of classes and groups that gets most rows right.

    The table of classes × groups goes to the driver, at most MAX_CLASSES of each; more raise an error.
    """
    sizes = table.agg(F.count_distinct("true_label").alias("t"), F.count_distinct("pred_label").alias("p"), F.sum("n").alias("n")).first()
    if max(sizes["t"], sizes["p"]) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes or groups")
    rows = table.collect()
    ts, ps = sorted({r["true_label"] for r in rows}), sorted({r["pred_label"] for r in rows})
    gain = np.zeros((len(ts), len(ps)))
    at, bt = {v: i for i, v in enumerate(ts)}, {v: i for i, v in enumerate(ps)}
    for r in rows:
        gain[at[r["true_label"]], bt[r["pred_label"]]] = r["n"]
    match = assignment(gain) if rows else []
    good = sum(gain[i, j] for i, j in enumerate(match) if j >= 0)
    kind = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    out = [(ts[i], ps[j], int(gain[i, j]), float(good / sizes["n"])) for i, j in enumerate(match) if j >= 0]
    return table.sparkSession.createDataFrame(out, f"true_label {kind['true_label']}, pred_label {kind['pred_label']}, n long, accuracy double")


def class_scores(table: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) where predicted labels are of the same kind as the true ones."""
    t = table.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("a"))
    p = table.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("b"))
    hit = table.where(F.col("true_label") == F.col("pred_label")).select(F.col("true_label").alias("label"), F.col("n").alias("tp"))
    j = t.join(p, "label", "full").join(hit, "label", "left").na.fill(0, ["a", "b", "tp"])
    tp, fp, fn = F.col("tp"), F.col("b") - F.col("tp"), F.col("a") - F.col("tp")
    share = lambda a, b: F.when(b > 0, a / b)
    return j.select("label", "tp", fp.alias("fp"), fn.alias("fn"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def subset_match(table: DataFrame) -> DataFrame:
    """(true_label, pred_label, f1): for each class the group of greatest F-measure, ties by group; a group may serve several."""
    t = table.groupBy("true_label").agg(F.sum("n").alias("a"))
    p = table.groupBy("pred_label").agg(F.sum("n").alias("b"))
    each = table.join(t, "true_label").join(p, "pred_label").select("true_label", "pred_label", (2 * F.col("n") / (F.col("a") + F.col("b"))).alias("f1"))
    best = each.groupBy("true_label").agg(F.max("f1").alias("f1"))
    return each.join(best, ["true_label", "f1"]).groupBy("true_label", "f1").agg(F.min("pred_label").alias("pred_label")).select("true_label", "pred_label", "f1")
