"""Mixing sources to target shares of tokens, by entropy balancing.

The mixture has as many tokens as all documents have. Its document rates stay as near to 1 as possible, in relative entropy
over tokens, while each source gets its share and the means of further features (bands of length, languages) come near those
of the whole corpus, which shares alone would shift. The rates are min(cap, exp(λ of the source + μ·x)): so within a source
documents are tilted towards what the mixture lacks. λ and μ solve the convex dual by Newton steps whose sums are distributed
aggregates over all documents. λ lives in a small table with a row for each source; only sums over features reach the driver.
Rates become copies by priority sampling with a threshold for each source that meets the target to within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marchland.session import Cut

ROUNDS = 40
BINS = 1024
REFINEMENTS = 3
#: Weight of the squared tilts in the dual, as a share of all tokens: keeps it solvable where features can't be balanced.
RIDGE = 1e-3


@dataclass(frozen=True)
class Mixture:
    """``report``: one row per source of the targets; ``copies``: id, source, tokens, rate, copies of each document used;
    ``balance``: for each feature its mean over tokens in the corpus, in a mixture of equal rates within a source, and in this
    one, and its tilt."""

    report: DataFrame
    copies: DataFrame
    balance: DataFrame


def _solve(docs: DataFrame, state: DataFrame, names: list[str], aim: np.ndarray, total: float, cut: Cut) -> tuple[DataFrame, np.ndarray]:
    """λ of each source in ``state`` (source, cap, goal, open, lam) and μ, by Newton's method on the dual.

    ``aim`` are the features' means over the mixture's tokens. Steps longer than 2 are cut.
    """
    k = len(names)
    x = [F.col(c) for c in names]
    mu = np.zeros(k)
    for turn in range(ROUNDS):
        z = sum((F.lit(float(m)) * c for m, c in zip(mu, x)), F.col("lam"))
        w = F.when(F.col("open"), F.least(F.col("cap"), F.exp(F.least(z, F.log("cap") + 1.0)))).otherwise(F.col("cap"))
        free = F.when(F.col("open") & (w < F.col("cap")), w * F.col("t")).otherwise(F.lit(0.0))
        sums = [F.sum(w * F.col("t")).alias("a"), F.sum(free).alias("h")]
        sums += [F.sum(w * F.col("t") * x[i]).alias(f"b{i}") for i in range(k)] + [F.sum(free * x[i]).alias(f"c{i}") for i in range(k)]
        sums += [F.sum(free * x[i] * x[j]).alias(f"d{i}_{j}") for i in range(k) for j in range(i, k)]
        each = cut(state.join(docs.join(state, "source").groupBy("source").agg(*sums), "source"), f"sums{turn}")
        # the sources' part of the system is diagonal, so it is eliminated where the sums are
        g, h = F.col("a") - F.col("goal"), F.greatest(F.col("h"), 1e-6 * F.col("goal"))
        on = lambda e: F.coalesce(F.sum(F.when(F.col("open"), e)), F.lit(0.0))
        asked = [F.max(F.when(F.col("open"), F.abs(g) / F.col("goal"))).alias("off"), F.sum("a").alias("a")]
        asked += [F.sum(f"b{i}").alias(f"b{i}") for i in range(k)] + [on(F.col(f"c{i}") * g / h).alias(f"r{i}") for i in range(k)]
        asked += [on(F.col(f"d{i}_{j}") - F.col(f"c{i}") * F.col(f"c{j}") / h).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
        got = each.agg(*asked).first()
        off = got["off"]
        if off is None:  # no source is open
            break
        used = got["a"] or 0.0
        slope = np.array([got[f"b{i}"] for i in range(k)]) - aim * used + RIDGE * total * mu
        if off < 1e-7 and (not k or np.abs(slope).max() < 1e-6 * total):
            break
        step = np.zeros(k)
        if k:
            system = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + (RIDGE + 1e-9) * total * np.eye(k)
            step = np.linalg.solve(system, np.array([got[f"r{i}"] for i in range(k)]) - slope)
            step *= min(1.0, 2 / max(1e-12, float(np.abs(step).max())))
        move = (-g - sum((F.col(f"c{i}") * float(step[i]) for i in range(k)), F.lit(0.0))) / h
        lam = F.when(F.col("open"), F.col("lam") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))).otherwise(F.col("lam"))
        mu = mu + step
        state = cut(each.select("source", "cap", "goal", "open", lam.alias("lam")), f"state{turn}")
        if turn:
            cut.drop(f"sums{turn - 1}", f"state{turn - 1}")
    return state, mu


def _thresholds(rated: DataFrame, need: DataFrame, cut: Cut) -> DataFrame:
    """(source, lo): the documents of a source whose log priority lies below lo get one more copy.

    ``need`` (source, need) are the tokens missing. Each turn cuts the range that holds the threshold into BINS.
    """
    range_ = need.select("source", "need", F.lit(0.0).alias("lo"), F.lit(float(np.log1p(1e9))).alias("hi"))
    for turn in range(REFINEMENTS):
        v = F.log1p("prio")
        inside = rated.where("prio is not null").select("source", "tokens", v.alias("v")).join(range_, "source").where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
        bins = inside.groupBy("source", F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int").alias("b")).agg(F.sum("tokens").alias("n"))
        summed = bins.withColumn("sum", F.sum("n").over(Window.partitionBy("source").orderBy("b"))).join(range_.select("source", "need"), "source")
        over = F.col("sum") > F.col("need")
        found = summed.groupBy("source").agg(F.coalesce(F.min(F.when(over, F.col("b"))), F.lit(BINS)).alias("at"), F.coalesce(F.max(F.when(~over, F.col("sum"))), F.lit(0)).alias("done"))
        width = (F.col("hi") - F.col("lo")) / BINS
        at = F.coalesce("at", F.lit(BINS))
        range_ = range_.join(found, "source", "left").select("source", (F.col("need") - F.coalesce("done", F.lit(0))).alias("need"), (F.col("lo") + at * width).alias("lo"), (F.col("lo") + (at + 1) * width).alias("hi"))
        range_ = cut(range_, f"range{turn}")
    return range_.select("source", "lo")


def mix(docs: DataFrame, targets: DataFrame, doc_id: str, source: str, tokens: str, text: str, features: dict[str, Column] | None = None) -> Mixture:
    """Mixes ``docs`` to ``targets`` (source, target_share, max_repeats).

    No text is used more than its source's max_repeats times: of equal texts the lowest id stands for all, so a source may have
    fewer tokens of its own (``own_tokens``) than its documents have; ``reachable`` goes by the documents, ``attainable`` by what
    is its own. A source that isn't attainable is used max_repeats times throughout. Documents without tokens, with a null
    source, or of a source without target get no copies but count in the size of the whole. A source of the targets may have no
    document. Targets with a null source, share or number of repeats are left out; of several rows of one source the first by
    share counts. Null features count as their mean. Empty tables give a report without use.
    """
    spark = docs.sparkSession
    cut = Cut(spark)
    features = features or {}
    named = [f"x_{n}" for n in features]
    slim = docs.select(
        F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"), F.sha2(F.col(text).cast("binary"), 256).alias("h"),
        *[e.cast("double").alias(f"x_{n}") for n, e in features.items()],
    )
    slim = cut(slim, "sizes")
    clean = targets.where("source is not null and target_share is not null and max_repeats is not null")
    wanted = cut(clean.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("r")).select("source", "r.*"), "wanted")
    totals = slim.agg(F.sum("tokens").alias("t"), *[(F.sum(F.col(c) * F.col("tokens")) / F.sum(F.when(F.col(c).isNotNull(), F.col("tokens")))).alias(c) for c in named]).first()
    total = float(totals["t"] or 0)
    means = np.array([totals[c] or 0.0 for c in named])

    texts = slim.where(F.col("source").isNotNull() & (F.col("tokens") > 0)).groupBy("h").agg(F.min(F.struct("id", "source", "tokens", *named)).alias("r")).select("r.*")
    texts = texts.withColumns({"t": F.col("tokens").cast("double"), **{c: F.coalesce(F.col(c) - F.lit(float(m)), F.lit(0.0)) for c, m in zip(named, means)}})
    texts = cut(texts.join(wanted.select("source"), "source", "left_semi"), "texts")
    goal, cap = F.col("target_share") * F.lit(total), F.greatest(F.col("max_repeats"), F.lit(0)).cast("double")
    own = texts.groupBy("source").agg(F.sum("t").alias("own"), F.max("tokens").alias("longest"))
    state = wanted.join(own, "source").select("source", cap.alias("cap"), goal.alias("goal"), ((goal > 0) & (goal < cap * F.col("own"))).alias("open"), F.when((goal > 0) & (F.col("own") > 0), F.log(goal / F.col("own"))).otherwise(F.lit(0.0)).alias("lam"))
    state = cut(state.withColumn("cap", F.when(F.col("goal") > 0, F.col("cap")).otherwise(F.lit(0.0))), "state")
    solved, mu = _solve(texts, state, named, np.zeros(len(named)), max(1.0, total), cut)
    z = sum((F.lit(float(m)) * F.col(c) for m, c in zip(mu, named)), F.col("lam"))
    rate = F.when(F.col("open"), F.least(F.col("cap"), F.exp(F.least(z, F.log("cap") + 1.0)))).otherwise(F.col("cap"))
    flat = F.when(F.col("open"), F.exp("flat")).otherwise(F.col("cap"))
    both = solved.join(state.select("source", F.col("lam").alias("flat")), "source")
    rated = cut(texts.join(both, "source").select("id", "source", "tokens", rate.alias("rate"), flat.alias("flat"), "goal", *named), "rated")

    # priority sampling: a document gets one more copy if its priority is at most its source's threshold
    part = F.col("rate") - F.floor("rate")
    uniform = (F.xxhash64(F.lit(5), "id").cast("double") / F.lit(2.0**64)) + 0.5
    placed = rated.select("id", "source", "tokens", "rate", "goal", F.when((part < 1e-9) | (part > 1 - 1e-9), F.lit(0.0)).otherwise(part).alias("part"), F.floor(F.col("rate") + 1e-9).alias("whole"))
    placed = placed.withColumn("prio", F.when(F.col("part") > 0, uniform / F.col("part")))
    need = cut(placed.groupBy("source").agg(F.greatest(F.lit(0.0), F.first("goal") - F.sum(F.col("whole") * F.col("tokens"))).alias("need")), "need")
    lows = _thresholds(placed, need, cut)
    more = F.col("prio").isNotNull() & (F.log1p("prio") < F.col("lo"))
    copies = placed.join(lows, "source").withColumn("copies", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long"))
    copies = cut(copies.select("id", "source", "tokens", "rate", "copies"), "copies")
    used = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"), F.min("rate").alias("least_rate"), F.max("rate").alias("most_rate"))
    sizes = slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    all_used = copies.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] or 0
    report = wanted.join(sizes, "source", "left").join(own.select("source", F.col("own").cast("long").alias("own_tokens"), "longest"), "source", "left").join(used, "source", "left")
    report = report.na.fill(0, ["tokens", "documents", "own_tokens", "longest", "used_tokens", "most_copies"]).withColumns({
        "target_tokens": goal,
        "reachable": ~(F.col("max_repeats") * F.col("tokens") < goal),
        "attainable": ~(F.col("max_repeats") * F.col("own_tokens") < goal),
        "actual_share": F.col("used_tokens") / F.lit(float(max(1, all_used))),
    })
    mean = lambda w, c: (F.sum(w * F.col(c) * F.col("tokens")) / F.sum(w * F.col("tokens")))
    sampled = rated.join(copies.select("id", "source", "copies"), ["id", "source"])
    got = sampled.agg(*[f(c) for c in named for f in (lambda c: mean(F.col("flat"), c).alias(f"p_{c}"), lambda c: mean(F.col("copies"), c).alias(f"m_{c}"))]).first() if named else {}
    rows = [(c[2:], float(m), float(m + (got[f"p_{c}"] or 0.0)), float(m + (got[f"m_{c}"] or 0.0)), float(t)) for c, m, t in zip(named, means, mu)]
    balance = spark.createDataFrame(rows, "feature string, corpus_mean double, shares_only_mean double, mixture_mean double, tilt double")
    return Mixture(report, copies.where("copies > 0").withColumnRenamed("id", doc_id), balance)
