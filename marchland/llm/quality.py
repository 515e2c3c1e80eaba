"""Statistics of each text, and which texts are no natural prose but lists, tables or junk.

The statistics come from one scan of the whole text (``llm.text_scan``). Weak labels come from independent voters that abstain
where they know nothing: function words, repetition, damaged or symbolic characters, the layout of lines, the rhythm of
sentences; texts they don't agree on get no label. Gradient-boosted trees are trained on a bounded sample of labelled texts.
They don't see the voters' lists of words, only statistics of characters, lines, words and sentences that no language is
needed for, so they also judge texts the voters abstain on. One half of the hand-checked texts of ``quality_holdout``
calibrates the score to a probability; the other half is kept for reports.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from marchland.llm.quality_holdout import HOLDOUT
from marchland.llm.text_scan import ALL, FEATURES, scan
from marchland.session import spread

MAX_TRAIN_ROWS = 20_000
SCAN_CHARS = 1_000_000
#: Hand-checked texts that calibrate, and those that are kept for reports.
CALIBRATION, REPORT = HOLDOUT[::2], HOLDOUT[1::2]


def scan_column(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of a column of texts, NaN for null ones; as many texts at a time as have about SCAN_CHARS characters."""
    texts = column.to_pylist()
    there = [i for i, t in enumerate(texts) if t is not None]
    out = {c: np.full(len(texts), np.nan) for c in ("n_chars", *ALL)}
    at = 0
    while at < len(there):
        end, chars = at, 0
        while end < len(there) and (end == at or chars + len(texts[there[end]]) <= SCAN_CHARS):
            chars += len(texts[there[end]])
            end += 1
        for c, v in scan([texts[i] for i in there[at:end]]).items():
            out[c][there[at:end]] = v
        at = end
    return out


def _as_arrays(values: dict[str, np.ndarray]) -> list[pa.Array]:
    missing = np.isnan(values["n_chars"])
    chars = pa.array(np.where(missing, 0, values["n_chars"]).astype(np.int64), mask=missing)
    return [chars, *[pa.array(values[c], mask=missing) for c in ALL]]


_STATISTICS = [StructField("n_chars", LongType()), *[StructField(c, DoubleType()) for c in ALL]]


def text_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns, ``n_chars`` and ALL statistics of each row's text; a null text has nulls, an empty or blank one zeros.

    A word is a Han character or a run of other letters and digits. Shares are of characters for letter, digit, space, symbol, odd,
    separator (upper and vowel: of letters) and prose, which credits each function word with SPAN characters of its line; of
    lines that aren't blank for short_line, lines_ended, bullet, spaceless and distinct_line; of words for the others;
    repeated_share of the words' characters, those in runs of RUN words that occur three times or more.
    """
    slim = df.select(*keep, F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *_as_arrays(scan_column(b.columns[-1]))], [*b.schema.names[:-1], "n_chars", *ALL])

    return slim.mapInArrow(run, StructType([*slim.schema.fields[:-1], *_STATISTICS]))


def votes(s: pd.DataFrame) -> np.ndarray:
    """n × 5: 1 for junk, -1 for prose, 0 where a voter abstains."""
    words = np.where(s.prose_share > 0.6, -1, np.where(s.prose_share < 0.3, 1, 0))
    repeats = (s.repeated_share > 0.75) | ((s.top_word_share > 0.3) & (s.n_words > 20)) | ((s.n_words > 40) & (s.distinct_words < 9))
    damage = (s.odd_share > 0.12) | (s.broken_word_share > 0.24) | (s.separator_share > 0.1) | (s.digit_share > 0.3)
    items = (s.bullet_share > 0.6) | ((s.short_line_share > 0.8) & (s.lines_ended_share < 0.2) & (s.n_lines >= 4))
    layout = np.where(items, 1, np.where((s.lines_ended_share > 0.6) & (s.mean_line_length > 60), -1, 0))
    steady = (s.words_a_sentence >= 4) & (s.words_a_sentence <= 60) & (s.sentence_spread > 0.15) & (s.lines_ended_share > 0.5) & (s.repeated_short_share > 0.05)
    rhythm = np.where(steady, -1, np.where(s.words_a_sentence > 150, 1, 0))
    return np.stack([words, repeats.astype(int), damage.astype(int), layout, rhythm], axis=1)


def weak_labels(s: pd.DataFrame) -> np.ndarray:
    """1 for junk, 0 for prose, -1 for no label: the majority of votes, but repetition and damaged characters decide alone, and
    a text that shows some of them is never labelled prose."""
    v = votes(s)
    junk, prose = (v > 0).sum(axis=1), (v < 0).sum(axis=1)
    y = np.where(junk > prose, 1, np.where(prose > junk, 0, -1))
    y[(v[:, 1] > 0) | (s.odd_share > 0.12) | (s.broken_word_share > 0.24)] = 1
    some = (s.repeated_share > 0.5) | (s.odd_share > 0.06) | (s.broken_word_share > 0.12)
    y[(y == 0) & some] = -1
    y[(s.n_words + s.symbol_share) <= 0] = -1
    return y


@dataclass
class Boosted:
    """Gradient-boosted regression trees on the logistic loss, grown on histograms; scores are log odds."""

    edges: list[np.ndarray]
    trees: list[list[tuple[int, float, float]]]
    start: float
    depth: int
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 5) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
        model = cls(edges, [], float(np.log(p0 / (1 - p0))), depth)
        score = np.full(len(y), model.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), int)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (depth + 1) - 1)
            for level in range(depth + 1):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    at = np.flatnonzero(node == k)
                    if not len(at):
                        continue
                    g, h = grad[at].sum(), hess[at].sum()
                    value = rate * g / (h + 1)
                    best = (1e-6, -1, 0)
                    if level < depth and len(at) >= 2 * least:
                        for j in range(x.shape[1]):
                            b = binned[at, j]
                            size = len(edges[j]) + 1
                            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[at], hess[at], None))
                            gain = np.where((nl >= least) & (len(at) - nl >= least), gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), 0)
                            if len(gain) and gain.max() > best[0]:
                                best = (float(gain.max()), j, int(gain.argmax()))
                    if best[1] >= 0:
                        j, cut = best[1], best[2]
                        tree[k] = (j, float(edges[j][cut]), value)
                        node[at] = 2 * k + 1 + (binned[at, j] > cut)
                    else:
                        tree[k] = (-1, 0.0, value)
            model.trees.append(tree)
            score += model._one(tree, x)
        return model

    def _one(self, tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree))
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            inner = feature[node] >= 0
            at = np.flatnonzero(inner)
            node[at] = 2 * node[at] + 1 + (x[at, feature[node[at]]] > cut[node[at]])
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._one(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's sigmoid by Newton steps, with his smoothed targets."""
        m = self.margin(x)
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        w = np.array([1.0, 0.0])
        design = np.stack([m, np.ones(len(m))], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            h = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
            w = w + np.clip(np.linalg.solve(h, design.T @ (target - p)), -1, 1)
        self.slope, self.shift = (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def checked(texts: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of hand-checked texts."""
    values = scan([t for t, _ in texts])
    return np.stack([values[c] for c in FEATURES], axis=1), np.array([y for _, y in texts], float)


def train(df: DataFrame, key: str, text: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> Boosted:
    """Fits on about ``max_rows`` texts by hash of their key, those of them that the voters label, and calibrates on CALIBRATION.

    The hand-checked texts are never trained on.
    """
    there = df.where(F.col(text).isNotNull())
    n = there.count()
    hashed = F.xxhash64(F.lit(3), F.col(key).cast("string")).cast("double") / F.lit(2.0**64) + 0.5
    chosen = there.where(hashed < F.lit(1.1 * max_rows / max(1, n))).select(key, text)
    rows = text_statistics(spread(chosen), text, (key,)).orderBy(key).limit(2 * max_rows).toPandas()
    y = weak_labels(rows) if len(rows) else np.zeros(0, int)
    x, y = rows[list(FEATURES)].to_numpy(float)[y >= 0], y[y >= 0].astype(float)
    if not len(x):
        x, y = np.zeros((1, len(FEATURES))), np.array([0.0])
    model = Boosted.fit(x, y)
    model.calibrate(*checked(CALIBRATION))
    return model


def score_texts(df: DataFrame, key: str, text: str = "text", max_rows: int = MAX_TRAIN_ROWS, model: Boosted | None = None) -> DataFrame:
    """``key``, n_chars, ALL statistics, ``junk_probability`` and ``is_junk`` (at 0.5) of every row.

    Null, empty and blank texts have no probability and are no junk. Rows with a null or repeated key are scored each for
    itself; other columns are left out, so none can clash.
    """
    fitted = model or train(df, key, text, max_rows)
    slim = spread(df.select(key, text))
    at = FEATURES.index("n_words"), FEATURES.index("symbol_share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = scan_column(b.column(1))
            x = np.stack([values[c] for c in FEATURES], axis=1)
            filled = np.nan_to_num(x[:, at[0]]) + np.nan_to_num(x[:, at[1]]) > 0
            p = np.full(len(x), np.nan)
            if filled.any():
                p[filled] = fitted.probability(x[filled])
            yield pa.RecordBatch.from_arrays([b.column(0), *_as_arrays(values), pa.array(p, mask=~filled), pa.array(filled & (np.nan_to_num(p) >= 0.5))], [key, "n_chars", *ALL, "junk_probability", "is_junk"])

    return slim.mapInArrow(run, StructType([slim.schema.fields[0], *_STATISTICS, StructField("junk_probability", DoubleType())]).add("is_junk", "boolean"))
