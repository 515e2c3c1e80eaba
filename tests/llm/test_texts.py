"""Token ids, mixtures and text statistics."""


import os

import numpy as np
import pytest
import tiktoken


from pyspark.sql import functions as F

from marchland.llm import mixture, quality, tokens
from marchland.llm.quality_holdout import OTHER_LANGUAGES
from marchland.llm.text_scan import scan

TEXTS = [
    "Hello world, it's a test. It's 2024!",
    "",
    None,
    "   \n\n\t mixed   spaces \r\n end ",
    "如果邻居都在同一侧，这个点就应该算作边界。",
    "naïve café Straße ½ ² 🙂🙂 ​﻿ \x1c\x1d\x85\xa0",
    "<|endoftext|> is plain text",
    "a" * 5000 + " " + "xyz" * 3000 + "。" * 2000,
    "Hello world, it's a test. It's 2024!",
]


def reference():
    ranks = tokens.read_ranks(tokens.VOCABULARY)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return ranks, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("words", [3, 50_000])
def test_encode_equals_library(spark, words):
    _, enc = reference()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, words=words).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert all(enc.decode(got[i]) == (t or "") for i, t in enumerate(TEXTS))


def test_encode_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_transducer_is_minimal_and_exact(tmp_path):
    words = [w.encode() for w in ["tap", "taps", "top", "tops", "stop", "stops", "", "地", "地方"]]
    ids = [[i, i + 1] if i % 2 else [i] for i in range(len(words))]
    built = tokens.Transducer.build([w for w in words if w], [i for w, i in zip(words, ids) if w])
    built.save(str(tmp_path))
    held = tokens.Transducer.load(str(tmp_path))
    probe = [*words, b"ta", b"tapss", b"x", b"tap" * 40]
    at = held.numbers(probe)
    found = [held.ids[held.offsets[n] : held.offsets[n + 1]].tolist() if n >= 0 else None for n in at]
    assert found == [ids[i] if w else None for i, w in enumerate(words)] + [None] * 4
    # "tap" and "top" share the state after "p", and so its "s"
    assert len(built.final) < sum(len(w) for w in words)


def mixed(spark, rows, targets):
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long, text string")
    return mixture.mix(docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), "doc_id", "source", "tokens", "text")


def test_mixture_meets_shares(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3], int(rng.integers(5, 60)), f"text {i}") for i in range(1500)]
    rows += [(5000 + i, "a", 30, "same text") for i in range(50)] + [(9000, None, 40, "n"), (9001, "zzz", 10, "z"), (9002, "a", 0, ""), (9003, "a", None, None)]
    total = sum(r[2] or 0 for r in rows)
    got = mixed(spark, rows, [("a", 0.2, 1), ("b", 0.5, 4), ("c", 0.25, 3), ("none", 0.05, 9), (None, 0.1, 2), ("d", None, 1)])
    report = {r["source"]: r for r in got.report.collect()}
    for s in "abc":
        assert abs(report[s]["used_tokens"] - report[s]["target_share"] * total) <= 60 and report[s]["reachable"]
    assert not report["none"]["reachable"] and report["none"]["used_tokens"] == 0
    copies = got.copies.collect()
    assert all(0 < r["copies"] <= {"a": 1, "b": 4, "c": 3}[r["source"]] for r in copies)
    assert sum(r["copies"] for r in copies if r["doc_id"] >= 5000) <= 1


def test_mixture_unreachable_is_used_throughout(spark):
    got = mixed(spark, [(1, "a", 10, "x"), (2, "b", 90, "y")], [("a", 0.5, 3), ("b", 0.5, 1)])
    report = {r["source"]: (r["reachable"], r["used_tokens"]) for r in got.report.collect()}
    assert report["a"] == (False, 30) and report["b"][0]


def test_mixture_tilts_towards_what_shares_shift(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], int(rng.integers(20, 40)), f"t{i}", float(rng.random() < (0.8 if i % 2 else 0.3))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long, text string, f double")
    targets = spark.createDataFrame([("a", 0.8, 3), ("b", 0.2, 2)], "source string, target_share double, max_repeats int")
    got = mixture.mix(docs, targets, "doc_id", "source", "tokens", "text", {"f": F.col("f")})
    b = got.balance.first()
    assert abs(b["mixture_mean"] - b["corpus_mean"]) < 0.1 * abs(b["shares_only_mean"] - b["corpus_mean"]) and b["tilt"] > 0.1
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.001 for r in got.report.collect())
    rates = {(r["source"], round(r["rate"], 6)) for r in got.copies.collect()}
    assert len(rates) == 4


def test_mixture_empty(spark):
    assert mixed(spark, [], [("a", 1.0, 2)]).copies.count() == 0
    assert mixed(spark, [(1, "a", 5, "x")], []).report.count() == 0


def test_statistics_by_hand(spark):
    text = "The cat sat.\n- on 1 mat\n\n我们在家。"
    row = quality.text_statistics(spark.createDataFrame([(1, text), (2, None), (3, "  \n")], "doc_id long, text string"), "text", ("doc_id",)).orderBy("doc_id").collect()
    r = row[0]
    assert r["n_chars"] == len(text) and r["n_words"] == 10 and r["n_lines"] == 3
    assert r["letter_share"] == pytest.approx(18 / len(text)) and r["digit_share"] == pytest.approx(1 / len(text))
    assert r["lines_ended_share"] == pytest.approx(2 / 3) and r["bullet_share"] == pytest.approx(1 / 3)
    assert r["mean_word_length"] == pytest.approx(19 / 10) and r["common_word_share"] == pytest.approx(3 / 10)
    assert row[1]["n_words"] is None and row[2]["n_words"] == 0


DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the documents table")
def test_junk_is_told_from_prose(spark):
    """Trained on the documents and calibrated on one half of the hand-checked texts, the other half must come out right, and
    prose in languages that no list of words here knows."""
    model = quality.train(spark.read.parquet(DOCUMENTS), "doc_id")
    x, y = quality.checked(quality.REPORT)
    assert ((model.probability(x) >= 0.5) == (y > 0)).mean() >= 0.88
    x, _ = quality.checked([(t, 0) for t in OTHER_LANGUAGES])
    assert (model.probability(x) < 0.5).mean() >= 0.8
    blank = quality.score_texts(spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string"), "doc_id", model=model).collect()
    assert [r["is_junk"] for r in blank] == [False] * 3 and all(r["junk_probability"] is None for r in blank)


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "The house of the man was old. " * 20_000), (2, "x" * 300_000), (3, "\n" * 100_000)], "doc_id long, text string")
    stats = quality.text_statistics(df, "text", ("doc_id",)).orderBy("doc_id").collect()
    assert stats[0]["repeated_share"] > 0.9 and stats[1]["n_words"] == 1 and stats[2]["n_lines"] == 0


def test_scan_does_not_depend_on_neighbours():
    texts = ["One line. And two!", "", "  ", "- a\n- b\r\n(3) c", "不知道。是的，我们走了。", "x" * 2000, "\u2028 (", "tail"]
    whole = scan(texts)
    for i, t in enumerate(texts):
        alone = scan([t])
        assert all(np.isclose(whole[c][i], alone[c][0]) for c in alone), (i, [c for c in alone if not np.isclose(whole[c][i], alone[c][0])])
    assert whole["bullet_share"][3] == 1 and whole["n_words"][4] == 9 and whole["words_a_sentence"][0] == 2


def test_too_few_texts_to_train_on(spark):
    df = spark.createDataFrame([(1, "We have not seen the book that he was reading.")], "doc_id long, text string")
    assert quality.score_texts(df, "doc_id").count() == 1
    assert quality.score_texts(df.limit(0), "doc_id").count() == 0


def test_repeated_phrases_without_sentence_ends_are_junk(spark):
    phrase = "the old harbour was not open because of seven heavy storms and rain"
    tail = "It was late when they came back. Nobody had seen the light in their house. They were tired. We went on."
    texts = [(1, "\n".join([phrase] * 20)), (2, ", ".join([phrase] * 20)), (3, f"{phrase} " * 20 + tail), (4, tail)]
    got = quality.text_statistics(spark.createDataFrame(texts, "doc_id long, text string"), "text", ("doc_id",)).orderBy("doc_id").toPandas()
    assert quality.weak_labels(got).tolist() == [1, 1, 1, 0]
    assert got.repeated_share[0] == 1.0 and 0.85 < got.repeated_share[2] < 1.0 and got.repeated_share[3] == 0.0
