"""Toxicity and quality: restoration, held-out accuracy, odd rows."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import quality_zstd, toxicity
from siftstone.llm.common import fold, labelled_sample
from tests.conftest import SF

BIG = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


def held_out(spark, out, column):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", F.col(column).alias("y"))
    rows = out.where("held_out").join(labels, "doc_id").select("score", "predicted", "y").toPandas()
    return rows["score"].to_numpy(), rows["predicted"].to_numpy(), rows["y"].to_numpy()


def test_toxicity_on_held_out_labels(spark):
    score, predicted, y = held_out(spark, toxicity.op3_toxicity(spark, BIG), "toxic")
    assert (predicted == y).mean() > 0.96 and predicted[y == 1].mean() > 0.85 and predicted[y == 0].mean() < 0.02
    assert ((score >= 0.5) == predicted).all()


def test_quality_on_held_out_labels(spark):
    score, predicted, y = held_out(spark, quality_zstd.op4_quality(spark, BIG), "quality")
    assert (predicted == y).mean() > 0.96 and predicted[y == 1].mean() > 0.97 and auc(score, y) > 0.95


@pytest.fixture(scope="module")
def decoder():
    texts = ["the idiot and the moron said that the clown is a loser and worthless trash", "stupid people do this to other people in the street"] * 50
    import pandas as pd

    g = next(toxicity._trigrams(iter([pd.DataFrame({"text": texts})])))
    n = np.zeros(toxicity.SYMBOLS**3)
    n[g["gram"]] = g["n"]
    three = n.reshape([toxicity.SYMBOLS] * 3)
    lm = np.log((three + 0.01) / (three.sum(2, keepdims=True) + 0.01 * toxicity.SYMBOLS))
    return toxicity.Decoder(lm, frozenset(["idiot", "moron", "clown", "loser", "stupid", "trash"]))


@pytest.mark.parametrize(
    "disguised,plain",
    [
        ("1d10t", "idiot"), ("m0r0n", "moron"), ("c l o w n", "clown"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("$tup1d", "stupid"), ("tr@sh", "trash"),
        ("ID10T", "idiot"), ("ordinary words stay", "ordinary words stay"), ("in 2024 there were 100", "in 2024 there were 100"),
    ],
)
def test_restoration(decoder, disguised, plain):
    assert toxicity.restore(disguised, decoder) == plain


@pytest.mark.parametrize(
    "disguised,plain",
    [
        ("the clown is a l o s e r", "the clown is a loser"), ("a c l o w n", "a clown"), ("the i d i o t.", "the idiot."), ("(i d i o t)", "idiot"), ("t r a s h!", "trash!"),
        ("i  d  i  o  t", "idiot"), ("stuupid", "stupid"), ("idio7$$$", "idiot"),
    ],
)
def test_restoration_within_text(decoder, disguised, plain):
    assert toxicity.restore(disguised, decoder) == plain


@pytest.mark.parametrize("disguised,plain", [("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("tr@sh", "trash"), ("cl0wn$$$", "clown"), ("good moon", "good moon")])
def test_restoration_by_the_language_model_alone(decoder, disguised, plain):
    assert toxicity.restore(disguised, toxicity.Decoder(-np.array(decoder.costs).reshape([toxicity.SYMBOLS] * 3))) == plain


@pytest.mark.parametrize("text", ["1d10t", "a$$", "0", "st00p!d", "x1!|", "\x1f".join("ad1d"), "uu1!!l", "@@b", "(c0w", "3"])
def test_viterbi_against_all_paths(decoder, text):
    """The decoded spelling costs as little as any path through the lattice."""
    plain = toxicity.Decoder(-np.array(decoder.costs).reshape([toxicity.SYMBOLS] * 3))

    def cost(path):
        said, total = "".join(p for p, _ in path), sum(c + (plain.GAP if p == "" else 0) for p, c in path)
        s = [toxicity._BETWEEN] * 2 + [int(toxicity._codes()[ord(c)]) for c in said] + [toxicity._BETWEEN]
        return total + sum(plain.costs[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] for a, b, c in zip(s, s[1:], s[2:])), said

    paths = [cost(p) for p in itertools.product(*plain._lattice(text))]
    least = min(paths)[0]
    assert plain.decode(text) in {said for c, said in paths if c < least + 1e-6}


@pytest.mark.parametrize("unit", ["$", "$!", "a.", "a_.", "1a ", "ab1$", "a.....", "é1", "lll$ "])
def test_time_grows_with_the_length(decoder, unit):
    text = unit * (1_000_000 // len(unit)) + "ax"
    began = time.process_time()
    assert toxicity.restore(text, decoder)
    assert time.process_time() - began < 15


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i), "en", "s", 1) for i in range(40)] + [(50, "y" * 5000, "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    every = labelled_sample(docs, labels, "toxic", F.lit(True), 100, 1 << 20)
    assert len(every) == 41
    some = labelled_sample(docs, labels, "toxic", F.lit(True), 100, 400)
    assert 0 < len(some) < 41 and sum(len(t) for t, _ in some) <= 400 and set(some) <= set(every)
    assert len(labelled_sample(docs, labels, "toxic", F.lit(True), 7, 1 << 20)) <= 7


def test_language_model_counts_every_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lm = toxicity.language_model(docs)
    assert np.allclose(np.exp(lm).sum(2), 1, atol=1e-3)
    once = docs.select("text").mapInPandas(toxicity._trigrams, "gram long, n long").agg(F.sum("n")).first()[0]
    assert once == sum(len((r["text"] or "").lower()) + 1 for r in docs.collect())


@pytest.mark.parametrize("score,label", [(toxicity.toxicity, "toxic"), (quality_zstd.quality, "quality")])
def test_odd_rows(spark, score, label):
    rows = [(1, "fine words here", "en", "s", 1), (1, "fine words here", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "x" * 300000, "en", "s", 1), (4, "😀 1d10t 漢字", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("y", F.lit(0))
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = score(df, labels, ~(fold("doc_id", 5) == 0)).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    assert score(df.limit(0), labels.limit(0), F.lit(True)).count() == 0


def test_dictionaries_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(quality_zstd, "DICTIONARY", 100)
    texts = [f"text number {k} " * 2 for k in range(20)] + ["x" * 500, None, ""]
    built = quality_zstd.build_dictionary(texts)
    held = built.decode().split("\n")
    assert len(built) <= 100 and len(held) >= 2 and set(held) <= set(texts) and built == quality_zstd.build_dictionary(texts[::-1])
    assert quality_zstd.build_dictionary([None, ""]).strip() == b""


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = ~(fold("doc_id", 4) == 2)
    turned = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    a = sorted(map(tuple, quality_zstd.quality(docs, labels, learn).collect()))
    assert a == sorted(map(tuple, quality_zstd.quality(docs, turned, learn).collect()))
