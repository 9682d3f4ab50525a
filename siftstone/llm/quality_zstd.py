"""Quality scores by compression.

Two zstandard dictionaries are built from good and from bad labelled texts.  A text is
compressed once with each; the difference of the two sizes, normalised by their sum, says
which dictionary knows the text better.  A logistic curve over the difference and over how
far the text can be compressed at all (text that repeats itself needs no dictionary),
fitted on labelled texts that no dictionary was built from, gives a calibrated
probability.  Long texts are compressed in pieces of bounded size, and their sizes added,
so that no piece learns from far-away text in place of the dictionary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import arrow_batches, fit_logistic, fold, labelled_sample, sigmoid, table
from siftstone.sources.scratch import cut

#: Labelled texts learned from, at most, and their bytes; those whose ids hash lowest.
TRAIN_ROWS = 8192
TRAIN_BYTES = 64 << 20
#: Bytes of a dictionary, a part of the bounded sample; of a piece that is compressed at once.
DICTIONARY = 1 << 19
PIECE = 2048
LEVEL = 9
#: Compressed bytes added to the sum, so that a few words decide little.
PRIOR = 64


def build_dictionary(texts: list[str]) -> bytes:
    """Content of a dictionary: whole distinct texts, in the order of their digests, as many
    as fit; a text that no longer fits is left out whole.  Raw content needs no minimum of
    samples, unlike a trained one."""
    data = sorted({t.encode("utf-8", "surrogatepass") for t in texts if t}, key=lambda d: hashlib.sha256(d).digest())
    parts, left = [], DICTIONARY
    for d in data:
        if len(d) < left:
            parts.append(d)
            left -= len(d) + 1
    return b"\n".join(parts) if parts else b" " * 8


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (good, bad)]
        for d in made:
            d.precompute_compress(level=LEVEL)
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=d, **options) for d in made)

    def sizes(self, text: str | None) -> tuple[float, float]:
        """((bad - good) / (bad + good + prior), log of the mean ratio); zeros for an empty text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        good = bad = 0
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
        return (bad - good) / (bad + good + PRIOR), float(np.log((good + bad + 16) / (2 * len(data) + 16)))


def fit(sample: list[tuple[str, int]]) -> dict:
    """Dictionaries from half of the sample of each label, calibration on the other half."""
    by = {v: [t for t, y in sample if y == v] for v in (0, 1)}
    first = {v: build_dictionary(t[::2]) for v, t in by.items()}
    rest = [(t, v) for v, ts in by.items() for t in ts[1::2]]
    model = {"good": first[1], "bad": first[0], "w": (0.0, 0.0), "b": 0.0}
    if min(len(by[0]), len(by[1])) < 2:
        n1, n0 = len(by[1]), len(by[0])
        return model | {"b": float(np.log((n1 + 0.5) / (n0 + 0.5)))}
    c = Compressors(first[1], first[0])
    w, b = fit_logistic([c.sizes(t) for t, _ in rest], [v for _, v in rest], l2=1e-4)
    return model | {"w": (float(w[0]), float(w[1])), "b": b}


_held: dict[int, Compressors] = {}


def _scorer(broadcast, name: int):
    def run(text: pd.Series) -> pd.Series:
        model = broadcast.value
        if name not in _held:
            _held.clear()
            _held[name] = Compressors(model["good"], model["bad"])
        c = _held[name]
        (v, w), b = model["w"], model["b"]
        return pd.Series([sigmoid(v * d + w * r + b) for d, r in map(c.sizes, text)], dtype=float)

    return run


def quality(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; ``learn`` says of which ids labels may be
    learned.

    Only texts are inputs of a score.  Null and empty texts score as neither alike nor
    compressible; texts of any length are compressed whole, piece by piece.  Equal texts have
    equal scores: repeated rows are scored each, and a null doc_id is kept.  Of labels that
    repeat an id the larger counts, of texts that do the smallest.  Without labels of both
    kinds every text gets the base rate.  An empty table gives no rows.  Other columns of
    ``docs``, whatever their names, are not read.
    """
    spark = docs.sparkSession
    model = fit(labelled_sample(docs, labels, "quality", learn, TRAIN_ROWS, TRAIN_BYTES))
    shared = spark.sparkContext.broadcast(model)
    run = _scorer(shared, shared._jbroadcast.id())
    with arrow_batches(spark):
        return cut(docs.select("doc_id", F.pandas_udf(run, "double")("text").alias("score")), "quality-scores")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 4) == 2
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
