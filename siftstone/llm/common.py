"""Helpers shared by the operators: table access, hash folds, labelled samples."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from siftstone.sources.scratch import cut

#: Rows and bytes in one Arrow batch of whole documents.
ARROW_ROWS = 1024
ARROW_BYTES = 16 << 20
#: Bytes of labelled texts that a model is fitted to, at most.
SAMPLE_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, read by Spark from wherever ``sf_dir`` is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with a number behind it if ``df`` has such a column."""
    held, k, got = {c.lower() for c in df.columns}, 0, name
    while got.lower() in held:
        k += 1
        got = f"{name}_{k}"
    return got


def has_map(kind: DataType) -> bool:
    """Whether a type holds a map, which has no order, at any depth."""
    if isinstance(kind, StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType | VariantType) or (isinstance(kind, ArrayType) and has_map(kind.elementType))


def _bounds(rows: int) -> dict[str, str]:
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """The same bound for a frame that is returned before it is planned: it stays in the session."""
    for k, v in _bounds(rows).items():
        spark.conf.set(k, v)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS):
    """Bounds the Arrow batches of whole texts for the plans made and run inside; the
    session has its own settings again afterwards."""
    ours = _bounds(rows)
    before = {k: spark.conf.get(k, None) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id falls in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)) % F.lit(n)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, y) of labelled documents, at most ``rows``, and of them as many as have
    ``size`` bytes together: those whose ids hash lowest, the same ones at every run.  A text
    that no longer fits is left out whole.  Null texts are empty."""
    chosen = (
        labels.where(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = cut(found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("y").alias("y")), "labelled")
    ids, left, n = [], size, 0
    for r in got.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        n += 1
        if r["n"] <= left:
            ids.append(r["doc_id"])
            left -= r["n"]
    return got if len(ids) == n else got.where(F.col("doc_id").isin(ids))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, size: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """The (text, y) pairs of :func:`labelled_rows`, sorted; both bounds make the collect safe."""
    return sorted((r["text"], int(r["y"])) for r in labelled_rows(docs, labels, label, keep, rows, size).collect())


def fit_logistic(x, y, l2: float = 1e-3, steps: int = 50):
    """Newton's method for a logistic model on few columns; returns (weights, bias)."""
    import numpy as np

    x = np.asarray(x, dtype=float)
    x = x.reshape(len(x), -1)
    y = np.asarray(y, dtype=float)
    mean, std = (x.mean(0), x.std(0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    std = np.where(std > 1e-12, std, 1.0)
    z = np.c_[(x - mean) / std, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag([l2] * (z.shape[1] - 1) + [1e-6]) * max(1, len(x))
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge @ w
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(z.shape[1])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    coef = w[:-1] / std
    return coef, float(w[-1] - (coef * mean).sum())


def sigmoid(v: float) -> float:
    v = max(-30.0, min(30.0, v))
    return 1 / (1 + math.exp(-v))
