"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each vector is rotated into ``bits`` dimensions by a seeded random rotation and kept as the
sign bits, packed into words, with two correction scalars: its norm, and the cosine between
the rotated unit vector and its code.  A rotated query is cut into a few bit planes, so that
ANDs and bit counts over the packed words give its inner product with a code; the scalars
turn that into an unbiased estimate of the vectors' inner product and a bound on its error (RaBitQ).  The bound decides
which vectors are reranked by the exact
inner product in double precision: all whose estimate plus bound reaches the twentieth
best exact score so far.  Queries and candidates meet in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import table
from siftstone.sources.scratch import cut

BITS = 256
#: Bit planes of a rotated query.
PLANES = 4
#: Standard errors in a bound: an estimate misses by more in under two of 1,000 cases.
EPSILON = 3.2
BLOCK = 16384


def rotation(dim: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """``bits`` x ``dim`` matrix with orthonormal columns, the same at every run; a whole
    number of words, at least as many bits as dimensions."""
    bits = -(-max(bits, dim) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms, and cosines between unit vectors and their codes."""
    norm = np.linalg.norm(x, axis=1)
    z = (x / norm[:, None]) @ turn.T
    code = np.packbits(z > 0, axis=1)
    return code, norm, np.abs(z).sum(1) / np.sqrt(turn.shape[0])


def usable(v: str | Column) -> Column:
    """True for a vector that is not null, empty, zero, or with a null or non-finite part."""
    c = F.col(v) if isinstance(v, str) else v
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda e: e != 0), F.lit(False))


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for dim, part in pdf.groupby(pdf["embedding"].map(len)):
            x = np.stack(part["embedding"].to_numpy()).astype(float)
            code, norm, cos = encode(x, rotation(int(dim)))
            yield pd.DataFrame(
                {"vec_id": part["vec_id"], "dim": int(dim), "code": [c.tobytes() for c in code], "norm": norm, "cos": cos, "embedding": part["embedding"]}
            )


def planes(z: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A rotated query as ``PLANES`` packed bit planes, with the least value and the step of its levels."""
    low, top = float(z.min()), float(z.max())
    step = (top - low) / ((1 << PLANES) - 1) or 1.0
    level = np.rint((z - low) / step).astype(np.uint8)
    bits = np.stack([np.packbits(level >> b & 1) for b in range(PLANES)])
    return bits.view(np.uint64), low, step


def estimates(z: np.ndarray, words: list[np.ndarray], ones: np.ndarray) -> tuple[np.ndarray, float]:
    """Inner products of a rotated query with codes of signs, from the packed words, and the
    step of the query's levels.  ``ones`` has the number of set bits of each code."""
    bits, low, step = planes(z)
    total = np.zeros(len(ones), dtype=np.int32)
    for b, plane in enumerate(bits):
        for w, q in zip(words, plane):
            if q:
                total += np.bitwise_count(w & q).astype(np.int32) << b
    return 2 * (low * ones + step * total) - z.sum(), step


def search_block(q_ids, q, ids, x, code, norm, cos, k: int):
    """Top ``k`` of a block for each query: (query index, id, score) lists."""
    dim = x.shape[1]
    turn = rotation(dim)
    bits = turn.shape[0]
    packed = np.ascontiguousarray(code).view(np.uint64)
    words, ones = [np.ascontiguousarray(packed[:, w]) for w in range(packed.shape[1])], np.bitwise_count(packed).sum(1, dtype=np.int32)
    scale = norm / (cos * np.sqrt(bits))
    # By how much an estimate may miss, for a query of length one: what a code loses, and what
    # a query's levels do.
    slack = norm * np.sqrt(np.maximum(0, 1 - cos**2)) / cos * (EPSILON / np.sqrt(bits - 1)) + 1e-5 * norm
    first = 2 * k + 24
    for i, (v, z, length) in enumerate(zip(q, q @ turn.T, np.linalg.norm(q, axis=1))):
        own = ids == q_ids[i]
        if len(ids) > first:
            e, step = estimates(z, words, ones)
            e *= scale
            e[own] = -np.inf
            lead = np.argpartition(-e, first)[:first]
            lead = lead[~own[lead]]
            best = (x[lead] * v).sum(1)
            least = np.partition(best, -k)[-k] if len(best) >= k else -np.inf
            levels = EPSILON * step * np.sqrt(bits / 12)
            # What was scored stays, whatever its own bound says.
            chosen = np.union1d(lead, np.flatnonzero((e + slack * length + levels * scale >= least) & ~own))
        else:
            chosen = np.flatnonzero(~own)
        score = (x[chosen] * v).sum(1)
        order = np.lexsort((ids[chosen], -score))[:k]
        yield i, ids[chosen[order]], score[order]


def _cell(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            x = np.stack(rows["embedding"].to_numpy()).astype(float)
            q = np.stack(queries["embedding"].to_numpy()).astype(float)
            code = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
            q_ids, ids = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
            for i, got, score in search_block(q_ids, q, ids, x, code, rows["norm"].to_numpy(), rows["cos"].to_numpy(), k):
                out["query_id"] += [q_ids[i]] * len(got)
                out["vec_id"] += got.tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product.

    Both inputs have (vec_id, embedding).  A query's own row (same vec_id) is no candidate.
    Ties go to the smaller vec_id.  Vectors that are null, empty, zero or with null or
    non-finite parts take no part, nor do rows without an id, nor pairs of different
    length.  Of queries that repeat an id one is searched; repeated candidate rows all
    count.  Fewer candidates than ``k``: all are returned; empty tables: no rows.
    """
    rows = rows.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", "embedding")
    queries = queries.where(F.col("vec_id").isNotNull() & usable("embedding"))
    queries = queries.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    of = rows.schema["embedding"].dataType.elementType.simpleString()  # as they are: a double isn't cut to a float
    kind = f"vec_id long, dim int, code binary, norm double, cos double, embedding array<{of}>"
    n, m = rows.count(), queries.count()
    n_rows, n_queries = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    spread = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    coded = cut(rows.select("vec_id", "embedding").mapInPandas(_encoded, kind), "ann-codes")
    # By where rows lie: of many rows with one id each goes to a block of its own.
    lies = F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(n_rows)).cast("int")
    right = coded.select("*", lies.alias("rb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    left = (
        queries.select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dim"))
        .withColumn("qb", spread("query_id", n_queries))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    )
    cell = ["dim", "qb", "rb"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_cell(k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 20 = 0"), rows)
