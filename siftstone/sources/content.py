"""Reading file contents: digests of whole files, and comparison byte by byte."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import constants as K
from siftstone.functions.blake3 import CHUNK, Hasher, merge
from siftstone.sources.scratch import cut

ALGORITHMS = {"sha256": hashlib.sha256, "blake3": Hasher}
#: Digests that are trees: a file of more than ``RANGE`` bytes (a power of two of chunks) is read
#: in ranges, by as many tasks; ``FAN`` values, a power of two, are merged at once.
TREES = {"blake3"}
RANGE = 1 << 26
FAN = 1 << 10
CHANGED = "the file changed while it was read"


def hash_file(path: str, algorithm: str = "sha256") -> str:
    h = ALGORITHMS[algorithm]()
    with open(path, "rb", buffering=0) as f:
        while block := f.read(K.READ_BUFFER):
            h.update(block)
    return h.hexdigest()


def range_value(path: str, start: int, length: int, size: int) -> str:
    """The subtree's value of a file's bytes from ``start``, as hexadecimal digits; the file has to have its size still."""
    h = Hasher(start // CHUNK)
    with open(path, "rb", buffering=0) as f:
        f.seek(start)
        left = length
        while left and (block := f.read(min(left, K.READ_BUFFER))):
            h.update(block)
            left -= len(block)
        if left or os.fstat(f.fileno()).st_size != size:
            raise OSError(CHANGED)
    return h.value().hex()


def _hashes(algorithm: str, span: int, done: Accumulator | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, whole = [], 0
            for path, size, part, parts in zip(pdf["path"], pdf["size"], pdf["part"], pdf["parts"], strict=True):
                try:
                    value = hash_file(path, algorithm) if parts == 1 else range_value(path, part * span, min(span, size - part * span), size)
                    rows.append((path, part, parts, value, None, False))
                except OSError as e:
                    rows.append((path, part, parts, None, str(e.strerror or e), isinstance(e, PermissionError)))
                whole += part == 0
            if done is not None:
                done.add(whole)
            yield pd.DataFrame(rows, columns=["path", "part", "parts", "value", "message", "denied"])

    return run


def _merged(values: pd.Series, root: pd.Series) -> pd.Series:
    """Neighbouring values as one; one that is missing makes the whole missing, and one alone waits."""

    def one(held: list[str], top: bool) -> str | None:
        if any(v is None for v in held):
            return None
        return held[0] if len(held) == 1 else merge([bytes.fromhex(v) for v in held], top).hex()

    return pd.Series([one(list(v), bool(r)) for v, r in zip(values, root, strict=True)], dtype=object)


def _joined(ranges: DataFrame) -> DataFrame:
    """The digests of files that were read in ranges: values are merged ``FAN`` at a time, a level of
    the tree in each round, so no task holds more of a file than that."""
    up = F.pandas_udf(_merged, "string")
    while True:
        wide = ranges.agg(F.max("parts")).first()[0]
        if wide is None or wide == 1:
            return ranges.select("path", "value", "message", "denied")
        held = F.array_sort(F.collect_list(F.struct("part", "value")))
        group = ranges.groupBy("path", "parts", F.floor(F.col("part") / FAN).cast("long").alias("next"))
        rows = group.agg(held.alias("held"), F.min("message").alias("message"), F.max("denied").alias("denied"))
        value = up(F.transform("held", lambda x: x["value"]), F.col("parts") <= FAN)
        rows = rows.select("path", F.col("next").alias("part"), F.ceil(F.col("parts") / FAN).cast("long").alias("parts"), value.alias("value"), "message", "denied")
        ranges = cut(rows, "hash-levels")


def hash_files(files: DataFrame, algorithm: str = "sha256", bytes_per_task: int = 1 << 30, done: Accumulator | None = None, span: int = RANGE) -> DataFrame:
    """(path, hash, message, denied) of distinct paths, read in a stream of bounded buffers.

    ``files`` has (path, size); of one path's sizes the largest counts.  Files are dealt evenly
    over tasks first: a walk's partitions may be as uneven as its folders.  Of a digest that is a tree a
    file's ranges are dealt like files, so one huge file is read by many tasks.  ``done`` counts files as tasks end.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown digest {algorithm}")
    paths = files.groupBy("path").agg(F.max("size").alias("size"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / span)).cast("long") if algorithm in TREES else F.lit(1).cast("long")
    units = paths.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    own = F.when(F.col("parts") == 1, F.coalesce("size", F.lit(0))).otherwise(span)
    total, n = units.agg(F.coalesce(F.sum(own), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, min(100_000, total // bytes_per_task + 1, n or 1), paths.sparkSession.sparkContext.defaultParallelism)
    read = units.select("path", "size", "part", "parts").repartition(int(tasks))
    values = read.mapInPandas(_hashes(algorithm, span, done), "path string, part long, parts long, value string, message string, denied boolean")
    if algorithm not in TREES:
        return values.select("path", F.col("value").alias("hash"), "message", "denied")
    values = cut(values, "hash-values")
    whole = values.where("parts = 1").select("path", "value", "message", "denied")
    return whole.unionByName(_joined(values.where("parts > 1"))).withColumnRenamed("value", "hash")


def files_equal(a: str, b: str) -> bool:
    """Lengths first, then blocks of both."""
    if os.path.getsize(a) != os.path.getsize(b):
        return False
    with open(a, "rb") as x, open(b, "rb") as y:
        while True:
            p, q = x.read(K.COMPARE_BLOCK), y.read(K.COMPARE_BLOCK)
            if p != q:
                return False
            if not p:
                return True
